"""Corpus profile: distributions, outliers, n-grams, vocabulary, terms, topics, time.

Values are left unrounded; reports round on the driver with Python's round().
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import constants as K
from textloom.functions.text import SPACE, ngrams, once, strip, tokens, word_count


def _nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def distribution(df: DataFrame, value: str, by: list[str] | tuple = ()) -> DataFrame:
    """count, mean, median, std, skew, kurt, cv_pct, min, max, p5, p25, p75, p95, sum of a column, nulls left out.

    Population standard deviation, interpolated quantiles, bias-corrected skewness
    and excess kurtosis (0 where undefined); cv_pct is null for mean 0; without
    values all is 0. One aggregation with partial sums.
    """
    x = F.col(value).cast("double")
    n, g1, g2 = F.count(x), F.skewness(x), F.kurtosis(x)
    skew = F.when(n >= 3, g1 * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0)))
    kurt = F.when(n >= 4, (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)) * ((n + 1.0) * g2 + 6.0))
    q = F.percentile(x, F.array(F.lit(0.05), F.lit(0.25), F.lit(0.5), F.lit(0.75), F.lit(0.95)))
    out = df.groupBy(*by).agg(
        n.alias("count"), _nz(F.avg(x)).alias("mean"), q.alias("q"), _nz(F.stddev_pop(x)).alias("std"), _nz(skew).alias("skew"), _nz(kurt).alias("kurt"),
        _nz(F.min(x)).alias("min"), _nz(F.max(x)).alias("max"), _nz(F.sum(x)).alias("sum"),
    )
    cv = F.when(F.col("count") == 0, 0.0).when(F.col("mean") != 0, F.col("std") / F.nullif(F.col("mean"), F.lit(0.0)) * 100.0)
    names = ("p5", "p25", "median", "p75", "p95")
    return out.select(
        *by, "count", "mean", "std", "skew", "kurt", cv.alias("cv_pct"), "min", "max",
        *(_nz(F.col("q")[k]).alias(name) for k, name in enumerate(names)), "sum",
    )


def iqr_outliers(df: DataFrame, value: str, by: list[str] | tuple = ()) -> DataFrame:
    """q1, q3, iqr, the upper fences at 1.5 and 3 iqr, and how many values lie strictly above each; zeros without values.

    The quartiles (one row for each group) are joined back; with few groups that
    side is small, and the planner may broadcast it.
    """
    x = F.col(value).cast("double")
    q = df.groupBy(*by).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")).withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumns({"mild_fence": F.col("q3") + 1.5 * F.col("iqr"), "extreme_fence": F.col("q3") + 3.0 * F.col("iqr")})
    keys = ["q1", "q3", "iqr", "mild_fence", "extreme_fence"]
    if not by:  # the quartiles are one row
        one = q.first()
        return df.agg(
            *(F.lit(one[c] if one[c] is not None else 0.0).alias(c) for c in keys),
            *(F.count_if(x > F.lit(one[f"{c}_fence"])).alias(c) for c in ("mild", "extreme")),
        )
    joined = df.select(*by, x.alias("x")).join(q, list(by))
    return joined.groupBy(*by, *keys).agg(
        F.count_if(F.col("x") > F.col("mild_fence")).alias("mild"), F.count_if(F.col("x") > F.col("extreme_fence")).alias("extreme")
    ).select(*by, *(_nz(F.col(c)).alias(c) for c in keys), "mild", "extreme")


def histogram(df: DataFrame, value: str, width: int, bins: int = 15) -> DataFrame:
    """(bin, label, n): values in [k w, (k+1) w), the first ``bins`` bins by position, empty ones left out."""
    k = F.floor(F.col(value) / width).cast("long")
    # the bins are filtered by an aggregate: a filter on the key would go below and work ``value`` out again
    counts = df.groupBy(k.alias("tmp_bin")).agg(F.count(F.lit(1)).alias("n"), F.max(k).alias("bin")).filter((F.col("bin") >= 0) & (F.col("bin") < bins))
    return counts.select("bin", F.concat_ws("-", (F.col("bin") * width).cast("string"), ((F.col("bin") + 1) * width).cast("string")).alias("label"), "n")


def with_ratio(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``pairs`` with n_source, n_target (words) and ratio (null where the target has none)."""
    df = pairs.withColumns({"n_source": word_count(source), "n_target": word_count(target)})
    return df.withColumn("ratio", F.when(F.col("n_target") > 0, F.try_divide(F.col("n_source").cast("double"), F.col("n_target"))))


def ratio_stats(df: DataFrame, ratio: str = "ratio", by: list[str] | tuple = ()) -> DataFrame:
    """mean, median, population std, min and max of the ratios there are; zeros if none."""
    x = F.col(ratio)
    return df.groupBy(*by).agg(
        F.count(x).alias("n"), _nz(F.avg(x)).alias("mean"), _nz(F.median(x)).alias("median"), _nz(F.stddev_pop(x)).alias("std"),
        _nz(F.min(x)).alias("min"), _nz(F.max(x)).alias("max"),
    )


def novel_ngram_rates(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """``pairs`` with novel_1, novel_2, novel_3: percent of the target's distinct n-grams that the source lacks.

    Null where a target has fewer than max(2, n) words. Row-local, no shuffle.
    """
    df = pairs.withColumns({"tmp_s": F.coalesce(tokens(F.lower(source)), F.array().cast("array<string>")), "tmp_t": F.coalesce(tokens(F.lower(target)), F.array().cast("array<string>"))})
    for n in (1, 2, 3):
        s, t = ngrams(F.col("tmp_s"), n), ngrams(F.col("tmp_t"), n)
        rate = F.size(F.array_except(t, s)) * 100.0 / F.nullif(F.size(t), F.lit(0))
        df = df.withColumn(f"novel_{n}", F.when(F.size("tmp_t") >= max(2, n), rate))
    return df.drop("tmp_s", "tmp_t")


def novel_ngrams(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(n, pairs, mean, median, std): novelty for each n that has rows."""
    rates = novel_ngram_rates(pairs, source, target).select("novel_1", "novel_2", "novel_3").unpivot([], ["novel_1", "novel_2", "novel_3"], "n", "rate")
    return (
        rates.filter("rate is not null").groupBy(F.substr("n", F.lit(7)).cast("int").alias("n"))
        .agg(F.count(F.lit(1)).alias("pairs"), F.avg("rate").alias("mean"), F.median("rate").alias("median"), F.stddev_pop("rate").alias("std"))
    )


def vocabulary(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """One row: distinct lower-cased tokens of the sources, the targets, either, both, and percentages of either.

    A text without tokens adds one null element to its side. Sides are reduced by
    token before they meet, in one aggregation instead of a join.
    """
    none = F.array(F.lit(None).cast("string"))

    def side(column: str, name: str) -> DataFrame:
        words = tokens(F.lower(column))
        return pairs.select(F.explode(F.when(F.size(words) > 0, words).otherwise(none)).alias("token"), F.lit(name == "s").alias("s"), F.lit(name == "t").alias("t"))

    by_token = side(source, "s").unionByName(side(target, "t")).groupBy("token").agg(F.bool_or("s").alias("s"), F.bool_or("t").alias("t"))
    both, only_s, only_t = F.count_if(F.col("s") & F.col("t")), F.count_if(F.col("s") & ~F.col("t")), F.count_if(~F.col("s") & F.col("t"))
    total = F.count(F.lit(1))

    def pct(c: Column) -> Column:
        return _nz(F.try_divide(c * 100.0, total))

    return by_token.agg(
        F.count_if("s").alias("source_size"), F.count_if("t").alias("target_size"), total.alias("union_size"), both.alias("shared"),
        pct(both).alias("shared_pct"), pct(only_s).alias("source_only_pct"), pct(only_t).alias("target_only_pct"),
    )


def top_terms(df: DataFrame, text: str, top: int = 100, stop=K.STOP_WORDS, least: int = 3) -> DataFrame:
    """(term, weight): the most frequent terms, ties by term.

    Lower-cased words without marks at either end, of at least ``least`` characters, no stop words.
    """
    marks = F.lit(K.TERM_STRIP)
    words = F.transform(tokens(F.lower(text)), lambda w: F.btrim(w, marks))
    words = F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*stop))
    return df.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("weight")).orderBy(F.desc("weight"), "term").limit(top)


def font_weights(terms: DataFrame, least: float = 12.0, most: float = 72.0) -> DataFrame:
    """Terms with size: max(least, weight / largest weight * most)."""
    top = terms.agg(F.max("weight").alias("tmp_top"))
    return terms.join(F.broadcast(top)).withColumn("size", F.greatest(F.lit(least), F.col("weight") / F.col("tmp_top") * most)).drop("tmp_top")


def topic_of(c: Column | str, rules=K.TOPIC_RULES, other: str = K.OTHER_TOPIC) -> Column:
    """Topic of a text: the first rule of which a keyword occurs in its upper-cased first sentence."""
    c = F.col(c) if isinstance(c, str) else c
    prefix = F.upper(strip(F.substring_index(c, ".", 1)))
    out = None
    for topic, keywords in rules:
        hit = reduce(lambda a, b: a | b, (prefix.contains(k) for k in keywords))
        out = F.when(hit, topic) if out is None else out.when(hit, topic)
    return F.lit(other) if out is None else out.otherwise(other)


def topic_distribution(df: DataFrame, topic: Column, top: int = 10, other: str = K.OTHER_TOPIC) -> DataFrame:
    """(topic, n, share_pct): counts of the ``top`` topics; the rest joins ``other``, which is one row, also if it was on top."""
    counts = df.select(topic.alias("topic")).filter("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    # the number of topics is that of the rules, so ranking them in one task is bounded
    ranked = counts.withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n"), "topic")))
    folded = ranked.groupBy(F.when(F.col("rk") <= top, F.col("topic")).otherwise(other).alias("topic")).agg(F.sum("n").alias("n"))
    return folded.withColumn("share_pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def anomaly_labels(c: Column | str) -> Column:
    """Labels of a target that is clearly broken; none for blank texts."""
    # heads are compared, and letters never become fewer in upper case
    n = max(len(K.TRUNCATED_TARGET), len(K.INSTITUTIONAL_HEADER)) + 1

    def labels(t: Column, up: Column) -> Column:
        return F.array_compact(F.array(
            F.when(up == K.TRUNCATED_TARGET, "trunc_8w_exata"), F.when(up.startswith(K.INSTITUTIONAL_HEADER), "header_ementa"),
            F.when(up.startswith("DESPACHO"), "despacho_ementa"), F.when(F.substr(t, F.lit(1), F.lit(1)).rlike("[0-9]") & t.rlike(r"^[0-9]+[).\-]"), "ementa_start_digit"),
            F.when(F.size(F.split(t, f"{SPACE}+", K.LONG_TARGET_WORDS + 1)) > K.LONG_TARGET_WORDS, "ementa_longa_anomala"),
        ))

    t = strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return once(t, lambda t: once(F.upper(F.substr(t, F.lit(1), F.lit(n))), lambda up: labels(t, up)))


def anomaly_summary(df: DataFrame, split: str = "split", source: str = "source", target: str = "target") -> DataFrame:
    """(kind, total, train, test): rows with broken targets, and rows with contaminated sources."""
    flags = df.select(F.col(split).alias("split"), (F.size(anomaly_labels(target)) > 0).alias("rotulos_corrompidos"), F.coalesce(F.upper(strip(source)).startswith(K.CONTAMINATED_SOURCE), F.lit(False)).alias("inputs_contaminados"))
    long = flags.unpivot(["split"], ["rotulos_corrompidos", "inputs_contaminados"], "kind", "hit")
    return long.groupBy("kind").agg(F.count_if("hit").alias("total"), F.count_if(F.col("hit") & (F.col("split") == "train")).alias("train"), F.count_if(F.col("hit") & (F.col("split") == "test")).alias("test"))


def length_overflow(df: DataFrame, text: str, count_tokens, limit: int = K.MAX_INPUT_TOKENS, by: str = "split") -> DataFrame:
    """(by, total, over): rows whose text has more than ``limit`` tokens.

    ``count_tokens`` takes a list of texts and returns their token counts; it runs
    in batches on the executors.
    """
    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series(count_tokens(s.fillna("").tolist()))

    counted = df.select(by, count(text).alias("n"))
    return counted.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > limit).alias("over"))


def funnel(stages: list[tuple[str, int]]) -> list[dict]:
    """Stage counts with loss and retention in percent of the first and of the stage before; 0 where that is 0."""
    out: list[dict] = []
    for name, n in stages:
        before, first = (out[-1]["n"], out[0]["n"]) if out else (n, n)
        out.append({"stage": name, "n": n, "lost": before - n, "retention_pct": round(100.0 * n / before, 1) if before else 0.0, "retention_total_pct": round(100.0 * n / first, 1) if first else 0.0})
    return out


def wall_clock(c: Column | str) -> Column:
    """Timestamp as written, its offset left aside; null if it isn't an ISO-8601 date."""
    c = F.col(c) if isinstance(c, str) else c
    s = F.trim(c.cast("string"))
    bare = F.regexp_replace(s, r"(Z|[+-]\d{2}(:?\d{2})?)$", "")
    return F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"), F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s).otherwise(bare).try_cast("timestamp_ntz"))


def temporal_profile(df: DataFrame, date: Column) -> DataFrame:
    """(year, n, first, last): rows and range of dates for each year; rows without a date are left out."""
    return df.select(date.alias("d")).filter("d is not null").groupBy(F.year("d").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("first"), F.max("d").alias("last"))


def rank_by_value(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the average rank of each value over all rows (1-based), without sorting all rows in one task.

    Rows are counted by distinct value first. Distinct values are cut into ranges;
    a running sum within ranges plus the totals of the ranges before gives ranks.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("tmp_v")).agg(F.count(F.lit(1)).alias("tmp_n"))
    cuts = counts.select(F.percentile_approx("tmp_v", F.array(*[F.lit(k / 64) for k in range(1, 64)]), 640)).first()[0] or []
    cut = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array(F.lit(0.0))
    counts = counts.withColumn("tmp_r", F.size(F.filter(cut, lambda c: c <= F.col("tmp_v"))))
    below = counts.groupBy("tmp_r").agg(F.sum("tmp_n").alias("tmp_t"))
    below = below.select("tmp_r", F.coalesce(F.sum("tmp_t").over(Window.orderBy("tmp_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("tmp_b"))  # at most 64 rows
    running = F.coalesce(F.sum("tmp_n").over(Window.partitionBy("tmp_r").orderBy("tmp_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.withColumn("tmp_u", running).join(below, "tmp_r").select("tmp_v", (F.col("tmp_b") + F.col("tmp_u") + (F.col("tmp_n") + 1) / 2.0).alias(out))
    return df.join(ranks, F.col(value) == F.col("tmp_v"), "left").drop("tmp_v")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho): Pearson's correlation of average ranks over rows with both values; null where a side is constant."""
    both = df.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = rank_by_value(rank_by_value(both, x, "tmp_x"), y, "tmp_y")
    rho = F.try_divide(F.covar_pop("tmp_x", "tmp_y"), F.stddev_pop("tmp_x") * F.stddev_pop("tmp_y"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), rho.alias("rho"))


def linear_trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, slope, intercept, r2 of y on x, and the line's ends (x0, y0, x1, y1); null where x is constant."""
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    cov, vx, vy = F.covar_pop("x", "y"), F.var_pop("x"), F.var_pop("y")
    slope = F.try_divide(cov, vx)
    fit = both.agg(
        F.count(F.lit(1)).alias("n"), slope.alias("slope"), (F.avg("y") - slope * F.avg("x")).alias("intercept"), F.try_divide(cov * cov, vx * vy).alias("r2"),
        F.min("x").alias("x0"), F.max("x").alias("x1"),
    )
    return fit.withColumns({"y0": F.col("intercept") + F.col("slope") * F.col("x0"), "y1": F.col("intercept") + F.col("slope") * F.col("x1")})


def scatter_sample(df: DataFrame, key: Column, order: str, most: int = 2000) -> DataFrame:
    """At most ``most`` rows by a fixed key (a hash of the id, say), sorted by ``order``: the same rows on every run."""
    return df.orderBy(key).limit(most).orderBy(order)
