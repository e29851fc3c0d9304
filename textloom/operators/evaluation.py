"""Evaluation sets: splits, strata, samples, joins, pivots and text-similarity scores."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.window import Window

from textloom.functions import constants as K
from textloom.operators.contracts import ContractError, coverage_gaps, duplicate_keys, missing_keys, require_empty
from textloom.operators.order import kth_largest, with_position

# Order ---------------------------------------------------------------------------


def _nulls_first(df: DataFrame, name: str) -> Column:
    """An integer column with nulls below all its values."""
    low = df.agg(F.min(F.col(name).cast("long"))).first()[0]
    return F.coalesce(F.col(name).cast("long"), F.lit((low or 0) - 1))


def chronological_split(df: DataFrame, time: str, tie: str, share: float = K.TEST_SHARE) -> DataFrame:
    """``df`` with split: the last floor(n * share) rows by (time, tie) are 'test', the rest 'train'.

    The boundary row is found by narrowing a histogram of times, so no rows are
    moved and none is sorted; where the share comes to 0 rows, all are 'train'. A row
    without a time has no place in the order, so it raises; an integer tie may be
    null and then comes first among its like.
    """
    micros = F.unix_micros(F.to_timestamp(F.col(time)))
    n, dated = df.agg(F.count(F.lit(1)), F.count(micros)).first()
    if dated < n:
        raise ContractError(f"{n - dated} of {n} rows have no {time}")
    test = int(n * share)
    if test == 0:
        return df.withColumn("split", F.lit("train"))
    ties = _nulls_first(df, tie)
    edge, left = kth_largest(df.select(micros.alias("x")), "x", test)
    last, _ = kth_largest(df.filter(micros == edge).select(ties.alias("x")), "x", left)
    late = (micros > edge) | ((micros == edge) & (ties >= last))
    return df.withColumn("split", F.when(late, "test").otherwise("train"))


def quartile_strata(df: DataFrame, length: str, tie: str, strata: int = K.STRATA) -> DataFrame:
    """``df`` with stratum: min(floor(i * strata / n) + 1, strata) for the i-th row by (length, tie), from 0.

    Nulls come first, like the shortest. With an integer length and tie only the
    first row of each stratum is looked for, by narrowing histograms, and no row
    moves; others take the rows' places.
    """
    n = df.count()
    if n < strata:
        raise ValueError(f"{n} rows are too few for {strata} strata")
    if not all(isinstance(df.schema[c].dataType, IntegralType) for c in (length, tie)):
        ranked = with_position(df, [F.col(length), F.col(tie)])
        return ranked.withColumn("stratum", F.least(F.floor((F.col("position") - 1) * strata / F.lit(n)) + 1, F.lit(strata)).cast("int")).drop("position")
    size, ties, stratum = _nulls_first(df, length), _nulls_first(df, tie), F.lit(1)
    for k in range(1, strata):
        place = -(-k * n // strata)  # of the stratum's first row, from 0: as many rows come before it
        edge, left = kth_largest(df.select(size.alias("x")), "x", n - place)
        last, _ = kth_largest(df.filter(size == edge).select(ties.alias("x")), "x", left)
        stratum = stratum + F.when((size > edge) | ((size == edge) & (ties >= last)), 1).otherwise(0)
    return df.withColumn("stratum", stratum.cast("int"))


def stratified_sample(df: DataFrame, stratum: str, key: Column, per_stratum: int = K.CASES_PER_STRATUM) -> DataFrame:
    """``per_stratum`` rows of each stratum, those with the smallest key; each task passes on no more than that."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy("tmp_key"))
    return df.withColumn("tmp_key", key).withColumn("tmp_rk", rank).filter(F.col("tmp_rk") <= per_stratum).drop("tmp_rk", "tmp_key")


def seeded_sample(df: DataFrame, stratum: str, case: str, order: list[str], per_stratum: int = K.CASES_PER_STRATUM, seed: int = K.SEED, most: int = 1_000_000) -> DataFrame:
    """Sample that a NumPy generator draws over strata in order, as a driver-side library would.

    Only ids and strata of the evaluation set come to the driver, ``most`` of them at
    the most: a larger table raises (stratified_sample has no such bound). Sampled
    rows are joined back.
    """
    import numpy as np

    if (n := df.count()) > most:
        raise ValueError(f"{n} cases are more than the driver may hold ({most})")
    ids = df.select(*dict.fromkeys((stratum, case, *order))).toPandas().sort_values([stratum, *order])
    rng = np.random.default_rng(seed)
    drawn: list[str] = []
    for _, group in ids.groupby(stratum, sort=True):
        if len(group) < per_stratum:
            raise ValueError("a stratum has too few cases")
        drawn += group[case].iloc[rng.choice(len(group), size=per_stratum, replace=False)].tolist()
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(c,) for c in drawn], f"`{case}` string")), case, "left_semi")


def blinded_items(sample: DataFrame, case: str = "case_id", condition: str = "condition_id", seed: int = K.SEED) -> DataFrame:
    """``sample`` (a row for each case and condition) with blind_label A, B, ... in hashed order and item_id <case>_<label>."""
    rank = F.row_number().over(Window.partitionBy(case).orderBy(F.xxhash64(case, condition, F.lit(seed)), condition))
    return sample.withColumn("blind_label", F.chr(rank + 64)).withColumn("item_id", F.concat_ws("_", case, "blind_label"))


def seeded_blinded_items(sample: DataFrame, order: list[str], conditions: tuple[str, ...] = K.CONDITION_IDS, case: str = "case_id", condition: str = "condition_id", seed: int = K.SEED, most: int = 100_000) -> DataFrame:
    """blinded_items() by the permutations of one NumPy generator, case after case, so that a published key can be made again.

    Cases are taken by ``order``; each has to have all ``conditions``. Cases are those
    of an evaluation sample, ``most`` at the most, as one generator serves them in turn.
    """
    import numpy as np

    cases = [r[0] for r in sample.select(case, *(c for c in order if c != case)).distinct().orderBy(*order).select(case).limit(most + 1).collect()]
    if len(cases) > most:
        raise ValueError(f"over {most} cases: use blinded_items")
    grid = sample.groupBy(case).agg(F.sort_array(F.collect_set(condition)).alias("c"), F.count(F.lit(1)).alias("n"))
    whole = F.array(*[F.lit(c) for c in sorted(conditions)])
    require_empty(grid.filter((F.col("c") != whole) | (F.col("n") != len(conditions))).select(case), "cases without all conditions")
    rng, rows = np.random.default_rng(seed), []
    for c in cases:
        rows += [(c, conditions[int(k)], chr(65 + place)) for place, k in enumerate(rng.permutation(len(conditions)))]
    key = sample.sparkSession.createDataFrame(rows, f"`{case}` string, `{condition}` string, blind_label string")
    return sample.join(F.broadcast(key), [case, condition]).withColumn("item_id", F.concat_ws("_", case, "blind_label"))


def blind_package(items: DataFrame, case: str = "case_id", condition: str = "condition_id", text: str = "candidate") -> tuple[DataFrame, DataFrame]:
    """(sample, key): cases with their blinded items (no condition in them), and what each item is."""
    key = items.select("item_id", case, "blind_label", F.col(condition).alias("true_condition_id"))
    grouped = items.groupBy(case).agg(F.array_sort(F.collect_list(F.struct("blind_label", "item_id", F.col(text).alias("text")))).alias("items"))
    return grouped, key


# Joins ---------------------------------------------------------------------------


def join_predictions(cases: DataFrame, predictions: DataFrame, complete: bool = True) -> DataFrame:
    """Cases with their predictions, for every condition at once.

    Unknown cases raise; so do missing ones if ``complete``. Keys have to be unique.
    """
    require_empty(duplicate_keys(cases, "case_id"), "duplicate cases")
    require_empty(duplicate_keys(predictions, "case_id", "condition_id"), "duplicate predictions")
    require_empty(missing_keys(predictions, cases, "case_id"), "predictions of unknown cases")
    if complete:
        conditions = [r[0] for r in predictions.select("condition_id").distinct().limit(1001).collect()]
        if len(conditions) > 1000:
            raise ContractError("over 1000 conditions")
        grid = cases.select("case_id", F.explode(F.array(*[F.lit(c) for c in conditions]).cast("array<string>")).alias("condition_id"))
        require_empty(missing_keys(grid, predictions, "case_id", "condition_id"), "cases without prediction")
    return cases.join(predictions, "case_id")


def pending(every: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return every.join(done.select(*keys).distinct(), list(keys), "left_anti")


def upsert_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; rows shrink to one for each key and task before the shuffle."""
    columns = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("tmp_row")).select(key, "tmp_row.*").select(df.columns)


def rating_grid(items: DataFrame, raters: int = K.RATERS, criteria=K.HUMAN_CRITERIA) -> DataFrame:
    """Every rating expected: item, rater and criterion, with no rating yet."""
    return items.select("case_id", "item_id", "blind_label", F.explode(F.array(*[F.lit(f"avaliador_{k + 1}") for k in range(raters)])).alias("rater_id")).withColumn(
        "criterion", F.explode(F.array(*[F.lit(c) for c in criteria]))
    ).withColumns({"rating": F.lit(None).cast("int"), "notes": F.lit("")})


def require_grid(grid: DataFrame, ratings: DataFrame) -> None:
    """Ratings have to cover the grid, each cell once and nothing else."""
    keys = ("case_id", "item_id", "blind_label", "rater_id", "criterion")
    require_empty(duplicate_keys(ratings, "item_id", "rater_id", "criterion"), "duplicate ratings")
    require_empty(coverage_gaps(grid, ratings, *keys), "incomplete ratings")


def unblind(ratings: DataFrame, key: DataFrame) -> DataFrame:
    """Ratings with their condition; many to one, and every rating finds its item."""
    require_empty(duplicate_keys(key, "item_id"), "duplicate items in the key")
    out = ratings.join(key, ["item_id", "case_id", "blind_label"], "left")
    require_empty(out.filter("true_condition_id is null").select("item_id"), "ratings of unknown items")
    return out


def rating_means(ratings: DataFrame, condition: str = "true_condition_id") -> DataFrame:
    """(condition, criterion, n, mean): means by condition and criterion, and by condition alone (criterion null), in one pass."""
    return (
        ratings.groupingSets([[F.col(condition), F.col("criterion")], [F.col(condition)]], F.col(condition), F.col("criterion"))
        .agg(F.count("rating").alias("n"), F.avg("rating").alias("mean")).select(F.col(condition).alias("condition_id"), "criterion", "n", "mean")
    )


def metric_pairs(metrics: DataFrame, families: dict[str, tuple[str, str]]) -> DataFrame:
    """(family, metric, case_id, ft, zs, delta) from the long table: fine-tuned against zero-shot, both needed.

    One pivot by conditional aggregation for all families and metrics.
    """
    rows = [(c, f, side) for f, pair in families.items() for c, side in zip(pair, ("ft", "zs"), strict=True)]
    dim = metrics.sparkSession.createDataFrame(rows, "condition_id string, family string, side string")
    wide = metrics.join(F.broadcast(dim), "condition_id").groupBy("family", "metric", "case_id").agg(
        F.max(F.when(F.col("side") == "ft", F.col("score"))).alias("ft"), F.max(F.when(F.col("side") == "zs", F.col("score"))).alias("zs")
    )
    return wide.withColumn("delta", F.col("ft") - F.col("zs"))


def condition_families(conditions=K.CONDITIONS) -> dict[str, tuple[str, str]]:
    """Family to (fine-tuned, zero-shot) condition."""
    out: dict[str, dict[str, str]] = {}
    for cid, _, family, kind in conditions:
        out.setdefault(family, {})[kind] = cid
    return {f: (k["fine_tuned"], k["zero_shot"]) for f, k in out.items()}


def condition_pivot(metrics: DataFrame, conditions: list[str], case: str = "case_id") -> DataFrame:
    """A column of scores for each condition."""
    return metrics.groupBy(case).pivot("condition_id", conditions).agg(F.max("score"))


def metric_table(scored: DataFrame, metrics: list[str]) -> DataFrame:
    """Long table (case_id, condition_id, metric, score) of a wide one."""
    return scored.unpivot(["case_id", "condition_id"], metrics, "metric", "score")


def judge_score(answer: str = "answer") -> Column:
    """Mean of the five dimensions' scores."""
    return sum((F.col(f"{answer}.{d}.score") for d in K.JUDGE_DIMENSIONS), start=F.lit(0)) / float(len(K.JUDGE_DIMENSIONS))


def evaluation_metrics(joined: DataFrame, judged: DataFrame, similarity: Column | None = None) -> DataFrame:
    """The long table of all metrics: ROUGE, the similarity score if given, the judge's mean and its dimensions.

    ``joined`` has case_id, condition_id, reference, candidate; ``judged`` case_id,
    condition_id, answer, and has to cover exactly the same keys.
    """
    require_empty(coverage_gaps(joined, judged, "case_id", "condition_id"), "judge records don't cover the predictions")
    wide = rouge(joined.join(judged, ["case_id", "condition_id"]), "reference", "candidate")
    names = ["rouge1_f1", "rouge2_f1", "rougeL_f1"]
    if similarity is not None:
        wide, names = wide.withColumn("bertscore_f1", similarity), [*names, "bertscore_f1"]
    wide = wide.withColumn("judge_score_global", judge_score())
    dims = {f"judge_{d}": F.col(f"answer.{d}.score").cast("double") for d in K.JUDGE_DIMENSIONS}
    return metric_table(wide.withColumns(dims), [*names, "judge_score_global", *dims])


# Similarity ------------------------------------------------------------------------


def rouge_tokens(c: Column | str) -> Column:
    """Lower-cased runs of a-z and 0-9; everything else, accents too, divides."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _f1(overlap: Column, candidate: Column, reference: Column) -> Column:
    """Harmonic mean of overlap / candidate and overlap / reference: 2 overlap / (candidate + reference)."""
    return F.coalesce(F.try_divide(2.0 * overlap, candidate + reference), F.lit(0.0))


def _clipped_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays.

    Both are sorted and numbered within equal elements, which makes them sets.
    """

    def numbered(x: Column) -> Column:
        acc = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("k"), F.array().cast("array<string>").alias("out"))
        out = F.aggregate(
            F.array_sort(x), acc,
            lambda s, g: F.struct(
                g.alias("last"), F.when(s["last"] == g, s["k"] + 1).otherwise(0).alias("k"),
                F.concat(s["out"], F.array(F.concat_ws("#", F.when(s["last"] == g, s["k"] + 1).otherwise(0).cast("string"), g))).alias("out"),
            ),
        )
        return out["out"]

    return F.size(F.array_intersect(numbered(a), numbered(b)))


def _grams(t: Column, n: int) -> Column:
    if n == 1:
        return t
    return F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - (n - 1)), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))


def _lcs_length(a: Column, b: Column) -> Column:
    """Longest common subsequence by rows of the usual table, as a fold over one array."""
    zero = F.transform(F.concat(F.array(F.lit("")), b), lambda _: F.lit(0))

    def row(prev: Column, x: Column) -> Column:
        step = F.struct(F.array(F.lit(0)).alias("r"))
        return F.aggregate(
            F.sequence(F.lit(1), F.size(b)), step,
            lambda s, j: F.struct(F.concat(s["r"], F.array(F.when(F.get(b, j - 1) == x, F.get(prev, j - 1) + 1).otherwise(F.greatest(F.get(prev, j), F.element_at(s["r"], -1))))).alias("r")),
        )["r"]

    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.element_at(F.aggregate(a, zero, row), -1)).otherwise(0)


def rouge(df: DataFrame, reference: str, candidate: str, method: str = "arrow") -> DataFrame:
    """``df`` with rouge1_f1, rouge2_f1 and rougeL_f1 (0 where a side has no n-gram).

    Overlaps are counted in batches in Python: a multiset intersection and a
    bit-parallel subsequence are linear there, while their folds in the JVM
    (method="native") copy an array for each word.
    """
    df = df.withColumns({"tmp_r": rouge_tokens(reference), "tmp_c": rouge_tokens(candidate)})
    r, c = F.col("tmp_r"), F.col("tmp_c")
    if method == "native":
        found = F.struct(*(_clipped_overlap(_grams(c, n), _grams(r, n)).alias(f"o{n}") for n in (1, 2)), _lcs_length(r, c).alias("l"))
    else:
        found = _overlaps_udf()(r, c)
    df = df.withColumn("tmp_o", found)
    size = {n: (F.greatest(F.size(c) - (n - 1), F.lit(0)), F.greatest(F.size(r) - (n - 1), F.lit(0))) for n in (1, 2)}
    return df.withColumns({
        "rouge1_f1": _f1(F.col("tmp_o.o1"), *size[1]), "rouge2_f1": _f1(F.col("tmp_o.o2"), *size[2]), "rougeL_f1": _f1(F.col("tmp_o.l"), *size[1])
    }).drop("tmp_r", "tmp_c", "tmp_o")


def lcs_length(a, b) -> int:
    """Longest common subsequence, in bit-parallel form: one big integer for a row of the table."""
    where: dict[str, int] = {}
    for k, t in enumerate(a):
        where[t] = where.get(t, 0) | (1 << k)
    full = (1 << len(a)) - 1
    row = full
    for t in b:
        u = row & where.get(t, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def overlaps(a, b) -> tuple[int, int, int]:
    """Shared words, shared pairs of neighbours (both as multisets) and the longest common subsequence."""
    a, b = list(a), list(b)
    one = Counter(a) & Counter(b)
    two = Counter(zip(a, a[1:], strict=False)) & Counter(zip(b, b[1:], strict=False))
    return one.total(), two.total(), lcs_length(a, b)


def _overlaps_udf():
    @F.pandas_udf("o1 int, o2 int, l int")
    def f(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([overlaps(x, y) for x, y in zip(a, b, strict=True)], columns=["o1", "o2", "l"])

    return f


def cohen_kappa(df: DataFrame, a: str, b: str, by: list[str] | tuple = (), low: int = 1, high: int = 5) -> DataFrame:
    """(by, n, kappa): quadratic weighted kappa of two ratings; where no disagreement is expected, 1 if there is none, else 0.

    A contingency table of at most (high - low + 1)^2 cells a group, its marginals and weighted sums.
    """
    w = ((F.col("a") - F.col("b")) / float(high - low)) ** 2
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    observed = cells.groupBy(*by).agg(F.sum("n").alias("n"), F.sum(w * F.col("n")).alias("o"))
    rows = cells.groupBy(*by, "a").agg(F.sum("n").alias("na"))
    cols = cells.groupBy(*by, "b").agg(F.sum("n").alias("nb"))
    pairs = rows.join(cols, list(by)) if by else rows.crossJoin(F.broadcast(cols))  # at most five rows each
    expected = pairs.groupBy(*by).agg(F.sum(w * F.col("na") * F.col("nb")).alias("e"))
    both = observed.join(expected, list(by)) if by else observed.crossJoin(F.broadcast(expected))
    e = F.col("e") / F.col("n")
    return both.select(*by, "n", F.when(e == 0, F.when(F.col("o") == 0, 1.0).otherwise(0.0)).otherwise(1.0 - F.try_divide(F.col("o"), e)).alias("kappa"))


def rater_pairs(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """(item_id, criterion, one column for each rater)."""
    return ratings.groupBy("item_id", "criterion").pivot("rater_id", raters).agg(F.max("rating"))
