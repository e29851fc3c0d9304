"""Audit for personal data that masking left behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.functions import constants as K
from textloom.functions.gates import gated, led
from textloom.functions.text import once, strip
from textloom.operators.masking import has_context_marker


def residual_names(c: Column | str) -> Column:
    """Names in private contexts that hold no mask: contextual ones first, then those after an honorific."""
    c = F.col(c) if isinstance(c, str) else c
    gate = has_context_marker(c)
    for term in K.AUDIT_HONORIFICS:
        gate = gate | c.contains(term)
    found = F.concat(
        F.regexp_extract_all(c, F.lit(led(K.CONTEXT_NAME)), F.lit(2)),
        F.regexp_extract_all(c, F.lit(led(K.AUDIT_HONORIFIC_NAME)), F.lit(1)),
    )
    clear = F.filter(F.transform(found, strip), lambda n: (n != "") & ~n.contains("[") & ~n.contains("]"))
    return F.when(gate, clear).otherwise(F.array().cast("array<string>"))


def findings(df: DataFrame, text: str, patterns=K.AUDIT_PATTERNS, names: bool = True) -> DataFrame:
    """(ordinal, category, n, example): one row for each row and category with a match, in one pass.

    ``df`` has ordinal and ``text``; the example is the row's first match.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def row(name: str, n: Column, example: Column) -> Column:
        return F.struct(F.lit(name).alias("category"), n.cast("long").alias("n"), example.alias("example"))

    def of_pattern(name: str, pattern: str, flags: str, may: Column) -> Column:
        count = F.when(may, F.regexp_count(t, F.lit(led(pattern, flags)))).otherwise(0)
        return once(count, lambda n: row(name, n, F.when(n > 0, F.regexp_extract(t, led(pattern, flags), 0)).otherwise("")))

    def rows(may_match) -> Column:
        out = [of_pattern(name, p, flags, may_match(p)) for name, p, flags in patterns]
        if names:
            out.append(once(residual_names(t), lambda found: row(K.AUDIT_NAMES, F.size(found), F.coalesce(F.get(found, F.lit(0)), F.lit("")))))
        return F.array(*out)

    return df.select("ordinal", F.explode(gated(t, [p for _, p, _ in patterns], rows)).alias("x")).select("ordinal", "x.*").filter("n > 0")


#: Groups of a category's rows, ranked apart from each other.
GROUPS = 256


def audit_report(df: DataFrame, text: str, patterns=K.AUDIT_PATTERNS, names: bool = True, examples: int = 3) -> DataFrame:
    """(category, n, rows, examples): totals and the first few examples in row order, for every category."""
    spark = df.sparkSession
    every = spark.createDataFrame([(p[0],) for p in patterns] + ([(K.AUDIT_NAMES,)] if names else []), "category string")
    found = findings(df, text, patterns, names)
    # one scan of the texts: rows are ranked within groups, of which the first few and the totals go on
    place = F.struct(F.col("ordinal").isNull().alias("unplaced"), "ordinal", "example")
    group = [F.col("category"), F.pmod(F.xxhash64("ordinal"), F.lit(GROUPS))]
    ranked = found.withColumn("rk", F.row_number().over(Window.partitionBy(*group).orderBy(place)))
    parts = ranked.groupBy("category", group[1].alias("part")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.collect_list(F.when(F.col("rk") <= examples, place)).alias("x"))
    totals = parts.groupBy("category").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.slice(F.array_sort(F.flatten(F.collect_list("x"))), 1, examples).alias("x"))
    return every.join(totals, "category", "left").select(
        "category", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("rows", F.lit(0)).alias("rows"),
        F.coalesce(F.transform("x", lambda e: e["example"]), F.array().cast("array<string>")).alias("examples"),
    )


def passed(report: DataFrame) -> bool:
    """True if no category has a finding."""
    return bool(report.agg(F.bool_and(F.col("n") == 0)).first()[0])


def gate(reports: dict[str, DataFrame | None]) -> tuple[bool, list[str]]:
    """Verdict over several files; a missing one (None) fails. The second part names the failed ones."""
    failed = [name for name, r in reports.items() if r is None or not passed(r)]
    return not failed, failed
