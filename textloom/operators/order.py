"""Places in a global order, found without one task or driver that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def kth_largest(df: DataFrame, col: str, k: int, bins: int = 4096) -> tuple[int, int] | None:
    """(k-th largest value of an integer column, k less the number of larger values); None if there are fewer.

    A histogram of at most ``bins`` counts is narrowed to the bin that holds it, so
    that no sort, single task or driver holds the values. Nulls don't count.
    """
    if k < 1:
        return None
    x = F.col(col).cast("decimal(38,0)")
    lo, hi, n = df.agg(F.min(x), F.max(x), F.count(x)).first()
    if n < k:
        return None
    lo, hi = int(lo), int(hi)
    while lo < hi:
        width = -(-(hi - lo + 1) // bins)
        rows = df.filter(f"cast(`{col}` AS decimal(38,0)) BETWEEN {lo}BD AND {hi}BD").groupBy(F.expr(f"cast((cast(`{col}` AS decimal(38,0)) - ({lo}BD)) div {width}BD AS int)").alias("b")).count().collect()
        for b, c in sorted(((r["b"], r["count"]) for r in rows), reverse=True):
            if k <= c:
                lo, hi = lo + b * width, min(hi, lo + (b + 1) * width - 1)
                break
            k -= c
    return lo, k


def with_position(df: DataFrame, order: list[Column], name: str = "position", ranges: int = 64) -> DataFrame:
    """``df`` with the 1-based place of each row in a global order (nulls first), without one task that sees all rows.

    Rows are dealt into ``ranges`` by cuts that come from a hashed sample of a
    bounded number of keys; a place is the rows of the ranges before (one count for
    each) plus the place in the range. The cuts are part of the plan, so every
    evaluation deals the rows alike. Rows have to be told apart by ``order``, and it
    must not depend on how they arrive.
    """
    keyed = df.withColumn("tmp_order", F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))))
    sample = keyed.select("tmp_order").orderBy(F.xxhash64("tmp_order"), "tmp_order").limit(16 * ranges).orderBy("tmp_order").collect()
    kinds = [f.dataType for f in keyed.schema["tmp_order"].dataType.fields]
    cuts = [F.struct(*(F.lit(v).cast(t).alias(f"o{k}") for k, (v, t) in enumerate(zip(r["tmp_order"], kinds, strict=True)))) for r in sample[8::16]]
    own = F.size(F.filter(F.array(*cuts), lambda c: c <= F.col("tmp_order"))) if cuts else F.lit(0)
    ranged = keyed.withColumn("tmp_range", own)
    before = F.coalesce(F.sum("tmp_n").over(Window.orderBy("tmp_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each range
    counts = ranged.groupBy("tmp_range").agg(F.count(F.lit(1)).alias("tmp_n")).select("tmp_range", before.alias("tmp_before"))
    place = F.row_number().over(Window.partitionBy("tmp_range").orderBy("tmp_order"))
    placed = ranged.withColumn("tmp_within", place).join(F.broadcast(counts), "tmp_range")
    return placed.withColumn(name, (F.col("tmp_before") + F.col("tmp_within")).cast("long")).drop("tmp_order", "tmp_range", "tmp_within", "tmp_before")
