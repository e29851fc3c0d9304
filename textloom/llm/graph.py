"""Connected components of a link table, without holding it anywhere at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialise, reading, spread_join


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` (u, v long) to (u, root): each linked vertex with the smallest vertex it reaches.

    Alternating large-star and small-star steps: every step points a vertex's
    neighbours at the smallest vertex near it, so a hub loses its links after one
    step and the number of rounds is logarithmic in the number of vertices.
    Minima are pre-aggregated before the shuffle, and the links of a hub are dealt
    over many tasks. Self-links, repeated links and nulls are ignored; an empty
    table gives an empty result.
    """
    edges = materialise(
        links.filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            spread_join(both, least, ["u"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        large = materialise(large)
        discard(edges)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            spread_join(large, low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
            .union(low.select("u", "m")).distinct()
        )
        small = materialise(small)
        discard(large)
        # Done when every vertex points at a vertex that points nowhere, and at one only.
        chained = small.select(F.col("v").alias("u")).distinct().join(small, "u", "left_semi").limit(1).count()
        many = 0 if chained else small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).count()
        if not chained and not many:
            roots = small.select("u", F.col("v").alias("root"))
            return reading(roots.union(small.select(F.col("v").alias("u"), F.col("v").alias("root")).distinct()), small)
        edges = small
