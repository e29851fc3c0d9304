"""Corpus pipeline: documents to packed training sequences.

Each stage works on all rows that the stage before kept, written as Parquet and
read again. Rows with null ids, null or empty texts and repeated rows pass
through as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import packing, quality, secrets, simhash, toxicity
from textloom.llm.common import discard, free_name, materialise, reading, settle, spread_join, table


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id, text and all else in one column, so that no name clashes with an operator's."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("doc_id"), *rest).alias("carried"))


def _restored(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(c) if c in ("doc_id", "text") else F.col("carried").getField(c).alias(c) for c in docs.columns))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling draws.

    Rows alike in id and text are kept or dropped together; a null or empty text has
    weight 1 and is drawn like any other; without labels all rows stay; an empty
    table stays empty. Columns pass as they are, whatever their names.
    """
    drawn = quality.importance_resampling(_carried(docs), table(spark, sf_dir, "labels"))
    return reading(_restored(drawn.filter("kept"), docs), drawn)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the factorization machine scores below 0.5.

    A null or empty text has the score of a text without terms; repeated rows have
    one score; without labels all rows stay; an empty table stays empty. Columns
    pass as they are, whatever their names.
    """
    return _restored(toxicity.toxicity(_carried(docs), table(spark, sf_dir, "labels")).filter("predicted = 0"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component of texts alike in 0.8 of their 5-word shingles; rows without id stay.

    It is the row with the smallest (doc_id, hash of the text, hash of all columns):
    an id may stand for texts of two components, and each keeps a row. Of rows that
    are alike in all columns one stays. Texts that are null, empty or without words
    are one component; an empty table stays empty. Only ids and hashes are looked
    at; texts meet the list of dropped rows, the smaller part, in one anti join.
    """
    vid, rid = free_name(docs, "vid"), free_name(docs, "rid")
    keys = ["doc_id", vid, rid]
    everything = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    known = docs.withColumns({vid: F.xxhash64(F.coalesce("text", F.lit(""))), rid: F.xxhash64(everything)}).filter("doc_id is not null")
    found = simhash.similar_texts(simhash.named_texts(docs.filter("doc_id is not null")), similarity=0.8, words=5)
    component = found.select(F.col("vid").alias(vid), F.col("root").alias("component"))
    rows = settle(reading(spread_join(materialise(known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))), component, [vid]), found))
    first = rows.groupBy("component").agg(F.min(F.struct(*keys)).alias("first"))
    placed = materialise(spread_join(rows, first, ["component"]).select(*keys, "n", F.struct(*keys).eqNullSafe(F.col("first")).alias("stays")))
    discard(rows)
    kept = known.join(placed.filter("NOT stays").select(*keys), keys, "left_anti")
    again = placed.filter("stays AND n > 1").select(*keys)
    if again.take(1):
        kept = kept.join(again, keys, "left_anti").unionByName(kept.join(again, keys, "left_semi").dropDuplicates(keys))
    return reading(kept.select(docs.columns).unionByName(docs.filter("doc_id is null")), placed)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; n_chars is counted anew.

    All rows stay: null and empty texts as they are, repeated rows alike; n_chars
    of a null text is left alone. Columns pass as they are, whatever their names.
    """
    masked = _restored(secrets.redact_secrets(_carried(docs)), docs)
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return masked.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids into sequences of at most 1024: one row for each piece.

    A null or empty text is one piece, its end id; repeated rows are documents of
    their own; an empty table gives no rows. Columns besides doc_id and text aren't read.
    """
    return packing.harmonic_pack(docs)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("toxicity", drop_toxic),
    ("SimHash near-dedup", drop_near_duplicates),
    ("secret scans", mask_secrets),
    ("packing", pack),
]

#: SQL can't express the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages; each stage's table is deleted once the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir))
        discard(before)  # the next table is whole and depends on nothing
    packed = STAGES[-1][1](spark, docs, sf_dir)
    return reading(packed, packed, docs)
