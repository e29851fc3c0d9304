"""Registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import extraction, imatch, multi_index, packing, pieces, quality, quotes, secrets, simhash, toxicity
from textloom.llm.common import fold, table

QUERIES: dict = {}
ORACLE: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    drawn = quality.importance_resampling(docs, table(spark, sf_dir, "labels"), bound=20_000, texts=False)
    return drawn.select("doc_id", "log_weight", "gumbel_key", "kept")


@_query
def op2_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_report(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op3_quotation_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.link_quotes(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


@_query
def op4_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=3, budget=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op5_factorization_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), bound=16_000)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


@_query
def op6_multi_index_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = multi_index.clean_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return multi_index.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


@_query
def op7_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op8_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(table(spark, sf_dir, "documents", "doc_id", "text"), capacity=1024)


@_query
def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@_query
def op10_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.find_secrets(docs).select("doc_id", "secret_spans", F.expr("filter(secret_spans, x -> x.k < 3)").alias("base"))

    def n(k: int):
        return F.expr(f"cast(size(filter(base, x -> x.k = {k})) AS bigint)")

    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(F.expr(secrets.span_text("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(secrets.span_text("secret_spans")).alias("spans"),
    )


ORACLE["op3_quotation_threads"] = quotes.ORACLE
ORACLE["op10_secret_spans"] = secrets.oracle()
