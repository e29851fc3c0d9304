"""Quality classifier: importance resampling with hashed n-gram models."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name, materialise, reading, sampled_labels, with_fields
from textloom.operators.order import kth_largest

WORD_BUCKETS, SHAPE_BUCKETS = 10_000, 2_000
BUCKETS = WORD_BUCKETS + SHAPE_BUCKETS
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_AGAIN = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _shape(token: str) -> str:
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:3]
    if token.isalpha():
        return "a" if token.islower() else "A" if token.isupper() and len(token) > 1 else "Aa"
    return "9" if token.isdigit() else "a9"


class _Hashes(dict):
    """Token to its row in two tables: the hash of its lower case, and of its shape."""

    most = 300_000

    def __init__(self):
        super().__init__()
        self.word, self.shape = np.empty(1024, np.uint64), np.empty(1024, np.uint64)

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self)
        if n == len(self.word):
            self.word, self.shape = np.resize(self.word, 2 * n), np.resize(self.shape, 2 * n)
        self.word[n] = xxhash.xxh64_intdigest(token.lower())
        self.shape[n] = xxhash.xxh64_intdigest("shape " + _shape(token))
        return n

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of a text's tokens; between texts the tables are emptied when they are full."""
        if len(self) >= self.most:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.word[rows], self.shape[rows]


def _ngrams(h: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of 1- and 2-grams; a token that repeats the one before counts as one fixed symbol."""
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    h = np.where(again, _AGAIN, h)
    pairs = (h[:-1] * _MIX) ^ (h[1:] >> np.uint64(7)) ^ h[1:]
    both = np.concatenate([h, pairs])
    both = (both ^ (both >> np.uint64(31))) * _MIX
    return ((both >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def buckets_of(text: str, hashes: _Hashes) -> np.ndarray:
    """Bucket of each n-gram of a text: words, and the shapes of words and marks."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        return np.empty(0, np.int64)
    words, shapes = hashes.of(tokens)
    pair = (shapes[:-1] * _MIX) ^ shapes[1:]
    pair = (pair ^ (pair >> np.uint64(29))) * _AGAIN
    of_shape = ((np.concatenate([shapes, pair]) >> np.uint64(17)) % np.uint64(SHAPE_BUCKETS)).astype(np.int64)
    return np.concatenate([_ngrams(words, WORD_BUCKETS), WORD_BUCKETS + of_shape])


def fit_importance(docs: DataFrame, target_ids: list[int], smooth: float = 1.0) -> np.ndarray:
    """Log ratio of the two bag-of-n-grams models, target against raw, for each bucket.

    Raw counts are those of all of ``docs`` (doc_id, text); target counts those of
    the rows named, whose number the caller bounds. Each task sends one row for
    each bucket it saw, so what is gathered is bounded by the number of buckets.
    """
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted(set(target_ids))], "doc_id long").withColumn("target", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", "target")

    def run(batches):
        counts, hashes = np.zeros((2, BUCKETS), np.int64), _Hashes()
        for b in batches:
            for text, target in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                n = np.bincount(buckets_of(text.as_py() or "", hashes), minlength=BUCKETS)
                counts[0] += n
                if target:
                    counts[1] += n
        seen = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], names=["k", "raw", "target"])

    got = marked.mapInArrow(run, "k long, raw long, target long").groupBy("k").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in got:
        raw[r["k"]], target[r["k"]] = r["raw"], r["target"]
    out = np.zeros(BUCKETS)
    for part in (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, BUCKETS)):
        n = part.stop - part.start
        q, p = raw[part] + smooth, target[part] + smooth * target[part].sum() / max(1.0, raw[part].sum())
        if target[part].sum() > 0:
            out[part] = np.log(p / p.sum()) - np.log(q / q.sum())
        assert len(q) == n
    return out


def log_weights(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` with log_weight: the log likelihood ratio of the text; 0 for an empty or null text."""

    def run(batches):
        hashes = _Hashes()
        for b in batches:
            at = b.schema.get_field_index("text")
            w = np.array([ratios[buckets_of(t.as_py() or "", hashes)].sum() for t in b.column(at)], np.float64)
            yield b.append_column("log_weight", pa.array(w, pa.float64()))

    docs = docs.drop("log_weight")
    return docs.mapInArrow(run, with_fields(docs, log_weight="double"))


UNIT = 1 << 20


def resample(weighted: DataFrame, keep: int | None = None, seed: int = 29) -> DataFrame:
    """``weighted`` (a written table with doc_id, log_weight) with gumbel_key and kept.

    Gumbel top-k: the ``keep`` rows with the largest log weight plus Gumbel noise,
    ties to the smaller doc_id, are a sample without replacement in proportion to
    the weights. By default ``keep`` is the number of rows that the target model
    accounts for, the sum of min(1, weight). Noise comes from a hash of doc_id, so
    a rerun draws the same rows; rows alike in both are kept together.
    """
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    key = F.round((F.col("log_weight") - F.log(-F.log(u))) * UNIT).cast("long")
    k = free_name(weighted, "tmp_key")
    keyed = weighted.withColumn(k, key)
    if keep is None:
        # in fixed point: the sum of floats depends on their order
        share = F.round(F.least(F.lit(1.0), F.exp(F.least(F.lit(0.0), "log_weight"))) * UNIT).cast("long")
        keep = round((keyed.agg(F.sum(share)).first()[0] or 0) / UNIT)
    found = kth_largest(keyed, k, keep)
    if found is None:
        kept = F.lit(keep > 0)
    else:
        edge, _ = found
        above = keyed.filter(F.col(k) > edge).count()
        last, _ = kth_largest(keyed.filter(F.col(k) == edge).select((-F.coalesce("doc_id", F.lit(-1)).cast("decimal(38,0)")).alias("i")), "i", keep - above)
        kept = (F.col(k) > edge) | ((F.col(k) == edge) & (-F.coalesce("doc_id", F.lit(-1)).cast("decimal(38,0)") >= F.lit(last)))
    return keyed.withColumn("kept", kept).withColumn("gumbel_key", F.col(k) / float(UNIT)).drop(k)


def importance_resampling(docs: DataFrame, labels: DataFrame, bound: int = 20_000, keep: int | None = None, texts: bool = True) -> DataFrame:
    """``docs`` with log_weight, gumbel_key and kept; without ``texts``, the text column isn't written out.

    The target text is that of at most ``bound`` rows labelled quality 1 (none of
    fold 0), the raw text that of all rows. Without labels all weights are 1 and
    all rows are kept. Null texts count as empty (weight 1); nulls in other
    columns and repeated rows pass; an empty table gives an empty result; former
    columns of the three names are replaced.
    """
    docs = docs.drop("log_weight", "gumbel_key", "kept")
    ids = [i for i, y in sampled_labels(labels.filter("quality = 1"), "quality", bound)]
    ratios = fit_importance(docs, ids)
    weighted = log_weights(docs, ratios)
    weighted = materialise(weighted if texts else weighted.drop("text"))
    return reading(resample(weighted, keep), weighted)
