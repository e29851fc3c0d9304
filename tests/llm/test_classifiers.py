import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import quality, queries, toxicity
from textloom.llm.common import fold

LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("k", [1, 2, 5, 17, 40, 60])
def test_kth_largest(spark, k):
    values = [7, 7, 7, -5, 10**12, -(10**12), 0, 3] + list(range(50))
    df = spark.createDataFrame([(v,) for v in values], "x long")
    want = sorted(values, reverse=True)[k - 1] if k <= len(values) else None
    assert (quality.kth_largest(df, "x", k, bins=4) or [None])[0] == want


def test_top_k_is_exact_with_ties(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(90)], "doc_id long, log_weight double")
    rows = quality.resample(df, keep=25).collect()
    order = sorted(rows, key=lambda r: (-r["gumbel_key"], r["doc_id"]))
    assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in order[:25]}
    assert quality.resample(df, keep=0).filter("kept").count() == 0
    assert quality.resample(df, keep=90).filter("kept").count() == 90


def test_gumbel_draws_follow_weights(spark):
    df = spark.createDataFrame([(i, math.log(3.0) if i % 2 else 0.0) for i in range(4000)], "doc_id long, log_weight double")
    kept = [r["doc_id"] % 2 for r in quality.resample(df, keep=400).filter("kept").collect()]
    assert len(kept) == 400 and 0.68 < np.mean(kept) < 0.82  # 3 to 1


def test_buckets_see_repeats_and_shapes():
    h = quality._Hashes()
    a, b = quality.buckets_of("zig zig zig zig", h), quality.buckets_of("zag zag zag zag", h)
    assert set(a) & set(b) and len(quality.buckets_of("", h)) == 0
    assert (a < quality.BUCKETS).all() and len(a) == 2 * (4 + 3)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.importance_resampling(docs, labels).join(labels, "doc_id").filter(fold(F.col("doc_id")) == 0).collect()
    good, bad = [r["kept"] for r in rows if r["quality"] == 1], [r["kept"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_quality_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (None, 1, 1), (8, None, None), (7, 0, 0)], LABELS)
    out = quality.importance_resampling(edge_docs, labels)
    assert out.count() == 9 and out.filter("doc_id in (2, 3) and log_weight <> 0").count() == 0
    again = quality.importance_resampling(edge_docs, labels)
    assert sorted(map(str, out.select("doc_id", "kept").collect())) == sorted(map(str, again.select("doc_id", "kept").collect()))
    assert quality.importance_resampling(no_docs, labels).count() == 0
    none = quality.importance_resampling(edge_docs, labels.limit(0))
    assert none.filter("kept").count() == 9


def test_machine_learns_a_pair():
    """Label 1 needs both terms: an additive score can't tell the pair from either term alone as well."""
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        terms = ([1] if a else []) + ([2] if b else []) + sorted({int(t) for t in rng.integers(10, 40, 5)})
        rows.append(np.array(terms, np.int32))
        y.append(float(a and b))
    m = toxicity.FactorizationMachine().fit(rows, np.array(y))
    z = np.array([m.margin(r) for r in rows])
    assert ((z > 0) == np.array(y).astype(bool)).mean() > 0.99
    v = m.v[[1, 2]]
    assert v[0] @ v[1] > 0.1


def test_margin_is_the_sum_over_pairs():
    m = toxicity.FactorizationMachine(3)
    rng = np.random.default_rng(1)
    m.w0, m.w, m.v = 0.3, rng.normal(size=m.w.shape), rng.normal(size=m.v.shape)
    idx = np.array([3, 8, 11, 90], np.int32)
    want = 0.3 + m.w[idx].sum() + sum(m.v[i] @ m.v[j] for k, i in enumerate(idx) for j in idx[k + 1 :])
    assert abs(m.margin(idx) - want) < 1e-9


def test_toxicity_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    rows = toxicity.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").filter(fold(F.col("doc_id")) == 0).collect()
    hit = [r["predicted"] for r in rows if r["toxic"] == 1]
    false = [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(hit) > 0.85 and np.mean(false) < 0.02 and all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_edge_rows(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (8, 0, 1), (7, 0, 0), (2, 1, None)], LABELS)
    out = toxicity.toxicity(edge_docs, labels).collect()
    assert len(out) == 9 and all(r["predicted"] == int(r["score"] >= 0.5) for r in out)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    assert toxicity.toxicity(edge_docs, labels.limit(0)).filter("predicted = 1").count() == 0


def plain_buckets(text):
    """Buckets of a text by whole numbers, token by token."""
    mask, mix, again = (1 << 64) - 1, 0xBF58476D1CE4E5B9, 0x9E3779B97F4A7C15
    tokens = quality._TOKEN.findall(text)
    words = [xxhash.xxh64_intdigest(t.lower()) for t in tokens]
    words = [again if k and words[k] == words[k - 1] else h for k, h in enumerate(words)]
    shapes = [xxhash.xxh64_intdigest("shape " + quality._shape(t)) for t in tokens]
    out = []
    for h in words + [(a * mix & mask) ^ (b >> 7) ^ b for a, b in zip(words, words[1:])]:
        out.append((((h ^ (h >> 31)) * mix & mask) >> 33) % quality.WORD_BUCKETS)
    pairs = [(a * mix & mask) ^ b for a, b in zip(shapes, shapes[1:])]
    for h in shapes + [((p ^ (p >> 29)) * again) & mask for p in pairs]:
        out.append(quality.WORD_BUCKETS + (h >> 17) % quality.SHAPE_BUCKETS)
    return out


def test_log_weights_equal_brute_force(spark):
    """Counts of both models, ratios and weights, a second time in plain Python."""
    d = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{d}/labels.parquet").filter("quality = 1").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        raw.update(plain_buckets(t))
        target.update(plain_buckets(t) if i in good else [])
    ratio = {}
    for part in (range(quality.WORD_BUCKETS), range(quality.WORD_BUCKETS, quality.BUCKETS)):
        n, m = sum(raw[k] for k in part), sum(target[k] for k in part)
        p, q = {k: target[k] + m / n for k in part}, {k: raw[k] + 1 for k in part}
        total_p, total_q = sum(p.values()), sum(q.values())
        ratio |= {k: math.log(p[k] / total_p) - math.log(q[k] / total_q) for k in part}
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_importance_resampling"](spark, d).collect()}
    assert len(got) == len(texts)
    for i, t in texts.items():
        assert got[i]["log_weight"] == pytest.approx(sum(ratio[k] for k in plain_buckets(t)), rel=1e-6, abs=1e-6)


def test_toxicity_scores_equal_brute_force(spark):
    """The query's columns against a scorer that adds up every pair of terms."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit_toxicity(docs, spark.read.parquet(f"{d}/labels.parquet"), 16_000)
    got = {r["doc_id"]: r for r in queries.QUERIES["op5_factorization_toxicity"](spark, d).collect()}
    for r in docs.collect():
        terms = set()
        for w in re.findall(r"\w+", r["text"] or ""):
            w = w.lower()
            terms |= {xxhash.xxh64_intdigest(x) % toxicity.DIMENSIONS for x in [w] + [f"{k} {w[:k]}" for k in (4, 5, 6) if len(w) > k]}
        used = [i for i in sorted(terms) if model.w[i] or model.v[i].any()]
        z = float(model.w0) + sum(float(model.w[i]) for i in used)
        z += sum(float(np.dot(model.v[a].astype(float), model.v[b].astype(float))) for x, a in enumerate(used) for b in used[x + 1 :])
        row = got[r["doc_id"]]
        assert row["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4) and row["predicted"] == (row["score"] >= 0.5)
        assert row["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
