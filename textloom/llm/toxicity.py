"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialise, sampled_labels, with_fields

DIMENSIONS = 1 << 18
_WORD = re.compile(r"\w+")


class _Terms(dict):
    """Word to the indices of its terms: itself and, for longer ones, its first letters."""

    most = 200_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        w = word.lower()
        names = [w] + [f"{k} {w[:k]}" for k in (4, 5, 6) if len(w) > k]
        self[word] = out = tuple(xxhash.xxh64_intdigest(n) % DIMENSIONS for n in names)
        return out


def terms_of(text: str, terms: _Terms) -> np.ndarray:
    """Sorted distinct term indices of a whole text."""
    out: set[int] = set()
    for w in set(_WORD.findall(text)):
        out.update(terms[w])
    return np.array(sorted(out), np.int32)


class FactorizationMachine:
    """score = sigmoid(w0 + sum of w_i + sum over pairs i < j of <v_i, v_j>), for the terms present.

    Fitted by AdaGrad on the logistic loss. Only terms take part that ``least`` or
    more training documents hold and whose share of label 1 is ``sure`` or more
    standard deviations off the mean; the rest, mostly names of the topic, would
    only add noise in long texts and keep weight 0 and no factors.
    """

    def __init__(self, factors: int = 4, steps: int = 600, rate: float = 0.1, decay: float = 1e-4, batch: int = 512, seed: int = 5):
        self.factors, self.steps, self.rate, self.decay, self.batch, self.seed = factors, steps, rate, decay, batch, seed
        self.w0, self.w, self.v = -3.0, np.zeros(DIMENSIONS, np.float32), np.zeros((DIMENSIONS, factors), np.float32)

    def margin(self, idx: np.ndarray) -> float:
        if not len(idx):
            return float(self.w0)
        v = self.v[idx]
        s = v.sum(0)
        return float(self.w0 + self.w[idx].sum() + 0.5 * (s @ s - (v * v).sum()))

    def fit(self, rows: list[np.ndarray], y: np.ndarray, least: int = 3, sure: float = 4.0) -> FactorizationMachine:
        if not len(rows) or len(set(y.tolist())) < 2:
            self.w0 = -20.0 if not len(rows) or not y.any() else 20.0
            return self
        rng = np.random.default_rng(self.seed)
        df = np.bincount(np.concatenate(rows), minlength=DIMENSIONS)
        hit = np.bincount(np.concatenate([r for r, t in zip(rows, y, strict=True) if t]), minlength=DIMENSIONS)
        share = y.mean()
        off = np.abs(hit - df * share) / np.sqrt(np.maximum(df, 1) * share * (1 - share))
        used = np.flatnonzero((df >= least) & (off >= sure))
        self.w0 = float(np.log(share / (1 - share)))
        if not len(used):
            return self
        place = np.full(DIMENSIONS, -1)
        place[used] = np.arange(len(used))
        rows = [(p := place[r])[p >= 0] for r in rows]
        d, k = len(used), self.factors
        w, v, w0 = np.zeros(d), rng.normal(0, 0.01, (d, k)), self.w0
        gw, gv, g0 = np.full(d, 1e-6), np.full((d, k), 1e-6), 1e-6
        for _ in range(max(1, -(-self.steps * self.batch // max(len(rows), self.batch)))):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), self.batch):
                part = order[at : at + self.batch]
                lengths = np.array([len(rows[i]) for i in part])
                idx, doc = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), lengths)
                lin = np.bincount(doc, w[idx], len(part))
                vi = v[idx]
                s = np.stack([np.bincount(doc, vi[:, f], len(part)) for f in range(k)], axis=1)
                z = w0 + lin + 0.5 * ((s * s).sum(1) - np.bincount(doc, (vi * vi).sum(1), len(part)))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
                gi = g[doc]
                grad = np.bincount(idx, gi, d) + self.decay * w * (np.bincount(idx, minlength=d) > 0)
                gw += grad * grad
                w -= self.rate * grad / np.sqrt(gw)
                for f in range(k):
                    grad = np.bincount(idx, gi * (s[doc, f] - vi[:, f]), d)
                    grad += self.decay * v[:, f] * (grad != 0)
                    gv[:, f] += grad * grad
                    v[:, f] -= 0.1 * self.rate * grad / np.sqrt(gv[:, f])
                g0 += g.sum() ** 2
                w0 -= self.rate * g.sum() / np.sqrt(g0)
        self.w0 = w0
        self.w[used], self.v[used] = w, v
        return self


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 16_000, most_terms: int = 20_000_000, **options) -> FactorizationMachine:
    """Fit on at most ``bound`` labelled rows, none of fold 0.

    Only term indices of those rows come to the driver, each at most DIMENSIONS of
    four bytes. Their number is added up first; if they are over ``most_terms``, rows
    are left out of the sample in order of a hash of the id until they are not.
    """
    spark = docs.sparkSession
    y_of = sampled_labels(labels, "toxic", bound)
    ids = F.broadcast(spark.createDataFrame(y_of, "doc_id long, y int"))

    def run(batches):
        terms = _Terms()
        for b in batches:
            rows = [terms_of(t.as_py() or "", terms).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], names=["doc_id", "y", "terms"])

    picked = docs.select("doc_id", "text").join(ids, "doc_id")
    termed = materialise(picked.mapInArrow(run, "doc_id long, y int, terms binary"))
    sizes = sorted((r["h"], r["n"]) for r in termed.select(F.xxhash64("doc_id", F.lit(23)).alias("h"), (F.length("terms") / 4).cast("long").alias("n")).collect())
    edge = next((h for (h, _), total in zip(sizes, np.cumsum([n for _, n in sizes]).tolist(), strict=True) if total > most_terms), None)
    fitting = termed if edge is None else termed.filter(F.xxhash64("doc_id", F.lit(23)) < edge)
    # in a fixed order, so that the fit doesn't depend on how rows are dealt to tasks
    got = sorted((r["doc_id"], r["y"], bytes(r["terms"])) for r in fitting.collect())
    discard(termed)
    rows = [np.frombuffer(t, np.int32) for _, _, t in got]
    return FactorizationMachine(**options).fit(rows, np.array([y for _, y, _ in got], float))


def score_toxicity(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 from 0.5); a null text counts as empty."""
    bias, used = model.w0, np.flatnonzero((model.w != 0) | (model.v != 0).any(1)).astype(np.int32)
    w, v, factors = model.w[used], model.v[used], model.factors

    def run(batches):
        own, terms = FactorizationMachine(factors), _Terms()
        own.w0, own.w[used], own.v[used] = bias, w, v
        for b in batches:
            at = b.schema.get_field_index("text")
            z = np.array([own.margin(terms_of(t.as_py() or "", terms)) for t in b.column(at)], np.float64)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield b.append_column("score", pa.array(p, pa.float64())).append_column("predicted", pa.array((p >= 0.5).astype(np.int32)))

    docs = docs.drop("score", "predicted")
    return docs.mapInArrow(run, with_fields(docs, score="double", predicted="int"))


def toxicity(docs: DataFrame, labels: DataFrame, bound: int = 16_000) -> DataFrame:
    """``docs`` with score and predicted, learned from ``labels`` (doc_id, toxic).

    Inputs of a score are the text's terms alone. Null texts count as empty; empty
    texts get the bias; nulls in other columns and repeated rows pass; without
    labels every score is near 0; an empty table gives an empty result; former
    columns of the two names are replaced.
    """
    return score_toxicity(docs, fit_toxicity(docs, labels, bound))
