"""Harmonic packing of token sequences."""

from __future__ import annotations

import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import materialise, reading

#: Published split pattern of the byte-level vocabulary (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary() -> str:
    """Place of the default byte-level vocabulary, outside the repository."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(2)
def encoder(path: str):
    """Encoder for a byte-level BPE vocabulary in the tokenizers JSON format.

    Every merge's rank is its token's id there, so the byte ranks give the ids of
    that file at several times the speed; the tests compare both. The fast
    encoder's pattern gives up on a run of nearly a million white-space characters;
    such a text goes to the file's own tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"] if t.get("special")}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> list[int]:
        try:
            return bpe.encode(text, allowed_special=allowed, disallowed_special=())
        except ValueError:
            return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids

    return encode


def class_sizes(capacity: int) -> list[int]:
    """The reciprocal-capacity sizes capacity // j, largest first; each divides a bin into j places."""
    return sorted({capacity // j for j in range(1, capacity + 1)}, reverse=True)


def cuts(length: int, capacity: int) -> list[int]:
    """``length`` as a sum of class sizes, largest first."""
    out = [capacity] * (length // capacity)
    rest = length % capacity
    for size in class_sizes(capacity):
        while size <= rest:
            out.append(size)
            rest -= size
    return out


def leftover_bins(left: dict[int, int], capacity: int) -> dict[tuple[int, int], tuple[int, int]]:
    """(size, k) of the k-th leftover piece of a class to (bin, offset), first fit, longest first.

    A class leaves fewer pieces than a bin of it holds, so there are fewer than
    capacity * ln(capacity) + capacity of them, however large the input is.
    """
    used: list[int] = []
    out = {}
    for size in sorted(left, reverse=True):
        at = 0
        for k in range(left[size]):
            while at < len(used) and used[at] + size > capacity:
                at += 1
            if at == len(used):
                used.append(0)
            out[size, k] = (at, used[at])
            used[at] += size
    return out


def tokenised_pieces(docs: DataFrame, capacity: int, path: str, end: int = 0) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, worker, nth): the pieces of each document.

    ``nth`` numbers the pieces of one length within one worker's share.
    """
    table = [cuts(r, capacity) for r in range(capacity)]

    def run(batches):
        encode = encoder(path)
        worker = TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for b in batches:
            cols: list[list] = [[] for _ in range(6)]
            where = []
            for row, text in enumerate(b.column(1)):
                ids = encode(text.as_py() or "")
                ids.append(end)
                raw = memoryview(np.array(ids, "<u4").tobytes())
                start, n = 0, len(ids)
                for size in [capacity] * (n // capacity) + table[n % capacity]:
                    nth = seen.get(size, 0)
                    seen[size] = nth + 1
                    where.append(row)
                    for c, v in zip(cols, (start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n, worker, nth), strict=True):
                        c.append(v)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(where, pa.int64())), *(pa.array(c, pa.int64()) for c in cols)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "worker", "nth"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, worker long, nth long"
    )


def harmonic_pack(docs: DataFrame, capacity: int = 1024, path: str | None = None) -> DataFrame:
    """Pack the token ids of ``docs`` (doc_id, text) into sequences of at most ``capacity``.

    Each document's ids (and an end id 0) are cut at the reciprocal-capacity sizes
    capacity // j; a bin of such a class takes exactly capacity // size pieces, so
    its places are known without looking at other pieces. Workers number the
    pieces of a class in their own share; running counts of workers (one row for
    each worker and class) join the shares into whole bins. What the last bin of a
    class would leave open is bounded by the number of classes and is packed
    across classes. Nothing is dropped.

    One row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is one piece with the end id; rows
    with the same doc_id are separate documents; an empty table gives no rows.
    Columns besides doc_id and text aren't read.
    """
    spark = docs.sparkSession
    pieces = materialise(tokenised_pieces(docs, capacity, path or vocabulary()))
    shares = pieces.groupBy("worker", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    shares = materialise(shares.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    total = {r["length"]: r["n"] for r in shares.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    base, classes, left = 0, [], {}
    for size in sorted(total, reverse=True):
        per = capacity // size
        classes.append((size, per, base, total[size] // per))
        left[size] = total[size] % per
        base += total[size] // per
    places = [(size, k, base + b, at) for (size, k), (b, at) in leftover_bins(left, capacity).items()]
    classes_df = F.broadcast(spark.createDataFrame(classes, "length long, per long, base long, full long"))
    places_df = F.broadcast(spark.createDataFrame(places, "length long, rest long, bin long, at long"))
    ranked = (
        pieces.join(shares.drop("n"), ["worker", "length"]).join(classes_df, "length")
        .withColumn("rank", F.col("before") + F.col("nth"))
        .withColumn("rest", F.when(F.col("rank") >= F.col("full") * F.col("per"), F.col("rank") - F.col("full") * F.col("per")))
        .join(places_df, ["length", "rest"], "left")
    )
    out = ranked.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("bin", F.col("base") + F.expr("rank div per")).alias("sequence_id"),
        F.coalesce("at", F.col("rank") % F.col("per") * F.col("length")).alias("offset"),
    )
    return reading(out, pieces, shares)
