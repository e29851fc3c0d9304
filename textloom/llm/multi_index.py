"""Approximate nearest neighbours: an inverted multi-index over two vector halves."""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import materialise, reading


def clean_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<double>) of the rows that take part.

    Out are rows without id or vector, zero vectors, and vectors with null, NaN
    or infinite components.
    """
    v = F.col(vector_col).cast("array<double>")
    good = F.expr("size(v) > 0 AND NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) AND exists(v, x -> x <> 0)")
    return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null").filter(good)


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of at most ``k`` groups."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None] - 2 * x @ c.T, axis=1)


class Cells:
    """The cells that hold entries, row by row of the first half's centroids, and how many each holds."""

    def __init__(self, counts: dict[int, int], width: int):
        self.cell = np.array(sorted(counts), np.int64)
        self.count = np.array([counts[c] for c in self.cell.tolist()], np.int64)
        self.column = self.cell % width
        rows, self.start = np.unique(self.cell // width, return_index=True)
        self.row, self.end = rows, np.append(self.start[1:], len(self.cell))


def walk(first: np.ndarray, second: np.ndarray, cells: Cells, enough: int, most: int, strip: float = 0.0) -> list[int]:
    """Places in ``cells`` in order of summed distance, within ``strip``, until they hold ``enough`` entries.

    ``first`` and ``second`` are the distances of a query's halves to either set of
    centroids. A heap holds the next cell of every row that has been opened; rows are
    opened in order of their own distance, once the heap's best can't be sure to
    come before them, and a row gives all its cells within ``strip`` of its next one at
    once. Empty cells are never met. Towards ``enough`` a cell counts for ``most``
    entries at the most, so that a cell of copies doesn't end the walk.
    """
    rows = np.argsort(first[cells.row], kind="stable")
    nearest = float(second.min()) if len(second) else 0.0
    heap: list[tuple[float, int, int]] = []
    orders: list[list[int]] = []
    sums: list[list[float]] = []
    worth = np.minimum(cells.count, most).tolist()
    out, held, opened = [], 0, 0
    while held < enough:
        while opened < len(rows) and (not heap or first[cells.row[rows[opened]]] + nearest <= heap[0][0]):
            r = rows[opened]
            own = second[cells.column[cells.start[r] : cells.end[r]]]
            order = np.argsort(own, kind="stable")
            orders.append((order + cells.start[r]).tolist())
            sums.append((own[order] + first[cells.row[r]]).tolist())
            heapq.heappush(heap, (sums[opened][0], opened, 0))
            opened += 1
        if not heap:
            break
        head, row, k = heapq.heappop(heap)
        end = bisect.bisect_right(sums[row], head + strip, k + 1) if strip else k + 1
        taken = orders[row][k:end]
        out += taken
        held += sum(worth[place] for place in taken)
        if end < len(orders[row]):
            heapq.heappush(heap, (sums[row][end], row, end))
    return out


def needed_share(x: np.ndarray, half: int, one: np.ndarray, two: np.ndarray, k: int, recall: float, queries: int = 256) -> float:
    """Share of ``x`` that walks have to cover so that ``recall`` of the k nearest, found exactly, are in the cells read.

    Measured on the first rows as queries. Of more rows a smaller share is enough,
    as their k nearest are further out.
    """
    q = x[:queries]
    told = -(q[:, :half] @ one.T)[:, nearest(x[:, :half], one)]
    if x.shape[1] > half:
        told -= (q[:, half:] @ two.T)[:, nearest(x[:, half:], two)]
    exact = q @ x.T
    exact[np.arange(len(q)), np.arange(len(q))] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1.0
    best = np.argpartition(-exact, k - 1, axis=1)[:, :k]
    # entries of one cell are read together: those told no further away
    places = [np.searchsorted(np.sort(told[i]), told[i, best[i]], "right") for i in range(len(q))]
    ordered = np.sort(np.concatenate(places))
    return float(ordered[min(len(ordered) - 1, int(np.ceil(recall * len(ordered))))] / len(x))


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, centroids: int = 256, recall: float = 0.94, share: float | None = None,
    fit_on: int = 20_000, measure_on: int = 20_000, shard: int = 4096,
) -> DataFrame:
    """The ``k`` best found of ``vectors`` for each of ``queries`` (both from clean_vectors): query_id, rank, vec_id, score.

    Centroids of either half are fitted on at most ``fit_on`` vectors, at most
    ``centroids`` and one for eight of them; every vector is indexed in the cell of its
    two nearest ones. A query walks the cells by summed inner product until they hold
    ``share`` of all entries, and is compared exactly, in double precision, with all
    entries of those cells; a query's own row is left out. Ties go to the smaller
    vec_id. Without ``share``, it is the one that finds ``recall`` of the k nearest on a
    sample of ``measure_on`` vectors (beside those of the fit, if there are more), so it
    follows the data: little for clustered vectors, more for noise without clusters.

    Cells are laid out in shards of at most about ``shard`` entries; a cell with more,
    such as one of copies, is dealt over several. A shard's entries are read once and
    the queries that visit it stream past them, so a task holds a shard and a batch.
    Repeated rows count once; an id with several vectors stands for its best, as a
    query for its smallest. Empty tables give an empty result; vectors of another
    width than most of the sample take no part.
    """
    spark = vectors.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = vectors.orderBy(F.xxhash64("vec_id", F.lit(11)), "vec_id").limit(fit_on + measure_on).select("v").toArrow()
    if not sample.num_rows:
        return empty
    lengths = pc.list_value_length(sample.column(0))
    width = int(np.bincount(lengths.to_numpy()).argmax())
    half = max(1, width // 2)
    vectors, queries = (df.filter(F.size("v") == width) for df in (vectors, queries))
    queries = queries.repartition(tasks, "vec_id").groupBy("vec_id").agg(F.min("v").alias("v"))
    x = _matrix(sample.filter(pc.equal(lengths, width)).column(0), width)
    fit, rest = x[:fit_on], x[fit_on:]
    groups = max(1, min(centroids, len(fit) // 8))
    one = kmeans(fit[:, :half], groups)
    two = kmeans(fit[:, half:], groups) if width > half else np.zeros((1, 0))
    if share is None:
        share = needed_share(rest if 4 * len(rest) >= len(fit) else x[:measure_on], half, one, two, k, recall)

    def place(m: np.ndarray) -> np.ndarray:
        return nearest(m[:, :half], one).astype(np.int64) * len(two) + (nearest(m[:, half:], two) if width > half else 0)

    def count(batches):
        n = np.zeros(len(one) * len(two), np.int64)
        for b in batches:
            n += np.bincount(place(_matrix(b.column(1), width)), minlength=len(n))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(n[seen])], names=["cell", "n"])

    counted = vectors.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()  # at most centroids^2 rows
    cells = Cells({r["cell"]: r["n"] for r in counted}, len(two))
    total = int(cells.count.sum())
    enough = int(np.ceil(share * total))
    shard = max(1, min(shard, max(32 * k, -(-total // tasks))))  # a shard gives k rows a query: many more entries than that, whatever the tasks
    first_shard, parts = np.zeros(len(cells.cell), np.int64), np.maximum(1, -(-cells.count // shard))
    shards, filled = 0, 0
    for c, n in enumerate(cells.count.tolist()):
        if filled and filled + n > shard:
            shards, filled = shards + 1, 0
        first_shard[c] = shards
        if parts[c] > 1:
            shards, filled = shards + int(parts[c]), 0
        else:
            filled += n

    def entries(batches):
        for b in batches:
            ids = b.column(0).to_numpy().astype(np.int64)
            m = _matrix(b.column(1), width)
            at = np.searchsorted(cells.cell, place(m))
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield _rows(first_shard[at] + salt % parts[at], ids, [r.tobytes() for r in m], [v.tobytes() for v in at.astype("<i4")], 0)

    def asked(batches):
        for b in batches:
            m = _matrix(b.column(1), width)
            a, c = -(m[:, :half] @ one.T), -(m[:, half:] @ two.T)
            out: list[list] = [[] for _ in range(4)]
            for row, (qid, q) in enumerate(zip(b.column(0).to_pylist(), m, strict=True)):
                near = np.array(walk(a[row], c[row], cells, enough, max(1, shard // 4), float(np.ptp(c[row])) / 16), np.int64)
                to = np.repeat(near, parts[near])
                to_shard = np.repeat(first_shard[near], parts[near]) + np.arange(len(to)) - np.repeat(np.cumsum(parts[near]) - parts[near], parts[near])
                by = np.argsort(to_shard, kind="stable")
                to, to_shard = to[by], to_shard[by]
                names, start = np.unique(to_shard, return_index=True)
                raw = q.tobytes()
                for s, visited in zip(names.tolist(), np.split(to, start[1:]), strict=True):
                    for col, v in zip(out, (s, qid, raw, visited.astype("<i4").tobytes()), strict=True):
                        col.append(v)
                if len(out[0]) > 20_000:
                    yield _rows(*out, 1)
                    out = [[] for _ in range(4)]
            yield _rows(*out, 1)

    kind = "shard long, id long, v binary, cells binary, query int"
    met = vectors.mapInArrow(entries, kind).unionByName(queries.mapInArrow(asked, kind))
    met = met.repartition(max(1, min(shards + 1, 8 * tasks)), "shard").sortWithinPartitions("shard", "query", "id")
    found = materialise(met.mapInArrow(_compare(k, width), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return reading(ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), found)


def _rows(shard, ids, vectors: list[bytes], cells: list[bytes], query: int) -> pa.RecordBatch:
    n = len(vectors)
    return pa.RecordBatch.from_arrays(
        [pa.array(shard, pa.int64()), pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(cells, pa.binary()), pa.array(np.full(n, query, np.int32))],
        names=["shard", "id", "v", "cells", "query"],
    )


def _best(ids: np.ndarray, m: np.ndarray, q: np.ndarray, at: np.ndarray, k: int, first: int) -> np.ndarray:
    """The places of ``at`` with the k largest products, one for each id, ties to the smaller id; tried on the ``first`` best, then on all."""
    near = at
    if len(at) > first:
        rough = m[at] @ q
        edge = np.partition(rough, len(at) - first)[len(at) - first]
        near = at[rough >= edge - 1e-9 * max(1.0, abs(edge))]
    score = (m[near] * q).sum(axis=1)  # row by row in one order: equal vectors score equal
    order = np.lexsort((ids[near], -score))
    _, once = np.unique(ids[near][order], return_index=True)
    if len(once) < k and len(near) < len(at):
        return _best(ids, m, q, at, k, len(at))
    return near[order[np.sort(once)][:k]]


def _compare(k: int, width: int):
    """Rows of shards, a shard's entries before its queries, to the k best entries of each query there: (query_id, vec_id, score)."""

    def run(batches):
        shard, parts = None, []  # the entries of the shard at hand, as they come
        ids = m = names = place_of = None
        for b in batches:
            if not b.num_rows:
                continue
            s, query = b.column(0).to_numpy(), b.column(4).to_numpy()
            edges = [0, *(np.flatnonzero((s[1:] != s[:-1]) | (query[1:] != query[:-1])) + 1).tolist(), b.num_rows]
            out: tuple[list, list, list] = ([], [], [])
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if s[lo] != shard:
                    shard, parts, ids = s[lo], [], None
                part = b.slice(lo, hi - lo)
                if not query[lo]:
                    parts.append(part)
                    ids = None
                    continue
                if ids is None:
                    if not parts:
                        continue
                    t = pa.Table.from_batches(parts)
                    ids = t.column("id").to_numpy()
                    m = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float64).reshape(-1, width)
                    cell = np.frombuffer(b"".join(t.column("cells").to_pylist()), "<i4")
                    names, place_of = np.unique(cell, return_inverse=True)
                for qid, raw, visited in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    q, cells = np.frombuffer(raw, np.float64), np.frombuffer(visited, "<i4")
                    read = np.zeros(len(names) + 1, bool)
                    where = np.searchsorted(names, cells)
                    read[where[np.append(names, -1)[where] == cells]] = True
                    at = np.flatnonzero(read[place_of] & (ids != qid))
                    top = _best(ids, m, q, at, k, 4 * k)
                    out[0].extend([qid] * len(top))
                    out[1].extend(ids[top].tolist())
                    out[2].extend((m[top] * q).sum(axis=1).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run
