"""SimHash fingerprints, a Hamming self-join over a binary trie, and documents whose shingle sets overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialise, reading, settle, spread_join
from textloom.llm.graph import connected_components

BITS = 64
SEED = 42


def simhash(text: bytes | None, size: int = 3) -> int:
    """Fingerprint of a UTF-8 text as an unsigned integer.

    A-Z are lower-cased, words are runs without ASCII white space, shingles of
    ``size`` words (repeats included) are hashed with XXH64; a bit is set if it
    is set in over half the hashes. Fewer words make one shingle; none, zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[:n].tolist(), ends[size - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 15):
        part = hashes[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """(id, fp long): one row for each row; a null text counts as empty."""

    def run(batches):
        for b in batches:
            texts = b.column(1).cast(pa.large_binary())
            fps = np.array([simhash(t.as_py(), size) for t in texts], np.uint64).astype("<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, width) of budget + 1 blocks that cover all bits."""
    edges = [round(k * BITS / (budget + 1)) for k in range(budget + 2)]
    return list(zip(edges, np.diff(edges).tolist(), strict=False))


def _rotl(x: np.ndarray, k: int) -> np.ndarray:
    k %= BITS
    return x if k == 0 else (x << np.uint64(k)) | (x >> np.uint64(BITS - k))


def trie_pairs(left: np.ndarray, right: np.ndarray, same: bool, depth: int, budget: int, leaf: int = 64):
    """Index pairs of two sorted uint64 arrays whose values differ in at most ``budget`` bits.

    A trie node is a range of a sorted array. Node pairs are walked together from
    ``depth``; the bits in which their paths differ are accumulated and a pair
    past the budget is dropped with all below it. Small pairs are compared at once.
    """
    stack = [(0, len(left), 0, len(right), depth, 0)]
    while stack:
        a, b, c, d, at, spent = stack.pop()
        if a >= b or c >= d:
            continue
        if at >= BITS or (b - a) <= leaf and (d - c) <= leaf:
            i, j = np.nonzero(np.bitwise_count(left[a:b, None] ^ right[None, c:d]) <= budget)
            i, j = i + a, j + c
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j
            continue
        bit = np.uint64(1) << np.uint64(BITS - 1 - at)
        m = a + int(np.count_nonzero((left[a:b] & bit) == 0))
        k = c + int(np.count_nonzero((right[c:d] & bit) == 0))
        stack += [(a, m, c, k, at + 1, spent), (m, b, k, d, at + 1, spent)]
        if spent < budget:
            stack.append((a, m, k, d, at + 1, spent + 1))
            if not (same and a == c and b == d):  # its mirror image has been pushed
                stack.append((m, b, c, k, at + 1, spent + 1))


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """A spanning forest of the pairs: the same components with fewer than n links."""
    up, kept = list(range(n)), []

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    label = np.arange(n)
    for i, j in pairs:
        new = label[i] != label[j]
        for x, y in zip(i[new].tolist(), j[new].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q:
                up[p] = q
                kept.append((x, y))
        if len(i) > n:  # so many pairs pay for labels that spare those already joined
            label = np.array([find(x) for x in range(n)])
    return kept


def _walk(budget: int):
    starts = [s for s, _ in _blocks(budget)]

    def groups(batches):
        """Runs of equal (r, depth, a, b) across batches; each run fits in memory by construction."""
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5)])
            if kept:
                x = np.concatenate([*kept, x], axis=1)
            cut = np.flatnonzero((x[:4, 1:] != x[:4, :-1]).any(0)) + 1
            edges = [0, *cut.tolist(), x.shape[1]]
            for lo, hi in zip(edges[:-2], edges[1:-1], strict=True):
                if hi - lo > 1:
                    yield x[:, lo:hi]
            kept = [x[:, edges[-2] :]]
        if kept and kept[0].shape[1] > 1:
            yield kept[0]

    def run(batches):
        out = []
        for g in groups(batches):
            r, depth, a, b = (int(v) for v in g[:4, 0])
            rot = np.unique(g[4].view(np.uint64))  # unsigned order is the trie's order
            if a == b:
                left = right = rot
            else:
                own = (rot >> np.uint64(BITS - depth)) == np.uint64(a)
                left, right = rot[own], rot[~own]
            if a == b:
                links = [(rot[i], rot[j]) for i, j in _forest(len(rot), trie_pairs(rot, rot, True, depth, budget))]
            else:
                shift = len(left)
                pairs = ((i, j + shift) for i, j in trie_pairs(left, right, False, depth, budget))
                both = np.concatenate([left, right])
                links = [(both[i], both[j]) for i, j in _forest(len(both), pairs)]
            if links:
                out.append(_rotl(np.array(links, np.uint64), BITS - starts[r]))
            if len(out) > 2000:
                yield _edges(out)
                out = []
        yield _edges(out)

    return run


def _edges(out: list[np.ndarray]) -> pa.RecordBatch:
    x = (np.concatenate(out) if out else np.empty((0, 2), np.uint64)).astype("<u8").view("<i8").reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["u", "v"])


def hamming_links(fps: DataFrame, budget: int = 2, most: int = 1024, step: int = 4) -> DataFrame:
    """Links (u, v) that connect the distinct ``fp`` values within ``budget`` bits, directly or over others.

    Two values within the budget agree on one of budget + 1 blocks of bits, so
    there is one trie for each block, with that block's bits first, and the walk
    starts at the nodes below it with nothing spent. A node pair (r, depth, a, b)
    with more than ``most`` values is split ``step`` bits deeper: each value goes
    to the pairs of child nodes that the rest of the budget allows. So no task
    holds more than ``most`` values, however many meet at a node, and no pair is
    lost. Of each node pair's links a spanning forest is returned.
    """
    rows = []
    for r, (start, width) in enumerate(_blocks(budget)):
        rot = F.col("fp") if not start else F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", BITS - start))
        rows.append(F.struct(F.lit(r).alias("r"), F.lit(width).alias("depth"), rot.alias("rot")))
    key = ["r", "depth", "a", "b"]
    items = (
        fps.select("fp").distinct().select(F.explode(F.array(*rows)).alias("x")).select("x.*")
        .withColumn("a", F.expr("shiftrightunsigned(rot, 64 - depth)")).withColumn("b", F.col("a"))
        .select(*key, "rot")
    )
    prefix = F.expr("shiftrightunsigned(rot, 64 - depth)")
    items = materialise(items)
    done: list[DataFrame] = []
    written = [items]
    masks = [m for m in range(1 << step) if bin(m).count("1") <= budget]
    while True:
        nodes = items.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min(prefix).alias("p"), F.max(prefix).alias("q"))
        large = materialise(nodes.filter((F.col("n") > most) & (F.col("depth") <= BITS - step) & ((F.col("a") == F.col("b")) | (F.col("p") != F.col("q")))).select(*key))
        written.append(large)
        if not large.take(1):
            done.append(items)
            break
        done.append(items.join(large, key, "left_anti"))
        low = F.expr(f"shiftrightunsigned(rot, 64 - depth - {step})").bitwiseAND(F.lit((1 << step) - 1))
        own, other = F.shiftleft(prefix, step).bitwiseOR(low), F.when(prefix == F.col("a"), F.col("b")).otherwise(F.col("a"))
        far = F.shiftleft(other, step).bitwiseOR(low.bitwiseXOR(F.col("m")))
        first = F.when(F.col("a") == F.col("b"), own <= far).otherwise(prefix == F.col("a"))
        spread = (
            items.join(large, key, "left_semi")
            .select("*", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("m"))
            .filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) + F.bit_count("m") <= budget)
            .select(
                "r", (F.col("depth") + step).alias("depth"),
                F.when(first, own).otherwise(far).alias("a"), F.when(first, far).otherwise(own).alias("b"), "rot",
            )
        )
        items = materialise(spread)
        written.append(items)
    every = done[0]
    for d in done[1:]:
        every = every.union(d)
    return reading(every.repartition(*key).sortWithinPartitions(*key).mapInArrow(_walk(budget), "u long, v long"), *written)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, budget: int = 2) -> DataFrame:
    """(id, fp, component_id): each document with the smallest id reachable over links.

    Fingerprints link at ``budget`` or fewer differing bits. Copies of one
    fingerprint are one vertex. A null text counts as empty; empty texts have
    fingerprint zero and link like any other; a null id keeps its row and counts
    for no minimum. An empty table gives an empty result. Only ``id_col`` and
    ``text_col`` are read, so other columns can't clash.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, size).toDF("id", "fp"))
    vertices = fps.groupBy("fp").agg(F.min("id").alias("least"))
    links = settle(hamming_links(vertices, budget))
    roots = connected_components(links)
    discard(links)
    of_fp = settle(component_minima(vertices, roots, "fp"))
    return reading(spread_join(fps, of_fp.select("fp", "component_id"), ["fp"]).select(F.col("id").alias(id_col), "fp", "component_id"), fps, of_fp)


def component_minima(vertices: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """(key, root, component_id): each vertex (key, least) with the root of its component and the smallest ``least`` in it."""
    rooted = materialise(vertices.select(key, "least").join(roots.toDF(key, "root"), key, "left").withColumn("root", F.coalesce("root", key)))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return reading(spread_join(rooted, least, ["root"]).select(key, "root", "component_id"), roots, rooted)


# Documents that are alike by an exact measure ------------------------------------------------

#: Odd multipliers that make one hash of the hashes of a shingle's words.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` (at most 8) words; words are those of simhash()."""
    words = (text or b"").lower().split()
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += hashes[k : k + n] * _MIX[k]
    return np.unique(total)


#: Bands of minima, and minima in a band: texts alike in 0.8 of their shingles share a band with probability 0.9996.
BANDS, ROWS = 20, 5
_ODD = (np.random.default_rng(8).integers(0, 1 << 63, (2, BANDS * ROWS), np.uint64) << np.uint64(1)) | np.uint64(1)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least of each of BANDS * ROWS hashes over a set of shingles; all ones for an empty set."""
    out = np.full(BANDS * ROWS, ~np.uint64(0))
    for k in range(0, len(shingles), 2048):
        out = np.minimum(out, (shingles[k : k + 2048, None] * _ODD[0] + _ODD[1]).min(0))
    return out


def _vertices(docs: DataFrame, words: int) -> DataFrame:
    """(id, vid, fp, n, sig, bands) of each (id, vid, text) row: fingerprint and number of the distinct shingles, a byte of each minimum, and the bands' hashes."""

    def run(batches):
        for b in batches:
            fps, ns, sigs, bands = [], [], [], []
            for t in b.column(2).cast(pa.large_binary()):
                s = shingle_set(t.as_py(), words)
                m = minima(s)
                bits = np.unpackbits(s.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64) if len(s) else np.zeros(BITS, np.int64)
                fps.append(int(np.packbits(2 * bits > len(s), bitorder="little").view("<i8")[0]))
                ns.append(len(s))
                sigs.append((m >> np.uint64(40)).astype(np.uint8).tobytes())
                bands.append((m.reshape(BANDS, ROWS) * _MIX[:ROWS]).sum(1, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "vid", "fp", "n", "sig", "bands"],
            )

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, vid long, fp long, n long, sig binary, bands array<long>")


def cross_pairs(comp: np.ndarray, n: np.ndarray, sig: np.ndarray, own: np.ndarray | None, similarity: float, tile: int = 1024):
    """Index pairs of different components whose set sizes allow the similarity and whose signatures don't rule it out.

    ``own`` marks one side, if there are two. Signatures are ruled out at five
    standard deviations below ``similarity``.
    """
    width = sig.shape[1]
    enough = similarity - 5 * (similarity * (1 - similarity) / width) ** 0.5
    left, right = (np.arange(len(n)),) * 2 if own is None else (np.flatnonzero(own), np.flatnonzero(~own))
    for k in range(0, len(left), tile):
        x = left[k : k + tile]
        for c in range(0 if own is not None else k, len(right), tile):
            y = right[c : c + tile]
            may = (comp[x][:, None] != comp[y][None, :]) & (np.minimum(n[x][:, None], n[y][None, :]) >= similarity * np.maximum(n[x][:, None], n[y][None, :]) - 1e-6)
            if own is None and c == k:
                may &= np.arange(len(x))[:, None] < np.arange(len(y))[None, :]
            i, j = np.nonzero(may)
            for z in range(0, len(i), 1 << 16):
                p, q = x[i[z : z + (1 << 16)]], y[j[z : z + (1 << 16)]]
                good = (sig[p] == sig[q]).mean(1) >= enough
                yield p[good], q[good]


def _whole_groups(batches, keys: int):
    """(table, edges) of batches sorted by their first ``keys`` columns: whole groups, and where each begins and the last ends."""
    kept = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if kept is None else pa.concat_tables([kept, t])
        key = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(keys)])
        edges = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), t.num_rows]
        if len(edges) > 2:
            yield t.slice(0, edges[-2]), edges[:-1]
        kept = t.slice(edges[-2])
    if kept is not None:
        yield kept, [0, kept.num_rows]


def _links(vid: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    u, v = vid[pairs[:, 0]], vid[pairs[:, 1]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["u", "v"])


def _band_forests(similarity: float):
    """Batches of (r, a, vid, n, sig), sorted by the first two, to links (u, v): a spanning forest of each group's cross_pairs()."""

    def run(batches):
        for t, edges in _whole_groups(batches, 2):
            n = t.column("n").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            found = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                pairs = _forest(hi - lo, cross_pairs(np.arange(hi - lo), n[lo:hi], sig[lo:hi], None, similarity))
                found += [(lo + i, lo + j) for i, j in pairs]
            yield _links(t.column("vid").to_numpy(), np.array(found, np.int64).reshape(-1, 2))

    return run


def alike_forest(sets: list[np.ndarray], similarity: float, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs that span the components of the sets of at least the Jaccard similarity, counted exactly.

    Each set is held once against all that no search has reached yet, so a group of
    copies costs a single look at each. ``own`` marks one side, if only pairs of two
    sides count.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    ends = np.cumsum(sizes)
    sets = [codes[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
    marked = np.zeros(len(codes), np.uint8)
    alive, held, body, kept, queue = np.ones(len(sets), bool), np.arange(len(sets)), codes, [], []
    start = 0
    while True:
        if not queue:
            while start < len(sets) and not alive[start]:
                start += 1
            if start == len(sets):
                return kept
            alive[start] = False
            queue.append(start)
        i = queue.pop()
        n = int(np.count_nonzero(alive))
        if not n:
            return kept
        if 2 * n < len(held):
            held = np.flatnonzero(alive)
            body = np.concatenate([sets[k] for k in held])
        marked[sets[i]] = 1
        last = np.cumsum(sizes[held])
        upto = np.concatenate([[0], np.cumsum(marked[body], dtype=np.int64)])
        marked[sets[i]] = 0
        shared = upto[last] - upto[last - sizes[held]]
        good = alive[held] & (shared >= similarity * (sizes[i] + sizes[held] - shared) - 1e-9)
        if own is not None:
            good &= own[held] != own[i]
        hits = held[good]
        alive[hits] = False
        kept += [(i, k) for k in hits.tolist()]
        queue += hits.tolist()


def _text_forests(similarity: float, words: int):
    """Batches of (a, p, q, side, vid, text), sorted by the first three, to links (u, v): alike_forest() of each group.

    side is 0 or 1, if pairs of two sides count, or 2.
    """

    def run(batches):
        for t, edges in _whole_groups(batches, 3):
            side, found = t.column("side").to_numpy(), []
            texts = t.column("text").cast(pa.large_binary())
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo > 1:
                    sets = [shingle_set(x.as_py(), words) for x in texts.slice(lo, hi - lo)]
                    found += [(lo + i, lo + j) for i, j in alike_forest(sets, similarity, None if side[lo] == 2 else side[lo:hi] == 1)]
            yield _links(t.column("vid").to_numpy(), np.array(found, np.int64).reshape(-1, 2))

    return run


def _forests_of(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    key = ["a", "p", "q"]
    return rows.select(*key, "side", "vid", "text").repartition(*key).sortWithinPartitions(*key).mapInArrow(_text_forests(similarity, words), "u long, v long")


def _across_shards(held: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows (a, p, q, side, vid, text) of the pairs left to count in classes of several shards.

    Of each class the texts of its largest component so far meet all others of the
    class, and these meet each other; the largest one's texts needn't meet again.
    """
    wide = held.filter("shards > 1")
    placed = materialise(wide.select("vid", "root", "shards").join(roots.toDF("vid", "comp"), "vid", "left").withColumn("comp", F.coalesce("comp", "vid")))
    parts = placed.groupBy("root", "shards", "comp").agg(F.count(F.lit(1)).alias("c"))
    main = parts.groupBy("root", "shards").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.max_by("comp", F.struct("c", "comp")).alias("main")).filter("m > most")
    share = lambda c: F.ceil(F.col("shards") * c / F.col("m")).cast("int")
    main = main.select("root", "main", share(F.col("most")).alias("sa"), share(F.col("m") - F.col("most")).alias("sb"))
    sided = spread_join(placed.drop("shards"), main, ["root"]).withColumn("own", F.col("comp") == F.col("main"))
    sided = sided.withColumn("h", F.pmod(F.xxhash64("vid"), F.when(F.col("own"), F.col("sa")).otherwise(F.col("sb"))).cast("int"))
    cell = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    ours = F.transform(upto("sb"), lambda j: cell(F.col("h"), j, F.lit(1)))
    theirs = F.transform(upto("sa"), lambda i: cell(i, F.col("h"), F.lit(0)))
    each = F.transform(upto("sb"), lambda k: cell(-1 - F.least("h", k), F.greatest("h", k), F.when(F.col("h") == k, 2).when(F.col("h") < k, 1).otherwise(0)))
    dealt = sided.select("vid", F.col("root").alias("a"), F.explode(F.when(F.col("own"), ours).otherwise(F.concat(theirs, each))).alias("x"))
    return reading(dealt.select("vid", "a", "x.*").join(wide.select("vid", "text"), "vid"), placed)


def similar_texts(named: DataFrame, similarity: float = 0.8, words: int = 5, budget: int = 2, most: int = 2048, weight: int = 1 << 20) -> DataFrame:
    """(vid, root, component_id), written: each text of ``named`` (id, vid, text) with the smallest vid and the smallest id of its component.

    Texts are alike if the sets of their shingles of ``words`` words have a Jaccard
    similarity of at least ``similarity``. Candidates come from the trie join of
    SimHash fingerprints, at ``budget`` or fewer differing bits, and, as texts alike
    in 0.8 differ in about ten of 64 bits, also from bands of minima of the shingles'
    hashes (BANDS, ROWS). They only make classes: of a band's pairs that sizes and
    signatures don't rule out, a spanning forest links the texts; a band of over
    ``most`` texts is linked as a whole. Then each class's texts go once to one task,
    which counts overlaps exactly and returns a spanning forest. So no step makes a
    row for each pair of a group, and no pair of a shared band is left out.

    A class of over ``most`` texts or ``weight`` shingles is dealt into shards. Pairs
    of different shards are counted after that, but for those of the class's largest
    component, which need no further link.
    """
    texts = named.select("vid", "text")
    vertices = materialise(_vertices(named, words).groupBy("vid").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.min("id").alias("least")))
    # texts of one fingerprint meet at the smallest of them, and fingerprints by their smallest texts
    of_fp = vertices.groupBy("fp").agg(F.min("vid").alias("v"))
    close = settle(hamming_links(of_fp, budget))
    first_of = of_fp.toDF("fp", "w")
    by_trie = close.toDF("fp", "far").join(first_of, "fp").select(F.col("far").alias("fp"), F.col("w").alias("a")).join(first_of, "fp").select("a", F.col("w").alias("b"))
    by_copy = spread_join(vertices.select("vid", "fp"), of_fp, ["fp"]).select(F.col("v").alias("a"), F.col("vid").alias("b"))
    band = Window.partitionBy("r", "a")
    members = vertices.select("vid", F.posexplode("bands").alias("r", "a")).withColumns({"m": F.count(F.lit(1)).over(band), "least": F.min("vid").over(band)})
    members = materialise(members.filter("m > 1"))
    by_band = members.filter(F.col("m") > most).select(F.col("least").alias("a"), F.col("vid").alias("b"))
    signed = members.filter(F.col("m") <= most).join(vertices.select("vid", "n", "sig"), "vid").select("r", "a", "vid", "n", "sig")
    by_sign = signed.repartition("r", "a").sortWithinPartitions("r", "a").mapInArrow(_band_forests(similarity), "u long, v long")
    classes = settle(connected_components(by_trie.union(by_copy).union(by_band).toDF("u", "v").union(by_sign)))
    for t in (close, members):
        discard(t)
    sized = materialise(classes.toDF("vid", "root").join(vertices.select("vid", "n"), "vid"))
    discard(classes)
    shards = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(float(most)), F.sum("n") / F.lit(float(weight)))).cast("int")
    placed = spread_join(sized.drop("n"), sized.groupBy("root").agg(shards.alias("shards")), ["root"])
    held = materialise(texts.join(placed, "vid").groupBy("vid", "root", "shards").agg(F.first("text").alias("text")))
    discard(sized)
    home = F.pmod(F.xxhash64("vid"), F.col("shards")).cast("int")
    found = materialise(_forests_of(held.select(F.col("root").alias("a"), home.alias("p"), home.alias("q"), F.lit(2).alias("side"), "vid", "text"), similarity, words))
    roots = settle(connected_components(found))
    if held.filter("shards > 1").take(1):
        rest = _across_shards(held, roots)
        also = settle(reading(_forests_of(rest, similarity, words), rest))
        discard(roots)
        roots = settle(connected_components(found.union(also)))
        discard(also)
    for t in (held, found):
        discard(t)
    of_vid = settle(component_minima(vertices, roots, "vid"))
    discard(vertices)
    return of_vid


def named_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, vid, text): vid is a hash of the text, and a null text counts as empty."""
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("vid"), F.col(text_col).alias("text"))


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, words: int = 5, budget: int = 2, most: int = 2048
) -> DataFrame:
    """(id, vid, component, component_id): each document with its component of texts that are alike, and the smallest id in it.

    Texts are alike as in similar_texts(). vid is a hash of the text, component the
    smallest vid of a component (ids may be repeated, so that two components can have
    one smallest id); equal texts are one vertex, a null text is empty, two texts
    without words are alike, and a null id counts for no minimum. An empty table
    gives an empty result.
    """
    named = named_texts(docs, id_col, text_col)
    of_vid = similar_texts(named, similarity, words, budget, most)
    rows = materialise(named.select("id", "vid"))
    out = spread_join(rows, of_vid, ["vid"]).select(F.col("id").alias(id_col), "vid", F.col("root").alias("component"), "component_id")
    return reading(out, rows, of_vid)
