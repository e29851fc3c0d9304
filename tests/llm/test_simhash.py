import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm import graph, simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "one TWO", "a b c", "A b c d É f É f", "x\x0by\x0cz w\r\nq", "a b " * 40, "no break no break x y"])
def test_fingerprint(text):
    assert simhash.simhash(text.encode() if text is not None else None) == plain_fingerprint(text)


def plain_components(fps, budget=2):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= budget:
                up[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    return {frozenset(g) for g in groups.values() if len(g) > 1}


def balls(seed, centres=12, each=25):
    """Values around centres, so that nodes are crowded; some that differ only where blocks meet."""
    rng = random.Random(seed)
    out = {0, (1 << 64) - 1, 1 << 63, 3 << 62}
    for _ in range(centres):
        c = rng.getrandbits(64)
        for _ in range(each):
            x = c
            for _ in range(rng.randint(0, 5)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    out |= {rng.getrandbits(64) for _ in range(200)}
    return out


@pytest.mark.parametrize("seed,most", [(1, 1024), (2, 8), (3, 3)])
def test_trie_join_finds_every_component(spark, seed, most):
    fps = balls(seed)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.hamming_links(spark.createDataFrame(signed, "fp long"), most=most)
    pairs = [(r["u"] % (1 << 64), r["v"] % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    roots = graph.connected_components(links).collect()
    groups = {}
    for r in roots:
        groups.setdefault(r["root"], set()).add(r["u"] % (1 << 64))
    assert {frozenset(g) for g in groups.values()} == plain_components(fps)


def test_trie_pairs_between_two_nodes():
    rng = np.random.default_rng(5)
    left, right = np.sort(rng.integers(0, 1 << 12, 200, dtype=np.uint64)), np.sort(rng.integers(0, 1 << 12, 200, dtype=np.uint64))
    found = {(int(left[a]), int(right[b])) for i, j in simhash.trie_pairs(left, right, False, 0, 1, leaf=4) for a, b in zip(i, j, strict=True)}
    assert found == {(int(a), int(b)) for a in left for b in right if (int(a) ^ int(b)).bit_count() <= 1}


def test_components_of_chains_and_hubs(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["u"]: r["root"] for r in graph.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 160)} | {200: 200, 201: 200}


def test_edge_rows(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter([1, 2, 3, 4, 5, 5, None, 7, 8])
    comp = {r["doc_id"]: r["component_id"] for r in rows}
    assert (comp[1], comp[4], comp[2], comp[3], comp[5]) == (1, 1, 2, 2, 5) and comp[None] is None
    assert simhash.near_duplicates(no_docs).count() == 0


def test_query_columns(spark, tmp_path, edge_docs):
    from textloom.llm import queries

    edge_docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op4_simhash_components"](spark, str(tmp_path)).collect()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.select("doc_id", "text").collect()}
    assert all(r["fingerprint"] == f"{plain_fingerprint(texts[r['doc_id']]):016x}" for r in rows)


def test_components_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {r["doc_id"]: plain_fingerprint(r["text"]) for r in docs.select("doc_id", "text").collect()}
    comps = plain_components(set(fps.values()))
    for d, f in fps.items():
        mates = next((c for c in comps if f in c), {f})
        assert got[d]["component_id"] == min(x for x, g in fps.items() if g in mates)
    assert docs.select(F.count("*")).first()[0] == len(got)


def plain_shingles(text, size=5):
    words = text.lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def test_similar_documents(spark):
    """Edited copies are found by their overlap, not by two bits; texts below the similarity stay apart."""
    rng = random.Random(11)
    texts = []
    for _ in range(30):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(100, 300))]
        copy = list(words)
        for k in range(len(words) // 60):
            copy[30 + 50 * k] = "edited"
        other = list(words)
        for k in range(0, len(words), 12):
            other[k] = "changed"
        texts += [" ".join(words), " ".join(copy).title(), " ".join(other)]
    texts += ["same line again " * 50 + " ".join(f"a{k}" for k in range(60)), "same line again " * 50 + " ".join(f"b{k}" for k in range(60)), "", " \n"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    sets = [plain_shingles(t) for t in texts]

    def alike(a, b):
        return not (sets[a] | sets[b]) or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])

    want = {b: next((a for a in range(b) if alike(a, b)), b) for b in range(len(texts))}
    assert got == want and sum(a != b for a, b in want.items()) >= 25
    fps = [plain_fingerprint(t) for t in texts]
    assert sum((fps[a] ^ fps[b]).bit_count() > 2 for b, a in want.items()) >= 15  # out of reach of op4's budget


def brute_components(texts, similarity=0.8):
    """Smallest index of each text's component, over all pairs that share a shingle."""
    sets = [plain_shingles(t) for t in texts]
    holders, up = {}, list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, s in enumerate(sets):
        for x in s or {()}:
            holders.setdefault(x, []).append(k)
    for b, s in enumerate(sets):
        shared = {}
        for x in s or {()}:
            for a in holders[x]:
                if a < b:
                    shared[a] = shared.get(a, 0) + 1
        for a, n in shared.items():
            if not s or n >= similarity * (len(s) + len(sets[a]) - n) - 1e-9:
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("most", [3, 2048])
def test_similar_documents_equal_brute_force(spark, most):
    """Chains and families of edited copies, many in one band: every component is whole, and no larger."""
    rng = random.Random(5)
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for family in range(4):
        words = [f"w{rng.randrange(900)}" for _ in range(120)]
        for _ in range(25):  # each an edit of an earlier one: chains run below the similarity
            texts.append(" ".join(words))
            words = list(words)
            words[rng.randrange(120)] = f"edit{rng.randrange(10**6)}"
        base = [f"v{rng.randrange(900)}" for _ in range(100)]
        for _ in range(20):  # alike in about 0.6 to 0.9
            copy = list(base)
            for k in rng.sample(range(100), rng.randrange(2, 6)):
                copy[k] = f"other{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, most=most).collect()}
    assert [got[k] for k in range(len(texts))] == brute_components(texts)
    assert simhash.similar_documents(df.limit(0)).count() == 0


def test_cross_pairs_of_shards():
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 3, (60, 100)).astype(np.uint8)
    n, comp, own = rng.integers(80, 120, 60), rng.integers(0, 9, 60), rng.random(60) < 0.5
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if comp[a] != comp[b] and min(n[a], n[b]) >= 0.3 * max(n[a], n[b]) and (sig[a] == sig[b]).mean() >= 0.3 - 5 * (0.21 / 100) ** 0.5}
    for tile in (7, 1024):
        assert {(a, b) for i, j in simhash.cross_pairs(comp, n, sig, None, 0.3, tile) for a, b in zip(i.tolist(), j.tolist(), strict=True)} == want
        two = {tuple(sorted(x)) for i, j in simhash.cross_pairs(comp, n, sig, own, 0.3, tile) for x in zip(i.tolist(), j.tolist(), strict=True)}
        assert two == {(a, b) for a, b in want if own[a] != own[b]}


@pytest.mark.parametrize("most", [40, 2048])
def test_no_table_holds_the_pairs_of_a_family(spark, monkeypatch, most):
    """240 edits of one text, few alike in 0.8: what is written grows with the texts, not with their pairs."""
    rng = random.Random(9)
    base, texts = [f"w{k}" for k in range(150)], []
    for _ in range(240):
        copy = list(base)
        for k in rng.sample(range(150), rng.randint(2, 5)):
            copy[k] = f"other{rng.randrange(10**6)}"
        texts.append(" ".join(copy))
    written, plain = [], simhash.materialise

    def counted(df):
        out = plain(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(simhash, "materialise", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df, most=most).collect()}
    want = brute_components(texts)
    assert [got[k] for k in range(240)] == want and 10 < len(set(want)) < 230
    assert max(written) <= 20 * len(texts)  # a row for each band


def test_alike_forest():
    """The forest spans the components of all pairs, or of the pairs of two sides."""
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 30))).astype(np.uint64) for _ in range(80)]
    own = rng.random(80) < 0.3
    for side in (None, own):
        pairs = [(i, j) for i in range(80) for j in range(i) if side is None or own[i] != own[j]]
        good = {(i, j) for i, j in pairs if len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j])) - 1e-9}
        forest = simhash.alike_forest(sets, 0.5, side)
        assert {(max(p), min(p)) for p in forest} <= good
        label = list(range(80))
        for i, j in forest:
            assert label[i] != label[j]  # no link within a tree
            label = [label[i] if x == label[j] else x for x in label]
        assert all(label[i] == label[j] for i, j in good) and len(forest) >= 5
