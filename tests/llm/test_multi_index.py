import numpy as np

from textloom.llm import multi_index as M


def exact(ids, x, q, k=20):
    s = np.array([float(np.dot(v, x[list(ids).index(q)])) for v in x])
    order = sorted((-s[i], ids[i]) for i in range(len(ids)) if ids[i] != q)
    return [i for _, i in order[:k]]


def frame(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r] if r is not None else None) for i, r in rows], "vec_id long, embedding array<float>")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(6000, 32)).astype(np.float32)
    v = M.clean_vectors(frame(spark, enumerate(x)))
    got = M.search(v, v.filter("vec_id % 200 = 0")).toPandas()
    ids, hit = np.arange(len(x)), 0
    xd = x.astype(np.float64)
    for q, g in got.groupby("query_id"):
        assert g.sort_values("rank")["rank"].tolist() == list(range(1, 21))
        s = xd @ xd[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20]) & set(g["vec_id"]))
        assert np.allclose(g["score"], s[g["vec_id"]], rtol=1e-12) and (np.diff(g.sort_values("rank")["score"]) <= 0).all()
    assert hit >= 0.9 * len(got) and len(ids) == 6000


def test_a_whole_walk_is_exact(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    v = M.clean_vectors(d)
    got = M.search(v, v.filter("vec_id % 20 = 0"), shard=50, share=1.0).toPandas()
    pdf = v.toPandas()
    ids, x = pdf["vec_id"].tolist(), [np.array(r) for r in pdf["v"]]
    for q in list(got["query_id"].unique())[:6]:
        assert got[got["query_id"] == q].sort_values("rank")["vec_id"].tolist() == exact(ids, x, q)


def test_copies_ties_and_bad_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(k, [1.0, 0.0]) for k in range(300)] + [(1000, [0.0, 0.0]), (1001, [nan, 1.0]), (1002, [inf, 1.0]), (1003, None), (1004, [0.5, 0.5])]
    df = frame(spark, rows).union(spark.sql("select 1005L, array(cast(null as float), 1f)")).union(spark.sql("select cast(null as bigint), array(1f, 1f)"))
    v = M.clean_vectors(df)
    assert v.count() == 301
    got = M.search(v, v.filter("vec_id % 20 = 0"), shard=16).toPandas()
    for q, g in got.groupby("query_id"):
        assert g.sort_values("rank")["vec_id"].tolist() == [i for i in range(22) if i != q][:20] and set(g["score"]) == {1.0}
    few = M.clean_vectors(frame(spark, [(0, [1.0]), (20, [2.0]), (3, [-1.0])]))
    rows = [tuple(r) for r in M.search(few, few.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 20, 2.0), (0, 2, 3, -1.0), (20, 1, 0, 2.0), (20, 2, 3, -2.0)]
    twice = M.search(few.union(few), few.union(few).filter("vec_id % 20 = 0"))
    assert [tuple(r) for r in twice.orderBy("query_id", "rank").collect()] == rows
    odd = M.clean_vectors(frame(spark, [(k, [1.0, float(k)]) for k in range(60)] + [(60, [1.0, 2.0, 3.0])]))
    assert M.search(odd, odd.filter("vec_id % 20 = 0")).count() == 60
    assert M.search(v.limit(0), v.limit(0)).count() == 0


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    counts = {k: 1 + k % 3 for k in range(63) if k % 5}
    cells = M.Cells(counts, 7)
    told = M.walk(a, b, cells, 10**9, 10)
    sums = [a[c // 7] + b[c % 7] for c in cells.cell[told]]
    assert sorted(told) == list(range(len(counts))) and sums == sorted(sums)
    assert M.walk(a, b, cells, 5, 10) == told[: next(k for k in range(1, 9) if sum(cells.count[told[:k]]) >= 5)]
    strips = M.walk(a, b, cells, 10**9, 10, 0.3)
    sums = np.array([a[c // 7] + b[c % 7] for c in cells.cell[strips]])
    assert sorted(strips) == sorted(told) and (sums >= np.maximum.accumulate(sums) - 0.3 - 1e-12).all()
    assert M.walk(a, b, M.Cells({}, 7), 5, 10) == []


def test_the_index_prunes(spark):
    """The share is measured, is far below the whole for clustered vectors, and walks read no more than a cell or strip beyond it."""
    rng = np.random.default_rng(7)
    noise = rng.normal(size=(3000, 32))
    clustered = np.repeat(rng.normal(size=(60, 32)), 50, axis=0) + 0.1 * rng.normal(size=(3000, 32))
    shares = {}
    for name, x in (("noise", noise), ("clustered", clustered)):
        one, two = M.kmeans(x[:, :16], 128), M.kmeans(x[:, 16:], 128)
        shares[name] = share = M.needed_share(x, 16, one, two, 20, 0.94)
        cell = M.nearest(x[:, :16], one) * len(two) + M.nearest(x[:, 16:], two)
        cells = M.Cells({int(c): int(n) for c, n in zip(*np.unique(cell, return_counts=True), strict=True)}, len(two))
        hit = 0
        for q in range(100):
            seen = M.walk(-(one @ x[q, :16]), -(two @ x[q, 16:]), cells, int(share * 3000), 10**9)
            assert cells.count[seen].sum() < share * 3000 + cells.count.max()
            s = x @ x[q]
            s[q] = -np.inf
            hit += np.isin(cell[np.argsort(-s)[:20]], cells.cell[seen]).sum()
        assert hit >= 0.9 * 2000
    assert shares["noise"] < 0.45 and shares["clustered"] < 0.05


def test_an_id_with_several_vectors_stands_once(spark):
    rows = [(k, [1.0, float(k)]) for k in range(60)] + [(k, [2.0, float(k)]) for k in range(0, 60, 3)]
    v = M.clean_vectors(frame(spark, rows))
    got = M.search(v, v.filter("vec_id % 20 = 0"), share=1.0, shard=8).toPandas()
    assert len(got) == 60 and not got.duplicated(["query_id", "vec_id"]).any()
    best = {k: [(1.0, float(k))] + [(2.0, float(k))] * (k % 3 == 0) for k in range(60)}
    for q, g in got.groupby("query_id"):
        own = min(best[q])
        score = sorted((-max(own[0] * a + own[1] * b for a, b in vs), k) for k, vs in best.items() if k != q)
        assert g.sort_values("rank")["vec_id"].tolist() == [k for _, k in score[:20]]
