import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.operators import contracts, evaluation, inference, profile


def frame(spark, values, kind="double"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 50, 7, 8], [5, 5, 5, 5], [], [3], [1, 2], [1, 2, 9], [None, 4, 4, 5, 9, 1]])
def test_distribution_equals_pandas(spark, values):
    r = profile.distribution(frame(spark, [float(v) if v is not None else None for v in values]), "x").first()
    s = pd.Series([v for v in values if v is not None], dtype=float)

    def nz(v):
        return 0.0 if v is None or (isinstance(v, float) and math.isnan(v)) else v

    want = {"count": len(s), "mean": nz(s.mean()), "std": nz(s.std(ddof=0)), "skew": nz(s.skew()), "kurt": nz(s.kurt()), "min": nz(s.min()), "max": nz(s.max()), "sum": s.sum(), **{f"p{q}": nz(s.quantile(q / 100)) for q in (5, 25, 75, 95)}, "median": nz(s.median())}
    for k, v in want.items():
        assert r[k] == pytest.approx(v, abs=1e-9), k


def test_outliers_histogram_ratio(spark):
    df = frame(spark, [10.0, 11.0, 11.0, 12.0, 13.0, 14.0, 15.0, 100.0])
    r = profile.iqr_outliers(df, "x").first()
    assert (r["q1"], r["q3"], r["mild_fence"], r["extreme_fence"], r["mild"], r["extreme"]) == (11, 14.25, 19.125, 24.0, 1, 1)
    assert profile.iqr_outliers(df.limit(0), "x").first()["mild"] == 0
    h = profile.histogram(frame(spark, [0, 199, 200, 2999, 3000, None], "long"), "x", 200).orderBy("bin").collect()
    assert [(r["bin"], r["label"], r["n"]) for r in h] == [(0, "0-200", 2), (1, "200-400", 1), (14, "2800-3000", 1)]
    pairs = spark.createDataFrame([("a b c d", "x y"), ("a", "")], "source string, target string")
    assert [r["ratio"] for r in profile.with_ratio(pairs).collect()] == [2.0, None]
    assert profile.ratio_stats(profile.with_ratio(pairs)).first()["mean"] == 2.0


def test_ngrams_vocabulary_terms(spark):
    pairs = spark.createDataFrame([("O gato viu", "o GATO dormiu cedo"), ("a", "b"), ("", ""), ("x y", "x y")], "source string, target string")
    got = {r["n"]: r for r in profile.novel_ngrams(pairs).collect()}
    assert got[1]["mean"] == pytest.approx((50 + 0) / 2) and got[2]["mean"] == pytest.approx((200 / 3 + 0) / 2) and got[3]["mean"] == 100.0 and got[3]["pairs"] == 1
    v = profile.vocabulary(pairs).first()
    assert (v["source_size"], v["target_size"], v["union_size"], v["shared"]) == (7, 8, 10, 5)  # each side has one null of its empty text
    terms = profile.top_terms(spark.createDataFrame([("(Casa), casa para ab [CPF] zeta; alfa",)], "t string"), "t", 3).collect()
    assert [(r["term"], r["weight"]) for r in terms] == [("casa", 2), ("alfa", 1), ("zeta", 1)]


def test_topics_fold_the_rest(spark):
    rows = ["PREVIDENCIÁRIO. x", "previdenciário. y", "Civil e Penal. z", "FGTS. w", "nada. v", "TRIBUTÁRIO"]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = {r["topic"]: r["n"] for r in profile.topic_distribution(df, profile.topic_of("t"), top=2).collect()}
    assert got == {"Previdenciário": 2, "Civil": 1, "Outros": 3}


def test_anomalies(spark):
    df = spark.createDataFrame([("train", "VOTO-EMENTA x", K.TRUNCATED_TARGET), ("test", "ok", "1) abc"), ("test", "ok", "w " * 301), ("train", None, None), ("train", "ok", "despacho.")], "split string, source string, target string")
    labels = [r["l"] for r in df.select(profile.anomaly_labels("target").alias("l")).collect()]
    assert labels == [["trunc_8w_exata"], ["ementa_start_digit"], ["ementa_longa_anomala"], [], ["despacho_ementa"]]
    got = {r["kind"]: (r["total"], r["train"], r["test"]) for r in profile.anomaly_summary(df).collect()}
    assert got == {"rotulos_corrompidos": (4, 2, 2), "inputs_contaminados": (1, 1, 0)}


def test_ranks_and_spearman(spark):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 40, 500), rng.integers(0, 9, 500)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y, strict=True)], "x long, y long")
    assert profile.spearman(df, "x", "y").first()["rho"] == pytest.approx(pd.Series(x).rank().corr(pd.Series(y).rank()))
    t = profile.linear_trend(df, "x", "y").first()
    assert [t["slope"], t["intercept"]] == pytest.approx(list(np.polyfit(x, y, 1)))


@pytest.mark.parametrize("raw,ok", [("2025-01-01 12:34:56.123456-03", True), ("2025-01-01T10:00:00Z", True), ("2025-01-01", True), ("2025-01-01 10:00+03:00", True), ("2025", False), ("10:00", False), ("31/01/2025", False), ("2025-13-01", False), (" ", False), (None, False)])
def test_dates(spark, raw, ok):
    df = spark.createDataFrame([(raw,)], "d string")
    assert (contracts.invalid_dates(df, "d").count() == 0) == ok
    if ok:
        assert str(contracts.require_dates(df, "d", "t").first()["d"]).startswith(raw[:10])
    else:
        with pytest.raises(contracts.ContractError):
            contracts.require_dates(df, "d", "t")


def test_split_strata_sample(spark):
    df = spark.createDataFrame([(i, f"2025-01-{1 + i // 4:02d} 00:00:00") for i in range(40)], "i long, t string").repartition(5)
    test = {r["i"] for r in evaluation.chronological_split(df, "t", "i", 0.25).filter("split = 'test'").collect()}
    assert test == set(range(30, 40))
    assert evaluation.chronological_split(df.limit(5), "t", "i", 0.1).filter("split = 'test'").count() == 0
    for n, sizes in ((10, [3, 2, 3, 2]), (4, [1, 1, 1, 1]), (41, [11, 10, 10, 10])):
        s = evaluation.quartile_strata(spark.range(n).withColumn("len", F.lit(1)), "len", "id").groupBy("stratum").count().orderBy("stratum").collect()
        assert [r["count"] for r in s] == sizes
    with pytest.raises(ValueError):
        evaluation.quartile_strata(spark.range(3), "id", "id")
    assert evaluation.stratified_sample(spark.range(100).withColumn("s", F.col("id") % 4), "s", F.col("id"), 3).count() == 12


def test_joins_and_grids(spark):
    cases = spark.createDataFrame([("a", "s", "r"), ("b", "s", "r")], "case_id string, source string, reference string")
    full = spark.createDataFrame([(c, k, "t") for c in "ab" for k in ("qwen_ft", "gemini_ft")], "case_id string, condition_id string, candidate string")
    assert evaluation.join_predictions(cases, full).count() == 4
    for bad, what in ((full.limit(3), "without"), (full.union(spark.createDataFrame([("z", "qwen_ft", "t")])), "unknown"), (full.union(full.limit(1)), "duplicate")):
        with pytest.raises(contracts.ContractError, match=what):
            evaluation.join_predictions(cases, bad)
    assert evaluation.join_predictions(cases, full.limit(3), complete=False).count() == 3
    assert evaluation.pending(cases, cases.limit(1), "case_id").count() == 1
    items = evaluation.blinded_items(full)
    assert sorted(r["item_id"] for r in items.collect()) == ["a_A", "a_B", "b_A", "b_B"]
    package, key = evaluation.blind_package(items)
    assert "condition_id" not in str(package.schema) and key.count() == 4
    grid = evaluation.rating_grid(items)
    assert grid.count() == 4 * 2 * 4
    ratings = grid.withColumn("rating", F.lit(4))
    evaluation.require_grid(grid, ratings)
    with pytest.raises(contracts.ContractError, match="incomplete"):
        evaluation.require_grid(grid, ratings.filter("criterion <> 'fluencia'"))
    named = evaluation.unblind(ratings, key)
    assert {r["mean"] for r in evaluation.rating_means(named).collect()} == {4.0}
    kappa = evaluation.cohen_kappa(evaluation.rater_pairs(named, ["avaliador_1", "avaliador_2"]), "avaliador_1", "avaliador_2", ["criterion"])
    assert {r["kappa"] for r in kappa.collect()} == {1.0}


def plain_kappa(a, b):
    o = np.zeros((5, 5))
    for x, y in zip(a, b, strict=True):
        o[x - 1, y - 1] += 1
    w = (np.subtract.outer(np.arange(5), np.arange(5)) / 4.0) ** 2
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    return (1.0 if not (w * o).sum() else 0.0) if not (w * e).sum() else 1 - (w * o).sum() / (w * e).sum()


@pytest.mark.parametrize("a,b", [([1, 2, 3, 4, 5, 5], [1, 3, 3, 4, 4, 1]), ([4, 4], [4, 4]), ([4, 4], [2, 2]), ([3], [5])])
def test_kappa(spark, a, b):
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert evaluation.cohen_kappa(df, "a", "b").first()["kappa"] == pytest.approx(plain_kappa(a, b))


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_rouge(spark):
    rows = [("the cat sat", "the cat sat"), ("a b", "c d"), ("a a a b", "a a c"), ("decisão útil", "decisao util"), ("", "x"), ("p q r s t", "p x r y t")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, r string, c string")
    for method in ("arrow", "native"):
        got = {r["i"]: r for r in evaluation.rouge(df, "r", "c", method).collect()}
        assert got[0]["rouge1_f1"] == got[0]["rouge2_f1"] == got[0]["rougeL_f1"] == 1.0
        assert got[1]["rouge1_f1"] == 0.0 and got[4]["rougeL_f1"] == 0.0
        assert got[2]["rouge1_f1"] == pytest.approx(2 * 2 / 7) and got[2]["rouge2_f1"] == pytest.approx(2 * 1 / 5) and got[2]["rougeL_f1"] == pytest.approx(2 * 2 / 7)
        assert got[5]["rougeL_f1"] == pytest.approx(0.6)
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (["abcd"[k] for k in rng.integers(0, 4, rng.integers(0, 30))] for _ in range(2))
        assert evaluation.lcs_length(a, b) == plain_lcs(a, b)


def test_adjustments(spark):
    p = [0.01, 0.03, 0.04, 0.20]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(p)], "g string, i int, p double")
    assert [r["adjusted"] for r in inference.holm(df, "p", ["g"], "i").orderBy("i").collect()] == pytest.approx([0.04, 0.09, 0.09, 0.20])
    assert [r["adjusted"] for r in inference.benjamini_hochberg(df, "p", ["g"], "i").orderBy("i").collect()] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.20])
    assert inference.holm(df.limit(0), "p", ["g"], "i").count() == 0


def test_resampling_equals_one_draw_at_a_time():
    d = np.random.default_rng(3).normal(size=17)
    rng = np.random.default_rng(K.SEED)
    means = [d[rng.integers(0, 17, size=17)].mean() for _ in range(300)]
    assert inference.bootstrap_interval(d, 300) == pytest.approx((np.percentile(means, 2.5), np.percentile(means, 97.5)), rel=1e-12)
    rng, zs = np.random.default_rng(K.SEED), np.zeros(17)
    hits = sum(abs((d * rng.choice(np.array([-1.0, 1.0]), size=17)).mean()) >= abs(d.mean()) for _ in range(300))
    assert inference.permutation_p(d, zs, 300) == (hits + 1) / 301
    with pytest.raises(ValueError):
        inference.bootstrap_interval(np.array([]), 10)


def test_inference_end_to_end(spark):
    from textloom.plans import corpus

    rows = []
    for family, base in (("gemini", 0.5), ("qwen", 0.3)):
        for i in range(10):
            for metric in ("bertscore_f1", "judge_score_global", "rouge1_f1"):
                rows += [(f"c{i}", f"{family}_ft", metric, base + 0.2 + 0.01 * i), (f"c{i}", f"{family}_zero_shot", metric, base + 0.012 * i)]
    df = spark.createDataFrame(rows, "case_id string, condition_id string, metric string, score double")
    out = corpus.statistics(df, ["bertscore_f1", "judge_score_global"], 500)
    assert out["comparisons"].count() == 6 and all(r["success"] for r in out["success"].collect()) and all(r["consistent"] for r in out["directions"].collect())
    with pytest.raises(contracts.ContractError, match="unpaired"):
        corpus.statistics(df.filter("NOT (case_id = 'c1' AND condition_id = 'qwen_ft')"), ["bertscore_f1"], 10)
    with pytest.raises(contracts.ContractError, match="missing primary"):
        corpus.statistics(df, ["other"], 10)
    with pytest.raises(contracts.ContractError, match="invalid"):
        corpus.statistics(df.withColumn("score", F.lit(float("nan"))), ["bertscore_f1"], 10)


GOOD = '{"caso_id":"a","condicao_id":"qwen_ft","ementa_gerada":"t"}'


@pytest.mark.parametrize("line,bad", [(GOOD, []), (GOOD.replace('"a"', '" "'), ["caso_id"]), (GOOD.replace('"a"', "1"), ["caso_id"]), (GOOD.replace("qwen_ft", "x"), ["condicao_id"]), (GOOD.replace("}", ',"z":1}'), ["keys"]), ("{}", ["keys", "caso_id", "condicao_id", "ementa_gerada"])])
def test_prediction_contract(spark, line, bad):
    df = spark.createDataFrame([(0, line)], "ordinal long, value string")
    got = contracts.broken_records(df, contracts.prediction_violations(F.col("value"))).collect()
    assert (got[0]["violations"] if got else []) == bad


def test_judge_contract(spark):
    part = '{"score":4,"justificativa":"j"}'
    answer = "{" + ",".join(f'"{d}":{part}' for d in K.JUDGE_DIMENSIONS) + "}"
    lines = [answer, answer.replace('"score":4', '"score":6', 1), answer.replace('"score":4', '"score":true', 1), answer.replace('"score":4', '"score":"4"', 1), answer[:-1] + ',"score_global":4}']
    df = spark.createDataFrame(list(enumerate(lines)), "ordinal long, value string")
    got = {r["ordinal"]: r["violations"] for r in contracts.broken_records(df, contracts.judge_answer_violations(F.col("value"))).collect()}
    assert got == {1: ["pertinencia_tematica.score"], 3: ["pertinencia_tematica.score"], 4: ["dimensions"]}
    record = '{"caso_id":"a","condicao_id":"qwen_ft","avaliacao":' + answer + "}"
    one = spark.createDataFrame([(0, record)], "ordinal long, value string")
    assert contracts.broken_records(one, contracts.judge_record_violations(F.col("value"), "qwen_ft")).count() == 0
    assert contracts.broken_records(one, contracts.judge_record_violations(F.col("value"), "gemini_ft")).count() == 1
    case = spark.createDataFrame([(0, '{"caso_id":"a","indice_teste":0,"fundamentacao":"f","ementa_referencia":"e"}'), (1, '{"caso_id":"a","indice_teste":-1,"fundamentacao":"f","ementa_referencia":"e"}')], "ordinal long, value string")
    assert [r["ordinal"] for r in contracts.broken_records(case, contracts.case_violations(F.col("value"))).collect()] == [1]


def test_guards():
    contracts.check_runner(1, None, 1, 0)
    for bad in ({"flush_every": 0}, {"limit": 0}, {"max_retries": 0}, {"backoff": -1}):
        with pytest.raises(contracts.ContractError):
            contracts.check_runner(**bad)
    assert contracts.check_condition(" gemini_zero_shot ", "m", "m") == "gemini_zero_shot"
    for args in (("gemini_ft", "m", "m"), ("x", "m", "b")):
        with pytest.raises(contracts.ContractError):
            contracts.check_condition(*args)
    with pytest.raises(contracts.ContractError):
        contracts.check_condition("qwen_ft", "m", "m", None, True)
    assert contracts.check_ingest_stats({"total_lidos": 4, "descartados_nulos": 1, "exportados": 3})["exportados"] == 3
    with pytest.raises(contracts.ContractError):
        contracts.check_ingest_stats({"total_lidos": 4, "descartados_nulos": 2, "exportados": 3})
    assert profile.funnel([("a", 0), ("b", 0)])[1]["retention_pct"] == 0.0


def test_metric_table(spark):
    answer = tuple((k, "j") for k in (4, 4, 5, 3, 4))
    conditions = K.CONDITION_IDS
    joined = spark.createDataFrame([(c, k, "o gato", "o gato viu") for c in ("c1", "c2") for k in conditions], "case_id string, condition_id string, reference string, candidate string")
    kind = "struct<" + ",".join(f"{d}:struct<score:int,justificativa:string>" for d in K.JUDGE_DIMENSIONS) + ">"
    judged = spark.createDataFrame([(c, k, answer) for c in ("c1", "c2") for k in conditions], f"case_id string, condition_id string, answer {kind}")
    out = evaluation.evaluation_metrics(joined, judged, F.lit(0.5))
    assert out.count() == 80 and out.filter("metric = 'judge_score_global'").first()["score"] == 4.0
    with pytest.raises(contracts.ContractError):
        evaluation.evaluation_metrics(joined, judged.limit(7))


def plain_strata(values, strata=4):
    order = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    place = {i: k for k, i in enumerate(order)}
    return [min(place[i] * strata // len(values) + 1, strata) for i in range(len(values))]


@pytest.mark.parametrize("kind,values", [
    ("double", [k / 10 for k in range(12)]), ("double", [None, 0.5, None, 0.25, 0.5, 1e300, -1e300, 0.0, None]), ("long", [None] * 6 + [3, 1, 2, 2, 9, 7]), ("long", [None] * 7),
    ("int", [5, 5, 5, 5, 5]), ("long", [-(2**63) + 5, 2**63 - 1, 0, -1, None]),
])
def test_strata_of_fractions_and_nulls(spark, kind, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {kind}")
    got = {r["i"]: r["stratum"] for r in evaluation.quartile_strata(df, "v", "i").collect()}
    assert [got[i] for i in range(len(values))] == plain_strata(values)


def test_split_needs_dates(spark):
    df = spark.createDataFrame([(k, f"2025-01-0{k}" if k % 3 else None) for k in range(1, 10)], "i long, d string")
    with pytest.raises(ValueError, match="3 of 9 rows"):
        evaluation.chronological_split(df, "d", "i", 0.5)
    dated = df.filter("d is not null")
    assert sorted(r["i"] for r in evaluation.chronological_split(dated, "d", "i", 0.5).filter("split = 'test'").collect()) == [5, 7, 8]
    assert evaluation.chronological_split(df.limit(0), "d", "i").count() == 0


def test_places(spark):
    rows = [(k % 7, None if k % 11 == 0 else f"s{k % 13}", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, b string, c long").repartition(7)
    got = {r["c"]: r["position"] for r in evaluation.with_position(df, [F.col("a"), F.col("b"), F.col("c")]).collect()}
    want = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    assert got == {r[2]: k for k, r in enumerate(want, 1)}
    assert evaluation.with_position(df.limit(0), [F.col("a")]).count() == 0


def test_histogram_works_its_value_out_once(spark):
    from textloom.functions import text as T
    from textloom.operators import profile

    df = spark.createDataFrame([("a b c",), (None,), ("x " * 500,)], "t string").select(T.word_count("t").alias("n"))
    plan = profile.histogram(df, "n", 200)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert [tuple(r) for r in profile.histogram(df, "n", 200).orderBy("bin").collect()] == [(0, "0-200", 2), (2, "400-600", 1)]


def test_no_row_goes_through_python_objects():
    """Neither places nor resumed work use RDDs."""
    import inspect

    from textloom.operators import order
    from textloom.streaming import resumable

    assert ".rdd" not in inspect.getsource(order) + inspect.getsource(resumable) + inspect.getsource(evaluation)


def test_blinding_by_one_generator(spark):
    import numpy as np

    conditions = ("a", "b", "c", "d")
    df = spark.createDataFrame([(f"k{i}", c, i % 2) for i in range(6) for c in reversed(conditions)], "case_id string, condition_id string, stratum int")
    got = {(r["case_id"], r["blind_label"]): r["condition_id"] for r in evaluation.seeded_blinded_items(df, ["stratum", "case_id"], conditions, seed=7).collect()}
    rng, want = np.random.default_rng(7), {}
    for case in ("k0", "k2", "k4", "k1", "k3", "k5"):
        want |= {(case, "ABCD"[place]): conditions[k] for place, k in enumerate(rng.permutation(4))}
    assert got == want
    with pytest.raises(ValueError, match="without all conditions"):
        evaluation.seeded_blinded_items(df.filter("case_id <> 'k1' OR condition_id <> 'a'"), ["case_id"], conditions)
