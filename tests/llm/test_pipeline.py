import ast
import importlib

import pytest

import corpus_pipeline as P
from textloom.llm import simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_take_effect(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = docs
    kept = []
    for name, stage in P.STAGES[:-1]:
        seen = P.materialise(stage(spark, seen, d))
        assert seen.columns == COLUMNS, name
        kept.append({r["doc_id"] for r in seen.select("doc_id").collect()})
    assert kept[0] > kept[1] > kept[2] and kept[2] == kept[3]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    clean = [i for i, r in labels.items() if r["quality"] == 1]
    assert sum(i in kept[0] for i in clean) > 0.97 * len(clean)
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(seen).collect()}
    assert sum(c != i for i, c in comp.items()) <= 2  # redacted texts alone may meet anew
    packed = P.STAGES[-1][1](spark, seen, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept[3]
    assert packed.count() == P.run(spark, d).count()


def test_edge_rows(spark, edge_docs, no_docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (edge_docs, no_docs):
        for _, stage in P.STAGES[:-1]:
            out = P.materialise(stage(spark, docs, str(tmp_path)))
            assert out.columns == docs.columns
    deduped = P.drop_near_duplicates(spark, edge_docs, str(tmp_path)).collect()
    assert sorted(r["doc_id"] or 0 for r in deduped) == [0, 1, 2, 5, 7, 8]


def test_repeated_ids_with_other_texts(spark, tmp_path):
    """An id in two components keeps a row for each; which row stays doesn't hang on the order of rows."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "en"), (1, b, "en"), (2, a, "de"), (3, b, "de"), (3, c, "en"), (1, a, "fr"), (4, c, "en")]
    got = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "doc_id long, text string, lang string").repartition(3)
        got.append(sorted(tuple(r) for r in P.drop_near_duplicates(spark, df, str(tmp_path)).collect()))
    assert got[0] == got[1] and sorted((r[0], r[1]) for r in got[0]) == sorted([(1, a), (1, b), (3, c)])


@pytest.mark.parametrize("name", ["imatch", "quotes", "secrets"])
def test_native_operators_stay_in_the_jvm(name):
    source = open(importlib.import_module(f"textloom.llm.{name}").__file__).read()
    called = {n.attr for n in ast.walk(ast.parse(source)) if isinstance(n, ast.Attribute)}
    assert not called & {"mapInPandas", "mapInArrow", "applyInPandas", "pandas_udf", "udf", "rdd", "toPandas", "toArrow"}
