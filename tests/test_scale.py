"""Steps whose cost once grew with how often an expression is named: parsers, patterns and scans run once a row."""

import html
import json
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import gates
from textloom.functions.text import java_pattern, once
from textloom.operators import audit, cleaning, contracts, generation, profile

PART = '{"score":4,"justificativa":"j"}'


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def answer(part: str) -> str:
    """A judge's answer whose second dimension is ``part``."""
    return "{" + ",".join(f'"{d}":{part if i == 1 else PART}' for i, d in enumerate(K.JUDGE_DIMENSIONS)) + "}"


def test_once(spark):
    df = spark.range(4).select(once(F.col("id") + 1, lambda x: x * x - x).alias("y"))
    assert [r["y"] for r in df.collect()] == [0, 2, 6, 12]


def test_contract_parses_once(spark):
    """A record is written once and a part is parsed once; no filter repeats the checks below."""
    value = F.to_json(F.struct(*(F.struct(F.col("id").alias("score"), F.lit("j").alias("justificativa")).alias(d) for d in K.JUDGE_DIMENSIONS)))
    text = plan(contracts.broken_records(spark.range(4).select(F.col("id").alias("ordinal"), value.alias("value")), contracts.judge_answer_violations(F.col("value"))))
    assert (text.count("StructsToJsonEvaluator"), text.count("from_json"), "Filter" in text) == (11, 5, False)  # 10 are of scores and reasons
    response = F.to_json(F.struct(F.array(F.struct(F.lit("stop").alias("finish_reason"), F.struct(value.alias("content")).alias("message"))).alias("choices")))
    text = plan(spark.range(4).select(generation.judge_problem(response)))
    assert (text.count("StructsToJsonEvaluator"), text.count("from_json")) == (12, 5)


@pytest.mark.parametrize(
    "part, bad",
    [
        (PART, []), ('{ "justificativa" : "a b" , "score" : 5 }', []), ('{"score":4,"justificativa":"a\\"b"}', []), ('{"score":4,"justificativa":"é"}', []), ('{"score":true,"justificativa":"j"}', []),
        ('{"score":6,"justificativa":"j"}', ["score"]), ('{"score":4,"justificativa":" "}', ["justificativa"]),
        ('{"score":4,"justificativa":"\\u00a0"}', ["justificativa"]), ('{"score":4,"justificativa":{"a":"b"}}', ["justificativa"]), ('{"score":4,"justificativa":"j","z":1}', ["keys"]),
        ("[]", ["keys", "score", "justificativa"]),
    ],
)
def test_judge_parts(spark, part, bad):
    """Plain parts, which skip the parser, and all others."""
    bad = [f"completude_dispositiva.{b}" for b in bad]
    df = spark.createDataFrame([(0, answer(part))], "ordinal long, value string")
    assert [r["violations"] for r in contracts.broken_records(df, contracts.judge_answer_violations(F.col("value"))).collect()] == ([bad] if bad else [])
    response = json.dumps({"choices": [{"finish_reason": "stop", "message": {"content": answer(part)}}]})
    assert spark.createDataFrame([(response,)], "r string").select(generation.judge_problem("r")).first()[0] == (bad[0] if bad else None)


def references() -> list[str]:
    """Every named reference as it is, cut, and run into letters; numbers on all borders; and what only looks like one."""
    names = [f"&{n}{end}" for n in html5 for end in ("", "x", ";", " ")] + [f"&{n[:-1]}" for n in html5]
    numbers = [*range(0x200), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFEFF, *range(0xFDC8, 0xFDF8), 0x1F600, *(p << 16 | q for p in range(17) for q in (0xFFFD, 0xFFFE, 0xFFFF, 1)), 0x110000, 10**7, 10**8, 10**30]
    refs = names + [f"&#{z}{n}{end}" for n in numbers for z in ("", "00") for end in (";", "", "g")] + [f"&#{x}{n:x}{end}" for n in numbers for x in "xX" for end in (";", "", "g")]
    return refs + ["&", "&;", "&#", "&#;", "&#x;", "&#xg;", "&&amp;", "&amp;amp;", "&٣;", "&#٣;", "&" + "a" * 40, "&not" + "b" * 40 + ";", "&\U0001f600;", "a&lt;b&gt", "&amp", "", "no reference", "&notit;&copy\n&reg\t"]


def test_references_in_the_jvm(spark):
    """References are those of html.unescape, and no text goes to a Python worker."""
    texts = references()
    texts += [" ".join(texts[i::97]) for i in range(97)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i long, t string").repartition(4)
    out = df.select("i", "t", cleaning.unescape("t").alias("u"))
    assert "Python" not in plan(spark.range(1).select(cleaning.unescape(F.col("id").cast("string")))) and "from_json" not in plan(out)
    assert [(r["t"], r["u"]) for r in out.collect() if r["u"] != (None if r["t"] is None else html.unescape(r["t"]))] == []


def test_anomaly_labels_strip_once(spark):
    df = spark.createDataFrame([(" 1) x ",), (" despacho y ",), ("w " * 300,), ("\tw" * 301 + "\n",), (None,), (" ",), ("ß" * 80,), (K.TRUNCATED_TARGET.lower(),), (K.TRUNCATED_TARGET + "x",), (K.INSTITUTIONAL_HEADER.lower() + " x",)], "t string")
    out = df.select(profile.anomaly_labels("t").alias("l"))
    assert [r["l"] for r in out.collect()] == [["ementa_start_digit"], ["despacho_ementa"], [], ["ementa_longa_anomala"], [], [], [], ["trunc_8w_exata"], [], ["header_ementa"]]
    assert plan(out).count("trim(") == 1 and plan(out).count("upper(") == 1


def test_audit_scans_once(spark):
    """One scan of the texts; examples are the first by ordinal, however rows are dealt, and a null ordinal comes last."""
    rows = [(None if i == 7 else i, f"x{i}@b.org" if i % 2 else "none") for i in range(400)]
    report = audit.audit_report(spark.createDataFrame(rows, "ordinal long, t string").repartition(7), "t", (("mail", "[a-z0-9]+@[a-z]+[.]org", ""), ("none", "Q+", "")), names=False)
    assert {r["category"]: (r["n"], r["rows"], r["examples"]) for r in report.collect()} == {"mail": (200, 200, ["x1@b.org", "x3@b.org", "x5@b.org"]), "none": (0, 0, [])}
    docs = spark.read.schema("ordinal long, t string").parquet("/root/testdata/sf0.001/documents.parquet")
    assert plan(audit.audit_report(docs, "t")).count("parquet") == 1


def test_gates_change_nothing(spark):
    """Patterns with a lead and behind a gate match where they match alone."""
    bits = (
        "123.456.789-09 12.345.678/0001-95 1234567-89.2020.4.05.8200 conta corrente nº 12345-6 ag. 1234-5 AG 1234-5 a.b@c-d.org a@b.c @ (83) 98765-4321 83 3333-4444 "
        "id: 12345 ID.99999 ſr. Sr. dr. Ana Maria Souza réu Rui Ré ana maria AUTOR : movido por REPRESENTADA POR JOSE DA SILVA em face , ; São João Pessoa Luiz "
        "rua das Flores nº 12 AV. Brasil CEP 5 ſítio bloco 3 lote 7 br-101 n 5 DJe 1.2.20 dje 01/02/2003 ٣٣٣.٣٣٣.٣٣٣-٣٣ x -   \n é"
    ).split(" ")
    rng = random.Random(5)
    df = spark.createDataFrame([(rng.choice(["", " ", "\n"]).join(rng.choices(bits, k=rng.randint(1, 9))) if i % 3 else " ".join(rng.choices(bits, k=12)),) for i in range(2000)], "t string").repartition(4)
    patterns = [(p, f) for p in {*gates.REQUIRED, *gates.FIRST} for f in ("", "i") if f == "" or p not in (K.EMAIL, K.PROPER_NAME)]
    plain = [F.regexp_extract_all("t", F.lit(java_pattern(p, f)), F.lit(0)).alias(f"a{i}") for i, (p, f) in enumerate(patterns)]
    fast = F.struct(*(F.regexp_extract_all("t", F.lit(gates.led(p, f)), F.lit(0)).alias(f"b{i}") for i, (p, f) in enumerate(patterns)))
    may = gates.gated(F.col("t"), [p for p, _ in patterns], lambda m: F.array(*(m(p) for p, _ in patterns)))
    seen = set()
    for r in df.select("t", *plain, fast.alias("b"), may.alias("may")).collect():
        for i, pf in enumerate(patterns):
            assert r[f"a{i}"] == r["b"][f"b{i}"] and (r["may"][i] or not r[f"a{i}"]), (pf, r["t"])
            seen |= {pf} if r[f"a{i}"] else set()
    assert len({p for p, _ in seen}) == len({p for p, _ in patterns})


def test_rules_behind_gates(spark):
    """The chain of rules leaves what it leaves without gates and leads."""
    bits = (
        "<b> </b> < > Processo nº 0500148-54.2016 AUTOS n. 12/3 (id 48772689) ID: 12345 Data de Julgamento PROCESSO ELETRÔNICO DJe-123 dje s/n DJE 1.2.20 divulg "
        "Ação Civil Pública - ACP nº 5.2 DPU João Pessoa, ſousa, 12 de março 2021 Súmula do julgamento SUMULA de julgamento: Fim. ; 2. Maria da Silva Souza Juíza Federal "
        "juız Juiz Relator Desembargadora Excelentíssimo AMPARO SOCIAL TOTAL ÀÉ\xa0 \n \t fim"
    ).split(" ")
    rng = random.Random(7)
    texts = [" ".join(rng.choices(bits, k=rng.randint(1, 14))) + rng.choice(["", "\n", " ", "."]) for _ in range(3000)] + [f"x {t}" for t in ("", "Maria da Silva Juíza Federal", "A SÚMULA DE JULGAMENTO", "AB CD EF\n\n")] + [None, ""]
    plain = F.col("t")
    for _, pattern, to, flags in K.CLEANING_RULES:
        plain = F.regexp_replace(plain, java_pattern(pattern, flags), to)
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", plain.alias("a"), cleaning.apply_rules("t").alias("b"))
    assert [(r["t"], r["a"], r["b"]) for r in df.collect() if r["a"] != r["b"]] == []


def test_rules_are_gated(spark):
    """Each rule is behind a test, begins with one, or is known to be cheap."""
    assert {name for name, p, *_ in K.CLEANING_RULES if not (p in gates.REQUIRED or p in gates.FIRST or p in gates.ENDING)} == set()
