import html
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import text as T
from textloom.operators import audit, chat, cleaning, masking

ODD = ["", " ", "\xa0a b\x1c", "a\r\nb c\x85d", "x  y\tz", "　", "ab\x0bcd\x0c", "no spaces", "\n\n end\n"]


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column).first()[0]


@pytest.mark.parametrize("s", ODD)
def test_string_semantics(spark, s):
    row = spark.createDataFrame([(s,)], "t string").select(
        T.strip("t").alias("s"), T.tokens("t").alias("w"), T.word_count("t").alias("n"), T.is_blank("t").alias("b"), T.normalise_output("t").alias("o")
    ).first()
    assert row["s"] == s.strip() and row["w"] == s.split() and row["n"] == len(s.split()) and row["b"] == (not s.strip())
    assert row["o"] == " ".join(p.strip() for p in s.splitlines() if p.strip())


def test_ngrams_of_short_arrays(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b", "a", "b"],)], "w array<string>").select(T.ngrams(F.col("w"), 2).alias("g")).collect()
    assert [r["g"] for r in rows] == [[], [], [f"a{T.GLUE}b", f"b{T.GLUE}a"]]


def plain_clean(t):
    if not t:
        return ""
    t = html.unescape(t)
    for _, p, to, flags in K.CLEANING_RULES:
        t = re.sub(p, to, t, flags=(re.I if "i" in flags else 0) | (re.S if "s" in flags else 0))
    return re.sub(r" {2,}", " ", re.sub(r"[\r\n\t]+", " ", t)).strip()


CLEANED = [
    "Fundamentação válida. NOME MAGISTRADO GENERICO Juiz Federal Relator", "<p style='a'>x</p> &eacute;&nbsp;y", "Processo nº 0500148-54.2016.4.05.8200 segue", "(id 48772 689) id. 48772689 placid 12345",
    "Data de Julgamento: hoje PROCESSO ELETRÔNICO DJe-s/n DIVULG 23-05-2024", "DJe 26.09.2012", "o divulg isolado", "Ação Civil Pública - ACP nº 5.2-3 movida pela DPU agora",
    "João Pessoa, 12 de março de 2021", "Súmula de julgamento Súmula de Julgamento: tudo\nresto", "Fim.  Súmula do julgamento: x\ny", "Texto. Maria da Silva Souza Juíza Federal", "voto do Relator fulano",
    "Texto final AMPARO SOCIAL TOTAL", "Texto final AMPARO SOCIAL TOTAL.", "a\xa0b\r\n\tc  d", "", None, "ÇÃO ção PROTOCOLO Nº 123",
]


def test_cleaning_equals_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(CLEANED)], "i long, t string")
    got = {r["i"]: r["c"] for r in df.select("i", cleaning.clean_text("t").alias("c")).collect()}
    assert got == {i: plain_clean(s) for i, s in enumerate(CLEANED)}
    assert got[0] == "Fundamentação válida"


def test_reject_reasons_in_order(spark):
    long = "um dois tres quatro cinco seis sete oito nove dez onze"
    rows = [(None, "x"), ("", "x"), ("<b></b>", "a b c d e"), ("   ", "a b c d e"), (long, f" {long} "), (long, "a b"), ("a b", "a b c d e"), (long, "a b c d e")]
    df = cleaning.with_reject_reason(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, source string, target string"))
    reasons = [r["reject_reason"] for r in df.orderBy("i").collect()]
    assert reasons == ["empty_before", "empty_before", "empty_after", "empty_after", "identical", "short", "short", None]
    n = cleaning.reject_counts(df).first()
    assert (n["total"], n["empty"], n["identical"], n["short"], n["kept"], n["retention_pct"]) == (8, 4, 1, 2, 1, 12.5)
    assert cleaning.reject_counts(df.limit(0)).first()["retention_pct"] == 0.0 and cleaning.kept(df).count() == 1


def plain_mask(t):
    if not t:
        return ""
    for _, p, flags, to in masking.PLAIN_LAYERS:
        t = re.sub(p, to, t, flags=re.I if flags else 0)
    names = []
    for m in re.finditer(K.HONORIFIC_NAME, t, re.I):
        names.append(m[0][len(m[1]):].strip())
    t = re.sub(K.HONORIFIC_NAME, rf"\1 {K.MASK_HIDDEN_NAME}", t, flags=re.I)
    context = K.CONTEXT_NAME.replace("(?<prefixo>", "(?P<prefixo>").replace("(?<nome>", "(?P<nome>")
    if any(m in t for m in K.CONTEXT_MARKERS):
        names += [m["nome"].strip() for m in re.finditer(context, t)]
        t = re.sub(context, lambda m: m["prefixo"] + K.MASK_HIDDEN_NAME, t)
    parts = set()
    for w in (n.split() for n in names):
        parts |= {" ".join(w[i : i + k]) for k in range(2, len(w) + 1) for i in range(len(w) - k + 1)}
    for p in sorted(parts, key=lambda p: (-len(p), p)):
        t = t.replace(p, K.MASK_NAME)
    t = re.sub(K.PROPER_NAME, lambda m: m[0] if m[0].startswith(K.PROTECTED_PREFIXES) else K.MASK_NAME, t)
    return re.sub(K.ADDRESS, K.MASK_ADDRESS, t, flags=re.I)


MASKED = [
    "CPF 123.456.789-01 e CNPJ 12.345.678/0001-99", "0500148-54.2016.4.05.8200", "conta corrente nº 12345-6 ag. 1234-5", "a.b+c@x-y.com.br.", "(83) 99999-1234 e 83 3333-4444",
    "A autora apresentou documentos rurais contemporâneos", "Sr. João Silva Souza disse. Depois João Silva saiu", "movido por FULANO DE TAL SILVA em face de X", "AUTOR: MARIA DA SILVA RÉU: INSS",
    "época útil única", "Instituto Nacional Maria José Lima e Carlos Alberto Souza", "Tribunal Regional Federal da 5ª Região", "Rua das Flores, rua X bloco 3 nº 10", "", None,
    "Dr. Ana Lima Costa e Sra. Ana Lima Costa Prado; Lima Costa", "representada por JOAO PEDRO, por intermédio", "R$ 5\\x $1 texto",
]


def test_masking_equals_python(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(MASKED)], "i long, t string")
    got = {r["i"]: r for r in masking.mask_text(df, "t", "n").collect()}
    assert {i: r["t"] for i, r in got.items()} == {i: plain_mask(s) for i, s in enumerate(MASKED)}
    assert got[0]["n"]["cpfs"] == got[0]["n"]["cnpjs"] == 1 and got[2]["n"]["contas"] == 2 and got[7]["n"]["nomes_honorificos"] == 1
    assert got[10]["n"]["nomes_proprios"] == 1 and got[12]["n"]["logradouros"] == 1


def test_documents_equal_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in masking.mask_text(docs, "text").collect()} == {i: plain_mask(t) for i, t in texts.items()}
    assert {r["doc_id"]: r["c"] for r in docs.select("doc_id", cleaning.clean_text("text").alias("c")).collect()} == {i: plain_clean(t) for i, t in texts.items()}


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["Ana", "Lima", "sr.", "Dr.", "autor", "DE", "SILVA", "AUTOR:", "Código", "Civil", "rua", "nº 3", "é", ",", ".", "12345-6", "conta"]), max_size=14))
def test_masking_of_mixed_words(spark, words):
    t = " ".join(words)
    df = spark.createDataFrame([(t,)], "t string")
    assert masking.mask_text(df, "t").first()["t"] == plain_mask(t)


def test_mask_pairs_and_totals(spark):
    df = spark.createDataFrame([("x" * 60, "CPF 123.456.789-01 aqui, texto"), ("curto", "CPF 123.456.789-01")], "source string, target string")
    masked = masking.mask_pairs(df)
    assert [r["too_short"] for r in masked.collect()] == [False, True]
    totals = {r["counter"]: r["n"] for r in masking.mask_totals(masked).collect()}
    assert totals["cpfs"] == 2 and totals["descartados_pos_anon"] == 1
    assert masking.ranked_totals(masking.mask_totals(masked)).first()["counter"] == "cpfs"


def test_audit(spark):
    rows = [(0, "CPF 123.456.789-01 e 123.456.789-02"), (1, "movido por FULANO DE TAL em face de X; Dr. João da Silva"), (2, "limpo"), (3, "Dr. Carlos Souza ré"), (4, None), (5, "AUTOR: [NOME] x"), (6, "CPF 111.111.111-11")]
    report = audit.audit_report(spark.createDataFrame(rows, "ordinal long, t string"), "t")
    got = {r["category"]: r for r in report.collect()}
    assert got["1. CPF"]["n"] == 3 and got["1. CPF"]["rows"] == 2 and got["1. CPF"]["examples"] == ["123.456.789-01", "111.111.111-11"]
    assert got[K.AUDIT_NAMES]["examples"] == ["FULANO DE TAL", "Carlos Souza"] and len(got) == 8
    clean = audit.audit_report(spark.createDataFrame([(0, "limpo")], "ordinal long, t string"), "t")
    assert audit.passed(clean) and not audit.passed(report)
    assert audit.gate({"a": clean, "b": None}) == (False, ["b"])


def test_chat_records(spark):
    df = spark.createDataFrame([(0, "fonte", "alvo")], "ordinal long, source string, target string")
    made = df.select("ordinal", chat.chat_record("source", "target", "PROMPT").alias("contents"))
    row = chat.extract_pair(made).first()
    assert (row["source"], row["target"]) == ("fonte", "alvo")
    assert row["contents"][0]["parts"][0]["text"] == f"PROMPT\n\n{K.MARKER}fonte"
    chat.require_prompt(made, "PROMPT")
    with pytest.raises(ValueError, match="row 0"):
        chat.require_prompt(made, "OTHER")
    several = spark.createDataFrame([(0, [("user", [("a",)]), ("user", [("b", ), ("c",)]), ("model", [("x",)]), ("model", [(None,), ("y",)])]), (1, [])], f"ordinal long, contents {chat.CONTENTS}")
    rows = chat.extract_pair(several).orderBy("ordinal").collect()
    assert [(r["source"], r["target"]) for r in rows] == [("bc", "y"), ("", "")]
    sft = chat.sft_samples(df.withColumn("source", F.lit(" fonte ")), "PROMPT").first()
    assert sft["case_id"] == "treino_00000" and [m["role"] for m in sft["messages"]] == ["system", "user", "assistant"] and sft["source"] == "fonte" and len(sft["prompt"]) == 2
    assert one(spark, " a ", chat.judge_message("t", "t")) == "Fundamentação original:\na\n\nEmenta candidata:\na"
