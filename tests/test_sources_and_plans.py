import json

import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluation
from textloom.plans import corpus, manifest
from textloom.sources import dump, files, sinks
from textloom.streaming import resumable

DUMP = "\n".join([
    "-- dump", "COPY public.t (id, votoementa, ementa, data_cadastro) FROM stdin;", "1\tfonte\\num\talvo um\t2025-01-10 10:00:00-03", "2\t\\N\talvo\t2025", "3\tso\tdois", "4\t  \talvo\tx",
    "5\ta\\tb\\r\\\\N\tc\t\\N", "1\tfonte outra\talvo\t2025-01-11 10:00:00-03", "\\.", "6\tdepois\tdo\tfim", "COPY public.t (id) FROM stdin;", "7", "\\.", "",
])


def test_dump_scan(spark, tmp_path):
    (tmp_path / "d.sql").write_text(DUMP, encoding="utf-8")
    lines = dump.read_lines(spark, str(tmp_path / "d.sql"))
    fields = {"id": "id", "source": "votoementa", "target": "ementa", "data_cadastro": "data_cadastro"}
    records, stats = dump.extract_records(lines, "t", fields)
    rows = records.orderBy("ordinal").collect()
    assert [(r["id"], r["source"], r["target"], r["data_cadastro"]) for r in rows] == [
        ("1", "fonte\num", "alvo um", "2025-01-10 10:00:00-03"), ("5", "a\\tb\r\\\\N", "c", "\\N"), ("1", "fonte outra", "alvo", "2025-01-11 10:00:00-03")
    ]
    assert (stats["total_lidos"], stats["descartados_nulos"], stats["exportados"]) == (6, 3, 3)
    assert evaluation.upsert_latest(records, "id", "ordinal").filter("id = '1'").first()["source"] == "fonte outra"
    sinks.upsert_table(records, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2
    assert dump.copy_columns("COPY public.other (a) FROM stdin;", "t") is None
    with pytest.raises(ValueError):
        dump.copy_block(lines, "absent")
    with pytest.raises((RuntimeError, FileNotFoundError)):
        dump.export_dump("x", str(tmp_path / "o"), "t", tool="false")


def test_files(spark, tmp_path):
    p = str(tmp_path / "a.jsonl")
    sinks.write_jsonl(p, [{"contents": [{"role": "user", "parts": [{"text": "é"}]}]}])
    assert open(p, encoding="utf-8").read() == '{"contents":[{"role":"user","parts":[{"text":"é"}]}]}\n'
    (tmp_path / "b.jsonl").write_text('{"caso_id":"x"}\n\n{"caso_id":"y"}\n', encoding="utf-8")
    rows = files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "caso_id string").orderBy("ordinal").collect()
    assert [(r["ordinal"], r["caso_id"]) for r in rows] == [(0, "x"), (1, "y")]
    assert files.record_at(files.read_jsonl(spark, p, files.CHAT), 0)["contents"][0]["role"] == "user"
    with pytest.raises(IndexError):
        files.record_at(files.read_jsonl(spark, p, files.CHAT), 5)
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n{oops\n', encoding="utf-8")
    with pytest.raises(ValueError, match="bad.jsonl:2"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int")
    (tmp_path / "none.jsonl").write_text("\n", encoding="utf-8")
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    with pytest.raises(ValueError):
        files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int", empty_ok=False)
    (tmp_path / "a.json").write_text('[{"id":"1","source":"s","target":"t","data_cadastro":null}]', encoding="utf-8")
    arr = files.read_json_array(spark, str(tmp_path / "a.json"))
    assert arr.count() == 1
    assert files.first_with_dates(arr, spark.createDataFrame([("2025",), (None,)], "data_cadastro string"), "data_cadastro").count() == 1
    sinks.write_csv(str(tmp_path / "m.csv"), [{"case_id": "a", "condition_id": "b", "metric": "m", "score": 0.5}], ["case_id", "condition_id", "metric", "score"])
    assert files.read_csv(spark, str(tmp_path / "m.csv"), files.METRICS).first()["score"] == 0.5
    assert files.count_lines(str(tmp_path / "b.jsonl")) == 2 and files.count_lines("absent") is None and files.file_size_mb(p) == 0.0 and not files.has_files("absent")
    sinks.write_small_table(spark.range(3), str(tmp_path / "s.csv"), ["id"])
    with pytest.raises(ValueError):
        sinks.write_small_table(spark.range(3), str(tmp_path / "s.csv"), ["id"], most=2)
    assert sinks.object_uri("gs://b/", "/x/", "y") == "gs://b/x/y" and sinks.copy_report(p, str(tmp_path / "docs")).endswith("a.jsonl")


def test_lines_of_several_files_and_blocks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.txt").write_text("".join(f"{k}-{i}\n" + "\n" * (i % 3 == 0) for i in range(500 * (k + 1))), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        for skip in (False, True):
            got = [r["value"] for r in dump.read_lines(spark, str(tmp_path), skip).orderBy("ordinal").collect()]
            want = [line for k in range(3) for line in (tmp_path / f"{k}.txt").read_text(encoding="utf-8").split("\n")[:-1] if line or not skip]
            assert got == want
        assert [r["ordinal"] for r in dump.read_lines(spark, str(tmp_path)).orderBy("ordinal").limit(3).collect()] == [0, 1, 2]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_manifests(tmp_path):
    base = str(tmp_path)
    e = manifest.evaluation_artifacts(base, manifest.OFFICIAL)
    assert manifest.status_of(str(e["judge_manifest"])) == ("pendente", None)
    sinks.write_json(str(e["judge_manifest"]), {"status": "completed"})
    assert manifest.status_of(str(e["judge_manifest"]))[0] == "pendente"  # no profile
    sinks.write_json(str(e["judge_manifest"]), {"status": "completed", "perfil_execucao": "oficial"})
    assert manifest.status_of(str(e["judge_manifest"]))[0] == "concluida" and manifest.status_of(str(e["judge_manifest"]), "absent")[0] == "em_andamento"
    assert manifest.validation_status([]) == "pendente" and manifest.validation_status(["validada", "pendente"]) == "parcial" and manifest.official_status(["concluida"] * 2) == "concluida"
    assert manifest.readiness(base)["oficial"]["components"]["judge"] and manifest.readiness(base)["exploratorio"]["status"] == "pendente"
    p = manifest.protocol(base, manifest.EXPLORATORY, "prompt", "model")
    assert len(p["condicoes_experimentais"]) == 4 and json.dumps(p)
    with pytest.raises(ValueError):
        manifest.check_profile("x")
    with pytest.raises(ValueError):
        manifest.effective_batch(0, 4)
    assert manifest.effective_batch(4, 8) == 32 and manifest.duration_text(75) == "1min 15s" and manifest.compression_hint(10, 0) == "?:1"
    t = manifest.Timings()
    with t.phase("a"):
        pass
    t.save(str(tmp_path / "t.json"))
    assert "total" in files.load_json(str(tmp_path / "t.json"))
    assert manifest.narrative(1000, 10, 5, 2.5)[0] == "1.000 registros lidos. 10 mantidos"


def test_corpus_end_to_end(spark, tmp_path):
    body = "fundamentação com muitas palavras para passar no filtro de tamanho mínimo do corpus"
    rows = [
        (0, "1", f"<p>{body} um</p> movido por PESSOA TESTE UM em face de X", "ementa com cinco palavras boas aqui.", "2025-01-10 10:00:00-03"),
        (1, "2", f"{body} dois AUTOR: PESSOA TESTE DOIS RÉU: INSS fim do texto", "ementa com cinco palavras boas dois.", "2025-01-11 10:00:00-03"),
        (2, "3", f"{body} tres Sr(a). PESSOA TESTE TRES, presente", "ementa com cinco palavras boas tres.", "2025-01-12 10:00:00-03"),
        (3, "4", f"{body} quatro.  Súmula de Julgamento: A Turma decidiu", "ementa com cinco palavras boas quatro.", "2025-01-13 10:00:00-03"),
    ]
    raw = spark.createDataFrame(rows, "ordinal long, id string, source string, target string, data_cadastro string")
    built = corpus.build_corpus(raw, "PROMPT", 0.25)
    assert built["train"].count() == 3 and built["test"].count() == 1
    text = " ".join(r["source"] for r in built["split"].collect())
    assert "PESSOA TESTE" not in text and text.count("[NOME_OCULTADO]") == 3 and "Turma" not in text
    for part in ("train", "test"):
        assert corpus.audit.passed(corpus.audit_records(built[part]))
    report = corpus.profile_report(built["split"], raw, built["judged"], built["masked"])
    assert report["funnel"][-1]["n"] == 3 and report["years"] == {2025: 4} and report["masking"]["nomes_honorificos"] == 3 and json.dumps(report, default=str)
    sinks.save_chat(built["train"], str(tmp_path / "train"))
    back = files.read_jsonl(spark, str(tmp_path / "train"), files.CHAT)
    assert back.count() == 3 and back.columns == ["ordinal", "contents"]


def test_resume(spark, tmp_path):
    cases = spark.createDataFrame([(f"c{i}", i) for i in range(10)], "case_id string, test_index int")
    out, man = str(tmp_path / "out"), str(tmp_path / "m.json")

    def process(df):
        return df.select("case_id", F.concat(F.lit("t"), "case_id").alias("candidate"))

    first = resumable.resume(spark, cases, out, man, ["case_id"], ["test_index"], process, flush_every=3, limit=4)
    assert first["status"] == "completed" and first["processed"] == 4
    assert {r["case_id"] for r in spark.read.parquet(out).collect()} == {"c0", "c1", "c2", "c3"}

    def fails(df):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        resumable.resume(spark, cases, out, man, ["case_id"], ["test_index"], fails)
    assert files.load_json(man)["status"] == "failed"
    assert resumable.resume(spark, cases, out, man, ["case_id"], ["test_index"], process)["processed"] == 6
    assert resumable.resume(spark, cases, out, man, ["case_id"], ["test_index"], fails)["processed"] == 0
    assert spark.read.parquet(out).count() == 10


def test_generation_and_scores(spark):
    waits = []
    state = {"n": 0}

    def call():
        state["n"] += 1
        if state["n"] < 3:
            raise RuntimeError("busy")
        return "ok"

    assert resumable.with_retry(call, 3, 2.0, waits.append) == "ok" and waits == [2.0, 4.0]
    df = spark.createDataFrame([("a", "b"), ("c", "c")], "x string, y string")
    made = resumable.generate(df, lambda: lambda row: row["x"].upper()).orderBy("x").collect()
    assert [r["candidate"] for r in made] == ["A", "C"]
    scored = resumable.score_batches(df, "x", "y", lambda a, b: [float(p == q) for p, q in zip(a, b)]).orderBy("x").collect()
    assert [r["bertscore_f1"] for r in scored] == [0.0, 1.0]


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    q = resumable.upsert_stream(resumable.stream_table(spark, str(tmp_path / "in")), str(tmp_path / "out"), "user_id", "event_id", str(tmp_path / "cp"))
    q.awaitTermination()
    last = max(tmp_path.joinpath("out").iterdir(), key=lambda p: int(p.name[1:]))
    got = {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(last)).collect()}
    assert got == {r["user_id"]: r["m"] for r in events.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}
    counts = resumable.windowed_counts(resumable.stream_table(spark, str(tmp_path / "in"), 10), "ts", ["event_type"], "7 days", "1 hour", F.col("value"))
    resumable.run_available(counts, str(tmp_path / "w"), str(tmp_path / "cpw"))
    got = spark.read.parquet(str(tmp_path / "w"))
    want = events.groupBy(F.window("ts", "7 days").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert got.count() > 0 and got.select("start", "event_type", "n").join(want, ["start", "event_type", "n"], "left_anti").count() == 0


def test_human_evaluation(spark):
    cases = spark.createDataFrame([(f"teste_{i:05d}", i, "p " * (30 + i), "r") for i in range(40)], "case_id string, test_index int, source string, reference string")
    from textloom.functions.constants import CONDITION_IDS

    predictions = cases.select("case_id", F.explode(F.array(*[F.lit(c) for c in CONDITION_IDS])).alias("condition_id")).withColumn("candidate", F.lit("t"))
    sample, key, grid = corpus.prepare_human_evaluation(cases, predictions)
    assert sample.count() == 40 and key.count() == 160 and grid.count() == 1280
    out = corpus.human_report(grid.withColumn("rating", F.lit(4)), grid, key, ["avaliador_1", "avaliador_2"])
    assert {r["kappa"] for r in out["kappa"].collect()} == {1.0} and {r["mean"] for r in out["means"].collect()} == {4.0}


def test_judge_responses(spark):
    from textloom.functions.constants import JUDGE_DIMENSIONS
    from textloom.operators import generation

    part = {"score": 4, "justificativa": "j"}

    def response(content, finish="stop"):
        return json.dumps({"choices": [{"finish_reason": finish, "message": {"content": content}}]})

    good = json.dumps({d: part for d in JUDGE_DIMENSIONS})
    rows = [("a", response(good)), ("b", response(good, "length")), ("c", response("")), ("d", response("oops")), ("e", response("{}")), ("f", response("[1]"))]
    answers, failures = generation.judged(spark.createDataFrame([(c, "qwen_ft", r) for c, r in rows], "case_id string, condition_id string, response string"))
    assert [r["case_id"] for r in answers.collect()] == ["a"] and answers.first()["answer"]["concisao"]["score"] == 4
    assert {r["case_id"]: r["problem"] for r in failures.collect()} == {"b": "truncated", "c": "empty", "d": "not json", "e": "dimensions", "f": "not json"}
    generation.require_aligned(answers, answers)
    with pytest.raises(ValueError):
        generation.require_aligned(answers, failures)
    assert generation.absent_conditions(answers) == ["gemini_ft", "gemini_zero_shot", "qwen_zero_shot"]
    assert generation.response_text({"candidates": [{"content": {"parts": [{"text": " "}, {"text": " x "}]}}]}) == "x"
    with pytest.raises(ValueError):
        generation.response_text({})
    body = json.loads(answers.select(generation.chat_request("m", "sys", "case_id").alias("b")).first()["b"])
    assert body["messages"][1] == {"role": "user", "content": "a"}
    assert generation.tuning_manifest("m", "gs://b/t", "oficial", epochs=3)["hiperparametros"] == {"epochs": 3}


def test_command_line(spark, tmp_path, capsys):
    from textloom.__main__ import main
    from textloom.functions.constants import CONDITION_IDS, JUDGE_DIMENSIONS, MARKER

    chat_file = str(tmp_path / "chat.jsonl")
    sinks.write_jsonl(chat_file, [{"contents": [{"role": "user", "parts": [{"text": f"PROMPT\n\n{MARKER}fonte {'p ' * i}"}]}, {"role": "model", "parts": [{"text": f"alvo {i}"}]}]} for i in range(40)])
    (tmp_path / "prompt.txt").write_text("PROMPT", encoding="utf-8")
    assert main(["view", chat_file, "3"]) == 0 and "fonte" in capsys.readouterr().out
    assert main(["sft", chat_file, str(tmp_path / "prompt.txt"), str(tmp_path / "sft")]) == 0
    assert main(["cases", chat_file, str(tmp_path / "cases")]) == 0
    ids = [f"teste_{i:05d}" for i in range(40)]
    sinks.write_jsonl(str(tmp_path / "p.jsonl"), [{"caso_id": c, "condicao_id": k, "ementa_gerada": "alvo"} for c in ids for k in CONDITION_IDS])
    sinks.write_jsonl(str(tmp_path / "j.jsonl"), [{"caso_id": c, "condicao_id": k, "avaliacao": {d: {"score": 4, "justificativa": "j"} for d in JUDGE_DIMENSIONS}} for c in ids for k in CONDITION_IDS])
    assert main(["metrics", str(tmp_path / "cases"), str(tmp_path / "j.jsonl"), str(tmp_path / "m.csv"), str(tmp_path / "p.jsonl")]) == 0
    assert files.read_csv(spark, str(tmp_path / "m.csv"), files.METRICS).count() == 40 * 4 * 9
    assert main(["human", str(tmp_path / "cases"), str(tmp_path / "human"), str(tmp_path / "p.jsonl")]) == 0
    template = (tmp_path / "human" / "ratings.csv").read_text(encoding="utf-8").splitlines()
    filled = [template[0]] + [",".join([*line.split(",")[:5], "4", "ok"]) for line in template[1:]]
    (tmp_path / "filled.csv").write_text("\n".join(filled) + "\n", encoding="utf-8")
    assert main(["agreement", str(tmp_path / "human"), str(tmp_path / "filled.csv"), str(tmp_path / "r.json")]) == 0
    assert {r["kappa"] for r in files.load_json(str(tmp_path / "r.json"))["kappa"]} == {1.0}
    assert main(["protocol", str(tmp_path / "base"), str(tmp_path / "prompt.txt")]) == 0 and main(["readiness", str(tmp_path / "base")]) == 0
    (tmp_path / "d.sql").write_text(DUMP, encoding="utf-8")
    assert main(["ingest", str(tmp_path / "d.sql"), "t", str(tmp_path / "records"), "--source", "votoementa"]) == 0
    assert spark.read.json(str(tmp_path / "records")).count() == 3
    with pytest.raises(ValueError, match="ementa_gerada"):
        sinks.write_jsonl(str(tmp_path / "bad.jsonl"), [{"caso_id": "a", "condicao_id": "qwen_ft", "ementa_gerada": " "}])
        files.read_records(spark, str(tmp_path / "bad.jsonl"), "prediction")
