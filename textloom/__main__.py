"""Command line: python -m textloom COMMAND ..."""

from __future__ import annotations

import argparse
import json
import sys
from functools import reduce

from pyspark.sql import DataFrame

from textloom.operators import chat, contracts, evaluation
from textloom.plans import corpus, manifest, registry
from textloom.session import session
from textloom.sources import dump, files, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="textloom")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("query", help="run a registered query")
    q.add_argument("name", choices=sorted(registry.QUERIES))
    q.add_argument("data")
    q.add_argument("--rows", type=int, default=20)
    i = sub.add_parser("ingest", help="records of a plain-text dump, as JSON Lines")
    i.add_argument("dump")
    i.add_argument("table")
    i.add_argument("out")
    i.add_argument("--source", default="fundamentacao")
    i.add_argument("--target", default="ementa")
    c = sub.add_parser("corpus", help="clean, mask, split, audit and profile raw pairs")
    c.add_argument("pairs")
    c.add_argument("prompt")
    c.add_argument("out")
    c.add_argument("--test-share", type=float, default=0.10)
    e = sub.add_parser("cases", help="evaluation cases of a chat file")
    e.add_argument("chat")
    e.add_argument("out")
    f = sub.add_parser("sft", help="training samples of a chat file")
    f.add_argument("chat")
    f.add_argument("prompt")
    f.add_argument("out")
    m = sub.add_parser("metrics", help="the long metric table of cases, predictions and judgements")
    m.add_argument("cases")
    m.add_argument("judged")
    m.add_argument("out")
    m.add_argument("predictions", nargs="+")
    h = sub.add_parser("human", help="blind sample, key and rating template")
    h.add_argument("cases")
    h.add_argument("out")
    h.add_argument("predictions", nargs="+")
    k = sub.add_parser("agreement", help="report on filled ratings")
    k.add_argument("folder")
    k.add_argument("ratings")
    k.add_argument("out")
    v = sub.add_parser("view", help="one record of a chat file")
    v.add_argument("path")
    v.add_argument("index", type=int)
    s = sub.add_parser("statistics", help="paired inference over a metric table")
    s.add_argument("metrics")
    s.add_argument("out")
    t = sub.add_parser("protocol", help="the evaluation protocol")
    t.add_argument("base")
    t.add_argument("prompt")
    t.add_argument("--profile", default=manifest.EXPLORATORY, choices=(manifest.EXPLORATORY, manifest.OFFICIAL))
    t.add_argument("--model", default="judge")
    r = sub.add_parser("readiness", help="what is there of later phases")
    r.add_argument("base")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "readiness":
        print(json.dumps(manifest.readiness(a.base), ensure_ascii=False, indent=2))
        return 0
    if a.command == "protocol":
        path = manifest.evaluation_artifacts(a.base, a.profile)["protocol"]
        print(sinks.write_json(str(path), manifest.protocol(a.base, a.profile, files.read_text(a.prompt), a.model)))
        return 0
    spark = session()
    if a.command == "query":
        registry.QUERIES[a.name](spark, a.data).show(a.rows, truncate=60)
    elif a.command == "ingest":
        fields = {"id": "id", "source": a.source, "target": a.target, "data_cadastro": "data_cadastro"}
        records, stats = dump.extract_records(dump.read_lines(spark, a.dump), a.table, fields)
        sinks.save_records(records.orderBy("ordinal"), a.out)
        print(json.dumps(stats))
    elif a.command in ("cases", "sft"):
        pairs = chat.extract_pair(files.read_jsonl(spark, a.chat, files.CHAT, empty_ok=False))
        if a.command == "sft":
            prompt = files.read_text(a.prompt)
            chat.require_prompt(pairs, prompt)
            sinks.save_records(chat.sft_samples(pairs, prompt).orderBy("case_id"), a.out)
        else:
            sinks.save_records(files.records_of(chat.evaluation_cases(pairs).orderBy("test_index"), *contracts.CASE_KEYS), a.out)
    elif a.command in ("metrics", "human"):
        cases = files.read_records(spark, a.cases, "case").drop("ordinal")
        predictions = reduce(DataFrame.unionByName, (files.read_records(spark, p, "prediction") for p in a.predictions)).drop("ordinal")
        if a.command == "metrics":
            judged = files.read_records(spark, a.judged, "judge").drop("ordinal")
            table = evaluation.evaluation_metrics(evaluation.join_predictions(cases, predictions), judged)
            sinks.write_small_table(table, a.out, ["case_id", "condition_id", "metric"])
        else:
            sample, key, template = corpus.prepare_human_evaluation(cases, predictions)
            for name, df, order in (("sample", sample, "case_id"), ("key", key, "item_id")):
                sinks.write_json(f"{a.out}/{name}.json", [r.asDict(recursive=True) for r in df.orderBy(order).collect()])
            sinks.write_small_table(template, f"{a.out}/ratings.csv", ["case_id", "item_id", "rater_id", "criterion"])
    elif a.command == "agreement":
        key = spark.createDataFrame(files.json.loads(files.read_text(f"{a.folder}/key.json")))
        items = key.select("case_id", "item_id", "blind_label")
        ratings = files.read_csv(spark, a.ratings, files.RATINGS)
        raters = sorted(r[0] for r in ratings.select("rater_id").distinct().collect())
        report = corpus.human_report(ratings, evaluation.rating_grid(items), key, raters)
        sinks.write_json(a.out, {k: [r.asDict() for r in df.collect()] for k, df in report.items()})
    elif a.command == "view":
        print(json.dumps(files.record_at(files.read_jsonl(spark, a.path, files.CHAT), a.index), ensure_ascii=False, indent=2))
    elif a.command == "statistics":
        result = corpus.statistics(files.read_csv(spark, a.metrics, files.METRICS), list(manifest.PRIMARY_METRICS))
        sinks.write_json(a.out, {k: [r.asDict() for r in df.collect()] for k, df in result.items()})
    elif a.command == "corpus":
        times = manifest.Timings()
        prompt = files.read_text(a.prompt)
        raw = files.read_jsonl(spark, a.pairs, files.PAIRS)
        with times.phase("build"):
            built = corpus.build_corpus(raw, prompt, a.test_share)
            for part in ("train", "test"):
                sinks.save_chat(built[part], f"{a.out}/{part}")
        with times.phase("audit"):
            ok, failed = corpus.audit.gate({part: corpus.audit_records(built[part]) for part in ("train", "test")})
        if not ok:
            print(f"personal data left in: {', '.join(failed)}", file=sys.stderr)
            return 1
        with times.phase("profile"):
            report = corpus.profile_report(built["split"], raw, built["judged"], built["masked"], times)
        sinks.write_json(f"{a.out}/report.json", report)
        times.save(f"{a.out}/timings.json")
    return 0


if __name__ == "__main__":
    sys.exit(main())
