"""JSON, JSON Lines, CSV and text sources, and what is known about files."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import contracts
from textloom.operators.chat import CONTENTS
from textloom.operators.contracts import ContractError
from textloom.sources.dump import read_lines

PAIRS = "id string, source string, target string, data_cadastro string"
METRICS = "case_id string, condition_id string, metric string, score double"
RATINGS = "case_id string, item_id string, blind_label string, rater_id string, criterion string, rating int, notes string"
CASES = "caso_id string, indice_teste int, fundamentacao string, ementa_referencia string"
PREDICTIONS = "caso_id string, condicao_id string, ementa_gerada string"
ANSWER = "struct<{}>".format(",".join(f"{d}:struct<score:int,justificativa:string>" for d in ("pertinencia_tematica", "completude_dispositiva", "fidelidade_factual", "concisao", "adequacao_terminologica")))
JUDGED = f"caso_id string, condicao_id string, avaliacao {ANSWER}"
CHAT = f"contents {CONTENTS}"


def read_json_array(spark: SparkSession, path: str, schema: str = PAIRS) -> DataFrame:
    """A JSON array of objects, types as given, never inferred. One file is one task: prefer JSON Lines beyond one machine."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_jsonl(spark: SparkSession, path: str, schema: str, empty_ok: bool = True) -> DataFrame:
    """JSON Lines with ordinal (place among non-blank lines, from 0); blank lines are skipped.

    A malformed line raises with its path and line number, as does an empty file
    unless ``empty_ok``.
    """
    lines = read_lines(spark, path, skip_blank=True)
    broken = "r is null or r._corrupt is not null"
    record = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = lines.select("ordinal", record.alias("r"))
    if parsed.filter(broken).take(1):
        at = read_lines(spark, path).filter(F.trim("value") != "").select("ordinal", record.alias("r")).filter(broken).agg(F.min("ordinal")).first()[0]
        raise ContractError(f"{path}:{at + 1}: malformed JSON")
    if not empty_ok and not parsed.take(1):
        raise ContractError(f"{path}: no records")
    return parsed.select("ordinal", "r.*").drop("_corrupt")


#: Keys of records on disk and the columns they become.
RENAMED = {
    "caso_id": "case_id", "condicao_id": "condition_id", "indice_teste": "test_index", "fundamentacao": "source", "ementa_referencia": "reference",
    "ementa_gerada": "candidate", "avaliacao": "answer", "model_id_api": "model", "mensagem_usuario": "message", "resposta_bruta": "response",
}
KINDS = {
    "case": (CASES, contracts.case_violations), "prediction": (PREDICTIONS, contracts.prediction_violations), "judge": (JUDGED, contracts.judge_record_violations),
}


def read_records(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """Records of a closed contract (case, prediction or judge), checked line by line, keys as columns of the engine."""
    schema, check = KINDS[kind]
    lines = read_lines(spark, path)
    lines = lines.filter(F.trim("value") != "")
    bad = contracts.broken_records(lines, check(F.col("value"), **options))
    contracts.require_empty(bad.withColumn("violations", F.array_join("violations", ",")), path)
    rows = read_jsonl(spark, path, schema, empty_ok=False)
    return rows.withColumnsRenamed({k: v for k, v in RENAMED.items() if k in rows.columns})


def records_of(df: DataFrame, *keys: str) -> DataFrame:
    """The engine's columns as records on disk have them, in the given order of keys."""
    return df.select(*(F.col(RENAMED.get(k, k)).alias(k) for k in keys))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, multiLine=True, escape='"', mode="FAILFAST")


def read_text(path: str) -> str:
    """A text file (a prompt, say), stripped."""
    return Path(path).read_text(encoding="utf-8").strip()


def first_with_dates(primary: DataFrame, fallback: DataFrame | None, column: str) -> DataFrame:
    """Dates of ``primary``, or of ``fallback`` where ``primary`` lacks the column or holds only nulls in it."""
    if column in primary.columns and primary.filter(F.col(column).isNotNull()).take(1):
        return primary.select(column)
    if fallback is None or column not in fallback.columns:
        return primary.sparkSession.createDataFrame([], f"`{column}` string")
    return fallback.select(column).filter(F.col(column).isNotNull())


def record_at(df: DataFrame, index: int) -> dict:
    """The record with this ordinal; an index out of bounds raises."""
    row = df.filter(F.col("ordinal") == index).first() if index >= 0 else None
    if row is None:
        raise IndexError(f"no record {index}")
    return row.asDict(recursive=True)


def file_size_mb(path: str) -> float | None:
    p = Path(path)
    return round(p.stat().st_size / 1024**2, 1) if p.is_file() else None


def count_lines(path: str) -> int | None:
    p = Path(path)
    if not p.is_file():
        return None
    with p.open(encoding="utf-8") as f:
        return sum(1 for line in f if line.strip())


def has_files(path: str) -> bool:
    p = Path(path)
    return p.is_dir() and any(p.iterdir())


def load_json(path: str) -> dict | None:
    """A JSON object from a file; None if the file is missing, invalid or holds something else."""
    try:
        out = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return out if isinstance(out, dict) else None


def load_manifest(path: str, profile: str | None = None, statuses: set[str] | None = None) -> dict | None:
    """A manifest that has the profile and one of the statuses; those without a profile don't count."""
    m = load_json(path)
    if m is None or (profile is not None and m.get("perfil_execucao") != profile) or (statuses is not None and m.get("status") not in statuses):
        return None
    return m
