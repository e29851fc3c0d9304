"""Execution profiles, artifact paths, contracts and manifests."""

from __future__ import annotations

import hashlib
import time
from contextlib import contextmanager
from datetime import datetime
from pathlib import Path

from textloom.functions import constants as K
from textloom.sources.files import count_lines, has_files, load_manifest
from textloom.sources.sinks import write_json

EXPLORATORY, OFFICIAL = "exploratorio", "oficial"
PRIMARY_METRICS = ("bertscore_f1", "judge_score_global")
SECONDARY_METRICS = ("rouge1_f1", "rouge2_f1", "rougeL_f1", *(f"judge_{d}" for d in K.JUDGE_DIMENSIONS))


def check_profile(profile: str) -> str:
    if profile not in (EXPLORATORY, OFFICIAL):
        raise ValueError(f"unknown profile {profile!r}")
    return profile


def root_of(base: str, profile: str, part: str) -> Path:
    """Folder of a part of the work: under the base for official runs, in a folder of its own for exploratory ones."""
    root = Path(base) if check_profile(profile) == OFFICIAL else Path(base) / EXPLORATORY
    return root / part


def tuning_artifacts(base: str, profile: str) -> dict[str, Path]:
    d = root_of(base, profile, "tuning")
    return {
        "dir": d, "gemini_manifest": d / "gemini_sft_manifest.json", "gemini_model": d / "modelo_gemini_nome.txt",
        "qwen_manifest": d / "qwen_sft_manifest.json", "qwen_checkpoint": d / "modelo_qwen_checkpoint",
    }


def object_prefix(profile: str, official: str, exploratory: str) -> str:
    """Prefix for uploads, so that trial runs don't touch official objects."""
    return official if check_profile(profile) == OFFICIAL else exploratory


def evaluation_artifacts(base: str, profile: str) -> dict:
    d = root_of(base, profile, "evaluation")
    predictions = {c: d / "predicoes" / f"{c}.jsonl" for c in K.CONDITION_IDS}
    return {
        "dir": d, "protocol": d / "protocolo_avaliacao.json", "cases": d / "casos_avaliacao.jsonl", "predictions": predictions,
        "prediction_manifests": {c: p.with_suffix(".manifest.json") for c, p in predictions.items()},
        "metrics": d / "metricas_automaticas.csv", "judged": d / "avaliacao_llm_judge.jsonl", "judged_raw": d / "avaliacao_llm_judge_bruta.jsonl",
        "judge_manifest": d / "avaliacao_llm_judge_manifest.json", "human_sample": d / "amostra_humana.json", "blind_key": d / "gabarito_cegamento_humano.json",
        "ratings": d / "avaliacao_humana.csv", "human_report": d / "relatorio_avaliacao_humana.json", "statistics": d / "relatorio_estatistico.json",
    }


def sha256_text(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def effective_batch(per_device: int, accumulation: int) -> int:
    if per_device <= 0 or accumulation <= 0:
        raise ValueError("batch size and accumulation have to be positive")
    return per_device * accumulation


def experiment_name(prefix: str, at: datetime | None = None) -> str:
    return f"{prefix}_{(at or datetime.now()):%Y%m%d_%H%M%S}"


# JSON Schemas -------------------------------------------------------------------------


def _object(**properties: dict) -> dict:
    return {"type": "object", "additionalProperties": False, "required": list(properties), "properties": properties}


TEXT = {"type": "string", "minLength": 1}


def judge_answer_schema() -> dict:
    part = _object(score={"type": "integer", "minimum": 1, "maximum": 5}, justificativa=TEXT)
    return _object(**{d: part for d in K.JUDGE_DIMENSIONS})


def case_schema() -> dict:
    return _object(caso_id=TEXT, indice_teste={"type": "integer", "minimum": 0}, fundamentacao=TEXT, ementa_referencia=TEXT)


def prediction_schema() -> dict:
    return _object(caso_id=TEXT, condicao_id={"enum": list(K.CONDITION_IDS)}, ementa_gerada=TEXT)


def judge_record_schema() -> dict:
    return _object(caso_id=TEXT, condicao_id={"enum": list(K.CONDITION_IDS)}, avaliacao=judge_answer_schema())


def _strings(x):
    if isinstance(x, dict):
        return {str(k): _strings(v) for k, v in x.items()}
    return str(x) if isinstance(x, Path) else x


def protocol(base: str, profile: str, judge_prompt: str, judge_model: str) -> dict:
    """The evaluation's protocol: outcomes, conditions, schemas, sampling, inference and artifacts."""
    return {
        "perfil_execucao": check_profile(profile), "co_desfechos_primarios": list(PRIMARY_METRICS), "desfechos_secundarios": list(SECONDARY_METRICS),
        "condicoes_experimentais": [dict(zip(("id", "modelo", "familia", "condicao"), c, strict=True)) for c in K.CONDITIONS],
        "llm_judge": {"modelo_api": judge_model, "prompt_sha256": sha256_text(judge_prompt), "dimensoes": list(K.JUDGE_DIMENSIONS), "schema_resposta": judge_answer_schema(), "schema_registro": judge_record_schema()},
        "schema_caso_avaliacao": case_schema(), "schema_predicao": prediction_schema(),
        "avaliacao_humana": {
            "casos_amostrados": K.CASES_PER_STRATUM * K.STRATA, "casos_por_estrato": K.CASES_PER_STRATUM, "avaliadores": K.RATERS,
            "criterios": list(K.HUMAN_CRITERIA), "seed_amostragem": K.SEED, "seed_cegamento": K.SEED,
        },
        "inferencia": {"bootstrap_pareado_iteracoes": K.ITERATIONS, "permutacao_pareada_iteracoes": K.ITERATIONS, "ajuste_primario": "holm_bonferroni", "ajuste_secundario": "benjamini_hochberg"},
        "artefatos": _strings(evaluation_artifacts(base, profile)),
    }


# Status -------------------------------------------------------------------------------------


def roll_up(statuses: list[str], none: str, every: str, some: str) -> str:
    """``none`` if there are no statuses or all are that, ``every`` if all are that, else ``some``."""
    if all(s == none for s in statuses):
        return none
    return every if all(s == every for s in statuses) else some


def validation_status(statuses: list[str]) -> str:
    return roll_up(statuses, "pendente", "validada", "parcial")


def official_status(statuses: list[str]) -> str:
    return roll_up(statuses, "pendente", "concluida", "em_andamento")


def status_of(manifest: str, output: str | None = None, statuses: set[str] = frozenset({"completed", "prepared"})) -> tuple[str, dict | None]:
    """Official status by a manifest: pending without one, running while its output is missing, else done."""
    m = load_manifest(manifest, OFFICIAL, set(statuses))
    if m is None:
        return "pendente", None
    return ("concluida" if output is None or Path(output).exists() else "em_andamento"), m


def best_manifest(folder: str, names: list[str], profile: str = EXPLORATORY, statuses: set[str] = frozenset({"completed"})) -> tuple[dict | None, Path | None]:
    """The first manifest, in order of preference, that is valid."""
    for name in names:
        path = Path(folder) / name
        if (m := load_manifest(str(path), profile, set(statuses))) is not None:
            return m, path
    return None, None


def readiness(base: str, judge_manifests: list[str] | None = None) -> dict:
    """What of tuning, inference and evaluation is there, for both profiles."""
    out: dict = {}
    for profile in (EXPLORATORY, OFFICIAL):
        e, t = evaluation_artifacts(base, profile), tuning_artifacts(base, profile)
        predictions = {}
        for c in K.CONDITION_IDS:
            m = load_manifest(str(e["prediction_manifests"][c]), profile, {"completed"})
            predictions[c] = {"manifest": m is not None, "rows": count_lines(str(e["predictions"][c]))}
        judge, at = best_manifest(str(e["dir"]), judge_manifests or [e["judge_manifest"].name], profile)
        parts = {
            "tuning_gemini": load_manifest(str(t["gemini_manifest"]), profile) is not None,
            "tuning_qwen": load_manifest(str(t["qwen_manifest"]), profile) is not None and has_files(str(t["qwen_checkpoint"])),
            **{f"predictions_{c}": p["manifest"] and bool(p["rows"]) for c, p in predictions.items()},
            "judge": judge is not None, "metrics": e["metrics"].is_file(), "ratings": e["ratings"].is_file(), "statistics": e["statistics"].is_file(),
        }
        done = "concluida" if profile == OFFICIAL else "validada"
        statuses = [done if ok else "pendente" for ok in parts.values()]
        out[profile] = {
            "components": parts, "predictions": predictions, "judge_manifest": str(at) if at else None,
            "status": official_status(statuses) if profile == OFFICIAL else validation_status(statuses),
        }
    return out


# Timing ---------------------------------------------------------------------------------------


class Timings:
    """Wall time of named phases; written before a report reads it, so the report has this run's times."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str):
        began = time.monotonic()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began

    def save(self, path: str) -> Path:
        return write_json(path, {**{k: round(v, 3) for k, v in self.seconds.items()}, "total": round(sum(self.seconds.values()), 3)})


def duration_text(seconds: float) -> str:
    minutes, rest = divmod(int(seconds), 60)
    return f"{minutes}min {rest}s" if minutes else f"{rest}s"


def gauges(retention: float) -> dict[str, float]:
    return {"value": retention, "rest": 100.0 - retention}


def grouped(n: int) -> str:
    """A whole number with dots between thousands."""
    return f"{n:,}".replace(",", ".")


def narrative(total: int, kept: int, masked: int, ratio: float | None) -> list[str]:
    """Sentences of the report; every comma becomes a dot, in prose too, as readers of these reports expect."""
    lines = [f"{total:,} registros lidos, {kept:,} mantidos", f"{masked:,} substituições de dados pessoais"]
    if ratio is not None:
        lines.append(f"razão mediana de {ratio:.1f}, em palavras")
    return [s.replace(",", ".") for s in lines]


def compression_hint(median_source: float, median_target: float) -> str:
    return f"{int(median_source // median_target)}:1" if median_target else "?:1"
