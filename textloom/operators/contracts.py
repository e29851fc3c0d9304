"""Constraints on tables: each returns the rows that break it, or raises with a few of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions.text import is_blank, once, strip
from textloom.operators.profile import wall_clock


class ContractError(ValueError):
    """A table breaks its contract."""


def require_empty(bad: DataFrame, what: str, samples: int = 5) -> None:
    """Raise if ``bad`` has rows, with at most ``samples`` of them."""
    rows = bad.limit(samples).collect()
    if rows:
        raise ContractError(f"{what}: {', '.join(str(tuple(r)) for r in rows)}")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, n) of the keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing_keys(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of ``expected`` that ``found`` lacks."""
    return expected.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")


def coverage_gaps(expected: DataFrame, found: DataFrame, *keys: str) -> DataFrame:
    """(keys, side): keys on one side only, 'missing' or 'extra', by one aggregation over both sides."""
    both = expected.select(*keys, F.lit(1).alias("e"), F.lit(0).alias("f")).unionByName(found.select(*keys, F.lit(0).alias("e"), F.lit(1).alias("f")))
    sides = both.groupBy(*keys).agg(F.max("e").alias("e"), F.max("f").alias("f")).filter("e + f = 1")
    return sides.select(*keys, F.when(F.col("e") == 1, "missing").otherwise("extra").alias("side"))


def invalid_dates(df: DataFrame, column: str) -> DataFrame:
    """Values that are null, blank or no ISO-8601 date."""
    return df.select(column).filter(F.col(column).isNull() | is_blank(F.col(column).cast("string")) | wall_clock(column).isNull())


def require_dates(df: DataFrame, column: str, context: str) -> DataFrame:
    """``df`` with ``column`` as wall-clock timestamps; raises if one is invalid."""
    require_empty(invalid_dates(df, column), f"{context}: invalid {column}")
    return df.withColumn(column, wall_clock(column))


def invalid_scores(df: DataFrame, score: str = "score", condition: str = "condition_id", allowed=K.CONDITION_IDS) -> DataFrame:
    """Rows whose score is null, NaN or infinite, or whose condition isn't allowed."""
    s = F.col(score).cast("double")
    return df.filter(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")) | ~F.coalesce(F.col(condition).isin(*allowed), F.lit(False)))


def invalid_ratings(df: DataFrame, rating: str = "rating", criterion: str = "criterion", criteria=K.HUMAN_CRITERIA) -> DataFrame:
    """Rows off the 1 to 5 scale or with an unknown criterion."""
    return df.filter(~F.coalesce(F.col(rating).between(1, 5) & (F.col(rating) == F.floor(rating)), F.lit(False)) | ~F.coalesce(F.col(criterion).isin(*criteria), F.lit(False)))


def require_raters(df: DataFrame, rater: str = "rater_id", n: int = K.RATERS) -> None:
    found = df.agg(F.count_distinct(rater)).first()[0]
    if found != n:
        raise ContractError(f"{found} raters instead of {n}")


def check_ingest_stats(stats: dict) -> dict:
    """Ingest counters: a positive total, nothing negative, exported and dropped rows add up to it."""
    total, dropped, exported = (int(stats[k]) for k in ("total_lidos", "descartados_nulos", "exportados"))
    if total <= 0 or dropped < 0 or exported < 0 or dropped + exported != total:
        raise ContractError(f"inconsistent ingest counters: {stats}")
    return {"total_lidos": total, "descartados_nulos": dropped, "exportados": exported}


# Closed-world records: JSON lines with exactly these keys. ------------------------

#: Keys of each kind of record, and which of them are non-blank strings.
CASE_KEYS = ("caso_id", "indice_teste", "fundamentacao", "ementa_referencia")
PREDICTION_KEYS = ("caso_id", "condicao_id", "ementa_gerada")
JUDGE_KEYS = ("caso_id", "condicao_id", "avaliacao")
RAW_JUDGE_KEYS = ("caso_id", "condicao_id", "model_id_api", "mensagem_usuario", "resposta_bruta")


def _keys_exactly(json: Column, keys) -> Column:
    return F.coalesce(F.sort_array(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))


def _raw(fields: Column, key: str) -> Column:
    """JSON of one of a record's ``fields`` (map<string,variant>)."""
    return F.to_json(fields[key])


def _is_text(json: Column, raw: Column, key: str) -> Column:
    """A JSON string that isn't blank: numbers, objects and null don't count. ``raw`` is the field's JSON."""
    return F.coalesce(raw.startswith('"'), F.lit(False)) & ~is_blank(F.get_json_object(json, f"$.{key}"))


def _is_int(raw: Column, low: int, high: int | None) -> Column:
    """A JSON integer in range; true and false count as 1 and 0, as in the model these records come from."""

    def test(raw: Column) -> Column:
        n = F.when(raw == "true", 1).when(raw == "false", 0).otherwise(F.when(raw.rlike(r"^-?\d{1,18}$"), raw.try_cast("long")))
        return F.coalesce(n.between(low, high) if high is not None else n >= low, F.lit(False))

    return once(raw, test)


def _violations(**checks: Column) -> Column:
    return F.array_compact(F.array(*(F.when(~ok, name) for name, ok in checks.items())))


def _parsed(json: Column, violations) -> Column:
    """``violations(json, fields)`` with the text made once and its fields (map<string,variant>) parsed once."""
    return once(json, lambda j: once(F.from_json(j, "map<string,variant>"), lambda fields: violations(j, fields)))


def case_violations(json: Column) -> Column:
    return _parsed(json, lambda j, f: _violations(
        keys=_keys_exactly(j, CASE_KEYS), caso_id=_is_text(j, _raw(f, "caso_id"), "caso_id"), indice_teste=_is_int(_raw(f, "indice_teste"), 0, None),
        fundamentacao=_is_text(j, _raw(f, "fundamentacao"), "fundamentacao"), ementa_referencia=_is_text(j, _raw(f, "ementa_referencia"), "ementa_referencia"),
    ))


def _condition_ok(json: Column, expected: str | None) -> Column:
    def test(c: Column) -> Column:
        return F.coalesce(c.isin(*K.CONDITION_IDS) & (F.lit(expected is None) | (c == F.lit(expected))), F.lit(False))

    return once(strip(F.get_json_object(json, "$.condicao_id")), test)


def prediction_violations(json: Column, expected: str | None = None) -> Column:
    return _parsed(json, lambda j, f: _violations(
        keys=_keys_exactly(j, PREDICTION_KEYS), caso_id=_is_text(j, _raw(f, "caso_id"), "caso_id"), condicao_id=_condition_ok(j, expected), ementa_gerada=_is_text(j, _raw(f, "ementa_gerada"), "ementa_gerada")
    ))


#: A dimension without violations as get_json_object writes it, its reason without escapes and with a visible ASCII character.
_PLAIN_PART = r'^\{"score":[1-5],"justificativa":"[^"\\\x00-\x1f]*[!#-\[\]-~][^"\\\x00-\x1f]*"\}\z'


def judge_answer_violations(json: Column, at: str = "$") -> Column:
    """Of a judge's answer: exactly the five dimensions, each with a score from 1 to 5 and a reason."""

    def part_violations(d: str):
        def found(part: Column, f: Column) -> Column:
            return _violations(**{
                f"{d}.keys": _keys_exactly(part, ("score", "justificativa")), f"{d}.score": _is_int(_raw(f, "score"), 1, 5), f"{d}.justificativa": _is_text(part, _raw(f, "justificativa"), "justificativa"),
            })

        # most parts are plain: one test of these spares them the parser
        return lambda part: F.when(part.rlike(_PLAIN_PART), F.array().cast("array<string>")).otherwise(_parsed(part, found))

    def violations(answer: Column) -> Column:
        parts = (once(F.get_json_object(answer, f"$.{d}"), part_violations(d)) for d in K.JUDGE_DIMENSIONS)
        return F.concat(_violations(dimensions=_keys_exactly(answer, K.JUDGE_DIMENSIONS)), *parts)

    return once(F.get_json_object(json, at) if at != "$" else json, violations)


def judge_record_violations(json: Column, expected: str | None = None) -> Column:
    return _parsed(json, lambda j, f: F.concat(
        _violations(keys=_keys_exactly(j, JUDGE_KEYS), caso_id=_is_text(j, _raw(f, "caso_id"), "caso_id"), condicao_id=_condition_ok(j, expected)),
        judge_answer_violations(j, "$.avaliacao"),
    ))


def raw_judge_violations(json: Column) -> Column:
    return _parsed(json, lambda j, f: _violations(
        keys=_keys_exactly(j, RAW_JUDGE_KEYS), caso_id=_is_text(j, _raw(f, "caso_id"), "caso_id"), condicao_id=_condition_ok(j, None), model_id_api=_is_text(j, _raw(f, "model_id_api"), "model_id_api"),
        mensagem_usuario=_is_text(j, _raw(f, "mensagem_usuario"), "mensagem_usuario"), resposta_bruta=F.coalesce(_raw(f, "resposta_bruta").startswith("{"), F.lit(False)),
    ))


def broken_records(lines: DataFrame, violations: Column) -> DataFrame:
    """(ordinal, violations) of JSON lines (ordinal, value) that break their contract.

    Rows are dropped by the generator: a filter would be pushed below and repeat the checks.
    """
    return lines.select("ordinal", F.explode(F.filter(F.array(violations), lambda v: F.size(v) > 0)).alias("violations"))


def check_runner(flush_every: int = 1, limit: int | None = None, max_retries: int = 1, backoff: float = 0.0) -> None:
    """Options of a runner: positive flush interval, limit and retries, no negative pause."""
    if flush_every <= 0 or (limit is not None and limit <= 0) or max_retries <= 0 or backoff < 0:
        raise ContractError(f"flush_every={flush_every}, limit={limit}, max_retries={max_retries}, backoff={backoff}")


def check_condition(condition: str, model: str, base_model: str, adapter: str | None = None, needs_adapter: bool = False) -> str:
    """A condition that goes with its model: a fine-tuned one needs another model than the base one, or an adapter."""
    condition = condition.strip()
    if condition not in K.CONDITION_IDS:
        raise ContractError(f"unknown condition {condition!r}")
    if condition.endswith("_ft"):
        if needs_adapter and not adapter:
            raise ContractError(f"{condition} needs an adapter folder")
        if not needs_adapter and model == base_model:
            raise ContractError(f"{condition} can't use the base model {base_model!r}")
    return condition
