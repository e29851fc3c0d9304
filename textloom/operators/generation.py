"""Answers of models: requests, texts and judgements taken from them. Clients themselves are injected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions.text import is_blank, once
from textloom.operators.contracts import coverage_gaps, judge_answer_violations, require_empty

ANSWER = "struct<{}>".format(",".join(f"{d}:struct<score:int,justificativa:string>" for d in K.JUDGE_DIMENSIONS))


def chat_request(model: str, system: str, user: Column | str, temperature: float = 0.0, most_tokens: int = 1024) -> Column:
    """JSON body of a chat request that asks for a JSON object."""
    user = F.col(user) if isinstance(user, str) else user
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(
        F.lit(model).alias("model"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"),
        F.lit(temperature).alias("temperature"), F.lit(most_tokens).alias("max_tokens"), F.struct(F.lit("json_object").alias("type")).alias("response_format"),
    ))


def response_text(response: dict) -> str:
    """Text of a generation: its ``text``, else the first part that isn't blank; none raises."""
    text = (response.get("text") or "").strip()
    for candidate in () if text else response.get("candidates") or ():
        parts = ((candidate.get("content") or {}).get("parts")) or ()
        text = next((p["text"].strip() for p in parts if (p.get("text") or "").strip()), "")
        if text:
            break
    if not text:
        raise ValueError("the answer holds no text")
    return text


def judge_problem(response: Column | str) -> Column:
    """What is wrong with a judge's chat response, or null: 'truncated', 'empty', 'not json', or the first breach of contract."""
    response = F.col(response) if isinstance(response, str) else response

    def problem(content: Column, cut: Column) -> Column:
        return (
            F.when(cut, "truncated").when(is_blank(content), "empty")
            .when(F.try_parse_json(content).isNull() | ~F.startswith(F.ltrim(content), F.lit("{")), "not json").otherwise(F.try_element_at(judge_answer_violations(content), F.lit(1)))
        )

    return once(response, lambda r: once(F.get_json_object(r, "$.choices[0].message.content"), lambda c: problem(c, F.get_json_object(r, "$.choices[0].finish_reason") == "length")))


def judge_answer(response: Column | str) -> Column:
    """The five dimensions' scores and reasons of a response without problem."""
    return F.from_json(F.get_json_object(response, "$.choices[0].message.content"), ANSWER)


def judged(responses: DataFrame, response: str = "response") -> tuple[DataFrame, DataFrame]:
    """(answers, failures) of chat responses: rows with answer, and rows with problem."""
    df = responses.withColumn("problem", judge_problem(response))
    good = df.filter("problem is null").withColumn("answer", judge_answer(F.col(response)))
    return good.drop("problem", response), df.filter("problem is not null").drop(response)


def require_aligned(answers: DataFrame, raw: DataFrame) -> None:
    """Answers and raw responses on disk have to hold the same keys."""
    require_empty(coverage_gaps(answers, raw, "case_id", "condition_id"), "answers and raw responses differ")


def absent_conditions(predictions: DataFrame, conditions=K.CONDITION_IDS) -> list[str]:
    """Conditions that have no predictions."""
    there = {r[0] for r in predictions.select("condition_id").distinct().limit(len(conditions) + 1).collect()}
    return [c for c in conditions if c not in there]


def tuning_manifest(base_model: str, train_uri: str, profile: str, status: str = "prepared", **options) -> dict:
    """What a tuning job is given; submitting it is left to the provider's client."""
    if status not in ("prepared", "running", "completed", "failed"):
        raise ValueError(f"unknown status {status!r}")
    return {"modelo_base": base_model, "dataset_treino": train_uri, "perfil_execucao": profile, "status": status, "hiperparametros": options}
