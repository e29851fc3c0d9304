"""Chat records: shaping, extraction and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions.text import strip

CONTENTS = "array<struct<role:string,parts:array<struct<text:string>>>>"


def chat_record(source: Column | str, target: Column | str, prompt: str) -> Column:
    """contents: a user turn of prompt, blank line, marker and source, and a model turn of the target."""
    source, target = (F.col(c) if isinstance(c, str) else c for c in (source, target))

    def turn(role: str, text: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(F.struct(text.alias("text"))).alias("parts"))

    return F.array(turn("user", F.concat(F.lit(f"{prompt}\n\n{K.MARKER}"), source)), turn("model", target))


def _text_of(content: Column) -> Column:
    return F.array_join(F.transform(content["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")


def last_text(contents: Column | str, role: str) -> Column:
    """Text of the last turn of a role, its parts joined; '' if there is none."""
    turns = F.filter(contents, lambda c: c["role"] == role)
    return F.when(F.size(turns) > 0, _text_of(F.element_at(turns, -1))).otherwise("")


def after_marker(c: Column) -> Column:
    """Text after the first marker, or all of it where the marker is missing."""
    at = F.locate(K.MARKER, c) if isinstance(c, str) else F.instr(c, K.MARKER)
    return F.when(at > 0, F.substr(c, at + len(K.MARKER))).otherwise(c)


def extract_pair(df: DataFrame, contents: str = "contents") -> DataFrame:
    """``df`` with source and target from chat records."""
    return df.withColumn("source", after_marker(last_text(contents, "user"))).withColumn("target", last_text(contents, "model"))


def first_prompt(contents: Column | str) -> Column:
    """Stripped text before the marker in the first user turn; null without turn or marker."""
    text = F.try_element_at(F.transform(F.filter(contents, lambda c: c["role"] == "user"), _text_of), F.lit(1))
    at = F.instr(text, K.MARKER)
    return F.when(at > 0, strip(F.substr(text, F.lit(1), at - 1)))


def check_prompt(df: DataFrame, prompt: str, contents: str = "contents") -> DataFrame:
    """Rows (ordinal, found) whose prompt differs from ``prompt``; empty if there is no drift."""
    return df.select("ordinal", first_prompt(contents).alias("found")).filter(~F.col("found").eqNullSafe(F.lit(prompt)))


def require_prompt(df: DataFrame, prompt: str, contents: str = "contents") -> None:
    bad = check_prompt(df, prompt, contents).orderBy("ordinal").head()
    if bad is not None:
        raise ValueError(f"row {bad['ordinal']}: the prompt is not the canonical one")


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sft_samples(df: DataFrame, prompt: str, prefix: str = "treino") -> DataFrame:
    """(ordinal, source, target) to case_id, system_prompt, source, target, messages, prompt, completion; texts stripped."""
    s, t, p = strip("source"), strip("target"), F.lit(prompt.strip())
    return df.select(
        F.format_string(f"{prefix}_%05d", F.col("ordinal")).alias("case_id"), p.alias("system_prompt"), s.alias("source"), t.alias("target"),
        F.array(_message("system", p), _message("user", s), _message("assistant", t)).alias("messages"),
        F.array(_message("system", p), _message("user", s)).alias("prompt"), F.array(_message("assistant", t)).alias("completion"),
    )


def evaluation_cases(df: DataFrame, prefix: str = "teste") -> DataFrame:
    """(ordinal, source, target) to case_id, test_index, source, reference; ordinals count from 0."""
    return df.select(
        F.format_string(f"{prefix}_%05d", F.col("ordinal")).alias("case_id"), F.col("ordinal").cast("int").alias("test_index"), "source", F.col("target").alias("reference")
    )


def judge_message(source: Column | str, candidate: Column | str) -> Column:
    """The two-section message of a judge, both texts stripped."""
    return F.concat(F.lit(K.JUDGE_SOURCE_HEADING), strip(source), F.lit("\n\n" + K.JUDGE_TARGET_HEADING), strip(candidate))
