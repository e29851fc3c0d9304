"""Text cleaning by an ordered chain of rewrites, and reject accounting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import references
from textloom.functions.gates import rewrite
from textloom.functions.text import is_blank, strip, word_count


def unescape(c: Column | str) -> Column:
    """HTML references decoded by the full HTML5 table."""
    return references.unescape(F.col(c) if isinstance(c, str) else c)


def collapse_spaces(c: Column | str) -> Column:
    """Line ends and tabs to a space, runs of spaces to one, stripped; other spaces inside stay."""
    return strip(F.regexp_replace(c, r"[\r\n\t][ \r\n\t]*| [ \r\n\t]+", " "))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(c, r"<[^>]+>", " ")


def apply_rules(c: Column | str, rules=K.CLEANING_RULES) -> Column:
    """The rewrites in order; each sees what the ones before left."""
    return rewrite(F.col(c) if isinstance(c, str) else c, [(name, pattern, flags, to) for name, pattern, to, flags in rules])


def clean_text(c: Column | str, decode: bool = True) -> Column:
    """References decoded, rules applied, white space collapsed; '' for null or ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(collapse_spaces(apply_rules(unescape(c) if decode else c)), F.lit(""))


#: Reject reasons in the order in which they are tried.
REASONS = ("empty_before", "empty_after", "identical", "short")


def with_reject_reason(pairs: DataFrame, source: str = "source", target: str = "target", min_source: int = K.MIN_SOURCE_WORDS, min_target: int = K.MIN_TARGET_WORDS, clean: bool = True) -> DataFrame:
    """``pairs`` with cleaned texts and reject_reason: the first rule a pair fails, or null.

    Before cleaning a text is empty if null or '' (white space isn't); after it,
    identical compares stripped texts, short counts words.
    """
    gone = F.col(source).isNull() | (F.col(source) == "") | F.col(target).isNull() | (F.col(target) == "")
    df = pairs.withColumn("tmp_gone", gone)
    if clean:
        df = df.withColumns({source: clean_text(source), target: clean_text(target)})
    return df.withColumn(
        "reject_reason",
        F.when(F.col("tmp_gone"), "empty_before")
        .when((F.col(source) == "") | (F.col(target) == ""), "empty_after")
        .when(strip(source) == strip(target), "identical")
        .when((word_count(source) < min_source) | (word_count(target) < min_target), "short"),
    ).drop("tmp_gone")


def kept(df: DataFrame) -> DataFrame:
    return df.filter("reject_reason is null").drop("reject_reason")


def reject_counts(df: DataFrame) -> DataFrame:
    """One row: total, empty (both kinds), identical, short, kept, retention_pct (0 for an empty table)."""

    def n(*reasons: str) -> Column:
        return F.count_if(F.col("reject_reason").isin(*reasons))

    total = F.count(F.lit(1))
    kept_n = F.count_if(F.col("reject_reason").isNull())
    return df.agg(
        total.alias("total"), n("empty_before", "empty_after").alias("empty"), n("identical").alias("identical"), n("short").alias("short"),
        kept_n.alias("kept"), F.coalesce(F.try_divide(kept_n * 100.0, total), F.lit(0.0)).alias("retention_pct"),
    )


def drop_blank_pairs(df: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Rows of which neither text is null or blank."""
    return df.filter(~is_blank(source) & ~is_blank(target))
