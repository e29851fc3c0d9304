"""Masking of personal data in an ordered sequence of layers, JVM-side throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions.gates import gated, led, rewrite
from textloom.functions.text import SPACE, once, strip

#: (counter, pattern, flags, replacement) of the layers that are plain rewrites, in order.
PLAIN_LAYERS = (
    ("cpfs", K.CPF, "", K.MASK_CPF),
    ("cnpjs", K.CNPJ, "", K.MASK_CNPJ),
    ("npus", K.NPU, "", K.MASK_NPU),
    ("contas", K.ACCOUNT, "i", K.MASK_ACCOUNT),
    ("emails", K.EMAIL, "", K.MASK_EMAIL),
    ("telefones", K.PHONE, "", K.MASK_PHONE),
)
OPEN, CLOSE = "\x01", "\x02"


def has_context_marker(c: Column) -> Column:
    """A literal test that spares most texts the expensive pattern."""
    out = F.lit(False)
    for marker in K.CONTEXT_MARKERS:
        out = out | c.contains(marker)
    return out


def mask_plain(c: Column | str, layers=PLAIN_LAYERS) -> Column:
    """The layers in order. A text is scanned by those that may match it; masks hold nothing that a later layer looks for."""
    return rewrite(F.col(c) if isinstance(c, str) else c, layers)


def _windows(names: Column) -> Column:
    """All runs of two or more words of each name, longest first, then in text order."""

    def of(name: Column) -> Column:
        words = F.filter(F.split(name, f"{SPACE}+"), lambda w: w != "")
        n = F.size(words)
        spans = F.flatten(F.transform(F.sequence(F.lit(2), n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))
        return F.when(n >= 2, spans).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.flatten(F.transform(names, of)))
    keyed = F.array_sort(F.transform(every, lambda f: F.struct((-F.length(f)).alias("n"), f.alias("f"))))
    return F.transform(keyed, lambda x: x["f"])


def mask_proper_names(c: Column) -> Column:
    """Three or more capitalised words, unless they begin with a protected prefix.

    A protected match is consumed like any other, so matches are marked first, the
    protected ones unmarked, and the rest replaced.
    """
    prefixes = "|".join(p.replace(" ", "[ ]") for p in K.PROTECTED_PREFIXES)

    def replaced(marked: Column) -> Column:
        unmarked = F.regexp_replace(marked, f"{OPEN}((?:{prefixes})[^{CLOSE}]*){CLOSE}", "$1")
        return F.when(marked.contains(OPEN), F.regexp_replace(unmarked, f"{OPEN}[^{CLOSE}]*{CLOSE}", K.MASK_NAME)).otherwise(marked)

    return once(F.regexp_replace(c, led(K.PROPER_NAME), f"{OPEN}$0{CLOSE}"), replaced)


def _occurrences(c: Column, token: str) -> Column:
    return F.size(F.split(c, token.replace("[", r"\[").replace("]", r"\]"), -1)) - 1


def mask_text(df: DataFrame, column: str, counts: str | None = None) -> DataFrame:
    """``df`` with ``column`` masked ('' for null); ``counts``, if named, gets a struct of the layers' counts.

    Counts of patterns are taken on the text as it came, so overlapping layers
    count twice; nomes_proprios counts tokens gained. Fragments of collected names
    are replaced literally, longest first; of equal length, in text order.
    """
    t = f"tmp_{column}"
    original = F.coalesce(F.col(column), F.lit(""))
    honorific, context = led(K.HONORIFIC_NAME, "i"), led(K.CONTEXT_NAME)
    df = df.withColumn(f"{t}_0", original).withColumn(f"{t}_1", mask_plain(F.col(f"{t}_0")))
    text = F.col(f"{t}_1")
    full, title = F.regexp_extract_all(text, F.lit(honorific), F.lit(0)), F.regexp_extract_all(text, F.lit(honorific), F.lit(1))
    titled = F.zip_with(full, title, lambda m, h: strip(F.substr(m, F.length(h) + 1)))
    df = df.withColumn(f"{t}_titled", F.when(text.rlike(honorific), titled).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"{t}_2", F.when(F.size(f"{t}_titled") > 0, F.regexp_replace(text, honorific, f"$1 {K.MASK_HIDDEN_NAME}")).otherwise(text))
    text = F.col(f"{t}_2")
    named = F.transform(F.regexp_extract_all(text, F.lit(context), F.lit(2)), strip)
    df = df.withColumn(f"{t}_named", F.when(has_context_marker(text), named).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"{t}_3", F.when(has_context_marker(text), F.regexp_replace(text, context, "${prefixo}" + K.MASK_HIDDEN_NAME)).otherwise(text))
    names = F.filter(F.concat(F.col(f"{t}_titled"), F.col(f"{t}_named")), lambda n: n != "")
    df = df.withColumn(f"{t}_windows", F.when(F.size(names) > 0, _windows(names)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(f"{t}_4", F.aggregate(f"{t}_windows", F.col(f"{t}_3"), lambda acc, w: F.replace(acc, w, F.lit(K.MASK_NAME))))
    df = df.withColumn(f"{t}_5", mask_proper_names(F.col(f"{t}_4")))
    first, address = F.col(f"{t}_0"), led(K.ADDRESS, "i")
    df = df.withColumn(f"{t}_6", gated(first, [K.ADDRESS], lambda may_match: F.when(may_match(K.ADDRESS), F.regexp_replace(F.col(f"{t}_5"), address, K.MASK_ADDRESS)).otherwise(F.col(f"{t}_5"))))
    out = F.col(f"{t}_6")
    if counts:

        def n(pattern: str) -> Column:
            return F.regexp_count(first, F.lit(pattern)).cast("long")

        def plain(may_match) -> Column:
            layers = (*PLAIN_LAYERS, ("logradouros", K.ADDRESS, "i", K.MASK_ADDRESS))
            return F.struct(*(F.when(may_match(p), n(led(p, flags))).otherwise(F.lit(0).cast("long")).alias(name) for name, p, flags, _ in layers))

        df = df.withColumn(f"{t}_matches", gated(first, [*(p for _, p, *_ in PLAIN_LAYERS), K.ADDRESS], plain))
        fields = {name: F.col(f"{t}_matches")[name] for name, *_ in PLAIN_LAYERS}
        fields["nomes_honorificos"] = n(honorific) + F.when(has_context_marker(first), n(context)).otherwise(0)
        fields["nomes_proprios"] = (_occurrences(F.col(f"{t}_5"), K.MASK_NAME) - _occurrences(F.col(f"{t}_3"), K.MASK_NAME)).cast("long")
        fields["logradouros"] = F.col(f"{t}_matches")["logradouros"]
        df = df.withColumn(counts, F.struct(*(v.alias(k) for k, v in fields.items())))
    return df.withColumn(column, out).drop(*(f"{t}_{x}" for x in (0, 1, 2, 3, 4, 5, 6, "titled", "named", "windows", "matches")))


COUNTERS = (*(name for name, *_ in PLAIN_LAYERS), "nomes_honorificos", "nomes_proprios", "logradouros")


def mask_pairs(pairs: DataFrame, source: str = "source", target: str = "target", min_source: int = K.MIN_SOURCE_CHARS, min_target: int = K.MIN_TARGET_CHARS) -> DataFrame:
    """Masked pairs with mask_counts (both texts added up) and too_short (code points after masking)."""
    df = mask_text(mask_text(pairs, source, "tmp_source_counts"), target, "tmp_target_counts")
    total = F.struct(*((F.col(f"tmp_source_counts.{c}") + F.col(f"tmp_target_counts.{c}")).alias(c) for c in COUNTERS))
    return (
        df.withColumn("mask_counts", total).drop("tmp_source_counts", "tmp_target_counts")
        .withColumn("too_short", (F.length(source) < min_source) | (F.length(target) < min_target))
    )


def mask_totals(masked: DataFrame) -> DataFrame:
    """(counter, n): totals of all counters, dropped rows included, largest first, and the rows dropped."""
    sums = masked.agg(*(F.coalesce(F.sum(f"mask_counts.{c}"), F.lit(0)).alias(c) for c in COUNTERS), F.count_if("too_short").alias("descartados_pos_anon"))
    return sums.unpivot([], [*COUNTERS, "descartados_pos_anon"], "counter", "n")


def ranked_totals(totals: DataFrame) -> DataFrame:
    """Totals for display: dropped rows left out, largest first, ties by name."""
    return totals.filter("counter <> 'descartados_pos_anon'").orderBy(F.desc("n"), "counter")
