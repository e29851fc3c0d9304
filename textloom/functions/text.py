"""String functions with the semantics of Python's str and re, as Spark expressions.

Spark's trim removes spaces only and Java's \\s is ASCII unless told otherwise, so
white space is spelled out here once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is evaluated once however often ``f`` names it.

    Spark finds no common parts below functions with lambdas (array_compact is one), so an
    expression that is named k times there runs k times, with all that it is made of.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


#: One white-space character as str.split() and str.strip() see it.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def java_pattern(pattern: str, flags: str = "") -> str:
    """A Python pattern's Java form: Unicode classes, and '$' and '.' that know \\n only.

    flags: i ignores case (also beyond ASCII), s lets a dot match line ends.
    """
    return f"(?Ud{'iu' if 'i' in flags else ''}{'s' if 's' in flags else ''}){pattern}"


def strip(c: Column | str) -> Column:
    """str.strip(); looks at the ends only."""
    return F.btrim(c, F.lit(SPACES))


def tokens(c: Column | str) -> Column:
    """str.split(): words between white space, none empty; null for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(c, f"{SPACE}+"), lambda t: t != "")


def word_count(c: Column | str) -> Column:
    """len(str.split()); 0 for null."""
    return F.coalesce(F.size(tokens(c)), F.lit(0)).cast("long")


def is_blank(c: Column | str) -> Column:
    """Null, or nothing but white space."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(~c.rlike(f"(?!{SPACE})[\\s\\S]"), F.lit(True))


#: Joins the words of an n-gram; it is white space here, so no word holds it.
GLUE = "\x1f"


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams of a word array; empty if there are fewer words.

    An n-gram is its words joined by GLUE: arrays of strings are hashed by Spark's
    set functions, arrays of arrays are compared pair by pair.
    """
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), GLUE))
    return F.when(F.size(words) >= n, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def normalise_output(c: Column | str) -> Column:
    """Lines stripped, blank ones dropped, joined by one space."""
    c = F.col(c) if isinstance(c, str) else c
    lines = F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    return F.array_join(F.filter(F.transform(lines, strip), lambda s: s != ""), " ")


def sha256(c: Column | str) -> Column:
    """Lowercase hex SHA-256 of the UTF-8 text."""
    return F.sha2(F.encode(c, "UTF-8"), 256)
