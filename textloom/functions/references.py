"""HTML references decoded as by html.unescape, without Python workers and the batches of texts they hold."""

from __future__ import annotations

import html
import json
import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import once

_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Names that count without a semicolon, also before other letters: the longest first.
_OPEN_NAMES = "^(?:" + "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"
#: Numbers that don't stand for their own code point, but for surrogates and what lies beyond the last one.
_CANDIDATES = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(plane << 16 | low for plane in range(17) for low in (0xFFFE, 0xFFFF))]
_NUMBERS = {str(n): html.unescape(f"&#{n};") for n in _CANDIDATES if html.unescape(f"&#{n};") != chr(n)}
_BUCKETS = 1024


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """Value of a key of a fixed table, or null. A map is searched from end to end, so the table is cut into short ones by a hash."""
    buckets: list[dict[str, str]] = [{} for _ in range(_BUCKETS)]
    for k, v in table.items():
        buckets[zlib.crc32(k.encode()) % _BUCKETS][k] = v
    maps = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,string>>")  # folded to a constant by the optimizer
    return F.try_element_at(F.get(maps, (F.crc32(key.cast("binary")) % _BUCKETS).cast("int")), key)


def _character(n: Column) -> Column:
    """Text of one code point; the letter in front keeps U+FEFF from being read as a byte order mark."""
    return F.substr(F.decode(F.unhex(F.concat(F.lit("00000041"), F.lpad(F.hex(n), 8, "0"))), "UTF-32"), F.lit(2))


def _number(ref: Column) -> Column:
    digits = F.regexp_replace(ref, "^&#[xX]?0*|;$", "")
    is_hex = F.lower(F.substr(ref, F.lit(3), F.lit(1))) == "x"

    def read(d: Column) -> Column:
        n = F.when(d == "", 0).when(F.length(d) > 7, 0x110000).when(is_hex, F.conv(d, 16, 10).cast("int")).otherwise(d.try_cast("int"))
        return once(n, lambda n: F.coalesce(_lookup(n.cast("string"), _NUMBERS), F.when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "�").otherwise(_character(n))))

    return once(digits, read)


def _name(ref: Column) -> Column:
    def by_prefix(name: Column) -> Column:
        return once(F.regexp_extract(name, _OPEN_NAMES, 0), lambda p: F.when(p != "", F.concat(_lookup(p, html5), F.substr(name, F.length(p) + 1))))

    return once(F.substr(ref, F.lit(2)), lambda name: F.coalesce(_lookup(name, html5), by_prefix(name), ref))


def unescape(c: Column) -> Column:
    """The text with its references decoded; null for null."""
    decoded = F.transform(F.regexp_extract_all(c, F.lit(_REFERENCE), F.lit(0)), lambda r: F.when(r.startswith("&#"), _number(r)).otherwise(_name(r)))
    whole = F.array_join(F.zip_with(F.split(c, _REFERENCE, -1), decoded, lambda part, d: F.concat(part, F.coalesce(d, F.lit("")))), "")
    return F.when(c.contains("&"), whole).otherwise(c)
