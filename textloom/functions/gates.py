"""Cheap tests that a text has to pass for a pattern to match anywhere in it, and leads that let a scan skip most places.

Patterns with Unicode classes test word boundaries at every character. What is
required here is part of every match, so results stay those of the pattern alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions.text import java_pattern, once

_NUMBERED = r"\d-\d|\(\d\d\)"  # of every number with a check digit, account and telephone
#: Pattern -> what each of its matches holds.
REQUIRED = {
    K.CPF: _NUMBERED, K.CNPJ: _NUMBERED, K.NPU: _NUMBERED, K.ACCOUNT: _NUMBERED, K.PHONE: _NUMBERED, K.EMAIL: "@",
    K.ADDRESS: r"(?:[nN][º°oO]?|[pPºoOeE])\s*\d", r"\bid[\s.]*[\s:]*\d{5,}": r"\d{5}", r"\bDJe\s+\d{1,2}[./]\d{1,2}[./]\d{2,4}": r"[dD][jJ][eE]\s+\d",
}
_RULES = {name: pattern for name, pattern, *_ in K.CLEANING_RULES}
_STAMPED = "[dD][jJ][eE]|[uU][lL][gG]|[aA][cC][pP]"  # DJe, DIVULG, julgamento, ACP: letters that have no third form
_TITLED = "[rR][eE][lL][aA][tT][oO][rR]|[jJ][uU][iIıİíÍ]|[mM][bB][aA][rR][gG][aA][dD]|[xX][cC][eE][lL][eE][nN][tT]"
REQUIRED |= {_RULES["html_tags"]: "<", _RULES["ids_pje"]: r"\d{4}", _RULES["data_cidade"]: r"\d{4}"}
REQUIRED |= {_RULES[r]: _STAMPED for r in ("dje_carimbo_longo", "dje_simples", "dje_data", "divulg_isolado", "acp_dpu", "sumula_julgamento_duplicada", "sumula_julgamento")}
REQUIRED |= {_RULES[r]: _TITLED for r in ("assinatura_magistrado_nome_titulo", "honorificos_juiz")}
#: Pattern -> white space that may follow its matches at the end of the text, and how they end before it.
ENDING = {_RULES["capslock_assinatura"]: (" \n\r\t\xa0", "^[A-ZÀ-Þ]{2}$")}
#: Pattern -> the first character of each of its matches; the long s is an s to patterns that ignore case.
FIRST = {
    K.CPF: r"\d", K.CNPJ: r"\d", K.NPU: r"\d", K.PHONE: r"[(\d]", K.HONORIFIC_NAME: "[sSſdDaArRpP]", K.AUDIT_HONORIFIC_NAME: "[sSſdDaArRpP]",
    K.CONTEXT_NAME: "[AmrS]", K.PROPER_NAME: "[A-ZÀ-Ÿ]", K.ADDRESS: "[rRaApPtTbBsSſfF]",
    _RULES["metadados_processuais"]: "(?-i:[pP][rR]|[aA][uU])",
}


def led(pattern: str, flags: str = "") -> str:
    """java_pattern with a test of the first character before all others."""
    first = FIRST.get(pattern)
    return java_pattern(f"(?={first}){pattern}" if first else pattern, flags)


def _required(pattern: str) -> str | None:
    bare = re.sub(r"\[[^\]]*\]", "", pattern)
    plain_at = re.search(r"@(?![?*{])", bare) and not re.search(r"[|()\\]", bare)  # a sequence with an at sign outside its classes
    return REQUIRED.get(pattern, "@" if plain_at else None)


def gated(text: Column, patterns, f: Callable[[Callable[[str], Column]], Column]) -> Column:
    """``f`` of a function that says of each of ``patterns`` whether it may match in ``text``; a requirement of several is tested once."""
    needs = list(dict.fromkeys(r for r in map(_required, patterns) if r))
    if not needs:
        return f(lambda pattern: F.lit(True))
    tests = F.array(*(text.contains(r) if len(r) == 1 else text.rlike(java_pattern(r)) for r in needs))
    return once(tests, lambda found: f(lambda pattern: F.get(found, F.lit(needs.index(_required(pattern)))) if _required(pattern) else F.lit(True)))


def rewrite(c: Column, layers) -> Column:
    """Rewrites (name, pattern, flags, replacement) in order, each sees what the ones before left.

    What patterns require is looked for in the text as it comes: replacements hold
    none of it, and set off what they join by a space or brackets.
    """

    def layer(text: Column, may: Column, pattern: str, flags: str, to: str) -> Column:
        def replaced(t: Column) -> Column:
            end = ENDING.get(pattern)
            test = F.substr(F.rtrim(t, F.lit(end[0])), F.lit(-2)).rlike(end[1]) if end else may
            return F.when(test, F.regexp_replace(t, led(pattern, flags), to)).otherwise(t)

        return once(text, replaced)

    def chain(first: Column, may_match) -> Column:
        out = first
        for _, pattern, flags, to in layers:
            out = layer(out, may_match(pattern), pattern, flags, to)
        return out

    return once(c, lambda first: gated(first, [p for _, p, *_ in layers], lambda may_match: chain(first, may_match)))
