"""Secrets in text: fixed patterns, and character Markov models of random strings."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import free_name, let

# The base patterns. AKIA and hex runs are maximal, so a least
# length inside the pattern finds the same matches as a filter after it.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

#: Candidates of the models: long runs of token characters.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

#: Labelled sample of ordinary names: words that identifiers are put together from.
WORDS = """
account action address array async attribute average backend balance batch before boolean border buffer build button
cache callback center change channel character check children class client cluster collection column command comment
component config connection constant container content context control convert counter create current customer data
database default delete description destination device directory display document domain download duration element
enable encoding error event example exception execute export expression factory feature field file filter folder format
function generate global group handler header height history identifier image import index information initial input
instance integer interface internal invoice item iterator key label language length level library listener local
location manager mapping maximum memory message method minimum module name network number object offset operation option
order output package parameter parent parser password path pattern payment performance position prefix previous private
process product profile project property provider public query random range record reference register remove render
request resource response result return sample schema search section select sequence server service session setting
signature source start state static status storage stream string structure style subject suffix summary support system
table target template temporary text thread time title total transaction transform transport type update upload user
value variable vector version video view visible volume warning width window worker
aber alle anderen beispiel berechnung einstellung entwicklung gesellschaft geschwindigkeit keit lich schaft ung
verantwortung wissenschaft zeichen zusammen entre gouvernement nouveau ailleurs mentions toujours traitement ation
aunque ciudad desarrollo entonces gobierno mientras nacimiento siempre trabajo
""".split()


def _identifiers() -> list[str]:
    """Ordinary identifiers, by joining two or three words in the usual ways."""
    out = []
    n = len(WORDS)
    for k, a in enumerate(WORDS):
        b, c = WORDS[(7 * k + 3) % n], WORDS[(13 * k + 5) % n]
        out += [f"{a}{b}{c}", f"{a}_{b}_{c}", f"{a}-{b}", a + b.title() + c.title(), (a + "_" + b).upper(), f"{a}/{b}/{c}", f"{a}{k % 100}", a.title() + b]
    return out


def _random_strings(count: int = 2400) -> list[str]:
    """Random strings in the alphabets that keys use, from a digest of their number."""
    alphabets = (
        "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
        "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    )
    out = []
    for k in range(count):
        letters = alphabets[k % len(alphabets)]
        out.append("".join(letters[b % len(letters)] for b in hashlib.sha512(str(k).encode()).digest()[:40]))
    return out


#: Symbols of the models: letters in either case, all digits as one, all marks as one.
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIZE = len(LETTERS) + 2


def _symbol(c: str) -> int:
    return LETTERS.index(c) if c in LETTERS else len(LETTERS) + (not c.isdigit())


def log_ratios(random: list[str] | None = None, ordinary: list[str] | None = None, smooth: float = 0.5) -> list[float]:
    """Log-likelihood ratio of each transition, random against ordinary, SIZE x SIZE row by row.

    Runs of digits are as likely in either model, so a long number proves nothing by itself.
    """

    def model(samples: list[str]) -> list[list[float]]:
        counts = [[smooth] * SIZE for _ in range(SIZE)]
        for s in samples:
            symbols = [_symbol(c) for c in s]
            for a, b in zip(symbols, symbols[1:], strict=False):
                counts[a][b] += 1
        return [[math.log(x / sum(row)) for x in row] for row in counts]

    p = model(random if random is not None else _random_strings())
    q = model(ordinary if ordinary is not None else _identifiers())
    digit = len(LETTERS)
    return [0.0 if a == b == digit else p[a][b] - q[a][b] for a in range(SIZE) for b in range(SIZE)]


SPANS = "array<struct<s:int,e:int,v:string>>"
#: Characters of a candidate, and the mark that takes their place in a base match.
TOKEN = "A-Za-z0-9+/_="
#: Code points that are cut, and that are scored, at a time.
CHUNK, SCORED = 4096, 1 << 16


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _running(values: str, op: str) -> str:
    """SQL for running sums or maxima of an int array: each round adds what stands 2^k places before, so no array grows by appending."""
    return let("z", values, f"""aggregate(sequence(0, greatest(0, cast(ceil(log2(greatest(size(z), 1))) AS int) - 1)), z, (acc, k) ->
        transform(acc, (x, i) -> CASE WHEN i >= shiftleft(1, k) THEN {op.format('x', 'acc[i - shiftleft(1, k)]')} ELSE x END))""")


def _located(text: str, pattern: str, gate: str) -> Column:
    """Leftmost non-overlapping matches as (s, e, v): code points from running sums over matches and the gaps that split() leaves."""
    p = _quoted(pattern)
    lengths = f"zip_with(slice(split({text}, {p}, -1), 1, size(m)), m, (g, v) -> length(g) + length(v))"
    spans = f"zip_with(m, {_running(lengths, '{} + {}')}, (v, e) -> named_struct('s', e - length(v), 'e', e, 'v', v))"
    return F.expr(f"CASE WHEN {gate} THEN {let('m', f'regexp_extract_all({text}, {p}, 0)', spans)} ELSE cast(array() AS {SPANS}) END")


def _rlike(text: str, pattern: str) -> str:
    return f"{text} rlike {_quoted(pattern)}"


def _marked(text: str, pattern: str, mark: str) -> str:
    """SQL for ``text`` with each match v as ``mark`` says, of the same length."""
    p = _quoted(pattern)
    return f"array_join(zip_with(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0), (g, v) -> concat(g, coalesce({mark}, ''))), '')"


def find_secrets(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, model: list[float] | None = None) -> DataFrame:
    """``docs`` with secret_spans: array of (s, k, e, kind), sorted; s and e in code points, e exclusive.

    k numbers the kinds: 0 assign, 1 access, 2 hex by the base patterns, 3 markov:
    a run of 20 or more token characters, clear of base matches, whose transitions
    are likelier, by ``threshold`` a transition on average, under the model of
    random strings than under that of ordinary names. A null text counts as
    empty; empty texts have no spans. Rows and all other columns stay as they
    are, but for a former column named secret_spans, which is replaced.

    The work is linear in the text but for a logarithm of the number of matches:
    runs are scored in chunks of characters, and a run is known to be clear of base
    matches because its characters aren't marked in a copy of the text.
    """
    ratios = ",".join(f"{x:.4f}" for x in (model or log_ratios()))
    tmp = free_name(docs, "tmp_")
    t, m = f"{tmp}t", f"{tmp}m"
    df = docs.drop("secret_spans").withColumn(t, F.coalesce(F.col(text_col), F.lit("")))
    df = (
        df.withColumn(f"{tmp}a", _located(t, ASSIGN, _rlike(t, ASSIGN)))
        .withColumn(f"{tmp}c", _located(t, ACCESS, f"contains({t}, 'AKIA')"))
        .withColumn(f"{tmp}x", _located(t, HEX, _rlike(t, HEX)))
        .withColumn(m, _located(t, CANDIDATE, _rlike(t, CANDIDATE)))
    )

    def long_value(match: str) -> str:
        return f"length(regexp_extract({match}, {_quoted(ASSIGN)}, 2)) >= 12"

    def kept(col: str, k: int, where: str) -> str:
        return f"transform(filter({col}, x -> {where}), x -> named_struct('s', x.s, 'k', {k}, 'e', x.e, 'kind', '{KINDS[k]}'))"

    base = f"concat({kept(tmp + 'a', 0, long_value('x.v'))}, {kept(tmp + 'c', 1, 'true')}, {kept(tmp + 'x', 2, 'true')})"
    # token characters of base matches are marked; runs stay as long as they were, so the k-th run is the k-th candidate
    told = f"translate({t}, char(1), char(2))"
    told = _marked(told, ASSIGN, f"CASE WHEN {long_value('v')} THEN regexp_replace(v, '[{TOKEN}-]', char(1)) ELSE v END")
    for pattern in (ACCESS, HEX):
        told = let("w", told, _marked("w", pattern, "repeat(char(1), length(v))"))
    runs = f"regexp_extract_all({told}, '[{TOKEN}\\\\x01-]{{20,}}', 0)"
    symbols = "cast(split('" + ",".join(str(_symbol(chr(c))) for c in range(128)) + "', ',') AS array<int>)"
    chunk = f"transform(split(substr(x.v, {SCORED} * j + 1, {SCORED} + 1), ''), c -> element_at({symbols}, ascii(c) + 1))"
    steps = f"zip_with(slice(y, 1, size(y) - 1), slice(y, 2, size(y) - 1), (p, q) -> element_at(cast(split('{ratios}', ',') AS array<double>), p * {SIZE} + q + 1))"
    total = f"aggregate({steps}, cast(0 AS double), (sum, r) -> sum + r)"
    ratio = f"aggregate(sequence(0, (length(x.v) - 2) div {SCORED}), cast(0 AS double), (all, j) -> all + {let('y', chunk, total)})"
    clear = f"filter(zip_with({m}, {runs}, (x, w) -> CASE WHEN contains(w, char(1)) THEN NULL ELSE x END), x -> x IS NOT NULL)"
    extra = kept(clear, 3, f"{ratio} > {threshold} * (length(x.v) - 1)")
    df = df.withColumn("secret_spans", F.expr(f"array_sort(concat({base}, CASE WHEN size({m}) > 0 THEN {extra} ELSE array() END))"))
    return df.drop(*(tmp + k for k in "tacxm"))


def span_text(spans: str) -> str:
    """SQL for kind:start:end of the spans, comma-joined."""
    return f"array_join(transform({spans}, x -> concat_ws(':', x.kind, cast(x.s AS string), cast(x.e AS string))), ',')"


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of secrets replaced by ``mark``; overlapping spans become one. Null texts stay null.

    The text is cut in chunks once, and what lies between spans is put together
    from them, so a span costs a chunk and not the text.
    """
    t = f"`{text_col}`"
    # parts are [a, b) in code points; c holds the chunks
    part = f"""CASE WHEN b <= a THEN '' WHEN a div {CHUNK} = b div {CHUNK} THEN substr(get(c, cast(a div {CHUNK} AS int)), cast(a % {CHUNK} AS int) + 1, b - a)
        ELSE concat(substr(get(c, cast(a div {CHUNK} AS int)), cast(a % {CHUNK} AS int) + 1), array_join(slice(c, cast(a div {CHUNK} AS int) + 2, cast(b div {CHUNK} - a div {CHUNK} AS int) - 1), ''),
            substr(coalesce(get(c, cast(b div {CHUNK} AS int)), ''), 1, cast(b % {CHUNK} AS int))) END"""

    def between(a: str, b: str) -> str:
        return let("a", a, let("b", b, part))

    # u: furthest end so far; a span that begins before the ends of those before it adds nothing but its own end
    pieces = f"transform(secret_spans, (x, i) -> CASE WHEN i > 0 AND x.s < u[i - 1] THEN '' ELSE concat({between('CASE WHEN i = 0 THEN 0 ELSE u[i - 1] END', 'x.s')}, '{mark}') END)"
    whole = f"array_join(concat({pieces}, array({between('element_at(u, -1)', f'length({t})')})), '')"
    ends = _running("transform(secret_spans, x -> x.e)", "greatest({}, {})")
    merged = let("c", f"regexp_extract_all({t}, '(?s).{{1,{CHUNK}}}', 0)", let("u", ends, whole))
    found = find_secrets(docs, text_col, **options)
    return found.withColumn(text_col, F.expr(f"CASE WHEN size(secret_spans) > 0 THEN {merged} ELSE {t} END")).drop("secret_spans")


def oracle(threshold: float = 0.5) -> str:
    """SQL of another dialect (lists, lambdas, RE2) for the digest columns of all documents."""

    def quoted(pattern: str) -> str:
        return "'" + pattern.replace("'", "''") + "'"

    def located(pattern: str, k: int, kept: str = "true") -> str:
        p = quoted(pattern)
        before = "len(array_to_string(list_slice(g, 1, i), '')) + len(array_to_string(list_slice(m, 1, i - 1), ''))"
        # gaps and matches are joined without a separator, so their lengths add up in code points
        return f"""SELECT doc_id, t, {before} AS s, {k} AS k, {before} + len(m[i]) AS e, m[i] AS v FROM (
            SELECT doc_id, t, g, m, unnest(range(1, len(m) + 1)) AS i, f FROM (
                SELECT doc_id, t, string_split_regex(t, {p}) AS g, regexp_extract_all(t, {p}) AS m, {f"regexp_extract_all(t, {p}, 2)" if k == 0 else "[]"} AS f FROM texts)) WHERE {kept}"""

    ratios = "[" + ",".join(f"{x:.4f}" for x in log_ratios()) + "]::DOUBLE[]"

    def symbol(at: str) -> str:
        c = f"v[{at}]"
        return f"CASE WHEN {c} BETWEEN '0' AND '9' THEN {len(LETTERS)} WHEN instr('{LETTERS}', {c}) > 0 THEN instr('{LETTERS}', {c}) - 1 ELSE {len(LETTERS) + 1} END"

    total = f"list_sum(list_transform(range(1, len(v)), lambda j: model[({symbol('j')}) * {SIZE} + ({symbol('j + 1')}) + 1]))"
    names = " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(KINDS))
    told = f"CASE k {names} END || ':' || s || ':' || e"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        base AS ({located(ASSIGN, 0, "len(f[i]) >= 12")} UNION ALL {located(ACCESS, 1)} UNION ALL {located(HEX, 2)}),
        extra AS (SELECT c.* FROM ({located(CANDIDATE, 3)}) c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = c.doc_id AND b.s < c.e AND c.s < b.e)),
        scored AS (SELECT doc_id, t, s, k, e, v FROM (SELECT *, {ratios} AS model FROM extra) WHERE {total} > {threshold} * (len(v) - 1)),
        spans AS (SELECT * FROM base UNION ALL SELECT * FROM scored),
        told AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
            string_agg({told}, ',' ORDER BY s, k) FILTER (k < 3) AS base, string_agg({told}, ',' ORDER BY s, k) AS spans FROM spans GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM texts LEFT JOIN told USING (doc_id)"""
