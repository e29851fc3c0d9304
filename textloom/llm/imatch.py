"""I-Match document fingerprints over randomised lexicon subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import discard, let, materialise

#: A term is in one of SUBSETS subsets of a level with probability SUBSETS / size; sparse levels serve long texts.
#: Each size is 4 times the one before, so a level's terms are among those of the denser one, in the same subset.
LEVELS = (32, 128, 512, 2048, 8192)
SUBSETS = 32
NONE = "...."
#: Least number of subsets with terms for a level to be read.
ENOUGH = 10


def terms(text: str) -> str:
    """SQL for the distinct terms of a text, as (t, h) with a hash: runs of letters and digits in lower case."""
    words = f"array_distinct(filter(split(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> ''))"
    return f"transform({words}, x -> named_struct('t', x, 'h', xxhash64(x)))"


def band(docs: DataFrame, text_col: str = "text", least: int = 2, rare: float = 1e-4, share: float = 0.05, most: int = 16_384) -> list[int]:
    """Hashes of the terms within the band of inverse document frequency, sorted.

    A term's document frequency is counted exactly, over all documents, by its
    64-bit hash; counts are summed before the shuffle. The band is ln(1/share) <=
    idf <= ln(1/rare), without terms of fewer than ``least`` documents. A document
    has so many distinct terms, so at most their mean over ``rare`` can be in the
    band, however large the corpus is; if more than ``most`` are, the upper end
    of idf comes down to the first power of two of documents that leaves no more.
    """
    text = f"`{text_col}`"
    n = docs.count()
    hashes = docs.select(F.explode(F.expr(f"transform({terms(text)}, x -> x.h)")).alias("h"))
    low = max(least, rare * n)
    counts = materialise(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("df")).filter((F.col("df") >= low) & (F.col("df") <= max(least, share * n))))
    sizes = {r["k"]: r["n"] for r in counts.groupBy(F.floor(F.log2("df")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    k, total = max(sizes, default=0), 0
    while k >= 0 and total + sizes.get(k, 0) <= most:
        total += sizes.get(k, 0)
        k -= 1
    found = sorted(r["h"] for r in counts.filter(F.col("df") >= 2 ** (k + 1)).select("h").collect())
    discard(counts)
    return found


def _slots(h: int, size: int) -> tuple[int, int]:
    """The two places where a table of ``size`` (a power of two) may hold a hash."""
    return h & (size - 1), ((h & ((1 << 64) - 1)) >> 20) & (size - 1)


def cuckoo_table(hashes: list[int]) -> list[int]:
    """A table in which each hash is in one of its two slots; an empty slot holds a value that is never looked for there."""
    size = 1 << (2 * len(hashes) - 1).bit_length()
    while True:
        table: dict[int, int] = {}
        for h in hashes:
            at = _slots(h, size)[0]
            for _ in range(200):
                h, table[at] = table.get(at), h
                if h is None:
                    break
                a, b = _slots(h, size)
                at = b if at == a else a
            else:
                break
        else:
            return [table.get(k, 0 if k else (2 << 20) + 1) for k in range(size)]
        size *= 2


def lexicon(hashes: list[int], of: str) -> str:
    """SQL for whether the hash ``of`` is one of ``hashes``: two look-ups that compare whole hashes."""
    if not hashes:
        return "false"
    table = cuckoo_table(hashes)
    values = "cast(split('" + ",".join(map(str, table)) + "', ',') AS array<bigint>)"
    return "(" + " OR ".join(f"element_at({values}, cast({x} & {len(table) - 1} AS int) + 1) = {of}" for x in (of, f"shiftrightunsigned({of}, 20)")) + ")"


def with_fingerprint(df: DataFrame, inside: str, text_col: str, out: str, few: int = 8) -> DataFrame:
    """``df`` with ``out``: array of len(LEVELS) * SUBSETS hashes, NONE for a subset the text has no term of.

    The terms in the band (``inside``: SQL for x.h) are kept, or all terms of a text
    with fewer than ``few`` of those. They are sorted once, by subset and term,
    with a mark before each subset; a sparser level is a filter of each subset.
    Equal texts get equal fingerprints.
    """
    g = "cast(shiftrightunsigned(x.h, 40) AS int)"  # a term's place comes from other bits of its hash
    marks = f"transform(sequence(0, {SUBSETS - 1}), r -> named_struct('r', r, 't', '', 'g', 0))"
    kept = let("w", terms(f"`{text_col}`"), let("f", f"filter(w, x -> {inside})", f"CASE WHEN size(f) < {few} THEN w ELSE f END"))
    ordered = f"sort_array(concat(transform({kept}, x -> named_struct('r', {g} & {SUBSETS - 1}, 't', x.t, 'g', {g})), {marks}))"
    at = "filter(sequence(1, size(a)), i -> element_at(a, i).t = '')"
    subsets = let("a", ordered, let("b", at, f"zip_with(b, concat(slice(b, 2, {SUBSETS - 1}), array(size(a) + 1)), (i, j) -> slice(a, i + 1, j - i - 1))"))
    digest = "right(hex(xxhash64(transform(y, x -> x.t)) | 1152921504606846976), 4)"
    hashes = f"transform(l, y -> CASE WHEN size(y) = 0 THEN '{NONE}' ELSE {digest} END)"
    found = hashes
    for size in reversed(LEVELS[1:]):  # from the inside out: l is the level's subsets
        found = f"concat({hashes}, {let('l', f'transform(l, y -> filter(y, x -> (x.g & {size - 1}) < {SUBSETS}))', found)})"
    return df.withColumn(out, F.expr(let("l", subsets, found)))


def likeness(a: str, b: str) -> str:
    """SQL for the share of subsets with equal hashes, of those that either text has terms of (0 to 1).

    It is read at the sparsest level at which ENOUGH subsets have terms, else
    at the densest. Two texts without terms are alike.
    """
    cases = []
    for k in reversed(range(len(LEVELS))):
        at = f"sequence({k * SUBSETS}, {(k + 1) * SUBSETS - 1})"
        some = f"size(filter({at}, i -> {a}[i] <> '{NONE}' OR {b}[i] <> '{NONE}'))"
        same = f"size(filter({at}, i -> {a}[i] = {b}[i] AND {a}[i] <> '{NONE}'))"
        cases.append(f"WHEN {some} >= {ENOUGH if k else 1} THEN {same} / {some}")
    return f"cast(CASE {' '.join(cases)} ELSE 1.0 END AS double)"


def dealt_by_range(docs: DataFrame, most: int = 40_000, rows: int = 500) -> DataFrame:
    """``docs`` (doc_id, ...) dealt so that with_next() needs no further shuffle.

    Rows are dealt once, into ranges of ids (about ``rows`` each, at most ``most``
    ranges) that begin at ids which exist; the first row of a range is also sent to
    the range before, so that no range has to see another and none is sorted with
    all. The first row of all also goes to the last range. A row finds its range
    in two steps, each over about the square root of the number of ranges.
    """
    n = docs.count()
    ranges = max(1, min(most, n // rows))
    first = docs.agg(F.min("doc_id")).first()[0]
    cuts: list[int] = []
    if ranges > 1:
        shares = F.expr("cast(split('" + ",".join(repr(k / ranges) for k in range(1, ranges)) + "', ',') AS array<double>)")
        # where ranges begin may come from a sample of ids; all rows are dealt
        thin = max(1, n // 2_000_000)
        ids = docs.select("doc_id").filter(F.pmod(F.xxhash64("doc_id"), F.lit(thin)) == 0)
        found = ids.select(F.percentile_approx("doc_id", shares, 20 * ranges)).first()[0] or []
        cuts = sorted(set(found) - {first})
    step = max(1, round(len(cuts) ** 0.5))

    def array(values: list[int]) -> str:
        return "cast(split('" + ",".join(map(str, values)) + "', ',') AS array<bigint>)" if values else "cast(array() AS array<bigint>)"

    df = docs.withColumn("tmp_coarse", F.expr(f"size(filter({array(cuts[::step])}, c -> c <= doc_id))"))
    fine = f"slice({array(cuts)}, (tmp_coarse - 1) * {step} + 1, {step})"
    df = df.withColumn("tmp_own", F.expr(f"CASE WHEN tmp_coarse > 0 THEN (tmp_coarse - 1) * {step} + size(filter({fine}, c -> c <= doc_id)) ELSE 0 END"))

    def to(place: str, later: int) -> str:
        return f"named_struct('range', {place}, 'later', {later})"

    copies = f"""CASE WHEN doc_id = {first if first is not None else 0}L THEN array({to('tmp_own', 0)}, {to(len(cuts), 1)})
        WHEN tmp_own > 0 AND element_at({array(cuts)}, greatest(tmp_own, 1)) = doc_id THEN array({to('tmp_own', 0)}, {to('tmp_own - 1', 1)}) ELSE array({to('tmp_own', 0)}) END"""
    if not cuts:
        copies = f"CASE WHEN doc_id = {first if first is not None else 0}L THEN array({to('0', 0)}, {to('0', 1)}) ELSE array({to('0', 0)}) END"
    dealt = df.withColumn("tmp_to", F.explode(F.expr(copies)))
    dealt = dealt.withColumn("tmp_range", F.col("tmp_to.range")).withColumn("tmp_later", F.col("tmp_to.later"))
    return dealt.drop("tmp_to", "tmp_own", "tmp_coarse").repartition("tmp_range")


def with_next(dealt: DataFrame, columns: list[str]) -> DataFrame:
    """Dealt rows with next_<column>: the columns of the row with the next doc_id; after the last, the first.

    Among rows with the same id the order is that of the columns; a row without id
    comes before all others.
    """
    order = Window.partitionBy("tmp_range").orderBy("tmp_later", "doc_id", *columns)
    out = dealt
    for c in columns:
        out = out.withColumn(f"next_{c}", F.lead(c).over(order))
    return out.filter("tmp_later = 0").drop("tmp_range", "tmp_later")


def edit_report(docs: DataFrame, least: int = 2, rare: float = 1e-4, share: float = 0.05) -> DataFrame:
    """Fingerprints of each text of ``docs`` (doc_id, text) and of its edited text.

    The edited text has the last floor(n/4) code points replaced by as many first
    ones of the next document. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next. A null text counts as
    empty; a text without terms has a fingerprint of NONE marks and is like any
    other such text only; repeated rows each get a row; an empty table gives none.
    Columns besides doc_id and text aren't read.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    inside = lexicon(band(docs, "text", least, rare, share), "x.h")
    df = with_next(with_fingerprint(dealt_by_range(docs), inside, "text", "fp"), ["text", "fp"])
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    df = df.withColumn("edited", F.expr("concat(left(text, cast(n_chars - n_chars div 4 AS int)), left(coalesce(next_text, ''), cast(n_chars div 4 AS int)))"))
    df = df.drop("text", "next_text")
    df = with_fingerprint(df, inside, "edited", "edited_fp")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.lower(F.concat_ws("", "fp")).alias("fingerprint"), F.lower(F.concat_ws("", "edited_fp")).alias("edited_fingerprint"),
        F.expr(likeness("fp", "edited_fp")).alias("near_edited"), F.expr(likeness("fp", "coalesce(next_fp, fp)")).alias("near_next"),
    )
