"""Quotation linking: who is quoted, and conversations in reply order without quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, let, materialise, reading, spread_join

#: Marks of a quoted line: any number of '>' with single spaces between (possessive, so that it takes no stack).
MARKS = r"^[ \\t]*+(?:>[ ]?)++"


def _norm(x: str) -> str:
    """SQL for a passage's normal form: lower case, white space as one space, trimmed."""
    return f"trim(regexp_replace(lower({x}), '\\\\s+', ' '))"


def parse_quotes(messages: DataFrame, text_col: str = "text") -> DataFrame:
    """``messages`` with clean_text, quote_depth and quotes.

    quotes is an array of (level, passage): runs of lines with the same number of
    '>' marks, in normal form without marks, blank ones dropped. clean_text is the
    text without quoted lines and without the lines that introduce a quotation
    ("... wrote:"), trimmed. A null text counts as empty.
    """
    lines = rf"split(coalesce(`{text_col}`, ''), '\\r\\n|\\n|\\r', -1)"
    level = f"length(regexp_replace(regexp_extract(x, '{MARKS}', 0), '[^>]', ''))"
    df = messages.withColumn("tmp_lines", F.expr(f"transform({lines}, x -> named_struct('n', {level}, 't', regexp_replace(x, '{MARKS}', '')))"))
    quoted = "exists(tmp_lines, x -> x.n > 0)"
    # runs are slices between the places where the level changes, so nothing grows by appending
    starts = "filter(sequence(0, size(l) - 1), i -> i = 0 OR l[i].n <> l[i - 1].n)"
    cut = f"zip_with(b, concat(slice(b, 2, size(b) - 1), array(size(l))), (i, j) -> named_struct('level', l[i].n, 'passage', CASE WHEN l[i].n > 0 THEN {_norm("array_join(transform(slice(l, i + 1, j - i), x -> x.t), chr(10))")} ELSE '' END))"
    runs = let("l", "tmp_lines", let("b", starts, f"filter({cut}, q -> q.passage <> '')"))
    # an introducing line is followed by a quoted one
    plain = """filter(l, (x, i) -> x.n = 0 AND NOT (i + 1 < size(l) AND l[i + 1].n > 0 AND x.t rlike '(wrote|writes|said|schrieb|a écrit|escribió)\\\\s*:\\\\s*$'))"""
    clean = let("l", "tmp_lines", f"array_join(transform({plain}, x -> x.t), chr(10))")
    df = df.withColumn("clean_text", F.expr(f"trim(BOTH '\\n\\t ' FROM CASE WHEN {quoted} THEN {clean} ELSE coalesce(`{text_col}`, '') END)"))
    df = df.withColumn("quotes", F.expr(f"CASE WHEN {quoted} THEN {runs} ELSE cast(array() AS array<struct<level:int,passage:string>>) END"))
    return df.withColumn("quote_depth", F.expr("coalesce(array_max(transform(quotes, q -> q.level)), 0)")).drop("tmp_lines")


def passages_of(parsed: DataFrame) -> DataFrame:
    """(conv_id, turn, hash): each message's own text, whole and by paragraph and line, in normal form."""
    parts = F.expr(f"""array_distinct(filter(transform(
        concat(array(clean_text), split(clean_text, '\\\\n\\\\s*\\\\n'), split(clean_text, '\\\\n')), x -> {_norm('x')}), x -> x <> ''))""")
    return parsed.select("conv_id", "turn", F.explode(parts).alias("p")).select("conv_id", "turn", F.expr("xxhash64(p, 3)").alias("hash"))


def link_quotes(conversations: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) with what they reply to and where they stand.

    A quoted passage is hashed in normal form and looked up among the messages'
    own passages: first in the same conversation, before the quoting turn; else in
    the whole table, in a conversation with a smaller id. Each hash has one
    original, its first message, found by a pre-aggregated minimum, so frequent
    passages make no pairs. The parent of a message is the latest original that
    its outermost found quote names; without one, the turn numbered one less, if it is there. Parents precede
    their replies in (conv_id, turn), so threads are trees, and every message
    finds its thread's first message by pointer doubling.

    Columns: conv_id, turn, role, clean_text, quote_depth, n_quotes, n_linked,
    parent_conv, parent_turn, thread_conv, thread_turn, reply_depth; a thread in
    order of (reply_depth, conv_id, turn) is its conversation in reply order.
    Repeated (conv_id, turn) rows are replies to the same parent and each keep a
    row; rows with a null id or turn stand alone in a thread of depth 0; null
    texts count as empty; an empty table gives none; other columns aren't read.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    parsed = materialise(parse_quotes(rows).drop("text"))
    known = parsed.filter("conv_id is not null and turn is not null")
    quoting = known.filter("size(quotes) > 0").select("conv_id", "turn", F.posexplode("quotes").alias("pos", "q"))
    quoting = quoting.select("conv_id", "turn", "pos", F.col("q.level").alias("level"), F.expr("xxhash64(q.passage, 3)").alias("hash")).distinct()
    quoting = materialise(quoting)
    # only passages that somebody quotes are looked up
    own = materialise(passages_of(known))
    wanted = materialise(spread_join(own, quoting.select("hash").distinct(), ["hash"], "left_semi"))
    discard(own)
    inside = wanted.groupBy("hash", "conv_id").agg(F.min("turn").alias("t"))
    overall = wanted.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("o"))
    near = spread_join(quoting, overall, ["hash"], "left").join(inside, ["hash", "conv_id"], "left").withColumn("t", F.when(F.col("t") < F.col("turn"), F.col("t")))
    linked = near.select(
        "conv_id", "turn", "pos", "level",
        F.when(F.col("t").isNotNull(), F.struct(F.col("conv_id"), F.col("t").alias("turn"))).when(F.col("o.conv_id") < F.col("conv_id"), F.col("o")).alias("o"),
    )
    parents = linked.groupBy("conv_id", "turn").agg(
        F.count("o").alias("n_linked"), F.min_by("o", F.when(F.col("o").isNotNull(), F.struct("level", -F.col("o.conv_id"), -F.col("o.turn"), "pos"))).alias("o")
    )
    keys = known.select("conv_id", "turn").distinct()
    before = keys.select("conv_id", (F.col("turn") + 1).alias("turn"), F.struct("conv_id", "turn").alias("b"))
    tree = keys.join(before, ["conv_id", "turn"], "left").join(parents, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("o", "b").alias("p")
    )
    tree = materialise(tree.select("conv_id", "turn", "n_linked", F.col("p.conv_id").alias("parent_conv"), F.col("p.turn").alias("parent_turn")))
    discard(quoting)
    discard(wanted)
    # pointer doubling: after k rounds a message points 2^k steps up, or at its root
    at = tree.select("conv_id", "turn", F.coalesce("parent_conv", "conv_id").alias("to_conv"), F.coalesce("parent_turn", "turn").alias("to_turn"), F.when(F.col("parent_conv").isNull(), 0).otherwise(1).cast("long").alias("steps"))
    at = materialise(at)
    written = [at]
    settled, active = at.filter("steps = 0"), at.filter("steps > 0")
    while active.take(1):  # those whose target is a root leave; only deep threads go on
        up = at.select(F.col("conv_id").alias("to_conv"), F.col("turn").alias("to_turn"), F.col("to_conv").alias("up_conv"), F.col("to_turn").alias("up_turn"), F.col("steps").alias("more"))
        stepped = materialise(spread_join(active, up, ["to_conv", "to_turn"]).select(
            "conv_id", "turn", F.col("up_conv").alias("to_conv"), F.col("up_turn").alias("to_turn"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")
        ))
        written.append(stepped)
        settled = settled.union(stepped.filter("NOT moved").drop("moved"))
        active = stepped.filter("moved").drop("moved")
        at = settled.union(active)
    at = settled
    placed = tree.join(at, ["conv_id", "turn"]).withColumnsRenamed({"to_conv": "thread_conv", "to_turn": "thread_turn", "steps": "reply_depth"})
    out = parsed.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "clean_text", F.col("quote_depth").cast("long").alias("quote_depth"), F.size("quotes").cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "parent_conv", "parent_turn",
        F.coalesce("thread_conv", "conv_id").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("reply_depth", F.lit(0)).cast("long").alias("reply_depth"),
    )
    return reading(out, parsed, tree, *written)


def _norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


#: SQL of another dialect (lists, RE2, recursion) for the result: passages are joined as text, threads found by recursion.
ORACLE = rf"""WITH RECURSIVE m AS (SELECT row_number() OVER () AS r, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
    l AS (SELECT r, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS x FROM (SELECT r, string_split_regex(text, '\r\n|\n|\r') AS p FROM m)),
    k AS (SELECT r, i, len(regexp_replace(regexp_extract(x, '^[ \t]*(>[ ]?)+'), '[^>]', '', 'g')) AS n, regexp_replace(x, '^[ \t]*(>[ ]?)+', '') AS t FROM l),
    q AS (SELECT *, lead(n) OVER (PARTITION BY r ORDER BY i) AS after, i - row_number() OVER (PARTITION BY r, n ORDER BY i) AS island FROM k),
    p AS (SELECT r, n AS level, min(i) AS i, {_norm_sql("string_agg(t, chr(10) ORDER BY i)")} AS passage FROM q WHERE n > 0 GROUP BY r, n, island),
    quoted AS (SELECT r, level, passage, row_number() OVER (PARTITION BY r ORDER BY i) - 1 AS pos FROM p WHERE passage <> ''),
    body AS (SELECT r, max(n) AS top, coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (n = 0 AND NOT (coalesce(after, 0) > 0 AND regexp_matches(t, '(wrote|writes|said|schrieb|a écrit|escribió)\s*:\s*$'))), '') AS t FROM q GROUP BY r),
    c AS (SELECT m.r, conv_id, turn, role, trim(CASE WHEN top > 0 THEN t ELSE text END, chr(10) || chr(9) || ' ') AS clean_text,
        coalesce((SELECT max(level) FROM quoted WHERE quoted.r = m.r), 0)::BIGINT AS quote_depth, (SELECT count(*) FROM quoted WHERE quoted.r = m.r) AS n_quotes FROM m JOIN body USING (r)),
    known AS (SELECT * FROM c WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    own AS (SELECT DISTINCT conv_id, turn, {_norm_sql("x")} AS passage FROM (SELECT conv_id, turn, unnest(list_concat([clean_text], list_concat(string_split_regex(clean_text, '\n\s*\n'), string_split(clean_text, chr(10))))) AS x FROM known)),
    inside AS (SELECT passage, conv_id, min(turn) AS t FROM own WHERE passage <> '' GROUP BY ALL),
    overall AS (SELECT passage, conv_id AS oc, turn AS ot FROM own WHERE passage <> '' QUALIFY row_number() OVER (PARTITION BY passage ORDER BY conv_id, turn) = 1),
    asked AS (SELECT DISTINCT conv_id, turn, pos, level, passage FROM known JOIN quoted USING (r)),
    linked AS (SELECT a.conv_id, a.turn, a.pos, a.level, CASE WHEN i.t < a.turn THEN a.conv_id WHEN o.oc < a.conv_id THEN o.oc END AS oc, CASE WHEN i.t < a.turn THEN i.t WHEN o.oc < a.conv_id THEN o.ot END AS ot
        FROM asked a LEFT JOIN inside i ON i.passage = a.passage AND i.conv_id = a.conv_id LEFT JOIN overall o ON o.passage = a.passage),
    parents AS (SELECT conv_id, turn, count(oc) OVER (PARTITION BY conv_id, turn) AS n_linked, oc, ot FROM linked
        QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY (oc IS NULL)::INTEGER, level, oc DESC, ot DESC, pos) = 1),
    keys AS (SELECT DISTINCT conv_id, turn FROM known),
    tree AS (SELECT k.conv_id, k.turn, coalesce(n_linked, 0) AS n_linked, coalesce(oc, b.conv_id) AS parent_conv, coalesce(ot, b.turn) AS parent_turn
        FROM keys k LEFT JOIN parents p ON p.conv_id = k.conv_id AND p.turn = k.turn LEFT JOIN keys b ON b.conv_id = k.conv_id AND b.turn = k.turn - 1),
    up AS (SELECT conv_id, turn, conv_id AS thread_conv, turn AS thread_turn, 0::BIGINT AS reply_depth FROM tree WHERE parent_conv IS NULL
        UNION ALL SELECT t.conv_id, t.turn, u.thread_conv, u.thread_turn, u.reply_depth + 1 FROM tree t JOIN up u ON t.parent_conv = u.conv_id AND t.parent_turn = u.turn)
    SELECT c.conv_id, c.turn, role, clean_text, quote_depth, n_quotes, coalesce(n_linked, 0)::BIGINT AS n_linked, parent_conv, parent_turn, coalesce(thread_conv, c.conv_id) AS thread_conv,
        coalesce(thread_turn, c.turn) AS thread_turn, coalesce(reply_depth, 0)::BIGINT AS reply_depth
    FROM c LEFT JOIN tree t ON t.conv_id = c.conv_id AND t.turn = c.turn LEFT JOIN up u ON u.conv_id = c.conv_id AND u.turn = c.turn"""
