"""Registered queries on the test tables, and the SQL that a second engine checks them with.

Doubles are rounded to six places on both sides: engines sum in different orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import constants as K
from textloom.functions import text as T
from textloom.operators import audit, chat, cleaning, contracts, evaluation, generation, inference, masking, profile
from textloom.session import spread
from textloom.sources import dump

QUERIES: dict = {}
ORACLE: dict = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return spread(_t(spark, d, "documents").select(*columns))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _query(sql: str | None = None, doubles: str = ""):
    """Register a query under its function's name, with the SQL of its oracle if there is one."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, d: _rounded(f(spark, d))
        if sql is not None:
            rounded = ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split())
            ORACLE[f.__name__] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if rounded else sql
        return f

    return add


# Pieces of SQL ---------------------------------------------------------------------


def _words(c: str) -> str:
    return f"list_filter(string_split_regex(coalesce({c}, ''), '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"


_PAIRS = """SELECT u.conv_id, u.turn, u.text AS source, a.text AS target FROM conversations u
    JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""
_PAIR_COUNTS = f"SELECT conv_id, turn, len({_words('source')}) AS n_source, len({_words('target')}) AS n_target FROM ({_PAIRS})"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns with the assistant's answer: the corpus pairs of the test data."""
    c = _t(spark, d, "conversations")
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return u.join(a, ["conv_id", "turn"])


# Profile -----------------------------------------------------------------------------


@_query(
    f"""SELECT lang, count(v) AS count, avg(v) AS mean, stddev_pop(v) AS std, coalesce(skewness(v), 0) AS skew, coalesce(kurtosis(v), 0) AS kurt,
    100 * stddev_pop(v) / avg(v) AS cv_pct, min(v)::DOUBLE AS min, max(v)::DOUBLE AS max, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.25) AS p25,
    quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.95) AS p95, sum(v)::DOUBLE AS sum
    FROM (SELECT lang, len({_words('text')}) AS v FROM documents) GROUP BY lang""",
    "mean std skew kurt cv_pct min max p5 p25 median p75 p95 sum",
)
def word_count_distribution(spark, d):
    docs = _docs(spark, d, "lang", "text").select("lang", T.word_count("text").alias("n"))
    return profile.distribution(docs, "n", ["lang"])


@_query(
    f"""SELECT bin, (bin * 200)::VARCHAR || '-' || ((bin + 1) * 200)::VARCHAR AS label, count(*) AS n
    FROM (SELECT (len({_words('text')}) // 200)::BIGINT AS bin FROM documents) WHERE bin < 15 GROUP BY bin"""
)
def length_histogram(spark, d):
    return profile.histogram(_docs(spark, d, "text").select(T.word_count("text").alias("n")), "n", 200)


@_query(
    """WITH q AS (SELECT lang, quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents GROUP BY lang)
    SELECT lang, any_value(q1) AS q1, any_value(q3) AS q3, any_value(q3 - q1) AS iqr, any_value(q3 + 1.5 * (q3 - q1)) AS mild_fence,
    any_value(q3 + 3 * (q3 - q1)) AS extreme_fence, count(*) FILTER (n_chars > q3 + 1.5 * (q3 - q1)) AS mild,
    count(*) FILTER (n_chars > q3 + 3 * (q3 - q1)) AS extreme FROM documents JOIN q USING (lang) GROUP BY lang""",
    "q1 q3 iqr mild_fence extreme_fence",
)
def iqr_outliers(spark, d):
    return profile.iqr_outliers(_t(spark, d, "documents").select("lang", "n_chars"), "n_chars", ["lang"])


@_query(
    f"""SELECT count(r) AS n, avg(r) AS mean, median(r) AS median, stddev_pop(r) AS std, min(r) AS min, max(r) AS max
    FROM (SELECT CASE WHEN n_target > 0 THEN n_source / n_target::DOUBLE END AS r FROM ({_PAIR_COUNTS}))""",
    "mean median std min max",
)
def compression_ratio(spark, d):
    return profile.ratio_stats(profile.with_ratio(_pairs(spark, d)))


def _grams_sql(c: str, n: int) -> str:
    w = _words(f"lower({c})")
    return f"list_distinct(list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string(list_slice({w}, i, i + {n - 1}), chr(1))))"


@_query(
    " UNION ALL ".join(
        f"""SELECT {n}::INTEGER AS n, count(*) AS pairs, avg(x) AS mean, median(x) AS median, stddev_pop(x) AS std FROM (
        SELECT len(list_filter(t, lambda g: NOT list_contains(s, g))) * 100.0 / len(t) AS x FROM (SELECT {_grams_sql('source', n)} AS s, {_grams_sql('target', n)} AS t FROM ({_PAIRS})
        WHERE len({_words('target')}) >= {max(2, n)}))"""
        for n in (1, 2, 3)
    ),
    "mean median std",
)
def novel_ngrams(spark, d):
    return profile.novel_ngrams(_pairs(spark, d))


@_query(
    f"""WITH s AS (SELECT DISTINCT unnest({_words('lower(source)')}) AS t FROM ({_PAIRS})), g AS (SELECT DISTINCT unnest({_words('lower(target)')}) AS t FROM ({_PAIRS})),
    u AS (SELECT s.t AS a, g.t AS b FROM s FULL JOIN g ON s.t = g.t)
    SELECT count(a) AS source_size, count(b) AS target_size, count(*) AS union_size, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared,
    100.0 * count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) / count(*) AS shared_pct, 100.0 * count(*) FILTER (b IS NULL) / count(*) AS source_only_pct,
    100.0 * count(*) FILTER (a IS NULL) / count(*) AS target_only_pct FROM u""",
    "shared_pct source_only_pct target_only_pct",
)
def vocabulary_overlap(spark, d):
    return profile.vocabulary(_pairs(spark, d))


_STOP = ", ".join(f"'{w}'" for w in K.STOP_WORDS)
_TERMS = f"""SELECT term, count(*) AS weight FROM (SELECT trim(unnest({_words('lower(text)')}), '{K.TERM_STRIP.replace("'", "''")}') AS term FROM documents)
    WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY term ORDER BY weight DESC, term LIMIT 100"""


@_query(_TERMS)
def top_terms(spark, d):
    return profile.top_terms(_docs(spark, d, "text"), "text")


@_query(f"WITH t AS ({_TERMS}) SELECT term, weight, greatest(12.0, weight / (SELECT max(weight) FROM t) * 72.0) AS size FROM t", "size")
def term_font_sizes(spark, d):
    return profile.font_weights(profile.top_terms(_docs(spark, d, "text"), "text"))


#: Topics of the test corpus, in the shape of the fixed rules.
_TOPICS = (("articles", ("THE ", "DER ", "LES ")), ("prepositions", ("OF ", "VON ", "DANS ")), ("marks", ("!!", "%%%", "|")), ("conjunctions", (" AND ", " UND ", " ET ")), ("verbs", (" IS ", " IST ", " EST ")))
_TOPIC_SQL = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(p, '{k}')" for k in keys) + f" THEN '{name}'" for name, keys in _TOPICS
) + " ELSE 'Outros' END"


@_query(
    f"""WITH c AS (SELECT topic, count(*) AS n FROM (SELECT {_TOPIC_SQL} AS topic FROM (SELECT upper(trim(split_part(text, '.', 1), ' ' || chr(9) || chr(10) || chr(13))) AS p FROM documents)) GROUP BY topic),
    r AS (SELECT CASE WHEN row_number() OVER (ORDER BY n DESC, topic) <= 3 THEN topic ELSE 'Outros' END AS topic, n FROM c)
    SELECT topic, sum(n)::BIGINT AS n, 100.0 * sum(n) / (SELECT sum(n) FROM r) AS share_pct FROM r GROUP BY topic""",
    "share_pct",
)
def topic_distribution(spark, d):
    return profile.topic_distribution(_t(spark, d, "documents"), profile.topic_of("text", _TOPICS), top=3)


@_query(
    f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN starts_with(upper(t), 'DESPACHO') THEN 'despacho_ementa' END, CASE WHEN regexp_matches(t, '^[0-9]+[).\\-]') THEN 'ementa_start_digit' END,
    CASE WHEN len({_words('t')}) > 300 THEN 'ementa_longa_anomala' END], lambda x: x IS NOT NULL), ',') AS labels
    FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM documents)"""
)
def anomaly_labels(spark, d):
    return _docs(spark, d, "doc_id", "text").select("doc_id", F.array_join(profile.anomaly_labels("text"), ",").alias("labels"))


@_query(
    f"""SELECT kind, count(*) FILTER (hit) AS total, count(*) FILTER (hit AND split = 'train') AS train, count(*) FILTER (hit AND split = 'test') AS test FROM (
    SELECT CASE WHEN conv_id % 10 = 0 THEN 'test' ELSE 'train' END AS split, unnest(['rotulos_corrompidos', 'inputs_contaminados']) AS kind,
    unnest([len({_words('target')}) > 300, starts_with(upper(source), 'VOTO-EMENTA')]) AS hit FROM ({_PAIRS})) GROUP BY kind"""
)
def anomaly_summary(spark, d):
    return profile.anomaly_summary(_pairs(spark, d).withColumn("split", F.when(F.col("conv_id") % 10 == 0, "test").otherwise("train")))


@_query(
    f"""SELECT lang, count(*) AS total, count(*) FILTER (len({_words('text')}) > 500) AS over FROM documents GROUP BY lang"""
)
def length_overflow(spark, d):
    return profile.length_overflow(_docs(spark, d, "lang", "text"), "text", lambda texts: [len(t.split()) for t in texts], 500, "lang")


@_query(
    f"""SELECT count(*) AS total, count(*) FILTER (r IN ('b', 'a')) AS empty, count(*) FILTER (r = 'i') AS identical, count(*) FILTER (r = 's') AS short, count(*) FILTER (r IS NULL) AS kept,
    100.0 * count(*) FILTER (r IS NULL) / count(*) AS retention_pct FROM (SELECT CASE WHEN source IS NULL OR source = '' OR target IS NULL OR target = '' THEN 'b' WHEN source = target THEN 'i'
    WHEN n_source < 10 OR n_target < 5 THEN 's' END AS r FROM (SELECT source, target, len({_words('source')}) AS n_source, len({_words('target')}) AS n_target FROM ({_PAIRS})))""",
    "retention_pct",
)
def attrition_counts(spark, d):
    return cleaning.reject_counts(cleaning.with_reject_reason(_pairs(spark, d), clean=False))


@_query(
    """SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY 1"""
)
def temporal_profile(spark, d):
    return profile.temporal_profile(_t(spark, d, "orders"), F.col("o_orderdate"))


def _avg_rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0)"


@_query(f"SELECT count(*) AS n, corr(a, b) AS rho FROM (SELECT {_avg_rank('n_source')} AS a, {_avg_rank('n_target')} AS b FROM ({_PAIR_COUNTS}))", "rho")
def spearman_lengths(spark, d):
    return profile.spearman(profile.with_ratio(_pairs(spark, d)), "n_source", "n_target")


@_query(
    f"""SELECT n, slope, intercept, r2, x0, x1, intercept + slope * x0 AS y0, intercept + slope * x1 AS y1 FROM (SELECT regr_count(n_target, n_source)::BIGINT AS n, regr_slope(n_target, n_source) AS slope,
    regr_intercept(n_target, n_source) AS intercept, regr_r2(n_target, n_source) AS r2, min(n_source)::DOUBLE AS x0, max(n_source)::DOUBLE AS x1 FROM ({_PAIR_COUNTS}))""",
    "slope intercept r2 x0 x1 y0 y1",
)
def linear_trend(spark, d):
    return profile.linear_trend(profile.with_ratio(_pairs(spark, d)), "n_source", "n_target")


@_query("SELECT doc_id, n_chars FROM documents ORDER BY (doc_id * 7919 + 42) % 10007, doc_id LIMIT 200")
def scatter_sample(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    return profile.scatter_sample(docs, F.struct((F.col("doc_id") * 7919 + 42) % 10007, "doc_id"), "n_chars", 200)


# Cleaning, masking, audit -----------------------------------------------------------------


@_query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'),
    '[<][^>]+[>]', ' ', 'g'), '[\r\n\t]+', ' ', 'g'), ' {2,}', ' ', 'g')) AS text FROM pages"""
)
def clean_html(spark, d):
    text = cleaning.collapse_spaces(cleaning.strip_tags(cleaning.unescape("html")))
    return spread(_t(spark, d, "pages").select("page_id", "html")).select("page_id", text.alias("text"))


@_query()
def clean_documents(spark, d):
    return _docs(spark, d, "doc_id", "text").select("doc_id", cleaning.clean_text("text").alias("text"))


#: Rules of the kinds of personal data in the test corpus; classes are spelled out, as engines differ on \w and \b.
_MAIL = "[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+[.][A-Za-z0-9_.-]+"
_ADDRESS = "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"
_LAYERS = (("emails", _MAIL, "", "[EMAIL]"), ("ips", _ADDRESS, "", "[IP]"))


@_query(f"SELECT doc_id, regexp_replace(regexp_replace(text, '{_MAIL}', '[EMAIL]', 'g'), '{_ADDRESS}', '[IP]', 'g') AS text FROM documents")
def mask_pii(spark, d):
    return _docs(spark, d, "doc_id", "text").select("doc_id", masking.mask_plain("text", _LAYERS).alias("text"))


@_query(
    f"""SELECT category, sum(len(m))::BIGINT AS n, count(*) FILTER (len(m) > 0) AS rows, coalesce(array_to_string(list_slice(list(m[1] ORDER BY doc_id) FILTER (len(m) > 0), 1, 3), ' '), '') AS examples FROM (
    SELECT doc_id, 'mail' AS category, regexp_extract_all(text, '{_MAIL}') AS m FROM documents UNION ALL SELECT doc_id, 'ip', regexp_extract_all(text, '{_ADDRESS}') FROM documents
    UNION ALL SELECT doc_id, 'cpf', regexp_extract_all(text, '[0-9]{{3}}[.][0-9]{{3}}[.][0-9]{{3}}-[0-9]{{2}}') FROM documents) GROUP BY category"""
)
def audit_pii(spark, d):
    docs = _docs(spark, d, "doc_id", "text").withColumn("ordinal", F.col("doc_id"))
    patterns = (("mail", _MAIL, ""), ("ip", _ADDRESS, ""), ("cpf", "[0-9]{3}[.][0-9]{3}[.][0-9]{3}-[0-9]{2}", ""))
    report = audit.audit_report(docs, "text", patterns, names=False)
    return report.withColumn("examples", F.array_join("examples", " "))


@_query()
def mask_documents(spark, d):
    return masking.mask_text(_docs(spark, d, "doc_id", "text"), "text", "counts").select("doc_id", "text", "counts.*")


@_query()
def audit_documents(spark, d):
    report = audit.audit_report(_docs(spark, d, "doc_id", "text").withColumn("ordinal", F.col("doc_id")), "text")
    return report.withColumn("examples", F.array_join("examples", " | "))


@_query()
def mask_counter_totals(spark, d):
    return masking.ranked_totals(masking.mask_totals(masking.mask_pairs(_pairs(spark, d))))


# Chat ----------------------------------------------------------------------------------

_PROMPT = "Summarise the text."
_USER = f"'{_PROMPT}' || chr(10) || chr(10) || 'Gere a ementa para a seguinte fundamentação:' || chr(10) || source"


@_query(
    f"""SELECT conv_id, turn, '[{{"role":"user","parts":[{{"text":' || to_json({_USER})::VARCHAR || '}}]}},{{"role":"model","parts":[{{"text":' || to_json(target)::VARCHAR || '}}]}}]' AS contents FROM ({_PAIRS})"""
)
def chat_format(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.to_json(chat.chat_record("source", "target", _PROMPT)).alias("contents"))


@_query(f"SELECT conv_id, turn, source, target, '{_PROMPT}' AS prompt FROM ({_PAIRS})")
def chat_extract(spark, d):
    records = _pairs(spark, d).select("conv_id", "turn", chat.chat_record("source", "target", _PROMPT).alias("contents"))
    return chat.extract_pair(records).select("conv_id", "turn", "source", "target", chat.first_prompt("contents").alias("prompt"))


@_query(f"SELECT conv_id * 1000 + turn AS ordinal, 'Other.' AS found FROM ({_PAIRS}) WHERE conv_id % 7 = 0")
def prompt_drift(spark, d):
    pairs = _pairs(spark, d).withColumn("ordinal", F.col("conv_id") * 1000 + F.col("turn"))
    mixed = F.when(F.col("conv_id") % 7 == 0, chat.chat_record("source", "target", "Other.")).otherwise(chat.chat_record("source", "target", _PROMPT))
    return chat.check_prompt(pairs.select("ordinal", mixed.alias("contents")), _PROMPT)


_TRIM = "' ' || chr(9) || chr(10) || chr(13)"


@_query(
    f"""SELECT case_id, system_prompt, source, target, '[{{"role":"system","content":' || to_json(system_prompt)::VARCHAR || '}},{{"role":"user","content":' || to_json(source)::VARCHAR || '}},{{"role":"assistant","content":' || to_json(target)::VARCHAR || '}}]' AS messages
    FROM (SELECT printf('treino_%05d', conv_id * 100 + turn) AS case_id, '{_PROMPT}' AS system_prompt, trim(source, {_TRIM}) AS source, trim(target, {_TRIM}) AS target FROM ({_PAIRS}))"""
)
def sft_samples(spark, d):
    pairs = _pairs(spark, d).withColumn("ordinal", F.col("conv_id") * 100 + F.col("turn"))
    return chat.sft_samples(pairs, _PROMPT).select("case_id", "system_prompt", "source", "target", F.to_json("messages").alias("messages"))


@_query(f"SELECT printf('teste_%05d', conv_id * 100 + turn) AS case_id, (conv_id * 100 + turn)::INTEGER AS test_index, source, target AS reference FROM ({_PAIRS})")
def evaluation_cases(spark, d):
    return chat.evaluation_cases(_pairs(spark, d).withColumn("ordinal", F.col("conv_id") * 100 + F.col("turn")))


@_query(
    f"""SELECT conv_id, turn, 'Fundamentação original:' || chr(10) || trim(source, {_TRIM}) || chr(10) || chr(10) || 'Ementa candidata:' || chr(10) || trim(target, {_TRIM}) AS message,
    sha256(source) AS source_sha256 FROM ({_PAIRS})"""
)
def judge_messages(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", chat.judge_message("source", "target").alias("message"), T.sha256("source").alias("source_sha256"))


@_query(
    f"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l, {_TRIM})), lambda l: l <> ''), ' ') AS text FROM documents"""
)
def normalise_outputs(spark, d):
    return _docs(spark, d, "doc_id", "text").select("doc_id", T.normalise_output("text").alias("text"))


# Order, samples, keys -------------------------------------------------------------------------


@_query(
    """SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) > (SELECT count(*) - floor(count(*) * 0.1) FROM events) THEN 'test' ELSE 'train' END AS split FROM events"""
)
def chronological_split(spark, d):
    return evaluation.chronological_split(_t(spark, d, "events"), "ts", "event_id").select("event_id", "split")


@_query(
    """SELECT doc_id, least(floor((p - 1) * 4 / n) + 1, 4)::INTEGER AS stratum FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS p, count(*) OVER () AS n FROM documents)"""
)
def quartile_strata(spark, d):
    return evaluation.quartile_strata(_t(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id").select("doc_id", "stratum")


@_query(
    """SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY (doc_id * 7919 + 29) % 10007, doc_id) <= 10"""
)
def stratified_sample(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    return evaluation.stratified_sample(docs, "lang", F.struct((F.col("doc_id") * 7919 + 29) % 10007, "doc_id"))


@_query()
def blinded_items(spark, d):
    events = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("condition_id")).distinct()
    return evaluation.blinded_items(events)


@_query("SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def pending_rows(spark, d):
    return evaluation.pending(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@_query(
    """SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id + 5 FROM labels) UNION ALL
    SELECT doc_id, 'extra' FROM (SELECT doc_id + 5 AS doc_id FROM labels EXCEPT SELECT doc_id FROM documents)"""
)
def coverage_check(spark, d):
    shifted = _t(spark, d, "labels").select((F.col("doc_id") + 5).alias("doc_id"))
    return contracts.coverage_gaps(_t(spark, d, "documents"), shifted, "doc_id")


@_query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1", "value")
def upsert_latest(spark, d):
    return evaluation.upsert_latest(_t(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@_query("SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return contracts.duplicate_keys(_t(spark, d, "documents"), "text")


# Ingest ------------------------------------------------------------------------------------------

_DUMP_ROW = "c_custkey::VARCHAR || chr(9) || CASE WHEN c_custkey % 11 = 0 THEN '\\N' ELSE c_name || '\\nend' END || chr(9) || c_mktsegment"


@_query(
    r"""SELECT c_custkey AS ordinal, c_custkey::VARCHAR AS id, c_name || chr(10) || 'end' AS source, c_mktsegment AS target FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0"""
)
def dump_scan(spark, d):
    """Customers as lines of a dump: every 11th without a name, every 13th with a column too many."""
    c = _t(spark, d, "customer").select(
        F.col("c_custkey").alias("ordinal"),
        F.concat_ws("\t", F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 11 == 0, r"\N").otherwise(F.concat("c_name", F.lit(r"\nend"))), "c_mktsegment", F.when(F.col("c_custkey") % 13 == 0, "extra")).alias("value"),
    )
    head = spark.createDataFrame([(-1, "-- dump"), (0, "COPY public.customers (id, name, segment) FROM stdin;"), (1 << 50, r"\."), ((1 << 50) + 1, "9\tafter\tend")], "ordinal long, value string")
    records, _ = dump.extract_records(head.unionByName(c), "customers", {"id": "id", "source": "name", "target": "segment"})
    return records


@_query(
    """SELECT event_id, CASE WHEN event_id % 10 < 7 THEN date_trunc('second', ts) WHEN event_id % 10 = 7 THEN date_trunc('day', ts) END AS at FROM events"""
)
def date_validation(spark, d):
    ts = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    k = F.col("event_id") % 10
    raw = F.when(k < 4, F.concat(ts, F.lit("-03"))).when(k < 7, F.concat(F.replace(ts, F.lit(" "), F.lit("T")), F.lit("Z"))).when(k == 7, F.date_format("ts", "yyyy-MM-dd")).when(k == 8, F.date_format("ts", "dd/MM/yyyy"))
    return _t(spark, d, "events").select("event_id", profile.wall_clock(raw).alias("at"))


# Contracts -----------------------------------------------------------------------------------------

_RECORD = "CASE WHEN event_id % 5 = 1 THEN 'extra' WHEN event_id % 5 = 2 THEN 'blank' WHEN event_id % 5 = 3 THEN 'condition' ELSE '' END"


@_query(
    """SELECT event_id AS ordinal, CASE event_id % 5 WHEN 1 THEN 'keys' WHEN 2 THEN 'ementa_gerada' WHEN 3 THEN 'condicao_id' END AS violations FROM events WHERE event_id % 5 IN (1, 2, 3)"""
)
def prediction_contract(spark, d):
    k = F.col("event_id") % 5
    record = F.concat(
        F.lit('{"caso_id":"teste_'), F.col("event_id").cast("string"), F.lit('","condicao_id":"'), F.when(k == 3, "other").otherwise("qwen_ft"),
        F.lit('","ementa_gerada":"'), F.when(k == 2, "  ").otherwise("text"), F.lit('"'), F.when(k == 1, ',"score":1').otherwise(""), F.lit("}"),
    )
    lines = _t(spark, d, "events").select(F.col("event_id").alias("ordinal"), record.alias("value"))
    return contracts.broken_records(lines, contracts.prediction_violations(F.col("value"))).withColumn("violations", F.array_join("violations", ","))


def _judged(spark, d) -> DataFrame:
    """Judge records of the events: scores from the id; one in nine has a score of 6."""
    e = spread(_t(spark, d, "events").select("event_id"))
    parts = []
    for k, dim in enumerate(K.JUDGE_DIMENSIONS):
        score = (F.col("event_id") * (k + 3)) % 5 + 1
        if k == 2:
            score = F.when(F.col("event_id") % 9 == 0, 6).otherwise(score)
        parts.append(F.struct(score.cast("int").alias("score"), F.lit("because").alias("justificativa")).alias(dim))
    return e.select("event_id", F.struct(*parts).alias("answer"))


@_query("SELECT event_id AS ordinal, 'fidelidade_factual.score' AS violations FROM events WHERE event_id % 9 = 0")
def judge_contract(spark, d):
    lines = _judged(spark, d).select(F.col("event_id").alias("ordinal"), F.to_json("answer").alias("value"))
    return contracts.broken_records(lines, contracts.judge_answer_violations(F.col("value"))).withColumn("violations", F.array_join("violations", ","))


@_query(
    "SELECT event_id, (event_id * 3 % 5 + 1 + event_id * 4 % 5 + 1 + CASE WHEN event_id % 9 = 0 THEN 6 ELSE event_id * 5 % 5 + 1 END + event_id * 6 % 5 + 1 + event_id * 7 % 5 + 1) / 5.0::DOUBLE AS score FROM events", "score"
)
def judge_scores(spark, d):
    return _judged(spark, d).select("event_id", evaluation.judge_score().alias("score"))


@_query(
    """SELECT event_id, CASE event_id % 6 WHEN 1 THEN 'truncated' WHEN 2 THEN 'empty' WHEN 3 THEN 'not json' ELSE CASE WHEN event_id % 9 = 0 THEN 'fidelidade_factual.score' END END AS problem FROM events"""
)
def judge_responses(spark, d):
    k = F.col("event_id") % 6
    content = F.when(k == 2, " ").when(k == 3, "no json").otherwise(F.to_json("answer"))
    choice = F.struct(F.when(k == 1, "length").otherwise("stop").alias("finish_reason"), F.struct(content.alias("content")).alias("message"))
    df = _judged(spark, d).withColumn("response", F.to_json(F.struct(F.array(choice).alias("choices"))))
    return df.select("event_id", generation.judge_problem("response").alias("problem"))


# Metrics and inference ---------------------------------------------------------------------------------

#: Two families of the test events: their types as conditions, users as cases.
_FAMILIES = {"browse": ("click", "view"), "buy": ("purchase", "signup")}
_LONG = """SELECT user_id::VARCHAR AS case_id, event_type AS condition_id, unnest(['value', 'count']) AS metric, unnest([avg(value), count(*)::DOUBLE]) AS score FROM events GROUP BY user_id, event_type"""
_WIDE = f"""SELECT family, metric, case_id, max(score) FILTER (side = 'ft') AS ft, max(score) FILTER (side = 'zs') AS zs, max(score) FILTER (side = 'ft') - max(score) FILTER (side = 'zs') AS delta
    FROM ({_LONG}) JOIN (VALUES ('click', 'browse', 'ft'), ('view', 'browse', 'zs'), ('purchase', 'buy', 'ft'), ('signup', 'buy', 'zs')) f(condition_id, family, side) USING (condition_id) GROUP BY family, metric, case_id"""


def _metrics(spark, d) -> DataFrame:
    wide = _t(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("case_id"), F.col("event_type").alias("condition_id")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).cast("double").alias("count"))
    return evaluation.metric_table(wide, ["value", "count"])


@_query(_LONG, "score")
def metric_unpivot(spark, d):
    return _metrics(spark, d)


@_query(
    f"""SELECT case_id, max(score) FILTER (condition_id = 'click') AS click, max(score) FILTER (condition_id = 'view') AS view, max(score) FILTER (condition_id = 'purchase') AS purchase
    FROM ({_LONG}) WHERE metric = 'value' GROUP BY case_id""",
    "click view purchase",
)
def condition_pivot(spark, d):
    return evaluation.condition_pivot(_metrics(spark, d).filter("metric = 'value'"), ["click", "view", "purchase"])


@_query(_WIDE, "ft zs delta")
def metric_pairs(spark, d):
    return evaluation.metric_pairs(_metrics(spark, d), _FAMILIES)


_MEANS = f"SELECT family, metric, count(*) AS n, avg(ft) AS mean_ft, avg(zs) AS mean_zs, avg(delta) AS delta FROM ({_WIDE}) WHERE ft IS NOT NULL AND zs IS NOT NULL GROUP BY family, metric"


@_query(_MEANS, "mean_ft mean_zs delta")
def paired_comparison(spark, d):
    return inference.paired_means(evaluation.metric_pairs(_metrics(spark, d), _FAMILIES))


@_query()
def bootstrap_permutation(spark, d):
    pairs = evaluation.metric_pairs(_metrics(spark, d), _FAMILIES).filter("ft is not null and zs is not null")
    return inference.compare(pairs)


#: p-values of the test data, by part: a fraction of the key.
_P = "(p_partkey * 7919 % 10007) / 10007.0::DOUBLE"


def _p_values(spark, d) -> DataFrame:
    return _t(spark, d, "part").select("p_brand", "p_partkey", ((F.col("p_partkey") * 7919) % 10007 / 10007.0).alias("p"))


@_query(
    f"""SELECT p_brand, p_partkey, p, max(step) OVER (PARTITION BY p_brand ORDER BY p, p_partkey ROWS UNBOUNDED PRECEDING) AS adjusted FROM (SELECT p_brand, p_partkey, {_P} AS p,
    least(1.0, {_P} * (count(*) OVER (PARTITION BY p_brand) - row_number() OVER (PARTITION BY p_brand ORDER BY {_P}, p_partkey) + 1)) AS step FROM part)""",
    "p adjusted",
)
def holm_adjust(spark, d):
    return inference.holm(_p_values(spark, d), "p", ["p_brand"], "p_partkey")


@_query(
    f"""SELECT p_brand, p_partkey, p, least(1.0, min(step) OVER (PARTITION BY p_brand ORDER BY p DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING)) AS adjusted FROM (SELECT p_brand, p_partkey, {_P} AS p,
    {_P} * count(*) OVER (PARTITION BY p_brand) / row_number() OVER (PARTITION BY p_brand ORDER BY {_P}, p_partkey) AS step FROM part)""",
    "p adjusted",
)
def bh_adjust(spark, d):
    return inference.benjamini_hochberg(_p_values(spark, d), "p", ["p_brand"], "p_partkey")


def _tested(spark, d) -> DataFrame:
    """Comparisons of the test events with p-values that follow from their size."""
    return inference.paired_means(evaluation.metric_pairs(_metrics(spark, d), _FAMILIES)).withColumn("p", 1.0 / (1.0 + 1000.0 * F.abs("delta")))


@_query(
    f"""SELECT family, metric, 1.0 / (1.0 + 1000.0 * abs(delta)) AS adjusted, CASE metric WHEN 'value' THEN 'primary' ELSE 'secondary' END AS scope, 1.0 / (1.0 + 1000.0 * abs(delta)) < 0.05 AS significant FROM ({_MEANS})""", "adjusted"
)
def multiplicity(spark, d):
    return inference.adjust(_tested(spark, d), ["value"]).select("family", "metric", "adjusted", "scope", "significant")


@_query(f"SELECT family, bool_and(delta > 0 AND 1.0 / (1.0 + 1000.0 * abs(delta)) < 0.05) AS success FROM ({_MEANS}) WHERE metric = 'value' GROUP BY family")
def success_summary(spark, d):
    return inference.success_by_family(inference.adjust(_tested(spark, d), ["value"]))


@_query(f"SELECT metric, count(DISTINCT family) AS families, NOT (bool_or(delta > 0) AND bool_or(delta < 0)) AS consistent FROM ({_MEANS}) GROUP BY metric")
def direction_consistency(spark, d):
    return inference.direction_consistency(_tested(spark, d))


def _items(spark, d) -> DataFrame:
    labels = _t(spark, d, "labels")
    return labels.select(F.col("doc_id").cast("string").alias("case_id"), F.concat(F.col("doc_id").cast("string"), F.lit("_A")).alias("item_id"), F.lit("A").alias("blind_label"))


_GRID = """SELECT doc_id::VARCHAR AS case_id, doc_id::VARCHAR || '_A' AS item_id, 'A' AS blind_label, rater_id, criterion FROM labels CROSS JOIN (VALUES ('avaliador_1'), ('avaliador_2')) r(rater_id)
    CROSS JOIN (VALUES ('adequacao'), ('completude'), ('concisao'), ('fluencia')) c(criterion)"""


@_query(_GRID)
def rating_grid(spark, d):
    return evaluation.rating_grid(_items(spark, d)).select("case_id", "item_id", "blind_label", "rater_id", "criterion")


_RATED = f"""SELECT *, ((case_id::BIGINT * 31 + length(criterion) + CASE WHEN rater_id = 'avaliador_2' AND case_id::BIGINT % 3 = 0 THEN 1 ELSE 0 END) % 5 + 1)::INTEGER AS rating,
    CASE case_id::BIGINT % 4 WHEN 0 THEN 'gemini_ft' WHEN 1 THEN 'gemini_zero_shot' WHEN 2 THEN 'qwen_ft' ELSE 'qwen_zero_shot' END AS true_condition_id FROM ({_GRID})"""


def _ratings(spark, d) -> DataFrame:
    case = F.col("case_id").cast("long")
    rating = (case * 31 + F.length("criterion") + F.when((F.col("rater_id") == "avaliador_2") & (case % 3 == 0), 1).otherwise(0)) % 5 + 1
    return evaluation.rating_grid(_items(spark, d)).withColumn("rating", rating.cast("int"))


def _unblinded(spark, d) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(c) for c in K.CONDITION_IDS]), (F.col("case_id").cast("long") % 4 + 1).cast("int"))
    key = _items(spark, d).withColumn("true_condition_id", name)
    return evaluation.unblind(_ratings(spark, d), key)


@_query(f"SELECT item_id, rater_id, criterion, rating, true_condition_id FROM ({_RATED})")
def unblinded_ratings(spark, d):
    return _unblinded(spark, d).select("item_id", "rater_id", "criterion", "rating", "true_condition_id")


@_query(
    f"""SELECT true_condition_id AS condition_id, criterion, count(rating) AS n, avg(rating) AS mean FROM ({_RATED}) GROUP BY GROUPING SETS ((true_condition_id, criterion), (true_condition_id))""", "mean"
)
def rating_means(spark, d):
    return evaluation.rating_means(_unblinded(spark, d))


_RATER_PAIRS = f"SELECT item_id, criterion, max(rating) FILTER (rater_id = 'avaliador_1') AS avaliador_1, max(rating) FILTER (rater_id = 'avaliador_2') AS avaliador_2 FROM ({_RATED}) GROUP BY item_id, criterion"


@_query(_RATER_PAIRS)
def rater_pairs(spark, d):
    return evaluation.rater_pairs(_ratings(spark, d), ["avaliador_1", "avaliador_2"])


@_query(
    f"""WITH c AS (SELECT criterion, avaliador_1 AS a, avaliador_2 AS b, count(*) AS n FROM ({_RATER_PAIRS}) GROUP BY ALL), t AS (SELECT criterion, sum(n) AS n, sum(n * (a - b) ** 2 / 16.0) AS o FROM c GROUP BY criterion),
    ra AS (SELECT criterion, a, sum(n) AS n FROM c GROUP BY ALL), rb AS (SELECT criterion, b, sum(n) AS n FROM c GROUP BY ALL),
    e AS (SELECT criterion, sum(ra.n * rb.n * (a - b) ** 2 / 16.0) AS e FROM ra JOIN rb USING (criterion) GROUP BY criterion)
    SELECT criterion, n::BIGINT AS n, 1 - o / (e / n) AS kappa FROM t JOIN e USING (criterion)""",
    "kappa",
)
def weighted_kappa(spark, d):
    return evaluation.cohen_kappa(evaluation.rater_pairs(_ratings(spark, d), ["avaliador_1", "avaliador_2"]), "avaliador_1", "avaliador_2", ["criterion"])


def _rouge_grams(c: str, n: int) -> str:
    w = f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda w: w <> '')"
    return w if n == 1 else f"list_transform(range(1, len({w})), lambda i: ({w})[i] || ' ' || ({w})[i + 1])"


def _rouge_sql(n: int) -> str:
    return f"""SELECT p.conv_id, p.turn, CASE WHEN coalesce(o, 0) = 0 THEN 0.0 ELSE 2.0 * o / (len({_rouge_grams('source', n)}) + len({_rouge_grams('target', n)})) END AS rouge{n}_f1 FROM ({_PAIRS}) p LEFT JOIN (
    SELECT conv_id, turn, sum(least(x.k, y.k)) AS o FROM (SELECT conv_id, turn, g, count(*) AS k FROM (SELECT conv_id, turn, unnest({_rouge_grams('source', n)}) AS g FROM ({_PAIRS})) GROUP BY ALL) x
    JOIN (SELECT conv_id, turn, g, count(*) AS k FROM (SELECT conv_id, turn, unnest({_rouge_grams('target', n)}) AS g FROM ({_PAIRS})) GROUP BY ALL) y USING (conv_id, turn, g) GROUP BY conv_id, turn) q USING (conv_id, turn)"""


@_query(f"SELECT conv_id, turn, rouge1_f1, rouge2_f1 FROM ({_rouge_sql(1)}) JOIN ({_rouge_sql(2)}) USING (conv_id, turn)", "rouge1_f1 rouge2_f1")
def rouge_scores(spark, d):
    return evaluation.rouge(_pairs(spark, d), "source", "target").select("conv_id", "turn", "rouge1_f1", "rouge2_f1")


@_query()
def rouge_lcs(spark, d):
    return evaluation.rouge(_pairs(spark, d), "source", "target").select("conv_id", "turn", "rougeL_f1")


# Rules on constructed texts: each document stands for one case, and the SQL holds what has to come out -----------


def _case_of(cases: list, column: str = "doc_id"):
    """The case of a row, as an expression: cases follow each other by id."""
    values = F.array(*[F.lit(c).cast("string") for c in cases])
    return F.element_at(values, (F.pmod(F.col(column), F.lit(len(cases))) + 1).cast("int"))


def _told(expected: list, column: str = "doc_id") -> str:
    quoted = ["NULL" if e is None else "'" + e.replace("'", "''") + "'" for e in expected]
    return f"CASE {column} % {len(expected)} " + " ".join(f"WHEN {k} THEN {e}" for k, e in enumerate(quoted)) + " END"


#: A text for each cleaning rule, and the text that is left.
_CLEANED = (
    ("<p class='x'>Texto <b>forte</b></p> fim", "Texto forte fim"), ("Processo nº 0500148-54.2016.4.05.8200 segue", "segue"), ("visto (id 48772689) e id. 48772690 nos autos", "visto e nos autos"),
    ("Data de Julgamento: hoje", ": hoje"), ("PROCESSO ELETRÔNICO DJe-123 DIVULG 23-05-2024", ""), ("publicado no DJe em maio", "publicado no em maio"), ("publicado DJe 26.09.2012 ontem", "publicado 26.09.2012 ontem"),
    ("o divulg isolado", "o isolado"), ("Ação Civil Pública - ACP nº 5.2-3 movida pela DPU agora", "agora"), ("João Pessoa, 12 de março de 2021", "[DATA]"),
    ("Súmula de julgamento Súmula de Julgamento: tudo", "Súmula de Julgamento: tudo"), ("Fim.  Súmula do julgamento: resto", "Fim"), ("Texto. Maria da Silva Souza Juíza Federal", "Texto"),
    ("voto do Relator fulano", "voto do"), ("Texto final AMPARO SOCIAL TOTAL", "Texto final"), ("a\r\n\tc  d ", "a c d"), ("&eacute; &lt;b&gt; &amp;c", "é &c"), (None, ""), ("", ""),
)


@_query("SELECT doc_id, " + _told([e for _, e in _CLEANED]) + " AS text FROM documents")
def cleaning_rules(spark, d):
    return _t(spark, d, "documents").select("doc_id", cleaning.clean_text(_case_of([c for c, _ in _CLEANED])).alias("text"))


#: A text for each masking layer, the masked text, and what its counters say.
_MASKED = (
    ("CPF 123.456.789-01 visto", "CPF [CPF] visto", {"cpfs": 1}), ("CNPJ 12.345.678/0001-99 visto", "CNPJ [CNPJ] visto", {"cnpjs": 1}), ("NPU 0500148-54.2016.4.05.8200 visto", "NPU [NPU] visto", {"npus": 1}),
    ("conta corrente nº 12345-6 e ag. 1234-5", "[CONTA-DIGITO] e [CONTA-DIGITO]", {"contas": 2}), ("escreva a a.b+c@x-y.com hoje", "escreva a [EMAIL] hoje", {"emails": 1}),
    ("ligue (83) 99999-1234 ou 83 3333-4444", "ligue [TELEFONE] ou [TELEFONE]", {"telefones": 2}),
    ("Sr. João Silva Souza disse. Depois João Silva saiu", "Sr. [NOME_OCULTADO]. Depois [NOME_PESSOA] saiu", {"nomes_honorificos": 1, "nomes_proprios": 1}),
    ("movido por FULANO DE TAL SILVA em face de X", "movido por [NOME_OCULTADO] em face de X", {"nomes_honorificos": 1}), ("AUTOR: MARIA DA SILVA RÉU: INSS", "AUTOR: [NOME_OCULTADO] RÉU: INSS", {"nomes_honorificos": 1}),
    ("visto Maria José Lima e outros", "visto [NOME_PESSOA] e outros", {"nomes_proprios": 1}),
    ("o Instituto Nacional Maria José Lima e Carlos Alberto Souza", "o Instituto Nacional Maria José Lima e [NOME_PESSOA]", {"nomes_proprios": 1}),
    ("Rua das Flores, rua X bloco 3 nº 10", "Rua das Flores, [ENDEREÇO_COMPLETO] nº 10", {"logradouros": 1}), ("nada a mascarar aqui", "nada a mascarar aqui", {}), (None, "", {}),
)


@_query("SELECT doc_id, " + _told([e for _, e, _ in _MASKED]) + " AS text FROM documents")
def masking_layers(spark, d):
    texts = _t(spark, d, "documents").select("doc_id", _case_of([c for c, _, _ in _MASKED]).alias("text"))
    return masking.mask_text(texts, "text")


@_query(
    "SELECT counter, sum(n)::BIGINT AS n FROM (SELECT counter, CASE WHEN doc_id % " + str(len(_MASKED)) + " = k THEN hits ELSE 0 END AS n FROM documents CROSS JOIN (VALUES "
    + ", ".join(f"('{c}', {k}, {n.get(c, 0)})" for c in masking.COUNTERS for k, (_, _, n) in enumerate(_MASKED)) + ") h(counter, k, hits)) GROUP BY counter"
)
def mask_counters(spark, d):
    """Counters of both texts of a pair, dropped pairs included; the pair's target is empty here."""
    pairs = _t(spark, d, "documents").select(_case_of([c for c, _, _ in _MASKED]).alias("source"), F.lit("").alias("target"))
    return masking.ranked_totals(masking.mask_totals(masking.mask_pairs(pairs)))


#: Findings of the audit in the texts above: case, category, matches, first match. Cases of cleaning come first.
_FOUND = (
    (2, "4. ID PJe", 2, "id 48772689"), (6, "7. DJe com data residual", 1, "DJe 26.09.2012"), (1, "3. NPU (Número do Processo)", 1, "0500148-54.2016.4.05.8200"), (19, "1. CPF", 1, "123.456.789-01"),
    (20, "2. CNPJ", 1, "12.345.678/0001-99"), (21, "3. NPU (Número do Processo)", 1, "0500148-54.2016.4.05.8200"), (23, "5. E-mail", 1, "a.b+c@x-y.com"), (24, "6. Telefone", 2, "(83) 99999-1234"),
    (25, "8. Nomes privados", 1, "João Silva Souza"), (26, "8. Nomes privados", 1, "FULANO DE TAL SILVA"), (27, "8. Nomes privados", 1, "MARIA DA SILVA"),
)
_AUDITED = [c for c, _ in _CLEANED] + [c for c, _, _ in _MASKED]


@_query(
    "SELECT category, sum(n)::BIGINT AS n, count(*) AS rows, array_to_string(list_slice(list(example ORDER BY doc_id), 1, 3), ' | ') AS examples FROM documents JOIN (VALUES "
    + ", ".join(f"({k}, '{c}', {n}, '{e}')" for k, c, n, e in _FOUND) + f") f(k, category, n, example) ON doc_id % {len(_AUDITED)} = k GROUP BY category"
)
def audit_categories(spark, d):
    report = audit.audit_report(_t(spark, d, "documents").select(F.col("doc_id").alias("ordinal"), _case_of(_AUDITED).alias("text")), "text")
    return report.filter("n > 0").withColumn("examples", F.array_join("examples", " | "))


_LONG_TEXT = "um dois tres quatro cinco seis sete oito nove dez onze"
_REJECTED = (
    (None, "x", "empty_before"), ("", "x", "empty_before"), ("<b></b>", "a b c d e", "empty_after"), ("   ", "a b c d e", "empty_after"), (_LONG_TEXT, f" {_LONG_TEXT} ", "identical"), (_LONG_TEXT, "a b", "short"),
    ("a b", "a b c d e", "short"), (_LONG_TEXT, "a b c d e", None),
)


@_query("SELECT doc_id, " + _told([r for _, _, r in _REJECTED]) + " AS reject_reason FROM documents")
def reject_reasons(spark, d):
    pairs = _t(spark, d, "documents").select("doc_id", _case_of([a for a, _, _ in _REJECTED]).alias("source"), _case_of([b for _, b, _ in _REJECTED]).alias("target"))
    return cleaning.with_reject_reason(pairs).select("doc_id", "reject_reason")


_TOPIC_TEXTS = tuple((f"sobre {keywords[-1].lower()} e mais. Outra frase com FGTS", topic) for topic, keywords in K.TOPIC_RULES) + (("nada disso. PENAL", "Outros"), (None, None), ("", "Outros"))


@_query("SELECT doc_id, " + _told([t for _, t in _TOPIC_TEXTS]) + " AS topic FROM documents")
def topic_rules(spark, d):
    return _t(spark, d, "documents").select("doc_id", _case_of([c for c, _ in _TOPIC_TEXTS]).alias("text")).select("doc_id", F.when(F.col("text").isNotNull(), profile.topic_of("text")).alias("topic"))


_ANOMALIES = (
    (" Amparo assistencial. Sentença de improcedência. Recorre a parte-autora\n", "trunc_8w_exata"), ("Justiça Federal da 5ª Região - turma", "header_ementa"), ("despacho: nada", "despacho_ementa"), ("12) voto", "ementa_start_digit"),
    ("3- DESPACHO", "ementa_start_digit"), ("palavra " * 301, "ementa_longa_anomala"), ("1. " + "palavra " * 300, "ementa_start_digit,ementa_longa_anomala"), ("palavra " * 300, ""), ("ementa comum", ""), (None, ""),
)


@_query("SELECT doc_id, " + _told([x for _, x in _ANOMALIES]) + " AS labels FROM documents")
def anomaly_rules(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.array_join(profile.anomaly_labels(_case_of([c for c, _ in _ANOMALIES])), ",").alias("labels"))


#: Comparisons of the parts: a family for every five, a metric each; the first 40 are primary.
_COMPARED = f"""SELECT 'f' || (p_partkey % 5) AS family, 'm' || p_partkey AS metric, {_P} AS p, CASE WHEN p_partkey <= 40 THEN 'primary' ELSE 'secondary' END AS scope FROM part"""


@_query(
    f"""SELECT family, metric, scope, method, adjusted, adjusted < 0.05 AS significant FROM (
    SELECT family, metric, scope, 'holm_bonferroni' AS method, max(step) OVER (PARTITION BY family ORDER BY p, metric ROWS UNBOUNDED PRECEDING) AS adjusted FROM (
        SELECT *, least(1.0, p * (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, metric) + 1)) AS step FROM ({_COMPARED}) WHERE scope = 'primary')
    UNION ALL SELECT family, metric, scope, 'benjamini_hochberg', least(1.0, min(step) OVER (PARTITION BY family ORDER BY p DESC, metric DESC ROWS UNBOUNDED PRECEDING)) FROM (
        SELECT *, p * count(*) OVER (PARTITION BY family) / row_number() OVER (PARTITION BY family ORDER BY p, metric) AS step FROM ({_COMPARED}) WHERE scope = 'secondary'))""",
    "adjusted",
)
def multiplicity_of_many(spark, d):
    k = F.col("p_partkey")
    compared = _p_values(spark, d).select(F.concat(F.lit("f"), k % 5).alias("family"), F.concat(F.lit("m"), k).alias("metric"), "p")
    return inference.adjust(compared, [f"m{n}" for n in range(41)]).select("family", "metric", "scope", "method", "adjusted", "significant")


@_query(
    """SELECT event_id, least(floor((p - 1) * 4 / n) + 1, 4)::INTEGER AS stratum FROM (SELECT event_id, row_number() OVER (ORDER BY v NULLS FIRST, event_id) AS p, count(*) OVER () AS n
    FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events))"""
)
def fractional_strata(spark, d):
    """Strata of a double with nulls, which come first."""
    events = _t(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    return evaluation.quartile_strata(events, "v", "event_id").select("event_id", "stratum")


@_query("SELECT doc_id, row_number() OVER (ORDER BY lang, source NULLS FIRST, doc_id) AS position FROM documents")
def places_in_order(spark, d):
    return evaluation.with_position(_t(spark, d, "documents").select("doc_id", "lang", "source"), [F.col("lang"), F.col("source"), F.col("doc_id")]).select("doc_id", "position")


@_query("""SELECT p_partkey AS ordinal, CASE WHEN p_partkey % 4 = 1 THEN 'score' WHEN p_partkey % 4 = 2 THEN 'condition' END AS problem FROM part WHERE p_partkey % 4 IN (1, 2)""")
def score_contract(spark, d):
    """Scores that are not finite and conditions that aren't known, one row in four each."""
    k = F.col("p_partkey")
    score = F.when(k % 4 == 1, F.when(k % 8 == 1, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))).otherwise(k / 2.0)
    rows = _t(spark, d, "part").select("p_partkey", score.alias("score"), F.when(k % 4 == 2, "other").otherwise("qwen_ft").alias("condition_id"))
    bad = contracts.invalid_scores(rows)
    return bad.select(F.col("p_partkey").alias("ordinal"), F.when(F.col("condition_id") == "other", "condition").otherwise("score").alias("problem"))


@_query("SELECT p_partkey AS id, (p_partkey % 8)::INTEGER AS rating FROM part WHERE p_partkey % 8 NOT BETWEEN 1 AND 5 OR p_partkey % 10 = 0")
def rating_contract(spark, d):
    """Ratings off the scale, and ratings of unknown criteria."""
    k = F.col("p_partkey")
    rows = _t(spark, d, "part").select(k.alias("id"), (k % 8).cast("int").alias("rating"), F.when(k % 10 == 0, "other").otherwise("fluencia").alias("criterion"))
    return contracts.invalid_ratings(rows).select("id", "rating")
