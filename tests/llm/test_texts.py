import hashlib
import html
import random
import re

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from textloom.llm import extraction, imatch, pieces, quotes

# I-Match ------------------------------------------------------------------------------


def test_edited_texts_and_neighbours(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(5)
    rows = {r["doc_id"]: r for r in imatch.edit_report(docs).collect()}
    ordered = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(rows) == len(ordered)
    for (i, a), (_, b) in zip(ordered, [*ordered[1:], ordered[0]], strict=True):
        k = len(a) // 4
        assert rows[i]["edited_sha256"] == hashlib.sha256((a[: len(a) - k] + b[:k]).encode()).hexdigest()
        assert rows[i]["n_chars"] == len(a)
    by_text = {}
    for i, a in ordered:
        by_text.setdefault(a, set()).add(rows[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    assert sum(r["near_edited"] > r["near_next"] for r in rows.values()) > 0.9 * len(rows)


def plain_band(texts, least=2, rare=1e-4, share=0.05):
    df = {}
    for t in texts:
        for w in plain_terms(t):
            df[w] = df.get(w, 0) + 1
    return {w for w, k in df.items() if max(least, rare * len(texts)) <= k <= max(least, share * len(texts))}


def plain_terms(text):
    return {w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w}


def plain_print(text, inside):
    """Terms of the band, sorted, hashed for each subset of each level."""
    every = plain_terms(text)
    kept = every & inside
    place = {w: xxhash.xxh64_intdigest(w, 42) >> 40 for w in (kept if len(kept) >= 8 else every)}
    out = []
    for size in imatch.LEVELS:
        for r in range(imatch.SUBSETS):
            h, some = 42, False
            for w in sorted(w for w, g in place.items() if g % size == r):
                h, some = xxhash.xxh64_intdigest(w, h), True
            out.append(f"{h & 0xFFFF:04x}" if some else imatch.NONE)
    return out


def plain_likeness(a, b):
    n = imatch.SUBSETS
    for k in reversed(range(len(imatch.LEVELS))):
        pairs = [(x, y) for x, y in zip(a[k * n : k * n + n], b[k * n : k * n + n], strict=True) if (x, y) != (imatch.NONE, imatch.NONE)]
        if len(pairs) >= (imatch.ENOUGH if k else 1):
            return sum(x == y for x, y in pairs) / len(pairs)
    return 1.0


def test_fingerprints_equal_brute_force(spark):
    """All columns, on documents and on short, empty, long and non-Latin texts."""
    docs = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").collect()]
    texts = [*docs, "", "...", "one", "Über straße ÜBER naïve", "日本語 テキスト 日本語", "a b c d e f g h i j k", " ".join(f"w{k}" for k in range(5000)), docs[0], docs[0] + " more"]
    inside = plain_band(texts)
    prints = [plain_print(t, inside) for t in texts]
    rows = {r["doc_id"]: r for r in imatch.edit_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        nxt, q = texts[(k + 1) % len(texts)], len(t) // 4
        edited = plain_print(t[: len(t) - q] + nxt[:q], inside)
        r = rows[k]
        assert (r["fingerprint"], r["edited_fingerprint"]) == ("".join(prints[k]), "".join(edited)), t[:60]
        assert r["near_edited"] == pytest.approx(plain_likeness(prints[k], edited), abs=1e-12)
        assert r["near_next"] == pytest.approx(plain_likeness(prints[k], prints[(k + 1) % len(texts)]), abs=1e-12)


def test_the_band_is_one_of_terms(spark):
    """Terms that share a slot are told apart; the band's ends are exact, and it is bounded by raising its lower end."""
    def hashed(w):
        h = xxhash.xxh64_intdigest(w, 42)
        return h - (1 << 64) if h >> 63 else h

    words = [f"t{k}" for k in range(3000)]
    some = [hashed(w) for w in words[:8]]
    slots = len(imatch.cuckoo_table(some))
    inside = imatch.lexicon(some, "h")
    df = spark.createDataFrame([(w, hashed(w)) for w in words], "w string, h long")
    assert {r["w"] for r in df.filter(inside).collect()} == set(words[:8])
    assert any(hashed(w) % slots == some[0] % slots for w in words[8:])
    table, many = imatch.cuckoo_table(hashes := list(map(hashed, words))), len(words)
    assert set(hashes) <= set(table) and 2 * many <= len(table) and all(h in (table[a], table[b]) for h in hashes for a, b in [imatch._slots(h, len(table))])
    assert not any(h in (table[a], table[b]) for h in [0, 1, (2 << 20) + 1] for a, b in [imatch._slots(h, len(table))])
    rows = [(f"all {'few' if k < 5 else ''} {'two' if k < 2 else ''} {'half' if k % 2 else ''} only{k}",) for k in range(100)]
    texts = spark.createDataFrame(rows, "text string")
    assert imatch.band(texts) == sorted(map(hashed, ("few", "two"))) and imatch.band(texts, share=0.5) == sorted(map(hashed, ("few", "two", "half")))
    assert imatch.band(texts, rare=0.03) == [hashed("few")] and imatch.band(texts, most=1) == [hashed("few")] and imatch.band(texts.limit(0)) == []


@pytest.mark.parametrize("rows", [1, 7, 5000])
def test_ranges_hand_rows_on(spark, rows):
    """Many ranges, ids with gaps: the next row is found across every border."""
    ids = sorted(random.Random(3).sample(range(10**9), 3000))
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: r["next_text"] for r in imatch.with_next(imatch.dealt_by_range(df, rows=rows), ["text"]).collect()}
    assert got == {a: str(b) for a, b in zip(ids, [*ids[1:], ids[0]], strict=True)}


def test_imatch_edge_rows(edge_docs, no_docs, spark):
    rows = imatch.edit_report(edge_docs).collect()
    assert len(rows) == 9 and imatch.edit_report(no_docs).count() == 0
    one = imatch.edit_report(spark.createDataFrame([(4, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1.0
    empty = [r for r in rows if r["doc_id"] in (2, 3)]
    assert all(set(r["fingerprint"]) == {"."} and r["n_chars"] == 0 for r in empty)
    assert len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 4)}) == 1


# Pieces -----------------------------------------------------------------------------------

TEXTS = ["", " ", "  a  b", "Hello world", "日本語 \U0001f600 x", "\n\n\tfoo", "\x00\x01", "the thend hend", "a" * 300, " leading and trailing ", "é"]


def plain_viterbi(codec, s):
    """Best sums by trying every piece at every place."""
    known = {codec.pieces[i]: (i, x) for i, x in codec.score.items()}
    best, back = [0.0] + [-1e30] * len(s), [None] * (len(s) + 1)
    for end in range(1, len(s) + 1):
        for start in range(max(0, end - 64), end):
            hit = known.get(s[start:end])
            x = best[start] + (hit[1] if hit else codec.floor)
            if (hit or end - start == 1) and x > best[end]:
                best[end] = x
    return best[-1]


@pytest.mark.parametrize("text", TEXTS)
def test_best_segmentation_and_round_trip(text):
    c = pieces.codec(pieces.vocabulary())
    ids = c.encode(text)
    assert c.decode(ids) == text
    s, score = c.mark(text), 0.0
    for p in ids:
        if p not in c.byte_of:
            score += c.score[p]
    unknown = sum(1 for ch in s if ch not in {c.pieces[i] for i in c.score})
    assert abs(score + unknown * c.floor - plain_viterbi(c, s)) < 1e-3
    assert ids == c.viterbi(s)  # word by word is as good as the text at once


def test_codec_on_documents(spark, edge_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert pieces.digest(docs).filter("NOT round_trip").count() == 0
    both = pieces.decode(pieces.encode(edge_docs)).collect()
    assert len(both) == 9 and all(r["decoded"] == (r["text"] or "") for r in both)
    assert pieces.encode(no_docs).count() == 0 and pieces.digest(no_docs).count() == 0


# Pages --------------------------------------------------------------------------------------


def article_of(page):
    """The article of a generated page, by its tags."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    body = re.sub(r"<[^>]*$", "", re.sub(r"</?b>", "", body))
    return " ".join(t for t in (" ".join(html.unescape(p).split()) for p in re.split(r"</?[a-z0-9]+>", body)) if t)


def without_names(page):
    return re.sub(r' (class|id)="[^"]*"', "", page)


def without_article(page):
    return re.sub(r"<(/?)article>", r"<\1div>", without_names(page))


@pytest.mark.parametrize("change", [lambda p: p, without_names, without_article])
def test_articles_come_out_whole(spark, change):
    """Also where neither names nor an article element tell it from the rest."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    df = spark.createDataFrame([(r["page_id"], r["url"], change(r["html"])) for r in pages], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in extraction.extract(df).collect()}
    for r in pages:
        want = article_of(r["html"])
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


def test_blocks_keep_their_label_without_any_hint(spark):
    """With names gone and nav, article and footer made divs, words and links still decide nearly all blocks alike."""
    tree, n, same = extraction.default_tree(), 0, 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        plain = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", without_names(r["html"]))
        a, b = (extraction.blocks(p) for p in (r["html"], plain))
        assert [x.text for x in a] == [x.text for x in b]
        for x, y in zip(extraction.features(a).tolist(), extraction.features(b).tolist(), strict=True):
            n, same = n + 1, same + (tree.predict_one(x) == tree.predict_one(y))
    assert same >= 0.95 * n


def test_nesting_takes_linear_time():
    """A deep stack and end tags that match nothing in it."""
    import time

    spent = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert extraction.blocks("<div>" * n + "text</section>" * n)[-1].words == 1
        spent.append(time.perf_counter() - began)
    assert spent[1] < 12 * max(spent[0], 0.05)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("<p>", ""), ("plain text only, without any tags at all in it, but with quite a few words of prose", "plain text only, without any tags at all in it, but with quite a few words of prose"),
    ("<main><h1>T &amp; U</h1><p>a&nbsp;b <i>c</i>d</p><ul><li><a href=x>one</a></li><li><a href=y>two</a></li></ul></main>", "T & U a b cd"),
    ("<article><p>Body text here.</p><div class='comments'><p>I think this is a very nice article indeed</p></div></article>", "Body text here."),
    ("<div id=cookie-notice><p>We use cookies to improve your visit to this site</p></div><article><p>A.</p></article>", "A."),
    ("<article><p>One <!-- <p>not</p> --> two</p><form><label>Name</label><input></form><aside>Related</aside></article>", "One two"),
    ("<article><p>1 < 2 and 3 > 2</p><script>var x='<p>no</p>';</script><p>end</p><", "1 < 2 and 3 > 2 end <"),
    ("<article><p class=notice>We use cookies on this site<p>One.<p>Two<br>more.<p class='share-bar'>Share this<h2>Three</h2></article>", "One. Two more. Three"),
    ("<article><p>One.</p><section class=readerComments><p>What a great piece of writing this is</p></section><div hidden>Not shown</div><p aria-hidden=false>Two.</p></article>", "One. Two."),
    ("<div id=sideBar1><p>Some words about nothing at all</p></div><main><div class=ad-slot2>Buy</div><p>Text</p></main>", "Text"),
    ("<nav><a href=/>Home</a></nav><article><p>See <a href=x>this</a> and that thing.</p></article><footer>c</footer>", "See this and that thing."),
    ("<div id='content' class='content search-results-page'>ten words of prose that should come out of this page</div>", "ten words of prose that should come out of this page"),
    ("<article><p>The story begins with a sentence of some length here.</p><p class='body-text social'>A paragraph inside of it.</p><p>And an end.</p></article>", "The story begins with a sentence of some length here. A paragraph inside of it. And an end."),
    ("<div class=comment><h1>A title of a page</h1>" + "<p>All of this page stands in a container that is named like comments, so the name alone must not drop it.</p>" * 3 + "</div>",
     "A title of a page" + " All of this page stands in a container that is named like comments, so the name alone must not drop it." * 3),
])
def test_pages(page, text):
    assert extraction.main_text(page) == text


def test_tree_on_pages_it_has_not_seen():
    tree = extraction.default_tree()
    x, y = extraction.labelled_sample(draws=20, seed=99)
    assert x.shape[1] == len(extraction.FEATURES) and np.mean([tree.predict_one(r) == bool(v) for r, v in zip(x.tolist(), y, strict=True)]) > 0.98
    plain = x.copy()
    plain[:, [extraction.FEATURES.index(f) for f in ("named", "own")]] = 0  # without names, most blocks keep their label
    assert np.mean([tree.predict_one(r) == bool(v) for r, v in zip(plain.tolist(), y, strict=True)]) > 0.8


def test_page_edge_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<p>" * 20_000 + "deep", "x")], "page_id long, url string, html string, text string")
    assert [len(r) for r in extraction.extract(df).collect()] == [4, 4, 4] and extraction.extract(df.limit(0)).count() == 0


# Quotes ---------------------------------------------------------------------------------------

MESSAGES = [
    (1, 0, "user", "Hello there.\nHow are you today?"), (1, 1, "assistant", "> How are you today?\nFine thanks.\n\nSecond paragraph here."),
    (1, 2, "user", "Bob wrote:\n> > How are you today?\n> Second   paragraph HERE.\nok"), (2, 0, "user", "> Fine thanks.\nunrelated"), (2, 1, "assistant", "reply"),
    (3, 0, "user", None), (3, 2, "user", "gap"), (None, 0, "user", "> x"), (1, 0, "user", "Hello there.\nHow are you today?"), (4, 0, "user", "> nobody said this"), (4, 1, "user", "> nobody said this\n> > not this\nme"),
]


def test_threads(spark):
    df = spark.createDataFrame([(*m, "x") for m in MESSAGES], "conv_id long, turn long, role string, text string, quotes string")
    rows = quotes.link_quotes(df).collect()
    assert len(rows) == len(MESSAGES)
    at = {(r["conv_id"], r["turn"]): r for r in rows}
    told = {k: (r["parent_conv"], r["parent_turn"], r["thread_conv"], r["thread_turn"], r["reply_depth"]) for k, r in at.items()}
    assert told[1, 1] == (1, 0, 1, 0, 1) and told[1, 2] == (1, 1, 1, 0, 2) and told[2, 0] == (1, 1, 1, 0, 2) and told[2, 1] == (2, 0, 1, 0, 3)
    assert told[3, 2] == (None, None, 3, 2, 0) and told[None, 0][4] == 0 and told[4, 1] == (4, 0, 4, 0, 1)
    assert at[1, 2]["clean_text"] == "ok" and (at[1, 2]["quote_depth"], at[1, 2]["n_quotes"], at[1, 2]["n_linked"]) == (2, 2, 2)
    assert at[4, 1]["clean_text"] == "me" and at[3, 0]["clean_text"] == ""
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_threads_equal_sql(spark, tmp_path):
    """A second engine finds the same threads, on the cases above and on conversations that quote each other at random."""
    import duckdb
    import pandas as pd

    rng = random.Random(9)
    said: list[str] = []
    rows = [m for m in MESSAGES]
    for conv in range(20, 60):
        for turn in range(rng.randint(1, 6)):
            lines = [f"line {rng.randint(0, 60)} of words"]
            if said and rng.random() < 0.6:
                lines = [f"{'> ' * rng.randint(1, 2)}{x}" for x in rng.choice(said).split("\n")] + lines
                if rng.random() < 0.3:
                    lines.insert(0, "Ann wrote:")
            text = "\n".join(lines)
            said.append(lines[-1])
            rows.append((conv, turn, "user", text))
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", frame)
    cur = con.execute(quotes.ORACLE)
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(repr(tuple(r[c] for c in names)) for r in quotes.link_quotes(df).collect())
    assert got == want and sum("None" not in r for r in got) > 60


def test_long_conversations(spark):
    df = spark.range(700).selectExpr("5L AS conv_id", "id AS turn", "'u' AS role", "concat('t ', id) AS text")
    assert quotes.link_quotes(df).filter("reply_depth <> turn OR thread_turn <> 0").count() == 0


def test_long_quotations_in_linear_time(spark):
    """Tens of thousands of alternating lines, and a line of very many marks."""
    lines = [f"> said {k}" if k % 2 else f"own {k}" for k in range(64_000)]
    rows = [(1, 0, "u", "\n".join(lines)), (2, 0, "u", "> " * 100_000 + "deep\nrest"), (3, 0, "u", ">" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in quotes.parse_quotes(df).collect()}
    assert [tuple(q) for q in got[1]["quotes"]] == [(1, f"said {k}") for k in range(1, 64_000, 2)]
    assert got[1]["clean_text"] == "\n".join(lines[::2])
    assert (got[2]["quote_depth"], got[2]["clean_text"]) == (100_000, "rest") and [tuple(q) for q in got[2]["quotes"]] == [(100_000, "deep")]
    assert got[3]["clean_text"] == "" and got[3]["quotes"] == []


def test_frequent_keys_are_dealt_out(spark):
    """A third of the rows has one key: the join gives the same rows, and no partition holds them all."""
    from textloom.llm.common import materialise, spread_join

    big = materialise(spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS k", "id AS v"))
    small = spark.range(20_000).selectExpr("id AS k", "id * 2 AS w")
    for how in ("inner", "left", "left_semi"):
        got, want = spread_join(big, small, ["k"], how), big.join(small, ["k"], how)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # or it would put small partitions together
    try:
        dealt = spread_join(big, small.hint("merge"), ["k"]).filter("v % 3 = 0")
        most = max(dealt.groupBy(F.spark_partition_id().alias("p")).count().collect(), key=lambda r: r["count"])["count"]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert most < 5000


def test_frequent_passages_make_no_pairs(spark):
    """A passage that all say and all quote links each message to one original."""
    df = spark.range(400).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "CASE WHEN id = 0 THEN 'same words' ELSE '> same words\nsame words' END AS text")
    rows = quotes.link_quotes(df).collect()
    assert len(rows) == 400 and all(r["parent_conv"] == 0 and r["reply_depth"] == 1 for r in rows if r["conv_id"])
