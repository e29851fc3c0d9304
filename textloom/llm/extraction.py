"""Main text of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import functools
import html
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm.common import with_fields

BLOCK = set(
    """address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html input label legend li main menu nav ol optgroup option p
    pre section select summary table tbody td tfoot th thead tr ul""".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW = set("script style title textarea".split())
CONTAINER = (BLOCK - VOID - {"p", "html", "body"}) | set("noscript iframe svg template object canvas span".split())
#: Elements made for something else than the article.
BESIDE_TAGS = set("nav footer aside form button select dialog menu noscript iframe svg template object canvas head fieldset label".split())
BESIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MAIN_TAGS = {"article", "main"}
ITEM_TAGS = set("li dt dd option".split())
PARAGRAPH_TAGS = set("p pre blockquote figcaption summary caption".split())
#: Words of class and id names that hint at something else than the article, and at the article.
BESIDE_NAMES = set(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies
    consent gdpr notice notices alert comment comments commentlist reply replies respond discussion disqus sidebar sidenav menu nav
    navbar navigation topbar footer foot header masthead share sharing social related recommended breadcrumb breadcrumbs newsletter
    subscribe subscription signup login popup modal overlay pagination pager widget copyright legal disclaimer toolbar skip
    search outbrain taboola notification toast paywall cookiebar cookiebanner cookienotice navmenu adsbygoogle""".split()
)
MAIN_NAMES = set("article content main post entry story body text".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_HIDDEN = re.compile(r"""(?<![-\w])hidden(?![-\w]*=)|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def name_hint(names: list[str]) -> float:
    """How much an element's class and id names hint at something else than the article, from 0 to 1.

    A name counts 1 if it or its last part is such a word ("comments",
    "article-comments"), one half if another part is ("ad-slot"), and -1 if it
    names the article; the mean over all names counts, so that one name among
    others decides nothing.
    """
    total = n = 0.0
    for name in names:
        parts = [p.lower() for p in _PART.findall(name)]
        if not parts:
            continue
        n += 1
        if parts[-1] in BESIDE_NAMES or "".join(parts) in BESIDE_NAMES:
            total += 1
        elif MAIN_NAMES & set(parts):
            total -= 1
        elif BESIDE_NAMES & set(parts):
            total += 0.5
    return max(0.0, total / n) if n else 0.0


class Block(NamedTuple):
    """A flat text block: its text, words, words in links, and the kinds of element it stands in."""

    text: str
    words: int
    linked: int
    kind: str  # p paragraph, h heading, i list item, b text of another element
    main: bool  # in an article or main element
    beside: bool  # in a nav, footer, aside, form or the like
    named: float  # strongest name hint of the containers around
    own: float  # name hint of the paragraph or heading itself


class _Around(NamedTuple):
    main: bool = False
    beside: bool = False
    named: float = 0.0
    hidden: bool = False
    kind: str = "b"


def _attributes(attributes: str) -> tuple[list[str], set[str]]:
    names: list[str] = []
    roles: set[str] = set()
    for key, *value in _ATTRIBUTE.findall(attributes):
        words = "".join(value).split()
        if key.lower() == "role":
            roles.update(w.lower() for w in words)
        else:
            names += words
    return names, roles


def _inside(around: _Around, tag: str, attributes: str) -> _Around:
    """What holds inside of a container."""
    names, roles = _attributes(attributes)
    kind = "i" if tag in ITEM_TAGS else "p" if tag in PARAGRAPH_TAGS else around.kind if tag == "span" else "b"
    if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
        kind = "h"
    return _Around(
        around.main or tag in MAIN_TAGS or "main" in roles,
        around.beside or tag in BESIDE_TAGS or bool(BESIDE_ROLES & roles) or (tag == "header" and not around.main),
        around.named if tag in MAIN_TAGS else max(around.named, name_hint(names)),
        around.hidden or bool(_HIDDEN.search(attributes)),
        kind,
    )


def blocks(page: str) -> list[Block]:
    """Text blocks in page order; hidden elements and those whose content isn't text have none.

    One pass: an end tag is looked for among the open elements only if one of its
    name is open, and closes all it passes, so any nesting takes linear time.
    """
    out: list[Block] = []
    run: list[tuple[str, bool]] = []
    stack: list[tuple[str, _Around]] = []
    opened: dict[str, int] = {}
    links, around = 0, _Around()
    paragraph: tuple[bool, float] | None = None  # (hidden, hint) of an open paragraph, which the next block ends

    def close():
        nonlocal run
        if run:
            text = " ".join("".join(t for t, _ in run).split())
            hidden = around.hidden or paragraph is not None and paragraph[0]
            if text and not hidden:
                words = len(text.split(" "))
                linked = len("".join(t if a else " " for t, a in run).split())
                kind = "p" if paragraph is not None and around.kind == "b" else around.kind
                out.append(Block(text, words, min(words, linked), kind, around.main, around.beside, around.named, paragraph[1] if paragraph else 0.0))
            run = []

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            run.append((html.unescape(page[at:lt]), links > 0))
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if page[lt + 1 : lt + 2].isalpha() or page.startswith("</", lt):  # a tag that the page's end cuts off
                break
            run.append(("<", links > 0))
            at = lt + 1
            continue
        at = m.end()
        closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in BLOCK:
            close()
            if tag != "br":
                paragraph = None
        if tag == "p" and not closing:
            paragraph = (bool(_HIDDEN.search(attributes)), name_hint(_attributes(attributes)[0]))
        if tag == "a":
            links = max(0, links - 1) if closing else 1
        if tag in RAW and not closing:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = n if not end else end.start()
            continue
        if tag in CONTAINER and not (not closing and attributes.rstrip().endswith("/") and tag in ("svg", "iframe")):
            if not closing:
                inner = _inside(around, tag, attributes)
                if inner != around:
                    close()
                stack.append((tag, around))
                opened[tag] = opened.get(tag, 0) + 1
                around = inner
            elif opened.get(tag):
                while True:
                    name, outer = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
                if outer != around:
                    close()
                around = outer
                links = 0 if tag != "span" else links
    close()
    return out


# The tree -----------------------------------------------------------------------------------

FEATURES = (
    "words", "links", "density", "paragraph", "heading", "item", "main", "beside", "named", "own", "clear",
    "words_before", "links_before", "words_after", "links_after", "heading_after",
)


def features(found: list[Block]) -> np.ndarray:
    """One row of FEATURES for each block; a missing neighbour has no words.

    links is the share of words in links, density the words a line of 80 characters,
    clear whether the page has prose outside of what names and tags set beside.
    """
    n = len(found)
    x = np.zeros((n, len(FEATURES)))
    words, links = np.array([b.words for b in found], float), np.array([b.linked / b.words for b in found])
    heading = np.array([b.kind == "h" for b in found], float)
    clear = any(not b.beside and b.named < 0.5 and 2 * b.linked < b.words and (b.kind == "p" or b.main or b.words >= 25) for b in found)
    x[:, 0], x[:, 1] = words, links
    x[:, 2] = [b.words / -(-len(b.text) // 80) for b in found]
    x[:, 3:6] = [[b.kind == "p", b.kind == "h", b.kind == "i"] for b in found] if n else np.zeros((0, 3))
    x[:, 6:10] = [[b.main, b.beside, b.named, b.own] for b in found] if n else np.zeros((0, 4))
    x[:, 10] = clear
    x[1:, 11], x[1:, 12] = words[:-1], links[:-1]
    x[:-1, 13], x[:-1, 14], x[:-1, 15] = words[1:], links[1:], heading[1:]
    return x


#: The labelled table. A paragraph of lines is a page, a line a run of blocks:
#: label (1 main text), kind, marks (m in article or main, s in nav, footer, aside, form, n in a container
#: whose name hints at something else, o itself so named, - none), words, share of words in links, number of blocks.
LABELLED = """
0 i s  1-3 1 4-9 | 0 b n 3-25 0 0-1 | 1 h m 1-14 0 1 | 1 p m 1-250 0-.4 1-12 | 0 b s 3-40 0-.3 1
0 i s  1-3 1 4-9 | 0 b - 3-25 0 0-1 | 1 h m 1-14 0 1 | 1 p m 1-250 0-.3 1-12 | 0 b - 3-40 0-.3 1
0 i -  1-3 1 4-9 | 0 b - 3-25 0 0-1 | 1 h - 1-14 0 1 | 1 p - 1-250 0-.3 1-12 | 0 b - 3-40 0-.3 1
0 b -  1-8 .8-1 1-3 | 0 b - 3-25 0 0-1 | 1 h - 2-14 0 1 | 1 p - 4-250 0-.3 1-9 | 1 h - 1-8 0 1 | 1 p - 1-250 0 1-6 | 0 i - 1-6 1 3-8 | 0 b - 2-30 0-.8 1-2
0 b -  1-4 1 3-6 | 1 b - 30-250 0-.2 2-8 | 0 b - 2-14 0-.6 1
0 b -  1-4 1 0-6 | 1 h - 2-12 0 1 | 1 b - 15-250 0-.2 1-9 | 0 b - 2-14 0-.6 0-1
1 b -  4-400 0 1
1 b -  10-400 0-.1 2-6
1 p -  1-300 0-.2 1-6
1 h m  1-12 0 1 | 1 p m 1-250 0-.2 2-8 | 0 h mn 1-3 0 0-1 | 0 p mn 2-80 0-.2 1-6
1 h -  1-12 0 1 | 1 p - 8-250 0-.2 2-8 | 0 h n 1-3 0 0-1 | 0 b n 1-4 0-1 0-2 | 0 p n 2-80 0-.2 1-6
0 h s  1-6 0 1 | 0 p s 2-60 0-.5 1-4 | 1 h m 1-12 0 1 | 1 p m 1-250 0-.2 2-8 | 0 h s 1-6 0 1 | 0 p s 3-60 0-1 1-3
0 b s  1-12 0-1 1-2 | 1 h - 1-12 0 1 | 1 p - 1-250 0-.2 1-8 | 0 b s 1-6 0 1-5 | 0 p s 3-60 0-.4 0-2
0 b n  1-12 0-1 1-2 | 0 i n 1-6 0-1 2-8 | 1 h - 1-12 0 1 | 1 p - 1-250 0-.2 1-8 | 0 p n 3-60 0-.4 1-3
1 h m  1-12 0 1 | 1 p m 1-250 0-.3 1-4 | 1 i m 1-50 0-.4 2-8 | 1 p m 1-250 0 0-4
1 h -  1-12 0 1 | 1 p - 5-250 0-.2 1-4 | 1 i - 3-50 0-.3 2-8 | 1 p - 5-250 0 0-4
1 p m  10-200 0-.2 1-4 | 0 i m 1-8 .9-1 2-8 | 1 p m 10-200 0 0-3
1 p m  1-200 0-.2 1-4 | 0 p mo 2-30 0-.5 1 | 1 p m 1-200 0 1-4
1 p m  20-200 0-.2 1-4 | 1 p mo 45-250 0-.1 1 | 1 p m 20-200 0 1-4
1 p -  20-200 0-.2 1-4 | 0 p o 2-30 0-.5 1 | 1 p - 20-200 0 1-4
1 p m  1-200 0-.2 1-4 | 0 b mn 1-30 0-.8 1 | 1 p m 1-200 0 1-4
1 p -  10-200 0-.2 1-4 | 0 b n 1-30 0-.8 1 | 1 p - 10-200 0 1-4
1 p m  1-200 0-.2 1-4 | 0 b ms 1-30 0-.8 1-3 | 0 p ms 2-60 0-.5 0-2 | 1 p m 1-200 0 0-4
0 i -  1-4 1 2-6 | 1 h n 1-12 0 1 | 1 p n 5-250 0-.2 2-9
0 i s  1-4 1 2-6 | 1 p n 12-250 0-.2 3-9 | 0 b s 2-20 0-.5 1
1 h m  1-12 0 1 | 1 b m 1-8 0 4-20 | 1 p m 5-200 0 0-3
0 b -  1-4 1 0-4 | 1 b m 2-250 0-.2 1-8 | 0 b s 2-20 0-.5 1
1 h m  1-9 0 1 | 1 p m 1-120 0-.3 1-3 | 1 h m 1-9 0 1 | 1 p m 1-120 0-.3 1-3 | 1 h m 1-9 0 1
0 h -  2-12 1 1-5 | 0 p - 1-4 .9-1 2-5 | 1 h - 1-12 0 1 | 1 p - 6-250 0-.2 1-6
"""


def labelled_pages(draws: int = 60, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """Pages drawn from LABELLED: blocks with counts from the ranges (logarithmic for words), and their labels."""
    rng = np.random.default_rng(seed)

    def draw(span: str, log: bool = False) -> float:
        low, _, high = span.partition("-")
        a, b = float(low), float(high or low)
        return float(np.exp(rng.uniform(np.log(a), np.log(b + 0.999)))) if log else float(rng.uniform(a, b))

    out = []
    for line in LABELLED.strip().split("\n"):
        for _ in range(draws):
            page, y = [], []
            for run in line.split("|"):
                label, kind, marks, words, share, times = run.split()
                low, _, high = times.partition("-")
                for _ in range(int(rng.integers(int(low), int(high or low) + 1))):
                    n = int(draw(words, log=True))
                    text = "x" * max(1, round(n * rng.uniform(4.5, 7)))
                    hint = float(rng.choice([0.5, 1.0]))
                    page.append(Block(text, n, round(n * draw(share)), kind, "m" in marks, "s" in marks, hint * ("n" in marks), hint * ("o" in marks)))
                    y.append(int(label))
            out.append((page, y))
    return out


def labelled_sample(draws: int = 60, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    pages = [p for p in labelled_pages(draws, seed) if p[0]]
    return np.concatenate([features(b) for b, _ in pages]), np.concatenate([y for _, y in pages]).astype(int)


class DecisionTree:
    """Binary tree of threshold tests, grown greedily on Gini impurity; ties take the first feature."""

    def __init__(self, depth: int = 12, least: int = 8):
        self.depth, self.least = depth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> DecisionTree:
        self.root = self._grow(x, y.astype(float), self.depth)
        return self

    def _grow(self, x, y, depth):
        n, share = len(y), y.mean()
        if depth == 0 or share in (0, 1) or n < 2 * self.least:
            return bool(share >= 0.5)
        best = None
        low = np.arange(1, n)
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, hits = x[order, f], np.cumsum(y[order])[:-1]
            p, q = hits / low, (hits[-1] + y[order[-1]] - hits) / (n - low)
            g = low * p * (1 - p) + (n - low) * q * (1 - q)
            g[(v[1:] == v[:-1]) | (low < self.least) | (n - low < self.least)] = np.inf
            k = int(np.argmin(g))
            if g[k] < np.inf and (best is None or g[k] < best[0] - 1e-9):
                best = (float(g[k]), f, float((v[k] + v[k + 1]) / 2))
        if best is None or best[0] > n * share * (1 - share) - 1e-9:
            return bool(share >= 0.5)
        _, f, cut = best
        left = x[:, f] < cut
        return f, cut, self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1)

    def predict_one(self, row) -> bool:
        node = self.root
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] < node[1] else node[3]
        return bool(node)


@functools.lru_cache(1)
def default_tree() -> DecisionTree:
    return DecisionTree().fit(*labelled_sample())


def main_text(page: str | None, tree: DecisionTree | None = None) -> str:
    """Main text of a page: its blocks that the tree takes, in order, joined by one space."""
    tree = tree or default_tree()
    found = blocks(page or "")
    return " ".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if tree.predict_one(row))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without ``html_col``, with text and n_chars (code points).

    The tree is grown once, on the driver, from the labelled table. What it knows
    of a block are its words, link and text density, those of its neighbours, its
    kind of element, whether it stands in an element made for the article or for
    something else, and a hint from names. A null or empty page has the text ''.
    Tags and references that the page's end cuts off are dropped or kept as they
    stand. Nulls in other columns and repeated rows pass; former columns text and
    n_chars are replaced.
    """
    tree = default_tree()

    def run(batches):
        for b in batches:
            texts = [main_text(t.as_py(), tree) for t in b.column(b.schema.get_field_index(html_col))]
            b = b.drop_columns([html_col])
            yield b.append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    pages = pages.drop("text", "n_chars")
    return pages.mapInArrow(run, with_fields(pages.drop(html_col), text="string", n_chars="long"))
