"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut at block tags into flat blocks of text.  A block is described by numbers: its words and link
density, those of the block before and after it, the larger word count and the lesser link density of these two, where it stands (inside an article or main element, outside of the page's
article, or on a page without one), the largest share of no-content words in a class, id or role around it, and whether it is in
an element for no content (navigation, footer, aside, form), a heading or a list item.  A decision tree grown (Gini) from the labelled
table below says which blocks are main text; they are joined in page order by one newline.  No name of a class decides
alone: names that merely contain a listed word are outweighed by prose among prose, and menus and reader comments under other names
are told by the link density of their neighbours.

Script, style, template and the like never give text; comments and markup go; character references are
decoded as browsers do; white space inside a block becomes one space.

Defined cases: null, empty and text-free pages give an empty text; unclosed, stray and truncated
tags are tolerated; repeated rows give repeated rows; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "words_around", "density_around", "place", "named", "no_content", "heading", "item")

#: Labelled blocks (main text or not), as `label: words density, before, after, place named flags`.  Place: + inside an article or
#: main element, - outside of the page's, . on a page without one; named: share of no-content words in a name around it; flags: e = in an
#: element for no content, h = heading, i = list item.
LABELLED = """
1: 60 0.00, 12 0.00, 70 0.00, + 0.0
1: 12 0.00, 60 0.00, 80 0.05, + 0.0
1: 1 0.00, 40 0.00, 60 0.00, + 0.0
1: 2 0.00, 0 0.00, 55 0.00, + 0.0
1: 3 0.00, 1 0.00, 2 0.00, + 0.0
1: 1 0.00, 9 0.00, 8 0.00, + 0.0
1: 24 0.00, 1 0.00, 1 0.00, + 0.0
1: 5 0.00, 0 0.00, 0 0.00, + 0.0
1: 6 0.00, 1 1.00, 9 0.00, + 0.0
1: 6 0.00, 55 0.00, 2 1.00, + 0.0
1: 300 0.00, 0 0.00, 0 0.00, + 0.0
1: 90 0.02, 9 0.00, 12 0.00, + 0.0
1: 30 0.40, 40 0.00, 60 0.10, + 0.0
1: 45 0.00, 4 1.00, 60 0.00, + 0.0
1: 50 0.00, 60 0.00, 3 1.00, + 0.0
1: 70 0.00, 2 1.00, 3 1.00, + 0.0
1: 110 0.02, 3 1.00, 2 1.00, + 0.0
1: 9 0.00, 4 1.00, 50 0.00, + 0.0 h
1: 8 0.00, 12 0.00, 12 0.00, + 0.0 h
1: 5 0.00, 5 1.00, 1 0.00, + 0.0 h
1: 2 0.00, 0 0.00, 3 0.00, + 0.0 h
1: 9 1.00, 4 0.00, 60 0.00, + 0.0 h
1: 6 0.00, 3 1.00, 2 1.00, + 0.0 h
1: 3 0.00, 2 1.00, 3 1.00, + 0.0 h
1: 10 0.00, 1 1.00, 2 1.00, + 0.0 h
1: 4 0.00, 0 0.00, 3 0.00, + 0.0
1: 12 0.00, 3 0.00, 4 0.00, + 0.0
1: 8 0.00, 5 0.00, 0 0.00, + 0.0
1: 3 0.00, 6 0.00, 2 0.00, + 0.0
1: 20 0.00, 4 0.00, 3 0.00, + 0.0
1: 1 0.00, 1 0.00, 1 0.00, + 0.0
1: 2 0.00, 4 0.00, 1 1.00, + 0.0
1: 7 0.00, 30 0.00, 5 0.00, + 0.0
1: 7 0.00, 6 1.00, 5 0.00, + 0.0 i
1: 4 0.50, 4 0.50, 4 0.50, + 0.0 i
1: 15 0.10, 20 0.00, 12 0.20, + 0.0 i
0: 2 1.00, 50 0.00, 60 0.00, + 0.0
0: 2 1.00, 9 0.00, 45 0.00, + 0.0
0: 4 1.00, 60 0.00, 20 0.00, + 0.0
0: 8 0.90, 60 0.00, 30 0.00, + 0.0
0: 2 1.00, 20 0.00, 18 0.00, + 0.0
0: 2 1.00, 1 1.00, 14 0.00, + 0.0
0: 1 1.00, 18 0.00, 2 1.00, + 0.0
0: 18 0.00, 2 1.00, 1 1.00, + 0.0
0: 9 0.00, 2 1.00, 1 1.00, + 0.0
0: 30 0.00, 3 1.00, 1 1.00, + 0.0
0: 25 0.05, 2 1.00, 2 1.00, + 0.0
0: 5 0.00, 2 1.00, 1 1.00, + 0.0
0: 40 0.00, 2 1.00, 1 1.00, + 0.0
0: 3 0.00, 4 1.00, 2 1.00, + 0.0
0: 3 1.00, 60 0.00, 3 1.00, + 0.0 i
0: 3 1.00, 3 1.00, 3 1.00, + 0.0 i
0: 14 0.00, 2 1.00, 1 1.00, + 0.0 i
1: 60 0.00, 12 0.00, 70 0.00, + 0.5
1: 25 0.00, 60 0.00, 40 0.00, + 0.5
1: 40 0.10, 9 0.00, 60 0.00, + 0.5
1: 5 0.00, 60 0.00, 40 0.00, + 0.5 h
0: 12 0.00, 60 0.00, 50 0.00, + 0.5
0: 4 0.00, 50 0.00, 3 1.00, + 0.5
0: 12 0.00, 3 1.00, 2 1.00, + 0.5
0: 3 1.00, 60 0.00, 4 1.00, + 0.5
0: 45 0.05, 8 0.00, 40 0.00, + 1.0
0: 12 0.00, 60 0.00, 50 0.00, + 1.0
0: 20 0.00, 3 0.00, 20 0.00, + 1.0
0: 80 0.00, 70 0.00, 90 0.00, + 1.0
0: 2 0.00, 60 0.00, 60 0.00, + 1.0
0: 3 0.00, 60 0.00, 25 0.00, + 1.0 h
0: 25 0.00, 3 0.00, 25 0.00, + 0.0 e
0: 60 0.00, 70 0.00, 20 0.00, + 0.0 e
0: 8 0.00, 70 0.00, 6 0.00, + 0.0 e
0: 4 0.00, 60 0.00, 30 0.00, + 0.0 eh
0: 3 1.00, 60 0.00, 3 1.00, + 0.0 ei
0: 12 0.00, 4 1.00, 8 0.00, - 1.0
0: 9 0.00, 1 1.00, 60 0.00, - 1.0
0: 6 0.00, 80 0.00, 0 0.00, - 0.0 e
0: 70 0.00, 60 0.00, 50 0.00, - 0.0
0: 120 0.00, 90 0.00, 3 0.00, - 0.0
0: 9 0.00, 90 0.00, 12 0.00, - 0.0
0: 2 1.00, 2 1.00, 2 1.00, - 0.0 ei
0: 1 1.00, 0 0.00, 1 1.00, - 0.0 ei
0: 3 1.00, 3 1.00, 40 0.00, - 0.0 ei
0: 14 0.00, 0 0.00, 5 0.00, - 0.5
0: 4 0.00, 12 0.00, 9 0.00, - 0.0 h
0: 30 0.00, 3 0.00, 30 0.00, - 0.0 i
0: 200 0.00, 0 0.00, 0 0.00, - 0.0 e
1: 60 0.00, 55 0.00, 70 0.00, . 0.0
1: 40 0.05, 5 0.00, 60 0.00, . 0.0
1: 18 0.00, 60 0.00, 60 0.00, . 0.0
1: 9 0.00, 45 0.00, 60 0.00, . 0.0
1: 120 0.00, 3 1.00, 4 1.00, . 0.0
1: 35 0.10, 0 0.00, 20 0.00, . 0.0
1: 22 0.00, 7 0.00, 2 1.00, . 0.0
1: 200 0.01, 0 0.00, 0 0.00, . 0.0
1: 48 0.00, 50 0.00, 1 1.00, . 0.0
1: 60 0.00, 60 0.00, 0 0.00, . 0.0
1: 30 0.00, 60 0.00, 3 1.00, . 0.0
1: 27 0.00, 27 0.00, 4 0.00, . 0.0
1: 36 0.00, 25 0.00, 5 0.00, . 0.0
1: 26 0.00, 60 0.00, 8 0.00, . 0.0
1: 45 0.00, 0 0.00, 1 0.00, . 0.0
1: 7 0.00, 3 1.00, 60 0.00, . 0.0 h
1: 6 0.00, 50 0.00, 50 0.00, . 0.0 h
1: 5 0.00, 2 1.00, 30 0.00, . 0.0 h
1: 25 0.00, 25 0.00, 25 0.00, . 0.0 i
1: 12 0.00, 30 0.00, 12 0.00, . 0.0 i
1: 60 0.00, 50 0.00, 55 0.00, . 0.5
0: 2 1.00, 2 1.00, 2 1.00, . 0.0 i
0: 1 1.00, 1 1.00, 40 0.00, . 0.0 i
0: 3 1.00, 0 0.00, 3 1.00, . 0.0
0: 5 0.80, 3 1.00, 60 0.00, . 0.0
0: 10 0.90, 60 0.00, 10 0.90, . 0.0
0: 30 0.80, 30 0.80, 5 1.00, . 0.0
0: 18 0.00, 2 1.00, 1 1.00, . 0.0
0: 4 0.00, 2 1.00, 2 1.00, . 0.0
0: 3 0.00, 3 1.00, 0 0.00, . 0.0
0: 5 0.00, 1 0.00, 0 0.00, . 0.0
0: 2 0.00, 3 0.00, 2 0.00, . 0.0
0: 6 0.50, 4 1.00, 0 0.00, . 0.0
0: 3 0.00, 2 1.00, 2 1.00, . 0.0 h
0: 2 0.00, 4 0.00, 3 1.00, . 0.0 h
0: 8 0.60, 8 0.60, 8 0.60, . 0.0 i
0: 4 0.00, 3 0.00, 4 0.00, . 0.0 i
0: 12 0.00, 60 0.00, 60 0.00, . 1.0
0: 40 0.00, 60 0.00, 5 0.00, . 1.0
0: 14 0.00, 5 1.00, 9 0.00, . 1.0
0: 12 0.00, 50 0.00, 3 1.00, . 0.5
0: 25 0.00, 30 0.00, 25 0.00, . 0.0 e
0: 60 0.00, 50 0.00, 60 0.00, . 0.0 e
0: 8 0.00, 60 0.00, 40 0.00, . 0.0 eh
"""

#: Factors by which word counts of the labelled rows are stretched.
STRETCH = (1.0, 0.75, 1.5)

#: Elements whose text never shows.
HIDDEN = {"script", "style", "template", "noscript", "svg", "math", "iframe", "object", "head", "title", "textarea", "select", "option", "datalist", "canvas", "audio", "video"}
RAW = {"script", "style", "textarea", "title", "iframe", "noscript", "template"}
#: Elements that end a text block.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul button".split())
CONTAINER = BLOCK - {"p", "hr", "h1", "h2", "h3", "h4", "h5", "h6"}
NO_CONTENT = {"nav", "footer", "aside", "form", "menu", "dialog", "button"}
#: Words of class, id or role that hint at no content.
MARKS = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promoted promotion sidebar aside rail nav navbar navigation menu breadcrumb breadcrumbs "
    "footer masthead topbar toolbar comment comments commentlist commenter reply replies respond disqus discussion talkback feedback cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup "
    "related recommended recommendations share sharing social widget widgets popup modal overlay login register search pagination pager pages legal copyright disclaimer complementary contentinfo skip".split()
)
#: Words of a name that say where or how, not what; they do not count beside those that do.
PLACES = set(
    "container wrapper wrap inner outer box body text bar item items list block area section panel content holder slot unit zone group row col column cell card entry post posts "
    "user users reader site page main left right top bottom small large mini inline new latest all area link links button title heading hd bd ft js id".split()
)
#: Together: what readers wrote.
READERS, WRITINGS = {"user", "users", "reader", "readers", "customer", "customers", "visitor", "visitors", "guest", "member"}, {"review", "reviews", "rating", "ratings", "opinion", "opinions", "post", "posts", "message", "messages"}
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


def _named(attributes: str) -> tuple[float, bool, bool]:
    """(share of no-content words in the name that has most of them, hidden, called a header)."""
    named, hidden, header = 0.0, False, False
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value, name = a or b or c, name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name in ("class", "id", "role"):
            for one in value.split():
                words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", one).lower()) if w]
                telling = [w for w in words if w in MARKS or w not in PLACES and not w.isdigit()]
                if telling:
                    named = max(named, sum(w in MARKS for w in telling) / len(telling))
                    header |= "header" in words
                if READERS.intersection(words) and WRITINGS.intersection(words):
                    named = 1.0
    return named, hidden, header


def blocks(page: str | None) -> list[tuple[str, int, int, bool, float, bool, bool, bool]]:
    """Flat blocks ``(text, words, linked words, in article, named, no content, heading, item)`` in page order."""
    page = (page or "").replace("\0", "�")
    out: list[tuple] = []
    parts: list[tuple[str, bool]] = []
    # open containers: element, hidden, article, named, no content
    open_: list[tuple[str, bool, bool, float, bool]] = [("", False, False, 0.0, False)]
    depth: dict[str, int] = {}
    link = False
    heading = ""

    def flush() -> None:
        nonlocal parts
        if not parts:
            return
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(html.unescape(p).split()) for p, a in parts if a)
            _, _, article, named, empty = open_[-1]
            words = len(text.split())
            out.append((text, words, min(words, linked), article, named, empty, bool(heading), depth.get("li", 0) > 0))
        parts = []

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not open_[-1][1]:
            parts.append((page[at:stop], link))
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name == "br":
            parts.append((" ", link))
            continue
        if name == "a":
            link = not closing
            continue
        if name in BLOCK:
            flush()
            link = link and closing is False and name not in CONTAINER
            heading = name if name in ("h1", "h2", "h3", "h4", "h5", "h6") and not closing else "" if closing and heading == name or name in CONTAINER else heading
        if name in VOID or name not in CONTAINER and name not in HIDDEN:
            continue
        if closing:
            if depth.get(name):
                while True:
                    gone = open_.pop()[0]
                    depth[gone] -= 1
                    if gone == name:
                        break
            continue
        if name == "body":
            open_, depth = open_[:1], {}  # an unclosed head ends here
        if name in ("svg", "math") and attributes.endswith("/"):
            continue  # empty, and without an end tag
        if name in RAW and not attributes.endswith("/"):
            close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if name == "li":
            while open_[-1][0] == "li":  # a list item ends the one before it
                depth["li"] -= 1
                open_.pop()
        _, hidden, article, named, empty = open_[-1]
        inside = article or name in ("article", "main")
        own, unseen, header = _named(attributes) if attributes.strip(" /") else (0.0, False, False)
        own = own if name not in ("html", "body", "article", "main") else 0.0
        empty = empty or unseen or name in NO_CONTENT or not inside and (header or name == "header")
        open_.append((name, hidden or name in HIDDEN, inside, max(named, own), empty))
        depth[name] = depth.get(name, 0) + 1
    flush()
    return out


def _around(x: np.ndarray) -> np.ndarray:
    x[:, 6], x[:, 7] = np.maximum(x[:, 2], x[:, 4]), np.minimum(x[:, 3], x[:, 5])
    return x


def describe(found: list[tuple]) -> np.ndarray:
    """Rows of ``FEATURES``, one for each block."""
    x = np.zeros((len(found), len(FEATURES)))
    has_article = any(b[3] for b in found)
    for i, (_, words, linked, article, named, empty, heading, item) in enumerate(found):
        x[i] = words, linked / words, 0, 0, 0, 0, 0, 0, (1 if article else -1) if has_article else 0, named, empty, heading, item
    x[1:, 2:4] = x[:-1, :2]
    x[:-1, 4:6] = x[1:, :2]
    return _around(x)


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """The labelled table as features and labels."""
    x, y = [], []
    for line in LABELLED.strip().splitlines():
        label, rest = line.split(":")
        own, before, after, (place, named, *flags) = (p.split() for p in rest.split(","))
        x.append([*map(float, own + before + after), 0, 0, "-.+".index(place) - 1, float(named), *(float(f in "".join(flags)) for f in "ehi")])
        y.append(int(label))
    # each row stands for shorter and longer blocks of its kind, too
    return _around(np.concatenate([np.array(x) * np.array([s, 1, s, 1, s, 1, *[1] * (len(FEATURES) - 6)]) for s in STRETCH])), np.tile(y, len(STRETCH))


def grow(x: np.ndarray, y: np.ndarray, depth: int = 10) -> tuple | int:
    """A decision tree: a label, or (feature, threshold, tree up to it, tree above it)."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return int(y.sum() * 2 >= len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= t
            score = sum(m.sum() * (lambda p: p * (1 - p))(y[m].mean()) for m in (left, ~left))
            if best is None or score < best[0] - 1e-12:
                best = (score, f, t, left)
    if best is None:
        return int(y.sum() * 2 >= len(y))
    _, f, t, left = best
    return f, float(t), grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def decide(tree: tuple | int, row: np.ndarray) -> bool:
    while not isinstance(tree, int):
        f, t, low, high = tree
        tree = low if row[f] <= t else high
    return bool(tree)


def main_text(page: str | None, tree: tuple | int) -> str:
    """The main text of one page."""
    found = blocks(page)
    return "\n".join(b[0] for b, row in zip(found, describe(found), strict=True) if decide(tree, row))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Rows ``(page_id, url, text, n_chars)`` for every row of ``pages``."""
    tree = grow(*labelled())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                texts = [main_text(h.as_py(), tree) for h in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    d = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("h"))
    return d.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
