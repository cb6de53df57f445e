"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is read tag by tag into blocks, the text between block-level tags. A block's features are its word
count and link density, those of the blocks before and after, and where it stands: inside an article, inside
page furniture (by element, or by a class or id that is made of furniture words and fillers only), or in a
heading. The tree is grown on the small labelled table below, once for each process.

Character references are decoded outside markup; white space inside a block becomes one space; kept
blocks are joined in page order by two newlines. Comments, scripts, styles, forms' controls and everything
else without reader's text make no blocks. Bad markup costs no text: an element that takes its content out
(a script, a button, an object, page furniture, a link) does so only if it has an end tag of its own; else it
hides what stands before the next tag at most, as an option without end tag does. An attribute value whose
quote is never closed, or a comment without end, goes to the next ">"; a "<" that opens no tag is text.
Reading is linear in the size of a page, whatever its markup, so pages of any length are read whole. A null or
empty page has an empty text; repeated rows are read alike; an empty table gives an empty result. Only
page_id, url and html are read, so other columns can't clash.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from evencut.llm.common import lean, slices

NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
VALUE = re.compile(r"=\s*([\"'])|>")
ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
# Elements by what they do to text.
RAW = set("script style title textarea iframe xmp noembed noframes".split())  # no markup inside
MUTE = set("noscript template svg math object select datalist optgroup option button canvas video audio".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
BOXES = set("article aside blockquote details dialog div dl fieldset figure footer form header main menu nav ol section table td ul".split())
FURNITURE = set("nav footer aside form menu dialog".split())
HEADS = set("h1 h2 h3 h4 h5 h6".split())
# Words of class and id names. A name is furniture if it has one of these and else only fillers: "share-buttons", not "social-history".
BAD = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login nav navbar "
    "navigation menu breadcrumb breadcrumbs sidebar widget widgets related recommended share sharing social comment comments reply replies respond disqus footer header copyright masthead toolbar pagination pager search".split()
)
FILLERS = set("box bar block list wrap wrapper container area section link links site page main top bottom left right global inner outer unit slot item items button buttons panel content posts articles form icons text title".split())
GOOD = {"article", "article-body", "articlebody", "story", "post-body", "post-content", "entry-content", "main-content", "page-content", "content", "body-text"}


def tags(page: str):
    """(start, end, name, attributes, closes) of each piece of markup; name is "" for comments and declarations."""
    last, plain, at, no_comment_end = page.rfind(">"), False, 0, False
    while (at := page.find("<", at)) >= 0 and at < last:
        if page.startswith("<!--", at) and not no_comment_end:
            end = page.find("-->", at + 4)
            if end >= 0:
                yield at, end + 3, "", "", False
                at = end + 3
                continue
            no_comment_end = True
        if page[at + 1] in "!?":
            end = page.find(">", at) + 1
            yield at, end, "", "", False
            at = end
            continue
        m = NAME.match(page, at)
        if not m:
            at += 1
            continue
        pos, end = m.end(), -1
        while not plain and end < 0:
            stop = VALUE.search(page, pos)
            if stop and not stop[1]:
                end = stop.start()
            else:
                close = page.find(stop[1], stop.end()) if stop else -1
                if close < 0:
                    plain = True  # from here on, quotes mean nothing
                pos = close + 1
        if end < 0:
            end = page.find(">", m.end())
        yield at, end + 1, m[1].translate(ASCII_LOWER), page[m.end() : end], page[at + 1] == "/"
        at = end + 1


def pieces(page: str) -> list[tuple[str, str, str]]:
    """(kind, name or text, attributes) in page order; kinds are text, start and end. The content of RAW elements is left out."""
    out, at, skip, low, endless = [], 0, 0, None, set()
    for start, end, name, attrs, closes in tags(page):
        if start < skip:
            at = max(at, min(end, skip))
            continue
        if start > at:
            out.append(("text", page[at:start], ""))
        at = end
        if not name:
            continue
        out.append(("end" if closes else "start", name, attrs))
        if name in RAW and not closes and name not in endless and not attrs.endswith("/"):
            low = page.translate(ASCII_LOWER) if low is None else low
            to = low.find(f"</{name}", end)
            if to < 0:
                endless.add(name)
            else:
                at = skip = to
    if at < len(page):
        out.append(("text", page[at:], ""))
    return out


def closed(found: list[tuple[str, str, str]]) -> dict[int, int]:
    """The end tag of each element that has one of its own; the end of a box ends what is open inside."""
    out, stack, open_ = {}, [], Counter()
    for k, (kind, name, attrs) in enumerate(found):
        if kind == "text" or name not in BOXES and name not in MUTE and name not in RAW and name != "a":
            continue
        if kind == "start":
            if not attrs.endswith("/"):
                stack.append((name, k))
                open_[name] += 1
        elif open_[name]:
            while True:
                other, i = stack.pop()
                open_[other] -= 1
                if other == name:
                    out[i] = k
                    break
    return out


def furniture(name: str) -> bool:
    words = [w for w in re.split(r"[-_\d]+", name) if w]
    return any(w in BAD for w in words) and all(w in BAD or w in FILLERS for w in words)


def _kind(tag: str, attrs: str, inside: bool) -> int:
    """1: article; -1: page furniture; 0: neither."""
    if tag in FURNITURE or tag == "header" and not inside:
        return -1
    if attrs:
        of = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTR.finditer(attrs)}
        if "hidden" in of or re.search(r"display\s*:\s*none", of.get("style", ""), re.I):
            return -1
        names = " ".join(of.get(k, "") for k in ("class", "id", "role")).lower().split()
        if any(map(furniture, names)):
            return -1
        if tag not in ("article", "main") and any(n in GOOD for n in names):
            return 1
    return int(tag in ("article", "main"))


def blocks(page: str | None) -> list[tuple[str, int, float, int, int, int]]:
    """(text, words, link density, in article, in furniture, is heading) of each block in page order."""
    out: list = []
    if not page:
        return out
    parts: list[str] = []
    linked = head = good = bad = link = 0
    found = pieces(page)
    ends = closed(found)
    until = {}  # the end tag at which a box's place ends
    k, hush = 0, False

    def close() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            n = len(text.split())
            out.append((text, n, min(1.0, linked / n), int(good > 0), int(bad > 0), head))
        linked = 0

    while k < len(found):
        kind, name, attrs = found[k]
        if kind == "text":
            if not hush:
                text = html.unescape(name)
                parts.append(text)
                linked += len(text.split()) if link else 0
        elif kind == "end":
            if name == "a":
                link = 0
            elif name in BLOCK:
                close()
                head = 0 if name in HEADS else head
                for x in until.pop(k, ()):
                    good -= x > 0
                    bad -= x < 0
        elif name in RAW or name in MUTE:
            if name in MUTE and k in ends:
                k = ends[k]
        elif name == "br":
            parts.append(" ")
        elif name == "a":
            link = int(k in ends)
        elif name in BLOCK:
            close()
            head = int(name in HEADS)
            if name in BOXES and not attrs.endswith("/"):
                x = _kind(name, attrs, good > 0)
                if x and (x > 0 or k in ends):
                    good += x > 0
                    bad += x < 0
                    if k in ends:
                        until.setdefault(ends[k], []).append(x)
        # text behind a start tag that takes its content out and has no end tag goes up to the next tag
        hush = kind == "start" and k not in ends and (name in RAW or name in MUTE) and not attrs.endswith("/")
        k += 1
    close()
    return out


FEATURES = ("words before", "words", "words after", "links before", "links", "links after", "in article", "in furniture", "heading", "page has article")
# The labelled table: word counts and link densities of a block and its neighbours, place, and 1 for main text.
LABELLED = (
    # menus and link lists
    (0, 1, 1, 0, 1, 1, 0, 1, 0, 1, 0), (1, 1, 1, 1, 1, 1, 0, 1, 0, 1, 0), (1, 2, 9, 1, 1, 0, 0, 1, 0, 1, 0), (2, 3, 2, 1, 1, 1, 0, 0, 0, 0, 0),
    (4, 5, 6, 1, 0.9, 1, 0, 0, 0, 0, 0), (30, 4, 5, 0, 1, 1, 0, 0, 0, 0, 0), (5, 6, 40, 1, 0.8, 0, 0, 0, 0, 1, 0), (12, 7, 3, 0.1, 1, 1, 0, 0, 0, 1, 0),
    # links inside an article: in furniture they go, in prose they stay
    (60, 5, 6, 0, 1, 1, 1, 1, 0, 1, 0), (50, 8, 4, 0, 0.9, 0.9, 1, 1, 0, 1, 0), (50, 40, 60, 0, 0.2, 0, 1, 0, 0, 1, 1), (20, 12, 30, 0, 0.6, 0, 1, 0, 0, 1, 1),
    (8, 6, 9, 0, 1, 0, 1, 0, 0, 1, 1), (30, 3, 40, 0, 1, 0, 1, 0, 0, 1, 1),
    # adverts, notices, side bars, footers, comments
    (1, 9, 11, 1, 0, 0, 0, 1, 0, 1, 0), (1, 14, 11, 1, 0, 0, 0, 1, 0, 1, 0), (60, 16, 0, 0, 0, 0, 0, 1, 0, 1, 0), (25, 34, 0, 0, 0, 0, 0, 1, 0, 1, 0),
    (3, 80, 60, 0, 0.05, 0, 0, 1, 0, 1, 0), (80, 45, 50, 0, 0, 0, 0, 1, 0, 0, 0), (40, 30, 25, 0, 0, 0, 1, 1, 0, 1, 0), (70, 120, 0, 0, 0, 0, 0, 1, 0, 0, 0),
    (90, 12, 15, 0, 0.1, 0, 1, 1, 0, 1, 0), (11, 60, 80, 0, 0, 0, 1, 1, 0, 1, 0), (2, 2, 50, 0, 0, 0, 0, 1, 1, 1, 0), (50, 3, 30, 0, 0, 0, 1, 1, 1, 1, 0),
    # outside the article of a page that has one
    (10, 40, 60, 0, 0, 0, 0, 0, 0, 1, 0), (60, 25, 0, 0, 0, 0, 0, 0, 0, 1, 0), (80, 90, 10, 0, 0, 0, 0, 0, 0, 1, 0), (0, 8, 30, 0, 0, 0, 0, 0, 1, 1, 0),
    # article text, long and short
    (9, 11, 70, 0, 0, 0, 1, 0, 1, 1, 1), (11, 70, 80, 0, 0, 0, 1, 0, 0, 1, 1), (70, 90, 3, 0, 0, 0, 1, 0, 0, 1, 1), (90, 1, 120, 0, 0, 0, 1, 0, 0, 1, 1),
    (1, 120, 2, 0, 0, 0, 1, 0, 0, 1, 1), (120, 2, 16, 0, 0, 0, 1, 0, 0, 1, 1), (12, 1, 14, 0, 0, 0, 1, 0, 0, 1, 1), (10, 300, 20, 0, 0, 0, 1, 0, 0, 1, 1),
    (1, 4, 60, 1, 0, 0, 1, 0, 1, 1, 1), (15, 9, 12, 0, 0, 0, 1, 0, 0, 1, 1), (40, 3, 50, 0, 0, 0, 1, 0, 1, 1, 1), (3, 2, 2, 0, 0, 0, 1, 0, 0, 1, 1),
    # pages without an article: long prose, and short prose beside it
    (2, 40, 60, 0, 0, 0, 0, 0, 0, 0, 1), (40, 60, 30, 0, 0.1, 0, 0, 0, 0, 0, 1), (60, 25, 2, 0, 0, 1, 0, 0, 0, 0, 1), (60, 7, 45, 0, 0, 0, 0, 0, 0, 0, 1),
    (35, 4, 50, 0, 0, 0, 0, 0, 1, 0, 1), (1, 8, 45, 1, 0, 0, 0, 0, 1, 0, 1), (3, 18, 22, 0, 0, 0, 0, 0, 0, 0, 1), (50, 12, 3, 0, 0, 0, 0, 0, 0, 0, 1),
    (0, 80, 0, 0, 0, 0, 0, 0, 0, 0, 1), (3, 60, 2, 1, 0, 1, 0, 0, 0, 0, 1), (6, 30, 3, 0, 0, 1, 0, 0, 0, 0, 1), (10, 45, 4, 0, 0.1, 0, 0, 0, 0, 0, 1),
    (60, 9, 70, 0, 1, 0, 0, 0, 0, 0, 0), (45, 12, 5, 0, 0.9, 1, 0, 0, 0, 0, 0), (50, 25, 60, 0, 0.95, 0, 0, 0, 0, 0, 0), (5, 30, 4, 1, 0.9, 1, 0, 0, 0, 0, 0),
    # lists of nothing but links inside an article
    (80, 8, 7, 0, 1, 1, 1, 0, 0, 1, 0), (8, 7, 9, 1, 1, 1, 1, 0, 0, 1, 0), (7, 9, 0, 1, 1, 0, 1, 0, 0, 1, 0), (9, 6, 5, 1, 1, 1, 1, 0, 0, 1, 0),
    (2, 4, 3, 1, 0, 1, 0, 0, 0, 0, 0), (1, 3, 1, 1, 0, 1, 0, 0, 0, 0, 0), (3, 6, 0, 1, 0, 0, 0, 0, 0, 0, 0), (4, 5, 4, 0, 0, 1, 0, 0, 0, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A tree of (feature, threshold, low side, high side) and leaves 0 or 1, by Gini impurity."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return int(share >= 0.5)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= t
            a, b = y[low], y[~low]
            gini = len(a) * a.mean() * (1 - a.mean()) + len(b) * b.mean() * (1 - b.mean())
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(t), low)
    if best is None:
        return int(share >= 0.5)
    _, f, t, low = best
    return (f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


@lru_cache(maxsize=1)
def tree():
    rows = np.array(LABELLED, dtype=float)
    return grow(rows[:, :-1], rows[:, -1])


def is_main(row, node=None) -> bool:
    node = tree() if node is None else node
    while not isinstance(node, int):
        f, t, low, high = node
        node = low if row[f] <= t else high
    return bool(node)


def main_text(page: str | None) -> str:
    found = blocks(page)
    has = int(any(b[3] for b in found))
    none = ("", 0, 0.0, 0, 0, 0)
    kept = []
    for k, b in enumerate(found):
        a, c = found[k - 1] if k else none, found[k + 1] if k + 1 < len(found) else none
        if is_main((a[1], b[1], c[1], a[2], b[2], c[2], b[3], b[4], b[5], has)):
            kept.append(b[0])
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages."""
    p = pages.select("page_id", "url", "html")
    kinds = {f.name: f.dataType.simpleString() for f in p.schema}

    def run(batches):
        for b in slices(batches, 1000):
            text = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return p.mapInArrow(lean(run), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
