"""Operator 10: main text of web pages, from flat text blocks and a decision tree.

A page is cut into a flat list of text blocks at block-level tags.  What is no main
text by its markup is cut away: menus, page headers, footers, asides, forms, dialogs,
what is hidden, reader comments, and elements that are named as one of these or as an
advert, a notice or a sidebar.  If the page marks its article (``article``, ``main``), what stands in it is
the main text, lists of links in it as well, and what stands outside is not.  On all other
pages a small decision tree judges each block by its number of words and link density (share of words inside
links) and by those of the blocks before and after it (cut ones included).  The tree
is trained on the labelled blocks of ``labelled_blocks.py``, which come from pages without an article.  If it finds
no main text on a page, the blocks with fewer than half of their words in links are.

Tags are read as browsers do: a quote opens a value only after an equals sign, an
unclosed tag runs to the end of the page.  A quote without an end is no quote.  Every
page is read once from left to right, whatever is broken in it, and an end tag costs what it closes.

Pages are independent rows: one Arrow pass, no shuffle; the tree has a few nodes
and is trained on the driver from the fixed small table.

Defined results: null and empty html give the empty text with 0 characters; text
without any tag is one block; unclosed and stray tags are tolerated; every row is
kept, repeated ids too; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled_blocks import FEATURES, LABELLED

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"=\s*([\"'])|>")
_MARKS = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|(?=[\s/]|\Z))", re.I)
#: Elements whose content is no text of the page, and those that run to the end of the page if nothing ends them (fixed values).
RAW = frozenset("script style title textarea".split())
SILENT = frozenset("title script style noscript template svg math iframe object canvas audio video select option datalist button textarea".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that frame parts of a page; the ones whose ends are followed.
FRAMES = frozenset("html body main article section div nav header footer aside form fieldset dialog menu ul ol dl table figure details".split())
CUT_TAGS = frozenset("nav footer aside form fieldset dialog menu".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names of class and id: reader comments; adverts, notices and sidebars (a word of a name is enough); headers, footers and menus (the whole name, outside an article).
READERS = re.compile(r"(?:user|reader|post|page|article|blog)?comments?(?:s|list|area|section|form|thread|box|wrapper)?|respond|reply|replies|disqus|discussion")
NAMED = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices
    popup modal newsletter subscribe subscription sidebar related recommended recommendations breadcrumb breadcrumbs pagination pager share sharing""".split()
)
FRAMING = frozenset(
    """header footer menu nav navbar navigation masthead topbar toolbar site-header site-footer site-nav site-menu page-header page-footer main-nav main-menu
    main-navigation top-nav top-menu footer-nav footer-menu global-header global-footer""".split()
)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    inside: bool
    cut: bool


class _Place:
    """Where the reader stands: the open frames, with what they say about their text."""

    def __init__(self) -> None:
        self.open: list[tuple[str, bool, bool]] = []  # tag, inside an article, cut
        self.count: dict[str, int] = {}

    def now(self) -> tuple[bool, bool]:
        return self.open[-1][1:] if self.open else (False, False)

    def enter(self, tag: str, attributes: str) -> None:
        inside, cut = self.now()
        names, role, hidden = _names(attributes)
        article = tag in ("main", "article") or role in ("main", "article")
        words = {w for name in names for w in re.split(r"[^a-z]+", name)}
        if tag in CUT_TAGS or role in CUT_ROLES or hidden or (tag == "header" and not inside):
            cut = True
        elif article and not cut:
            # An article may have an unlucky name.
            inside = True
        elif tag not in ("html", "body") and (words & NAMED or any(map(READERS.fullmatch, words)) or (names & FRAMING and not inside)):
            cut = True
        self.open.append((tag, inside, cut))
        self.count[tag] = self.count.get(tag, 0) + 1

    def leave(self, tag: str) -> None:
        if self.count.get(tag):
            last = ""
            while last != tag:
                last = self.open.pop()[0]
                self.count[last] -= 1


def _names(attributes: str) -> tuple[set[str], str, bool]:
    """Names of class and id, the role, and whether the element is hidden."""
    names: set[str] = set()
    role, hidden = "", False
    if attributes and not attributes.isspace():
        for key, value in _MARKS.findall(attributes):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id"):
                names.update(value.replace("_", "-").split())
            elif key == "role":
                role = value.strip()
            elif key == "style":
                hidden |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) is not None
            else:
                hidden |= value not in ("false", "until-found")
    return names, role, hidden


class _Reader:
    """Tags of a page from left to right; what was not found once is not sought again."""

    def __init__(self, html: str) -> None:
        self.html, self.lower = html, None
        self.missing: dict[str, int] = {}

    def find(self, what: str, at: int, fold: bool = False) -> int:
        if what in self.missing:
            return -1
        if fold and self.lower is None:
            # Letters beyond ASCII may change their number when they are lowered.
            self.lower = self.html.translate(_FOLD)
        found = (self.lower if fold else self.html).find(what, at)
        if found < 0:
            self.missing[what] = at
        return found

    def after(self, mark: str, at: int) -> int:
        """The place after the next mark, or the end of the page."""
        found = self.find(mark, at)
        return len(self.html) if found < 0 else found + len(mark)

    def tag_end(self, at: int) -> int:
        """The place of the > that ends a tag whose name ends before ``at``; the end of the page if none does."""
        plain = self.find(">", at)
        if plain >= 0 and self.html.find('"', at, plain) < 0 and self.html.find("'", at, plain) < 0:
            return plain
        while m := _QUOTE.search(self.html, at):
            if not m[1]:
                return m.start()
            close = self.find(m[1], m.end())
            at = m.end() if close < 0 else close + 1
        return len(self.html)

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, place after it, name, whether it closes, attributes); comments and declarations have no name."""
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            m = _NAME.match(html, start + 1)
            if m:
                end = self.tag_end(m.end())
                closing = html[start + 1] == "/"
                name, at = m[1].lower(), min(end + 1, len(html))
                yield start, at, name, closing, html[m.end() : end]
                if name in SILENT and not closing and not html[start:end].endswith("/"):
                    stop = self.find(f"</{name}", at, fold=True)
                    at = stop if stop >= 0 else len(html) if name in RAW else at
                    yield at, at, "", True, ""
            elif html.startswith("<!--", start):
                at = self.after("-->", start + 4)
                yield start, at, "", False, ""
            elif html.startswith("<![CDATA[", start):
                at = self.after("]]>", start + 9)
                yield start, at, "", False, ""
            elif html.startswith(("<!", "<?", "</"), start):
                at = self.after(">", start + 2)
                yield start, at, "", False, ""
            else:
                at = start + 1


_FOLD = {c: c + 32 for c in range(65, 91)}


def blocks(html: str) -> list[Block]:
    """The page's text blocks in order; white space is one blank and references are decoded."""
    out: list[Block] = []
    place, at, linked = _Place(), 0, False
    parts: list[tuple[str, bool]] = []

    def close() -> None:
        if parts:
            text = " ".join(unescape("".join(t for t, _ in parts)).split())
            if text:
                words = text.count(" ") + 1
                dense = sum(len(unescape(t).split()) for t, link in parts if link)
                out.append(Block(text, words, min(dense, words), *place.now()))
            parts.clear()

    for start, after, tag, closing, attributes in _Reader(html).tags():
        if not tag and closing:  # the content of a silent element ends
            at = after
            continue
        if start > at:
            parts.append((html[at:start], linked))
        at = after
        if not tag or tag in SILENT:
            continue
        if tag in INLINE:
            if tag == "a":
                linked = not closing
            elif tag == "br":
                parts.append((" ", linked))
        else:
            close()
            linked = False
            if tag in FRAMES:
                if closing:
                    place.leave(tag)
                else:
                    place.enter(tag, attributes)
    if at < len(html):
        parts.append((html[at:], linked))
    close()
    return out


def features(page: list[Block]) -> np.ndarray:
    """One row a block, columns as FEATURES; beyond the ends stand empty blocks."""
    words = np.array([0, *(b.words for b in page), 0], float)
    density = np.array([0, *(b.linked / b.words for b in page), 0], float)
    return np.column_stack([words[1:-1], density[1:-1], words[:-2], density[:-2], words[2:], density[2:]])


@dataclass
class Node:
    """A leaf, or the question whether a feature is at most a value."""

    main: bool
    feature: int = -1
    value: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """A decision tree: each split lowers the Gini impurity most; ties take the first feature and value."""
    leaf = Node(bool(2 * y.sum() >= len(y)))
    if not depth or len(set(y.tolist())) == 1:
        return leaf
    best = (-1.0, 0, 0.0)
    impurity = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for value in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= value
            if min(low.sum(), (~low).sum()) >= least:
                gain = impurity(y) - impurity(y[low]) - impurity(y[~low])
                if gain > best[0] + 1e-12:
                    best = (gain, f, float(value))
    gain, f, value = best
    if gain <= 1e-12:
        return leaf
    low = x[:, f] <= value
    below, above = grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)
    if below.low is None and above.low is None and below.main == above.main:
        return Node(below.main)
    return Node(leaf.main, f, value, below, above)


def train() -> Node:
    table = np.array(LABELLED, float)
    if table.shape[1] != len(FEATURES) + 1:
        raise ValueError("a labelled block has one number a feature, and the label")
    return grow(table[:, :-1], table[:, -1])


def printed(tree: Node, indent: str = "") -> str:
    """The tree as text, a question a line."""
    if tree.low is None or tree.high is None:
        return f"{indent}{'main' if tree.main else 'not main'}\n"
    return f"{indent}{FEATURES[tree.feature]} <= {tree.value:g}?\n{printed(tree.low, indent + '  ')}{indent}else\n{printed(tree.high, indent + '  ')}"


def is_main(tree: Node, x: np.ndarray) -> np.ndarray:
    if tree.low is None or tree.high is None:
        return np.full(len(x), tree.main)
    low = x[:, tree.feature] <= tree.value
    out = np.empty(len(x), bool)
    out[low], out[~low] = is_main(tree.low, x[low]), is_main(tree.high, x[~low])
    return out


def chosen(page: list[Block], tree: Node) -> list[bool]:
    """Which blocks of a page are main text."""
    if any(b.inside and not b.cut for b in page):
        return [b.inside and not b.cut for b in page]
    told = [bool(m) and not b.cut for b, m in zip(page, is_main(tree, features(page)), strict=True)] if page else []
    return told if any(told) else [not b.cut and 2 * b.linked < b.words for b in page]


def main_text(html: str | None, tree: Node) -> str:
    page = blocks(html or "")
    return " ".join(b.text for b, keep in zip(page, chosen(page, tree), strict=True) if keep)


def _extract(tree: Node) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                step = batch.slice(at, 256)
                text = [main_text(h, tree) for h in step.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([step.column(0), step.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: one row a page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(_extract(train()), "page_id long, url string, text string, n_chars long")
