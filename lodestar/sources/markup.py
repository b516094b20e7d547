"""Elements of stored pages by selectors: one Arrow pass, linear in a page.

``read`` turns (page_id, html) into a row a page with the page's text and its elements that fit one of some named selectors.
A selector is compiled into steps; while a page is read, the stack of open elements holds for every selector how far its steps have got,
so an element is judged once, when it opens, from its parent's progress. Texts are slices of one list of pieces.

Selectors: tag, ``.class``, ``#id``, ``[a]``, ``[a="v"]``, ``[a*="v"]``, ``[a^="v"]``, ``[a$="v"]``, ``:not(...)`` of these, the
descendant blank and ``>``; several with commas.

Pages are read as browsers do where it matters here: void elements, content of scripts and the like as no text, comments, ends that
are left out (paragraphs, items, cells, options, links), stray ends, unclosed quotes and tags. Null html is the empty page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Elements without content, with raw content, without visible text, inside a line, and those that one of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp noscript iframe".split())
SILENT = frozenset("head script style title template noscript iframe svg math object audio video canvas select datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A new element of the first kind ends an open one of the second kinds, unless an element of the third kinds opened after it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)), "a": (("a",), ("table", "object")),
}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Pages of one part where they are dealt by number.
PART = 5000

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_QUOTE = re.compile(r"=\s*([\"'])|>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_FOLD = {c: c + 32 for c in range(65, 91)}


class _Page:
    """A page's tags from left to right; what was sought to the end once is not sought again."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.folded: str | None = None
        self.missing: set[str] = set()

    def _find(self, what: str, at: int, fold: bool = False) -> int:
        if what in self.missing:
            return -1
        if fold and self.folded is None:
            self.folded = self.html.translate(_FOLD)
        found = ((self.folded if fold else self.html) or "").find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _after(self, what: str, at: int) -> int:
        found = self._find(what, at)
        return len(self.html) if found < 0 else found + len(what)

    def _tag_end(self, at: int) -> int:
        """Where the tag ends: quotes count after an equals sign, and only those that are closed."""
        while m := _QUOTE.search(self.html, at):
            if not m[1]:
                return m.start()
            close = self._find(m[1], m.end())
            at = m.end() if close < 0 else close + 1
        return len(self.html)

    def tags(self) -> Iterator[tuple[int, int, str, str | None]]:
        """(start, place after it, name, attributes); attributes are None for an end tag, the name is empty for what is no tag of an element."""
        html, at = self.html, 0
        while (start := html.find("<", at)) >= 0:
            m = _NAME.match(html, start + 1)
            if m:
                end = self._tag_end(m.end())
                closing, name, at = html[start + 1] == "/", m[1].lower(), min(end + 1, len(html))
                yield start, at, name, None if closing else html[m.end() : end]
                if name in RAW and not closing:
                    stop = self._find(f"</{name}", at, fold=True)
                    stop = len(html) if stop < 0 else stop
                    yield at, stop, "", ""
                    at = stop
                continue
            for opening, ending in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">"), ("</", ">")):
                if html.startswith(opening, start):
                    at = self._after(ending, start + len(opening))
                    yield start, at, "", ""
                    break
            else:
                at = start + 1


def attributes_of(text: str) -> dict[str, str]:
    """Names in lower case, values decoded, the first of a name."""
    found: dict[str, str] = {}
    if text and not text.isspace():
        for name, double, single, bare in _ATTRIBUTE.findall(text):
            found.setdefault(name.lower(), unescape(double or single or bare))
    return found


@dataclass(frozen=True)
class Compound:
    """What one element is asked for."""

    tag: str = ""
    classes: tuple[str, ...] = ()
    tests: tuple[tuple[str, str, str], ...] = ()
    never: tuple[Compound, ...] = ()
    child: bool = False

    def fits(self, tag: str, attributes: Mapping[str, str], classes: frozenset[str]) -> bool:
        if self.tag and self.tag != tag or any(c not in classes for c in self.classes):
            return False
        for name, how, value in self.tests:
            said = attributes.get(name)
            if said is None or not (how == "" or how == "=" and said == value or value and (how == "*=" and value in said or how == "^=" and said.startswith(value) or how == "$=" and said.endswith(value))):
                return False
        return not any(x.fits(tag, attributes, classes) for x in self.never)


_PART = re.compile(r"""\s*(>)\s*|(\s+)|(,)\s*|:not\(([^()]*)\)|([.\#]?)([\w-]+)|\*|\[\s*([\w-]+)\s*(?:([*^$]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s]+))\s*)?\]""")


def compile_selector(text: str) -> list[list[Compound]]:
    """The alternatives of a selector, each as its steps from the outermost."""
    out: list[list[Compound]] = [[]]
    tag, classes, tests, never, child, at, open_ = "", [], [], [], False, 0, False

    def flush() -> None:
        nonlocal tag, classes, tests, never, child, open_
        if open_:
            out[-1].append(Compound(tag, tuple(classes), tuple(tests), tuple(never), child))
        tag, classes, tests, never, child, open_ = "", [], [], [], False, False

    text = text.strip()
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            raise ValueError(f"selector {text!r} is not understood from {text[at:]!r}")
        at = m.end()
        if m[1] or m[2]:
            flush()
            child = bool(m[1])
        elif m[3]:
            flush()
            out.append([])
        else:
            open_ = True
            if m[4] is not None:
                never += [steps[-1] for steps in compile_selector(m[4])]
            elif m[6] and m[5] == ".":
                classes.append(m[6])
            elif m[6] and m[5] == "#":
                tests.append(("id", "=", m[6]))
            elif m[6]:
                tag = m[6].lower()
            elif m[7]:
                tests.append((m[7].lower(), m[8] or "", m[9] or m[10] or m[11] or ""))
    dangling = child and not open_
    flush()
    if dangling or not all(out):
        raise ValueError(f"selector {text!r} has an empty part")
    return out


class Selectors:
    """Named selectors as one set of steps; progress is a bit a step: bit i is set if the first i + 1 steps have been met."""

    def __init__(self, named: Mapping[str, str]) -> None:
        self.names = list(named)
        self.steps: list[tuple[Compound, int, int]] = []  # what is asked, the bit of the step before (0: none), the name if it is the last step (else -1)
        self.by_tag: dict[str, list[int]] = {}
        self.anywhere: list[int] = []
        for k, text in enumerate(named.values()):
            for alternative in compile_selector(text):
                for i, compound in enumerate(alternative):
                    before = 1 << (len(self.steps) - 1) if i else 0
                    (self.by_tag.setdefault(compound.tag, []) if compound.tag else self.anywhere).append(len(self.steps))
                    self.steps.append((compound, before, k if i == len(alternative) - 1 else -1))

    def enter(self, tag: str, attributes: Mapping[str, str], above: int, parent: int) -> tuple[int, int, list[int]]:
        """Steps met so far (above: by all ancestors, parent: by the parent itself); those of the element, and the names it fits."""
        own, fits = 0, []
        asked = self.by_tag.get(tag, ())
        if not asked and not self.anywhere:
            return above, 0, fits
        classes = frozenset(attributes.get("class", "").split())
        for i in (*asked, *self.anywhere):
            compound, before, name = self.steps[i]
            if (not before or (parent if compound.child else above) & before) and compound.fits(tag, attributes, classes):
                own |= 1 << i
                if name >= 0 and name not in fits:
                    fits.append(name)
        return above | own, own, fits


@dataclass(slots=True)
class _Open:
    tag: str
    above: int
    own: int
    silent: bool
    fits: list[tuple[int, int]] = field(default_factory=list)  # name, number of the element
    start: int = 0


def parse(html: str, selectors: Selectors) -> tuple[str, list[dict]]:
    """The page's text, and its elements in order: kind, pos, attributes, text, within.

    Text has single blanks and a line break at each block. An element inside one of the same kind has no text of its own (null): it is
    part of the outer one's. within: the number of the nearest element of each kind around it."""
    pieces: list[str] = []
    found: list[dict] = []
    stack: list[_Open] = [_Open("", 0, 0, False)]
    places: dict[str, list[int]] = {}
    around: list[list[int]] = [[] for _ in selectors.names]
    count = 0

    def text_from(start: int) -> str:
        joined = re.sub(r"[^\S\n]+", " ", "".join(pieces[start:]))
        return re.sub(r" ?\n[ \n]*", "\n", joined).strip()

    def pop() -> None:
        e = stack.pop()
        places[e.tag].pop()
        for name, number in e.fits:
            around[name].pop()
            if not around[name]:
                found[number]["text"] = text_from(e.start)

    def last(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            pop()

    def say(raw: str) -> None:
        if not stack[-1].silent:
            pieces.append((unescape(raw) if "&" in raw else raw).replace("\n", " "))

    page, at, html_end = _Page(html), 0, len(html)
    for start, after, tag, attributes in page.tags():
        if start > at:
            say(html[at:start])
        at = after
        if not tag:
            if stack[-1].tag == "textarea":
                say(html[start:after])
            continue
        if tag not in INLINE and tag not in SILENT and not stack[-1].silent:
            pieces.append("\n")
        if attributes is None:
            depth = last(tag)
            if depth:
                close_to(depth)
            continue
        if tag in ENDS:
            ended, walls = ENDS[tag]
            wall = max(map(last, walls))
            close_to(min([d for d in map(last, ended) if d > wall], default=len(stack)))
        if tag in CLOSES_P and last("p") > max(last("td"), last("th"), last("table"), last("object")):
            close_to(last("p"))
        said = attributes_of(attributes)
        parent = stack[-1]
        above, own, fits = selectors.enter(tag, said, parent.above, parent.own)
        element = _Open(tag, above, own, parent.silent or tag in SILENT or "hidden" in said or "style" in said and _HIDDEN.search(said["style"]) is not None, start=len(pieces))
        if fits:
            within = {selectors.names[k]: found[places_[-1]]["pos"] for k, places_ in enumerate(around) if places_}
            for name in fits:
                element.fits.append((name, len(found)))
                found.append({"kind": selectors.names[name], "pos": count, "attributes": list(said.items()), "text": None, "within": list(within.items())})
        if fits:
            count += 1
        if tag in VOID or attributes.endswith("/") and tag in ("svg", "path"):
            for _, number in element.fits:
                found[number]["text"] = ""
            continue
        for name, number in element.fits:
            around[name].append(number)
        stack.append(element)
        places.setdefault(tag, []).append(len(stack) - 1)
    if at < html_end:
        say(html[at:])
    close_to(1)
    return text_from(0), found


ELEMENT = "struct<kind string, pos int, attributes map<string,string>, text string, within map<string,int>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("pos", pa.int32()), ("attributes", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("within", pa.map_(pa.string(), pa.int32()))]))


def read(pages: DataFrame, selectors: Mapping[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """pages: page_id, html. page_id, the columns of ``keep``, text (of the page, a line a block) and elements (array of ELEMENT, in order) that fit one of the named selectors.

    An element's pos counts the elements that fit any of them; one that fits two has the same pos twice."""
    compiled = dict(selectors)
    Selectors(compiled)  # errors belong to the caller
    carried = ["page_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = Selectors(compiled)
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                parsed = [parse(html or "", steps) for html in batch.column(len(carried)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([t for t, _ in parsed], pa.string()), pa.array([e for _, e in parsed], _ARROW)], names=[*carried, "text", "elements"])

    rows = pages.select(*carried, F.col("html").cast("string").alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, text string, elements array<{ELEMENT}>")


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt into parts of about PART pages, two a core at least: for rows that become pages, so that a small file is not one task."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    count = rows.count()
    return rows.repartition(max(1, min(count, 2 * cores), -(-count // PART)), key)


def of_kind(elements: Column, kind: str) -> Column:
    return F.filter(elements, lambda e: e["kind"] == kind)


def exploded(read_pages: DataFrame, kind: str) -> DataFrame:
    """page_id, pos, attributes, text, within of one kind's elements; the text that an outer element of the kind has is null."""
    return read_pages.select("page_id", F.explode(of_kind(F.col("elements"), kind)).alias("e")).select("page_id", "e.pos", "e.attributes", "e.text", "e.within")
