"""HTML extraction by layout-aware rendering.

A tolerant tokeniser feeds a tree builder that knows void elements, implied end tags (a ``<p>`` ends at the next block,
``<li>``, ``<td>`` and their kind at the next sibling) and raw text elements. The renderer walks the tree: hidden
elements are left out, blocks stand on lines of their own, paragraphs and headings keep blank lines, list items get
bullets or numbers with indents, ``<pre>`` keeps its spaces, and table cells are padded so that columns line up.

The tokeniser only moves forward, open elements are found by their places, and the renderer keeps its own stack, so
elements may nest as deep as a page likes. Indents stop growing at ``WIDEST_INDENT`` and columns at ``WIDEST_COLUMN``
marks, and tables nested in ``DEEPEST_GRID`` others flow as lines: layout, which no text is lost by, that keeps the work
on hostile pages in proportion to them.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element kinds of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base area datalist param source track iframe embed audio video canvas noembed noframes dialog desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption colgroup".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt".split())
#: An element, those whose open element it ends, and where the search for one stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: An end tag looks no further than these for its element.
WALLS = frozenset("table td th caption html template".split())

NAME = re.compile(r"[A-Za-z][^\s/>]*")
QUOTE_OR_END = re.compile(r"[\"'>]")
WIDEST_INDENT, WIDEST_COLUMN, DEEPEST_GRID = 64, 200, 8
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        value = m.group(2) or ""
        if value[:1] in "\"'" and value:
            value = value[1:-1]
        found.setdefault(m.group(1).lower(), entities.unescape(value))
    return found


class _Tags:
    """Tags of a page from its begin to its end; every mark is looked at a fixed number of times."""

    def __init__(self, source: str):
        self.source, self.quotes = source, True

    def end(self, at: int) -> int:
        """Where the ``>`` of a start tag stands whose name ends at ``at``; -1 without one.

        Quotes hide it. After a tag whose quotes never close, quotes hide nothing for the rest of the page.
        """
        place = at
        while self.quotes:
            m = QUOTE_OR_END.search(self.source, place)
            if m and m.group() == ">":
                return m.start()
            close = self.source.find(m.group(), m.end()) if m else -1
            if close < 0:
                self.quotes = False
            place = close + 1
        return self.source.find(">", at)

    def __iter__(self) -> Iterator[tuple[str, str, str, int]]:
        """(kind, text or name, attributes, place after it); a reader may send the place to go on from."""
        source, at, n = self.source, 0, len(self.source)
        since = 0  # of the text not yet given
        while (at := source.find("<", at)) >= 0:
            mark = source[at + 1 : at + 2]
            name = NAME.match(source, at + (2 if mark == "/" else 1)) if mark not in "!?" else None
            if mark and mark in "!?":
                if source.startswith("<!--", at):
                    stop = source.find("-->", at + 2)
                    to = stop + 3 if stop >= 0 else n
                else:
                    stop = source.find(">", at)
                    to = stop + 1 if stop >= 0 else n
                kind, tag, attributes = "other", "", ""
            elif name and mark == "/":
                stop = source.find(">", name.end())
                kind, tag, attributes, to = "end", name.group().lower(), "", stop + 1 if stop >= 0 else n
            elif name:
                stop = self.end(name.end())
                if stop < 0:  # no tag can end any more
                    break
                kind, tag, attributes, to = "start", name.group().lower(), source[name.end() : stop], stop + 1
            else:
                at += 1
                continue
            if at > since:
                yield "text", source[since:at], "", at
            on = yield kind, tag, attributes, to
            since = at = on if on is not None else to
        if since < n:
            yield "text", source[since:], "", n


class _Open:
    """The open elements, and the places of each tag among them."""

    def __init__(self) -> None:
        self.stack = [Node("#root")]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The innermost open element with one of ``tags``; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def cut(self, place: int) -> None:
        while len(self.stack) > place:
            self.places[self.stack.pop().tag].pop()

    def close(self, tags, stops) -> bool:
        """End the innermost element of ``tags`` that no element of ``stops`` shields."""
        place = self.last(tags)
        if place <= self.last(stops):
            return False
        self.cut(place)
        return True


_RAW_END: dict[str, re.Pattern] = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in RAW}


def build(source: str) -> Node:
    """The tree of ``source``; never fails, whatever is in it."""
    opened = _Open()
    tags = iter(_Tags(source))
    on = None
    while True:
        try:
            kind, tag, attributes, at = tags.send(on)
        except StopIteration:
            return opened.stack[0]
        on = None
        inner = opened.stack[-1].children
        if kind == "text":
            inner.append(entities.unescape(tag))
        elif kind == "end":
            if tag == "br" or tag == "p" and not opened.places.get("p"):
                inner.append(Node(tag))
            else:
                opened.close({tag}, WALLS - {tag} - ({"td", "th", "caption"} if tag in ("tr", "tbody", "thead", "tfoot", "table") else set()))
        elif kind == "start":
            if tag in ENDS_P:
                opened.close({"p"}, WALLS | {"button"})
            if tag in IMPLIED:
                while opened.close(*IMPLIED[tag]):
                    pass
            node = Node(tag, _attributes(attributes) if attributes.strip(" /") else {})
            opened.stack[-1].children.append(node)
            if tag in RAW:
                end = _RAW_END[tag].search(source, at)
                text = source[at : end.start() if end else len(source)]
                if text and tag in ("textarea", "title"):
                    node.children.append(entities.unescape(text))
                on = end.end() if end else len(source)
            elif tag not in VOID:
                opened.push(node)


def hidden(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN:
        return not (node.tag == "dialog" and "open" in a)
    if not a:
        return False
    return "hidden" in a or bool(UNSEEN.search(a.get("style", ""))) or (node.tag == "input" and a.get("type", "").lower() == "hidden")


def _width(text: str) -> int:
    return len(text) if text.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _run(job):
    """The result of a generator that yields generators whose results it waits for: recursion without Python's stack."""
    jobs, value = [job], None
    while jobs:
        try:
            jobs.append(jobs[-1].send(value))
            value = None
        except StopIteration as done:
            jobs.pop()
            value = done.value
    return value


class Renderer:
    """Lines of visible text; ``gap`` is how many line feeds the next text needs before it.

    ``render`` and ``table`` are generators for ``_run``.
    """

    def __init__(self, level: int = 0) -> None:
        self.level = level  # of grids around this one
        self.out: list[str] = []
        self.gap, self.space, self.prefix, self.mark = 0, False, "", ""

    def line(self, feeds: int) -> None:
        self.gap = max(self.gap, feeds)
        self.space = False

    def put(self, text: str, verbatim: bool = False) -> None:
        if verbatim:
            for k, part in enumerate(text.split("\n")):
                if k:
                    self._feed(1)
                if part:
                    self._emit(part)
            return
        flat = SPACES.sub(" ", text)
        if flat == " " or not flat:
            self.space = self.space or bool(flat)
            return
        if flat[0] == " ":
            self.space = True
        self._emit(flat.strip(" "))
        self.space = flat[-1] == " "

    def _feed(self, n: int) -> None:
        self.gap += n
        self.space = False

    def _emit(self, text: str) -> None:
        if self.gap or not self.out:
            if self.out:
                self.out.append("\n" * self.gap)
            self.out.append(self.prefix[: len(self.prefix) - len(self.mark)] + self.mark if self.mark else self.prefix)
            self.mark = ""
        elif self.space:
            self.out.append(" ")
        self.gap, self.space = 0, False
        self.out.append(text)

    def _indent(self, more: str) -> str:
        return self.prefix + more if len(self.prefix) + len(more) <= WIDEST_INDENT else self.prefix

    def render(self, node: Node, pre: bool = False, depth: int = 0):
        counter = _number(node.attributes.get("start", "1"))
        for child in node.children:
            if isinstance(child, str):
                self.put(child, pre)
                continue
            tag = child.tag
            if tag == "br":
                self._feed(1)
            elif hidden(child):
                continue
            elif tag == "hr":
                self.line(2)
            elif tag == "wbr":
                continue
            elif tag == "img":
                if child.attributes.get("alt"):
                    self.put(child.attributes["alt"])
            elif tag == "input":
                if child.attributes.get("type", "").lower() in ("submit", "button", "reset"):
                    self.put(child.attributes.get("value", ""))
            elif tag == "table":
                self.line(2)
                yield self.table(child, depth) if self.level < DEEPEST_GRID else self.render(child, pre, depth)
                self.line(2)
            elif tag in ("td", "th"):  # outside a grid
                self.space = True
                yield self.render(child, pre, depth)
                self.space = True
            elif tag == "select":
                for option in _shown_options(child):
                    self.space = True
                    yield self.render(option, pre, depth)
                    self.space = True
            elif tag == "li":
                self.line(1)
                mark = "- "
                if node.tag == "ol":
                    counter = _number(child.attributes.get("value", str(counter)))
                    mark, counter = f"{counter}. ", counter + 1
                before = self.prefix
                self.prefix, self.mark = self._indent(" " * len(mark)), mark
                yield self.render(child, pre, depth + 1)
                self.prefix, self.mark = before, ""
                self.line(1)
            elif tag in BLOCK:
                feeds = 2 if tag in SPACED and not (tag in ("ul", "ol") and depth) else 1
                before = self.prefix
                if tag in ("blockquote", "dd"):
                    self.prefix = self._indent("  ")
                self.line(feeds)
                yield self.render(child, pre or tag == "pre", depth)
                self.prefix = before
                self.line(feeds)
            else:
                yield self.render(child, pre, depth)

    def table(self, node: Node, depth: int):
        """Rows as lines; a cell starts where the widest earlier cells of its column let it."""
        rows: list[list[tuple[str, int]]] = []
        loose: list[Node] = []

        todo = list(reversed(node.children))
        while todo:
            child = todo.pop()
            if isinstance(child, str):
                if child.strip():
                    loose.append(_wrap(child))
            elif hidden(child) or child.tag in ("col", "colgroup"):
                continue
            elif child.tag == "tr":
                cells = []
                for cell in child.children:
                    if isinstance(cell, Node) and cell.tag in ("td", "th"):
                        if not hidden(cell):
                            text = yield _inner(cell, self.level + 1)
                            cells.append((text, min(1000, max(1, _number(cell.attributes.get("colspan", "1"))))))
                    elif isinstance(cell, Node) and not hidden(cell) or isinstance(cell, str) and cell.strip():
                        loose.append(_wrap(cell))
                rows.append(cells)
            elif child.tag in ("tbody", "thead", "tfoot"):
                todo += reversed(child.children)
            elif child.tag in ("td", "th"):
                if not rows:
                    rows.append([])
                text = yield _inner(child, self.level + 1)
                rows[-1].append((text, 1))
            else:
                loose.append(_wrap(child))
        for x in loose:  # captions and stray content stand before the grid
            self.line(1)
            yield self.render(x, depth=depth)
            self.line(1)
        wide: dict[int, int] = {}
        for cells in rows:
            column = 0
            for text, span in cells:
                if span == 1:
                    wide[column] = min(WIDEST_COLUMN, max(wide.get(column, 0), max(map(_width, text.split("\n")))))
                column += span
        for cells in rows:
            split = [(text.split("\n"), span) for text, span in cells]
            tall = max((len(lines) for lines, _ in split), default=0)
            for k in range(tall):
                parts, column = [], 0
                for lines, span in split:
                    piece = lines[k] if k < len(lines) else ""
                    room = sum(wide.get(column + j, 0) for j in range(span)) + 2 * (span - 1)
                    parts.append(piece + " " * (room - _width(piece)))
                    column += span
                whole = "  ".join(parts).rstrip()
                if whole:
                    self.line(1)
                    self._emit(whole)
            if tall:
                self.line(1)

    def text(self) -> str:
        return "\n".join(x.rstrip(" ") for x in "".join(self.out).split("\n")).strip("\n")


def _number(text: str) -> int:
    m = re.match(r"\s*(-?\d{1,9})", text)
    return int(m.group(1)) if m else 1


def _wrap(child) -> Node:
    node = Node("#part")
    node.children.append(child)
    return node


def _inner(node: Node, level: int):
    r = Renderer(level)
    yield r.render(node)
    return r.text()


def _shown_options(select: Node) -> list[Node]:
    """The chosen options of a list (else its first one); all of a list that shows several."""
    options, todo = [], list(reversed(select.children))
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not hidden(x):
            if x.tag == "option":
                options.append(x)
            else:
                todo += reversed(x.children)
    if "multiple" in select.attributes or _number(select.attributes.get("size", "1")) > 1:
        return options
    return ([x for x in options if "selected" in x.attributes] or options)[:1]


def visible_text(source: str | None) -> str:
    """All visible text of a page, laid out; null and empty pages have none."""
    if not source:
        return ""
    r = Renderer()
    _run(r.render(build(source)))
    return r.text()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [visible_text(x) for x in batch.column(1).to_pylist()]
        lines = [t.count("\n") + 1 if t else 0 for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lines, pa.int64())], names=["page_id", "text", "n_lines"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text, n_lines`` for every row: the page's visible text, whole.

    A null or empty page gives an empty text of no lines; malformed markup is read as far as it goes and its text kept.
    Repeated rows each give a row, ids may be null, other columns are not read, an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract, "page_id long, text string, n_lines long")
