"""Visible text of web pages, laid out as a browser would.

A tree builder reads tags, closes what HTML closes without a tag, and leaves
out what is not shown.  A renderer that follows the tree writes the text: white
space collapses outside ``pre``, blocks stand on lines of their own, paragraphs
apart, list items behind their mark, and the cells of a table in columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .ship import ship

# Columns are aligned whatever their width, unless padding would make a table so many times as long
# as its text and this much longer: then those wider than WIDE_COLUMN aren't padded.
PADDED_TIMES, PADDED_MORE, WIDE_COLUMN = 16, 1 << 16, 60
# Lists, definitions and tables nested deeper than this are written as plain blocks.
DEEPEST = 16
WIDEST_SPAN = 1000  # fixed by HTML

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext textarea title".split())
UNSEEN = frozenset(
    "head script style template title noscript noframes noembed iframe object audio video canvas"
    " datalist meter progress param source track link meta base area map"
    .split())
# Inside these elements further ones aren't shown, and tags may close themselves.
FOREIGN_UNSEEN = {
    "math": frozenset(("annotation", "annotation-xml")),
    "svg": frozenset("defs desc metadata symbol clippath mask marker pattern".split()),
}
SVG_TEXT = frozenset(("text", "foreignobject"))  # all else of a drawing has no text
APART = frozenset(  # blank lines around
    "p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu dir".split())
BLOCK = APART | frozenset(
    "html body address article aside center details dialog div dd dt fieldset figcaption footer form"
    " header hgroup legend li listing main nav option optgroup search section select summary tr"
    " thead tbody tfoot caption xmp".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section"
    " summary table ul dd dt listing xmp plaintext".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# A start tag closes the open elements of the first set, up to one of the second.
IMPLIED: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir", "table", "td", "th"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table", "td", "th"))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "td": (frozenset(("td", "th", "caption", "colgroup")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th", "caption", "colgroup")), frozenset(("table", "tr"))),
    "caption": (frozenset(("caption", "colgroup")), frozenset(("table",))),
    "body": (frozenset(("head",)), frozenset()),
} | {
    group: (frozenset(("tr", "td", "th", "caption", "colgroup", "thead", "tbody", "tfoot")),
            frozenset(("table",)))
    for group in ("thead", "tbody", "tfoot", "colgroup")
}
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
HEAD_CONTENT = frozenset("base link meta title style script noscript template".split())
# An end tag reaches no further than these.
SCOPE = frozenset(("table", "td", "th", "caption", "template"))

# A tag that ends soon, which nearly all do.
_TAG = re.compile(
    r"</([a-zA-Z][^\s/>]*+)[^>]*+>"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_SOON = 256
_COMMENT_END = re.compile(r"--!?>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*+)")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(
    r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN_STYLE = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.I)
_SPACE = re.compile(r"[ \t\n\f\r]+")


class Flow:
    """Text being laid out: finished lines, the open line, and the space owed before it."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space is owed before the next word
        self.blank = False  # a blank line is owed before the next line

    def words(self, text: str) -> None:
        parts = _SPACE.sub(" ", text)
        if parts[:1] == " ":
            self.space = True
        core = parts.strip(" ")
        if core:
            self.add(core)
            self.space = parts[-1] == " "

    def add(self, text: str) -> None:
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def verbatim(self, text: str) -> None:
        first, *rest = text.replace("\r\n", "\n").split("\n")
        if first:
            self.add(first)
        for line in rest:
            self.break_line(keep=True)
            if line:
                self.add(line)

    def break_line(self, keep: bool = False) -> None:
        """End the open line; an empty one is only kept on demand."""
        if self.line or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False

    def block(self, apart: bool) -> None:
        self.break_line()
        self.blank = self.blank or apart

    def inset(self, lines: list[str], first: str, other: str) -> None:
        """Finished lines behind a mark."""
        self.break_line()
        if self.blank and self.lines and lines:
            self.lines.append("")
        self.blank = False if lines else self.blank
        self.lines += [(first if i == 0 else other if line else "") + line
                       for i, line in enumerate(lines)]

    def done(self) -> list[str]:
        self.break_line()
        return self.lines


class Table:
    """Rows of cells; a cell is its lines and its span."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int]]] = []

    def _widths(self, widest: float) -> dict[int, int]:
        widths: dict[int, int] = {}
        for row in self.rows:
            column = 0
            for lines, span in row:
                if span == 1:
                    width = max(map(len, lines), default=0)
                    if width <= widest:
                        widths[column] = max(widths.get(column, 0), width)
                column += span
        return widths

    def lines(self) -> list[str]:
        widths = self._widths(float("inf"))
        heights = [max((len(lines) for lines, _ in row), default=0) for row in self.rows]
        size = sum(len(line) for row in self.rows for lines, _ in row for line in lines)
        # The last column is not padded.
        padded = sum(heights) * (sum(widths.values()) - widths.get(max(widths, default=0), 0))
        if padded > PADDED_TIMES * size + PADDED_MORE:
            widths = self._widths(WIDE_COLUMN)
        columns = sorted(widths)
        upto = [0, *accumulate(widths[c] for c in columns)]

        def width_of(column: int, span: int) -> int:
            if span == 1:
                return widths.get(column, 0)
            low, high = bisect_left(columns, column), bisect_left(columns, column + span)
            return upto[high] - upto[low] + 3 * max(0, high - low - 1)

        out = []
        for row, height in zip(self.rows, heights):
            cells, column = [], 0
            for lines, span in row:
                cells.append((lines, width_of(column, span)))
                column += span
            for i in range(height):
                out.append(" | ".join(
                    (lines[i] if i < len(lines) else "").ljust(width) for lines, width in cells
                ).rstrip())
        return [line.rstrip(" |") if not line.strip(" |") else line for line in out]


class Renderer:
    """Follows the tree and writes into the flow of the innermost list item, cell or page."""

    def __init__(self):
        self.flows = [Flow()]
        self.tables: list[Table | None] = []  # None for one that is nested too deep
        self.lists: list[list] = []  # [ordered, next number]
        self.pre = 0
        self.apart: list[bool] = []  # whether each open item, definition or cell has its own flow

    @property
    def flow(self) -> Flow:
        return self.flows[-1]

    @property
    def table(self) -> Table | None:
        return self.tables[-1] if self.tables else None

    def open_flow(self) -> None:
        own = len(self.flows) <= DEEPEST
        self.apart.append(own)
        if own:
            self.flows.append(Flow())
        else:
            self.flow.block(False)

    def close_flow(self) -> list[str] | None:
        """The lines of the innermost flow, or None where it had none of its own."""
        if self.apart.pop():
            return self.flows.pop().done()
        self.flow.block(False)
        return None

    def start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.flow.break_line(keep=True)
        elif tag in ("td", "th") and self.tables:
            if self.table is not None and not self.table.rows:
                self.table.rows.append([])
            if self.table is None:
                self.apart.append(False)
                self.flow.block(False)
            else:
                self.open_flow()
        elif tag == "tr" and self.tables:
            if self.table is not None:
                self.table.rows.append([])
            else:
                self.flow.block(False)
        elif tag == "table":
            self.flow.block(True)
            # A table takes a flow for its cells.
            self.tables.append(Table() if len(self.flows) < DEEPEST else None)
        elif tag == "li":
            self.flow.block(False)
            self.open_flow()
        elif tag in ("thead", "tbody", "tfoot") and self.tables:
            pass
        elif tag in BLOCK:
            self.flow.block(tag in APART and not (tag in ("ul", "ol") and self.lists))
            if tag in ("ul", "ol", "menu", "dir"):
                number = re.search(r"\bstart\s*=\s*[\"']?(-?\d{1,9})", attributes)
                self.lists.append([tag == "ol", int(number[1]) if number else 1])
            elif tag in ("pre", "listing", "xmp"):
                self.pre += 1
            elif tag == "dd":
                self.open_flow()

    def end(self, tag: str, attributes: str) -> None:
        if tag in ("td", "th") and self.tables:
            span = re.search(r"\bcolspan\s*=\s*[\"']?0*(\d{1,9})", attributes)
            lines = self.close_flow()
            if lines is not None:
                wide = int(span[1]) if span else 1
                self.table.rows[-1].append((lines, min(max(1, wide), WIDEST_SPAN)))
        elif tag == "table":
            table = self.tables.pop()
            if table is not None:
                self.flow.inset(table.lines(), "", "")
            self.flow.block(True)
        elif tag == "li":
            lines = self.close_flow()
            ordered, number = self.lists[-1] if self.lists else (False, 1)
            mark = f"{number}. " if ordered else "- "
            if self.lists:
                self.lists[-1][1] += 1
            if lines is not None:
                self.flow.inset(lines, mark, " " * len(mark))
        elif tag == "dd":
            lines = self.close_flow()
            if lines is not None:
                self.flow.inset(lines, "  ", "  ")
        elif tag in ("tr", "thead", "tbody", "tfoot") and self.tables:
            pass
        elif tag in BLOCK:
            if tag in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
            elif tag in ("pre", "listing", "xmp"):
                self.pre -= 1
            self.flow.block(tag in APART and not (tag in ("ul", "ol") and self.lists))

    def text(self, text: str) -> None:
        if self.tables and self.flow_is_of_table():
            if not text.strip():
                return
        if self.pre:
            self.flow.verbatim(text)
        else:
            self.flow.words(text)

    def flow_is_of_table(self) -> bool:
        return self.table is not None and (len(self.flows) == 1 or not self.table.rows)


def _has_open(attributes: str) -> bool:
    return any(m[1].lower() == "open" for m in _ATTRIBUTE.finditer(attributes))


def _hidden(attributes: str) -> bool:
    if "hidden" not in attributes.lower() and "none" not in attributes.lower() and (
            "collapse" not in attributes.lower()):
        return False
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "")
             for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found and found["hidden"].lower() != "until-found":
        return True
    return found.get("type", "").lower() == "hidden" or bool(
        _HIDDEN_STYLE.search(unescape(found.get("style", ""))))


class Builder:
    """The stack of open elements; what is pushed and popped goes to the renderer."""

    def __init__(self, renderer: Renderer):
        self.renderer = renderer
        self.open: list[tuple[str, str, bool]] = []  # tag, attributes, starts a hidden part
        self.at: dict[str, list[int]] = {}  # the places of each tag among the open ones
        self.unseen = 0

    def count(self, tag: str) -> int:
        return len(self.at.get(tag, ()))

    def last(self, tags) -> int:
        """The place of the innermost open element of ``tags``, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, tag: str, attributes: str) -> None:
        hides = tag in UNSEEN or _hidden(attributes) or (
            tag == "dialog" and not _has_open(attributes)) or any(
            tag in inside and self.count(outer) > 0
            for outer, inside in FOREIGN_UNSEEN.items())
        self.unseen += hides
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, attributes, hides))
        if not self.unseen:
            if tag == "text" and self.count("svg"):
                self.renderer.text(" ")  # placed on its own
            self.renderer.start(tag, attributes)

    def pop(self) -> str:
        tag, attributes, hides = self.open.pop()
        self.at[tag].pop()
        if not self.unseen:
            self.renderer.end(tag, attributes)
            if tag == "text" and self.count("svg"):
                self.renderer.text(" ")
        self.unseen -= hides
        return tag

    def close(self, tags: frozenset[str], stop: frozenset[str]) -> None:
        """Close the elements down to the outermost of ``tags`` above ``stop``."""
        stopped, at = self.last(stop), len(self.open)
        for tag in tags:
            places = self.at.get(tag)
            if places and places[-1] > stopped:
                at = min(at, places[bisect_right(places, stopped)])
        while len(self.open) > at:
            self.pop()

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self.count(tag):
            return
        if tag in TABLE_PARTS and not self.count("table"):
            return
        if self.count("head") and tag not in HEAD_CONTENT and tag != "head":
            self.close(frozenset(("head",)), frozenset())
        if tag in CLOSES_P and self.count("p"):
            self.close(frozenset(("p",)), SCOPE | {"li", "dd", "button", "object"})
        if tag in HEADINGS and self.open and self.open[-1][0] in HEADINGS:
            self.pop()
        if tag in IMPLIED:
            self.close(*IMPLIED[tag])
        if tag in ("td", "th") and self.count("table"):
            if self.open[-1][0] in ("table", "thead", "tbody", "tfoot"):
                self.push("tr", "")
        if tag in VOID:
            if not self.unseen and tag in ("br", "hr") and not _hidden(attributes):
                self.renderer.start(tag, attributes)
                if tag == "hr":
                    self.renderer.end(tag, attributes)
            return
        self.push(tag, attributes)
        if self.closes_itself(attributes):
            self.pop()

    def closes_itself(self, attributes: str) -> bool:
        return attributes.endswith("/") and any(self.count(t) for t in FOREIGN_UNSEEN)

    def in_drawing(self) -> bool:
        """Whether the innermost drawing is outside its texts."""
        return self.last(("svg",)) > self.last(SVG_TEXT)

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "br":
            self.start("br", "")
            return
        if not self.count(tag):
            if tag == "p" and not self.unseen:
                self.renderer.flow.block(True)
            return
        at = self.at[tag][-1]
        if tag in SCOPE or self.last(SCOPE) < at:
            while len(self.open) > at:
                self.pop()

    def text(self, text: str) -> None:
        if self.count("head") and text.strip() and self.open[-1][0] == "head":
            self.close(frozenset(("head",)), frozenset())
        if not self.unseen and not self.in_drawing():
            self.renderer.text(unescape(text))


class _Tags:
    """The tags, comments and declarations of a page, from left to right, in time that grows with its
    length only: what an unclosed tag finds of the rest of the page is remembered for the next one.
    """

    def __init__(self, html: str):
        self.html = html
        self.special: list[int] | None = None  # the places of > and of quotes
        self.ends: dict[int, int] = {}  # by the place of a quote that opens: where its tag ends, or -1

    def end_of(self, at: int) -> int:
        """The place of the > that ends a start tag, quotes being passed over; -1 without one."""
        html = self.html
        if self.special is None:
            self.special = [m.start() for m in _SPECIAL.finditer(html)]
        passed, found = [], -1
        while True:
            place = bisect_left(self.special, at)
            if place == len(self.special):
                break
            at = self.special[place]
            if html[at] == ">":
                found = at
                break
            if at in self.ends:
                found = self.ends[at]
                break
            passed.append(at)
            close = html.find(html[at], at + 1)
            if close < 0:
                break
            at = close + 1
        for quote in passed:
            self.ends[quote] = found
        return found

    def __iter__(self) -> Iterator[tuple[int, int, str, str, str]]:
        """(start, end, closing tag, opening tag, attributes) of each; the caller may send the place from
        which to go on."""
        html, size, at, closed = self.html, len(self.html), 0, True
        while True:
            start = html.find("<", at)
            if start < 0:
                return
            at = start + 1
            found = _TAG.match(html, start, min(size, start + _SOON))
            if found:
                moved = yield start, found.end(), found[1] or "", found[2] or "", found[3] or ""
                at = found.end() if moved is None else moved
                continue
            second = html[at:at + 1]
            if html.startswith("<!--", start):
                close = _COMMENT_END.search(html, start + 4)
                yield start, close.end() if close else size, "", "", ""
                at = close.end() if close else size
                continue
            name = _NAME.match(html, start)
            if not name and second not in ("!", "?"):
                continue
            opens = name is not None and second != "/"
            if opens:
                end = self.end_of(name.end())
            else:
                end = html.find(">", at) if closed else -1
                closed = end >= 0
            if end < 0:
                continue
            tag = name[1] if name else ""
            moved = yield (start, end + 1, "" if opens else tag, tag if opens else "",
                           html[name.end():end] if opens else "")
            at = end + 1 if moved is None else moved


def visible_text(html: str) -> str:
    """All visible text of a page."""
    renderer = Renderer()
    builder = Builder(renderer)
    at, moved = 0, None
    tags = iter(_Tags(html))
    while True:
        try:
            start, end, closing, opening, attributes = tags.send(moved)
        except StopIteration:
            break
        moved = None
        if start > at:
            builder.text(html[at:start])
        at = end
        if closing:
            builder.end(closing.lower())
        elif opening:
            tag = opening.lower()
            builder.start(tag, attributes)
            if tag in RAW and not builder.closes_itself(attributes):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if tag in ("textarea", "xmp", "plaintext") and not builder.unseen:
                    renderer.pre += 1
                    renderer.text(unescape(html[at:stop]) if tag == "textarea" else html[at:stop])
                    renderer.pre -= 1
                at = moved = stop
                if end is None:
                    break
    if at < len(html) and not (builder.open and builder.open[-1][0] in RAW):
        builder.text(html[at:])
    while builder.open:
        builder.pop()
    return "\n".join(renderer.flows[0].done()).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars, n_lines): the visible text of every row of ``pages`` (page_id, html).

    A missing or empty page has an empty text.  Unclosed and stray tags, and tags
    in any case, are taken as HTML takes them.  Each row is a page, also where ids repeat
    or are missing.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "html"):
            texts = [visible_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column("page_id"), pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()),
            ], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "html").mapInArrow(
        run, "page_id bigint, text string, n_chars bigint, n_lines bigint")
