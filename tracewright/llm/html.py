"""HTML to text by layout: a tree with implied tags, and a renderer that keeps blocks, lists and table columns.

The tree builder reads tags, text and references, closes what the next tag implies to be
closed (``p`` before a block, ``li`` before ``li``, cells before cells, ...), ignores end
tags without a start, and reads raw text elements up to their end tag; elements may nest to any depth. The renderer
leaves out elements that are never shown (scripts, styles, head data,
``hidden``, ``display:none``) and text under ``visibility:hidden`` that no inner ``visible`` shows again, and writes *all* other text: blocks
on lines of their own (blank lines around paragraphs and headings), list items with a dash
or a number under their indent, table cells padded to their columns (``colspan`` and ``rowspan`` hold
columns and rows; text wraps at ``WIDEST`` columns, and a longer word pushes the cells behind it in its line alone), preformatted text as it stands. White
space elsewhere shrinks to one blank.

Defined cases: null or empty markup gives empty text; unclosed and misnested markup, stray
``<`` and unknown references are text or ignored as above, never an error (after a tag whose
quotes never close, ``>`` ends tags inside quotes too); ids may be null
or repeated, each row gives one; an empty table gives an empty table; only the id and markup columns are read, so other columns
can't clash; very long pages are taken whole, in time linear in the markup but for the padding of tables.
"""

from __future__ import annotations

import html as references
import re
import sys
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Columns at which the text of a cell wraps.
WIDEST = 200
#: The largest spans of a cell, as in the standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Never shown. ``title`` is the window's, not the page's.
UNSEEN = frozenset("script style head title template noscript iframe noembed noframes object audio video canvas svg math datalist meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure hr menu".split())
BLOCKS = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main nav option search section summary tr td th thead tbody tfoot caption".split())
#: A start tag -> the open elements it closes, and the elements beyond which it doesn't look.
_CELL, _ROW = frozenset(("td", "th")), frozenset(("tr",))
_PART = frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))
IMPLIED = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELL, frozenset(("tr", "table"))),
    "th": (_CELL, frozenset(("tr", "table"))),
    "tr": (_CELL | _ROW | {"caption", "colgroup"}, frozenset(("table",))),
    **{t: (_CELL | _ROW | _PART, frozenset(("table",))) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset(("head",)), frozenset()),
}
#: What an end tag of an inner element can't close.
FENCES = {"li": {"ul", "ol", "menu"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "dt": {"dl"}, "dd": {"dl"}}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?", re.S)
#: The same without quotes, for what follows a tag that never ends: keeps the time linear.
PLAIN_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)>|<[!?/][^>]*>?", re.S)
UNENDED = re.compile(r"<[A-Za-z/]")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
HIDING = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)", re.I)
#: Set apart by a blank on either side.
APART = frozenset("button select option".split())
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element: whether it is shown, whether its own text is visible, an ordered list's first number, an item's number, a cell's spans."""

    __slots__ = ("children", "columns", "number", "rows", "shown", "start", "tag", "visible")

    def __init__(self, tag: str, visible: bool = True):
        self.tag, self.visible, self.children = tag, visible, []
        self.shown, self.start, self.number, self.columns, self.rows = tag not in UNSEEN, 1, None, 1, 1


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)}


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"\s*-?[0-9]{1,9}\s*", text) else None


def _element(tag: str, raw: str, visible: bool) -> Node:
    """An element by its tag and attributes, under one whose text is visible or not."""
    node = Node(tag, visible)
    if not node.shown or not raw or raw.isspace():
        return node
    at = _attributes(raw)
    style = at.get("style", "")
    node.shown = "hidden" not in at and not HIDING.search(style) and not (tag == "input" and at.get("type", "").lower() == "hidden")
    if own := VISIBILITY.findall(style):
        node.visible = own[-1].lower() == "visible"
    if tag == "ol":
        node.start = 1 if (n := _number(at.get("start"))) is None else n
    elif tag == "li":
        node.number = _number(at.get("value"))
    elif tag in _CELL:
        node.columns = min(max(_number(at.get("colspan")) or 1, 1), MOST_COLUMNS)
        node.rows = min(max(_number(at.get("rowspan")) or 1, 1), MOST_ROWS)
    return node


class Open:
    """The open elements, outermost first, with a count of each tag: what isn't open needs no search."""

    def __init__(self, root: Node):
        self.nodes, self.count = [root], Counter()

    def push(self, node: Node) -> None:
        self.nodes[-1].children.append(node)
        self.nodes.append(node)
        self.count[node.tag] += 1

    def cut(self, at: int) -> None:
        for node in self.nodes[at:]:
            self.count[node.tag] -= 1
        del self.nodes[at:]

    def has(self, tags) -> bool:
        return any(self.count[t] for t in tags)

    def close(self, tags: frozenset | set, fences: frozenset | set, every: bool = False) -> None:
        """Closes the innermost of ``tags``, or every one, up to a fence, with what is inside."""
        i = len(self.nodes) - 1
        while i > 0 and self.nodes[i].tag not in fences and self.has(tags):
            if self.nodes[i].tag in tags:
                self.cut(i)
                if not every:
                    return
            i -= 1


def parse(markup: str) -> Node:
    """The tree of a page."""
    root = Node("#root")
    open_ = Open(root)
    at, size, last = 0, len(markup), markup.rfind(">")
    find = MARKUP.search

    def add_text(raw: str) -> None:
        if raw and open_.nodes[-1].visible:
            open_.nodes[-1].children.append(references.unescape(raw) if "&" in raw else raw)

    while at < size:
        m = find(markup, at) if at <= last else None
        stray = UNENDED.search(markup, at, m.start() if m else size) if find == MARKUP.search else None
        if stray and stray.start() < last:
            find = PLAIN_MARKUP.search
            m = find(markup, at)
        if m is None:
            add_text(markup[at:])
            break
        add_text(markup[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "p" and not open_.count["p"]:
                open_.nodes[-1].children.append(Node("p"))
                continue
            open_.close({tag}, FENCES.get(tag, frozenset()) | (_CELL if tag not in ("table", "tr", "td", "th", "thead", "tbody", "tfoot", "body", "html") else set()))
            continue
        if tag in BLOCKS and tag not in ("html", "body", "option"):
            open_.close({"p"}, frozenset(("td", "th", "li", "div", "blockquote", "button")))
        if tag in IMPLIED:
            open_.close(*IMPLIED[tag], every=True)
        if tag in _CELL and open_.has(("table", "tr")) and next(x.tag for x in reversed(open_.nodes) if x.tag in ("table", "tr")) == "table":
            open_.push(Node("tr", open_.nodes[-1].visible))
        node = _element(tag, m[3], open_.nodes[-1].visible)
        if tag in RAW:
            open_.nodes[-1].children.append(node)
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(markup, at)
            if tag in ("textarea", "xmp") and node.visible:
                node.children.append(references.unescape(markup[at : end.start() if end else size]))
            at = end.end() if end else size
        elif tag in VOID or m[3].endswith("/"):
            open_.nodes[-1].children.append(node)
        else:
            open_.push(node)
    return root


class Lines:
    """Text as lines, with pending blanks and blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank, self.gap = False, False

    def text(self, raw: str) -> None:
        words = BLANKS.split(raw)
        if words == ["", ""] or words == [""]:
            self.blank = self.blank or bool(raw)
            return
        if words[0] == "" or self.blank:
            if self.parts:
                self.parts.append(" ")
        self.blank = words[-1] == ""
        self.parts.append(" ".join(w for w in words if w))

    def end_line(self, always: bool = False) -> None:
        if self.parts or always:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines.append("".join(self.parts))
            self.parts = []
        self.blank = False

    def whole(self, lines: list[str]) -> None:
        """Finished lines as they are."""
        self.end_line()
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += lines

    def space(self) -> None:
        self.end_line()
        self.gap = True


def columns_of(text: str) -> int:
    """Columns that a text takes; wide characters take two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _rows(node: Node, out: list[list[Node]], others: list[Node]) -> None:
    for x in node.children:
        if isinstance(x, str):
            if x.strip():
                others.append(x)
        elif not x.shown:
            continue
        elif x.tag == "tr":
            out.append([c for c in x.children if isinstance(c, Node) and c.shown and c.tag in ("td", "th")])
            others += [c for c in x.children if (c.strip() if isinstance(c, str) else c.shown and c.tag not in ("td", "th"))]
        elif x.tag in _PART:
            if x.tag == "caption":
                others.append(x)
            else:
                _rows(x, out, others)
        else:
            others.append(x)


def _wrapped(lines: list[str]) -> list[str]:
    """Lines cut between words at WIDEST columns."""
    out = []
    for line in lines:
        if columns_of(line) <= WIDEST:
            out.append(line)
            continue
        part, width = [], 0
        for word in line.split(" "):
            n = columns_of(word)
            if part and width + 1 + n > WIDEST:
                out.append(" ".join(part))
                part, width = [], 0
            width += n + bool(part)
            part.append(word)
        out.append(" ".join(part))
    return out


def _placed(rows: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """First and last column (of those in which a cell begins) of each cell of each row; rows leave out what spans from above."""
    held: dict[int, int] = {}  # column -> rows it is taken for
    grid = []
    for row in rows:
        at, placed, below = 0, [], {}
        for cell in row:
            while held.get(at, 0):
                at += 1
            placed.append((at, at + cell.columns - 1, cell))
            if cell.rows > 1:
                below.update(dict.fromkeys(range(at, at + cell.columns), cell.rows))
            at += cell.columns
        grid.append(placed)
        held = {c: n - 1 for c, n in held.items() if n > 1} | {c: n - 1 for c, n in below.items()}
    starts = sorted({a for row in grid for a, _, _ in row})
    number = {a: i for i, a in enumerate(starts)}
    return [[(number[a], bisect_right(starts, b) - 1, cell) for a, b, cell in row] for row in grid]


def _table(node: Node) -> list[str]:
    """Captions and strays, then the rows: each cell's lines padded to its columns."""
    rows: list[list[Node]] = []
    others: list[Node] = []
    _rows(node, rows, others)
    head = Lines()
    for x in others:
        if isinstance(x, str):
            head.text(x)
        else:
            _render(x, head, False)
    head.end_line()
    cells = []
    for row in _placed(rows):
        cells.append([])
        for a, b, cell in row:
            cells[-1].append((a, b, _wrapped(_block(cell))))
    widths: Counter = Counter()
    need = lambda lines: max((w for w in map(columns_of, lines) if w <= WIDEST), default=0)
    for a, b, lines in sorted((c for row in cells for c in row), key=lambda c: c[1] - c[0]):
        # A spanning cell widens its last column by what the others lack.
        widths[b] = max(widths[b], need(lines) - sum(widths[i] + 2 for i in range(a, b)))
    start, at = {}, 0
    for i in range(max((b for row in cells for _, b, _ in row), default=-1) + 1):
        start[i] = at
        at += widths[i] + 2
    out = list(head.lines)
    for row in cells:
        for j in range(max((len(lines) for _, _, lines in row), default=0)):
            line, done = [], 0
            for a, _, lines in row:
                if j < len(lines) and lines[j]:
                    gap = max(start[a] - done, 2 if done else 0)
                    line.append(" " * gap + lines[j])
                    done += gap + columns_of(lines[j])
            out.append("".join(line).rstrip(" "))
    return out


def _block(node: Node) -> list[str]:
    inner = Lines()
    _inside(node, inner, False)
    inner.end_line()
    return inner.lines


def _inside(node: Node, to: Lines, pre: bool) -> None:
    for x in node.children:
        if isinstance(x, str):
            to.text(x)
        else:
            _render(x, to, pre)


def _render(node: Node, to: Lines, pre: bool) -> None:
    if not node.shown:
        return
    tag = node.tag
    if tag == "br":
        to.end_line(always=True)
    elif tag == "hr":
        to.space()
    elif tag == "table":
        to.space()
        to.whole(_table(node))
        to.space()
    elif tag in ("ul", "ol", "menu", "dir"):
        to.space() if not to.lines or to.parts or not pre else None
        number = node.start
        for x in node.children:
            if isinstance(x, str):
                to.text(x)
            elif x.tag == "li" and x.shown:
                number = number if x.number is None else x.number
                mark = f"{number}. " if tag == "ol" else "- "
                number += 1
                lines = [line for line in _block(x) if line] if x.children else []
                to.whole([(mark if i == 0 else " " * len(mark)) + line for i, line in enumerate(lines)])
            else:
                _render(x, to, pre)
        to.space()
    elif tag in ("pre", "textarea", "xmp"):
        to.space()
        to.whole("".join(_plain(node, [])).strip("\n").split("\n"))
        to.space()
    elif tag == "dd":
        to.whole(["  " + line for line in _block(node)])
    elif tag in _CELL or tag in APART:  # a cell outside a table
        to.text(" ")
        _inside(node, to, pre)
        to.text(" ")
    else:
        block = tag in BLOCKS
        if tag in SPACED:
            to.space()
        elif block:
            to.end_line()
        _inside(node, to, pre)
        if tag in SPACED:
            to.space()
        elif block:
            to.end_line()


def _plain(node: Node, out: list[str]) -> list[str]:
    """Preformatted text; inner blocks begin and end lines."""

    def begin_line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for x in node.children:
        if isinstance(x, str):
            if x:
                out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x.shown:
            if x.tag in BLOCKS:
                begin_line()
            _plain(x, out)
            if x.tag in BLOCKS:
                begin_line()
    return out


def _depth(root: Node) -> int:
    """How deep elements nest."""
    depth, level = 0, [root]
    while level:
        depth, level = depth + 1, [c for x in level for c in x.children if isinstance(c, Node)]
    return depth


def render(markup: str | None) -> str:
    """The visible text of a page."""
    if not markup:
        return ""
    root, out, limit = parse(markup), Lines(), sys.getrecursionlimit()
    # A few calls for each level.
    if (need := 6 * _depth(root) + 500) > limit:
        sys.setrecursionlimit(need)
    try:
        _render(root, out, False)
    finally:
        sys.setrecursionlimit(limit)
    out.end_line()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``page_id, text`` of every row."""
    common.small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(render, batch.column(1).to_pylist())), pa.string())], ["page_id", "text"])

    return rows.mapInArrow(run, f"page_id {rows.schema['page_id'].dataType.simpleString()}, text string")


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
