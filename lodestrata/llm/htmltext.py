"""Layout-aware HTML text: a tree builder with implied tags, visibility rules, and a text renderer.

The parser follows the practice of HTML rather than its letter: tags that end others by opening, end tags
that close what is open, void and raw-text elements, and broken or truncated markup as text or as nothing,
but never as an error. The renderer gives every visible text: blocks on lines of their own with blank
lines between paragraphs, list items with their bullets or numbers and indents, preformatted text as it
stands, and tables as columns padded to their widest cell.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import ship

ship(__name__)

# Fixed values of the language: element classes and what an opening tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style head title template noscript iframe noembed noframes object svg math audio video canvas datalist meta link base".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table ul".split()
)
SPACED = frozenset("p blockquote h1 h2 h3 h4 h5 h6 ul ol dl pre table figure menu dir".split())
CLOSES_P = BLOCK - frozenset("body caption html legend li dd dt summary".split()) | {"hr", "xmp"}
#: Elements that keep an item or a term from closing one around them.
SCOPES = (BLOCK - frozenset("address div p li dd dt".split())) | frozenset("table td th tr tbody thead tfoot select object".split())
SIBLINGS = {
    "li": ({"li"}, SCOPES),
    "dt": ({"dt", "dd"}, SCOPES),
    "dd": ({"dt", "dd"}, SCOPES),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Where only PARTS of a table may stand; text and other elements go before the table.
ROWS = frozenset("table thead tbody tfoot tr colgroup".split())
PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|(?P<odd>[!?][^>]*)(?:>|\Z)|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?P<shut>>|\Z)|(?P<bad_end>/)?(?P<bad_name>[A-Za-z][^\s/>]*)(?P<bad_rest>[^>]*)(?P<bad_shut>>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Spaces of indents and columns for each character of a page.
ROOM = 4
SPACE = re.compile(r"[ \t\n\r\f]+")
STYLE = re.compile(r"(?:^|;)\s*(display|visibility|content-visibility)\s*:\s*([a-z-]+)", re.I)


class Node:
    __slots__ = ("name", "attributes", "parts")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.parts = name, attributes, []


def parse(source: str) -> Node:
    """The tree of a document; its parts are nodes and strings with entities resolved."""
    root = Node("#document", {})
    stack = [root]
    where: dict[str, list[int]] = {}  # name: places of its open elements in the stack

    def deepest(names) -> int:
        """The place of the innermost open element of these names; a template hides what is around it."""
        found = max((where[n][-1] for n in names if where.get(n)), default=0)
        return found if found and not (where.get("template") and found < where["template"][-1]) else 0

    def push(node: Node) -> None:
        where.setdefault(node.name, []).append(len(stack))
        stack.append(node)

    def cut(at: int) -> None:
        """Close the elements from a place in the stack on."""
        while len(stack) > at:
            where[stack.pop().name].pop()

    def add(part: Node | str) -> None:
        """Put a part into the deepest open element, or before the table that has no place for it."""
        if stack[-1].name in ROWS and (part.strip(" \t\n\r\f") if isinstance(part, str) else part.name not in PARTS):
            at = deepest(("table",))
            if at:
                stack[at - 1].parts.insert(-1, part)  # an open table is the last part of its parent
                return
        stack[-1].parts.append(part)

    def text(s: str) -> None:
        if s:
            add(html.unescape(s))

    def back_to_table(name: str) -> None:
        """Close what stands before an open table, as its next part or another table comes."""
        row = deepest(ROWS)
        if row <= deepest(("td", "th", "caption")):
            return
        cut(row + 1)
        if name in ("caption", "colgroup", "col", "table"):
            while len(stack) > 1 and stack[-1].name in ROWS - {"table"}:
                cut(len(stack) - 1)
        if name == "table" and stack[-1].name == "table":
            cut(len(stack) - 1)

    def close_to(names: set[str], stops: set[str] | frozenset[str]) -> None:
        first = deepest(names)
        if first and first >= deepest(stops):
            while first > 1 and stack[first - 1].name in names:
                first -= 1
            cut(first)

    at = 0
    while True:
        m = TAG.search(source, at)
        if not m:
            text(source[at:])
            return root
        text(source[at : m.start()])
        at = m.end()
        # A quote that never closes does not hide the rest of the page: such a tag ends at the next bracket.
        found, ends, rest, shut = (m["name"], m["end"], m["rest"], m["shut"]) if m["name"] else (m["bad_name"], m["bad_end"], m["bad_rest"], m["bad_shut"])
        if not found:
            continue
        name = found.lower()
        if ends:
            if name == "br":
                add(Node("br", {}))
            elif name == "p" and not where.get("p"):
                add(Node("p", {}))
            else:
                bounds = {"table"} if name not in ("table", "body", "html", *SIBLINGS) else set()
                first = deepest((name,))
                if first and first >= deepest(bounds):
                    cut(first)
            continue
        if not shut:
            return root  # a tag that the end of the text cuts off
        if name in PARTS or (name == "table" and stack[-1].name in ROWS):
            back_to_table(name)
        if name in CLOSES_P:
            close_to({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if name in SIBLINGS:
            close_to(*SIBLINGS[name])
        if re.fullmatch("h[1-6]", name) and re.fullmatch("h[1-6]", stack[-1].name):
            cut(len(stack) - 1)
        if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr", {})
            stack[-1].parts.append(row)
            push(row)
        attributes = {}
        if rest.strip():
            for a in ATTRIBUTE.finditer(rest):
                value = next((v for v in a.groups()[1:] if v is not None), "")
                attributes.setdefault(a[1].lower(), html.unescape(value) if "&" in value else value)
        node = Node(name, attributes)
        add(node)
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            inside = source[at : end.start() if end else len(source)]
            node.parts.append(html.unescape(inside) if name in ("textarea", "title") else inside)
            at = end.end() if end else len(source)
            continue
        if name == "plaintext":
            node.parts.append(source[at:])
            return root
        push(node)


def style(node: Node) -> dict[str, str]:
    """The declarations of a style attribute that bear on what is seen; the last one of a name counts."""
    text = node.attributes.get("style", "")
    return {k.lower(): v.lower() for k, v in STYLE.findall(text)} if text else {}


def displayed(node: Node) -> bool:
    """Whether an element is laid out at all; what it holds can't undo a no."""
    a, said = node.attributes, style(node)
    if node.name in HIDDEN or "hidden" in a or (node.name == "input" and a.get("type", "").lower() == "hidden"):
        return False
    return said.get("display") != "none" and said.get("content-visibility") != "hidden" and not (node.name == "dialog" and "open" not in a)


def seen(node: Node, around: bool) -> bool:
    """Whether the text of an element shows: its own visibility, else that of what is around it."""
    said = style(node).get("visibility")
    return around if said not in ("visible", "hidden", "collapse") else said == "visible"


def _width(s: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s) if not s.isascii() else len(s)


class Room:
    """Spaces that indents and columns of one document may still take: ``ROOM`` for each character of its source."""

    def __init__(self, size: int):
        self.left = ROOM * size

    def spaces(self, n: int, least: int = 0) -> str:
        """``n`` spaces, or ``least`` where there is no room for them."""
        if n > self.left:
            return " " * least
        self.left -= n
        return " " * n


class Page:
    """Lines of text under construction. Space is collapsed; blank lines are owed until text comes."""

    def __init__(self, room: Room):
        self.room = room
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap, self.indent, self.mark, self.space = 0, 0, "", False

    def word(self, s: str, kept: bool = False) -> None:
        if kept:
            head, *more = s.split("\n")
            if head:
                self.put(head)
            for line in more:
                self.end(True)
                if line:
                    self.put(line)
            return
        plain = SPACE.sub(" ", s)
        if not plain:
            return
        if plain == " ":
            self.space = bool(self.parts)
            return
        if plain[0] == " " and self.parts:
            self.space = True
        self.put(plain.strip(" "))
        self.space = plain[-1] == " "

    def put(self, s: str) -> None:
        if not self.parts:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            self.parts.append(self.room.spaces(max(self.indent - len(self.mark), 0)) + self.mark)
            self.mark = ""
        elif self.space:
            self.parts.append(" ")
        self.space = False
        self.parts.append(s)

    def end(self, forced: bool = False) -> None:
        """End the line; a forced end of an empty line gives a blank one."""
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
        elif forced and self.lines:
            self.gap = max(self.gap, 1)
        self.parts, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.gap = max(self.gap, 1)


def _list_mark(node: Node, parent: Node, number: int) -> str:
    return f"{number}. " if parent.name == "ol" else "* "


def _walk(steps: Iterator) -> None:
    """Run steps that yield the steps to run before them, on a stack of their own: depth costs no recursion."""
    stack = [steps]
    while stack:
        below = next(stack[-1], None)
        if below is None:
            stack.pop()
        else:
            stack.append(below)


def _render(node: Node, page: Page, kept: bool, parent: Node, shown: bool = True) -> Iterator:
    number = 1
    if node.name == "ol":
        start = node.attributes.get("start", "")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for part in node.parts:
        if isinstance(part, str):
            if shown:
                page.word(part, kept)
            continue
        if not displayed(part):
            continue
        name, mine = part.name, seen(part, shown)
        if name in ("br", "hr", "img", "input") and not mine:
            continue
        if name == "br":
            page.end(True)
        elif name == "hr":
            page.block(True)
            page.put("---")
            page.block(True)
        elif name == "img":
            if part.attributes.get("alt", "").strip():
                page.word(f" {part.attributes['alt']} ")
        elif name == "input":
            if part.attributes.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel", "number"):
                page.word(f" {part.attributes.get('value', '')} ")
        elif name == "table":
            page.block(True)
            yield _table(part, page, mine)
            page.block(True)
        elif name == "li":
            page.block(False)
            mark = _list_mark(part, node, number)
            value = part.attributes.get("value", "")
            if node.name == "ol" and re.fullmatch(r"-?\d{1,9}", value):
                number = int(value)
                mark = f"{number}. "
            number += 1
            old = page.indent
            page.indent, page.mark = old + len(mark), mark if mine else ""
            yield _render(part, page, kept, node, mine)
            page.block(False)
            page.indent, page.mark = old, ""
        elif name in BLOCK:
            page.block(name in SPACED and not (name in ("ul", "ol", "menu", "dir") and node.name == "li"))
            old = page.indent
            if name in ("blockquote", "dd"):
                page.indent = old + 4
            yield _render(part, page, kept or name == "pre", node, mine)
            page.indent = old
            page.block(name in SPACED and not (name in ("ul", "ol", "menu", "dir") and node.name == "li"))
        elif name == "q":
            if mine:
                page.word('"')
            yield _render(part, page, kept, node, mine)
            if mine:
                page.word('"')
        elif name in ("option", "textarea", "xmp", "plaintext", "tr", "td", "th", "optgroup"):
            page.block(False)
            yield _render(part, page, kept or name in ("textarea", "xmp", "plaintext"), node, mine)
            page.block(False)
        else:
            yield _render(part, page, kept, node, mine)


def _span(value: str, most: int) -> int:
    return min(max(int(value), 1), most) if re.fullmatch(r"\d{1,6}", value) else 1


def _table(table: Node, page: Page, shown: bool) -> Iterator:
    """Rows on lines, columns padded to their widest cell; spans take the columns that they cover.

    Where the padding would take more room than the document has left, cells stand two spaces apart.

    What may not stand in a table, a row group or a row comes before the table, in its order.
    """
    captions: list[Node] = []
    groups: dict[str, list[tuple[Node, bool]]] = {"thead": [], "": [], "tfoot": []}

    loose = Node("div", {})

    def gather(node: Node, group: str, around: bool) -> None:
        for part in node.parts:
            if isinstance(part, str):
                if part.strip():
                    loose.parts.append(part)
            elif part.name in ("tr", "thead", "tbody", "tfoot", "caption"):
                if not displayed(part):
                    continue
                if part.name == "tr":
                    groups[group].append((part, seen(part, around)))
                    loose.parts += [p for p in part.parts if (p.strip() if isinstance(p, str) else p.name not in ("td", "th"))]
                elif part.name == "caption":
                    captions.append(part)
                else:
                    gather(part, part.name if part.name in groups else "", seen(part, around))
            elif part.name == "colgroup":
                gather(part, group, around)
            elif part.name != "col":
                loose.parts.append(part)

    gather(table, "", shown)
    for part in [loose, *captions]:
        yield _render(part, page, False, table, seen(part, shown))
        page.block(False)
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: list[tuple[int, int, int]] = []  # from, to, and the last row: columns that cells above cover
    for at, (row, around) in enumerate([*groups["thead"], *groups[""], *groups["tfoot"]]):
        cells: dict[int, tuple[list[str], int]] = {}
        taken = [t for t in taken if t[2] >= at]
        column, passed, more = 0, 0, []
        for cell in row.parts:
            if isinstance(cell, str) or cell.name not in ("td", "th") or not displayed(cell):
                continue
            while passed < len(taken) and taken[passed][0] <= column:
                column, passed = max(column, taken[passed][1]), passed + 1
            inner = Page(page.room)
            yield _render(cell, inner, False, row, seen(cell, around))
            inner.end()
            wide = _span(cell.attributes.get("colspan", ""), 1000)
            deep = _span(cell.attributes.get("rowspan", ""), 65534)
            cells[column] = (inner.lines, wide)
            if deep > 1:
                more.append((column, column + wide, at + deep - 1))
            column += wide
        if more:
            taken = sorted([*taken, *more])
        if any(lines for lines, _ in cells.values()):
            grid.append(cells)
    # Nothing stands right of the last column, so its width is of no matter.
    columns = sorted({c for cells in grid for c in cells})
    widths = dict.fromkeys(columns, 0)
    for cells in grid:
        for c, (lines, wide) in cells.items():
            if wide == 1 and lines and c != columns[-1]:
                widths[c] = max(widths[c], *map(_width, lines))
    for cells in grid:  # a cell over several columns widens the last of them where it must
        for c, (lines, wide) in sorted(cells.items()):
            if wide > 1 and lines and c + wide <= columns[-1]:
                over = columns[bisect_left(columns, c) : bisect_left(columns, c + wide)]
                lack = max(map(_width, lines)) - sum(widths[k] for k in over) - 2 * (len(over) - 1)
                if lack > 0:
                    widths[over[-1]] += lack
    offsets, at = {}, 0
    for c in columns:
        offsets[c] = at
        at += widths[c] + 2
    for cells in grid:
        placed = sorted(cells.items())
        for i in range(max(len(lines) for lines, _ in cells.values())):
            out, used = [], 0
            for c, (lines, _) in placed:
                if i < len(lines) and lines[i]:
                    gap = page.room.spaces(max(offsets[c] - used, 2 if out else 0), 2 if out else 0)
                    out += [gap, lines[i]]
                    used += len(gap) + _width(lines[i]) if c != columns[-1] else 0
            page.put("".join(out) or " ")
            page.end()


def render(source: str | None) -> str:
    """The visible text of a document; null and empty documents give an empty text."""
    if not source:
        return ""
    page = Page(Room(len(source)))
    _walk(_render(parse(source), page, False, Node("#none", {})))
    page.end()
    return "\n".join(page.lines).replace("\x00", "")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text), one row for each page, in place and without a shuffle.

    A null document gives an empty text; so does one without visible text. A document may have any length
    and depth, and break any rule of the language. Indents and columns take at most ``ROOM`` spaces for each
    character of the document, so a text grows in proportion to its page; beyond, lines start at the margin and
    cells stand two spaces apart. Rows that repeat a page_id, or have none, keep a row
    each, in no order. Only page_id and html are read, so other columns may have any name.
    """

    @F.pandas_udf("string")
    def of(source: pd.Series) -> pd.Series:
        return source.map(render, na_action=None)

    return pages.select("page_id", of(F.col("html").cast("string")).alias("text"))
