"""HTML extraction: a tree builder with implied tags, and a layout-aware renderer of all visible text.

The tree builder reads tags, texts and comments one after another, closes what an opening tag implies to be closed
(a paragraph before a block, a list item before its sibling, cells and rows before the next) and ignores closing tags
that match nothing. The renderer walks the tree. What isn't displayed (by tag, hidden attribute, style, or as a dialog that
isn't open) is left out with all it holds; what a style makes invisible is left out but for descendants that a style makes visible again.
What aria-hidden hides from screen readers only is on the page, and kept, as are formulas, texts of drawings, the
options of lists and what closed details hold. Blocks stand on lines of their own, paragraphs and headings with a blank line between; list
items get "- " or their number, indented by depth; tables become rows of cells padded to their columns' widths, with two
spaces between, a cell over several columns or rows taking as many, and wide characters counting two; preformatted text keeps its spaces. All
visible text is kept, menus and footers too.

Style sheets are not applied: what only a rule of theirs hides is kept. Values of input fields are left out.

Both work without recursion, and in time in proportion to the page however deep it is: an open element is found by its tag, indentation
ends at MOST_INDENT columns, and tables within MOST_TABLES others are plain blocks. Edge cases: null and empty pages give an empty
text, as do pages without visible text. Unclosed tags, comments and raw text end with the page. Rows are independent
of each other, so repeated rows get the same text each. Columns to keep may have any names, but text is this one's; other
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from unicodedata import combining, east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import named

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe object audio video canvas datalist noembed noframes rp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure".split())
BLOCK = SPACED | frozenset("html body address article aside dd details dialog div dt fieldset figcaption footer form header hgroup hr li main nav section summary center optgroup option tr caption thead tbody tfoot td th legend menu".split())
ENDS_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt summary".split())
#: What drawings and formulas don't show; elsewhere these are tags like others.
FOREIGN = {"svg": frozenset("desc metadata defs symbol".split()), "math": frozenset("annotation annotation-xml".split())}
#: An opening tag closes these open elements, as far up as one of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("table td th caption button object html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
#: Elements that collapse takes away; others it makes invisible.
COLLAPSES = frozenset("tr thead tbody tfoot col colgroup".split())
#: The largest spans that HTML allows.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
#: Lists deeper than this many columns are indented no further; tables within so many others are blocks, without columns.
MOST_INDENT, MOST_TABLES = 400, 64
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", s, ""), ("open", tag, attributes) and ("close", tag, "") in their order."""
    at, size = 0, len(page)
    while at < size:
        found = _TOKEN.search(page, at)
        if found is None:
            yield "text", page[at:], ""
            return
        if found.start() > at:
            yield "text", page[at : found.start()], ""
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                yield "text", found[0][9:].removesuffix("]]>"), ""
            continue
        tag = found[2].lower()
        if found[1]:
            yield "close", tag, ""
            continue
        yield "open", tag, found[3]
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(page, at)
            if end.start() > at:
                yield "text", page[at : end.start()], ""
            yield "close", tag, ""
            at = end.end()


def tree(page: str) -> Node:
    root = Node("#root", {})
    stack = [root]
    places: defaultdict[str, list[int]] = defaultdict(list)  # by tag: where its open elements stand in the stack
    foreign = False  # whether a drawing or formula has begun

    def last(tags: set[str] | frozenset[str] | tuple[str, ...]) -> int:
        at = 0
        for t in tags:
            if (open_at := places.get(t)) and open_at[-1] > at:
                at = open_at[-1]
        return at

    def close_from(at: int) -> None:
        while len(stack) > at:
            places[stack.pop().tag].pop()

    def close_up_to(tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        """Closes the open elements down to the outermost of tags that lies above no barrier."""
        at = last(tags)
        if at and at > last(barrier):
            while at > 1 and stack[at - 1].tag in tags:
                at -= 1
            close_from(at)

    for kind, value, rest in tokens(page):
        if kind == "text":
            stack[-1].children.append(value if stack[-1].tag in ("script", "style") else unescape(value))
        elif kind == "open":
            if value in ENDS_P and places["p"]:
                close_up_to({"p"}, SCOPE)
            if value in IMPLIED:
                close_up_to(*IMPLIED[value])
            attributes = {}
            if rest and "=" in rest or "hidden" in rest or value in ("dialog", "ol"):
                attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)}
            foreign = foreign or value in FOREIGN
            around = {x for x in FOREIGN if places[x]} if foreign else ()
            if any(value in FOREIGN[x] for x in around):
                attributes["hidden"] = ""
            node = Node(value, attributes)
            stack[-1].children.append(node)
            if "svg" in around and value == "text":  # a text of a drawing has a place of its own
                node.attributes["block"] = ""
            if value not in VOID and not ((around or value in FOREIGN) and rest.endswith("/")):
                places[value].append(len(stack))
                stack.append(node)
        elif value == "br" or value == "p" and not places["p"]:
            stack[-1].children.append(Node(value, {}))
        elif places[value]:
            at = places[value][-1]
            if value in ("table", "tr", "tbody", "thead", "tfoot", "td", "th") or at > last(("table", "td", "th")):
                close_from(at)
    return root


def displayed(node: Node) -> bool:
    """Whether the element takes part in the layout at all."""
    if node.tag in HIDDEN or "hidden" in node.attributes or node.tag == "input":
        return False
    if node.tag == "dialog" and "open" not in node.attributes:
        return False
    style = node.attributes.get("style")
    return not style or not (_NO_DISPLAY.search(style) or node.tag in COLLAPSES and _visibility(style) == "collapse")


def _visibility(style: str) -> str | None:
    found = _VISIBILITY.findall(style)
    return found[-1].lower() if found else None


def shown(node: Node, around: bool) -> bool:
    """Whether the element's own text is visible, in an element where it is or not."""
    style = node.attributes.get("style")
    own = _visibility(style) if style else None
    return around if own is None else own == "visible"


class _Page:
    """Lines of text under construction. A block asks for blank lines above and below; the larger wish counts."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0
        self.indent = 0
        self.mark = ""

    def text(self, s: str, pre: bool) -> None:
        if pre:
            first, *more = s.split("\n")
            if first:
                self.now.append(first)
            for line in more:
                self.line(keep=True)
                if line:
                    self.now.append(line)
            return
        s = _SPACES.sub(" ", s)
        if s == " ":
            if self.now and not self.now[-1].endswith(" "):
                self.now.append(s)
        elif s:
            self.now.append(s.lstrip(" ") if not self.now or self.now[-1].endswith(" ") else s)

    def line(self, keep: bool = False) -> None:
        """Ends the current line; an empty one stands only if keep."""
        s = "".join(self.now).rstrip(" ")
        self.now = []
        if not s and not keep:
            return
        if self.lines and self.gap > 1 and self.lines[-1]:
            self.lines.append("")
        self.gap = 0
        if s:
            s = " " * min(self.indent - len(self.mark), MOST_INDENT) + self.mark + s
            self.mark = ""
        self.lines.append(s)

    def block(self, spaced: bool) -> None:
        self.line()
        self.gap = max(self.gap, 2 if spaced else 1)

    def done(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def _span(cell: Node, name: str, most: int) -> int:
    given = cell.attributes.get(name, "").strip()
    return max(1, min(int(given[:10]), most)) if given.isascii() and given.isdigit() else 1


def _number(node: Node, name: str, otherwise: int) -> int:
    given = node.attributes.get(name, "")
    return int(given) if re.fullmatch(r"-?\d{1,9}", given) else otherwise


def _table_rows(table: Node, around: bool) -> list[list[tuple[Node, bool]]]:
    """The cells of a table's own rows, and whether their rows are visible; stray displayed children become rows of one cell."""
    rows: list[list[tuple[Node, bool]]] = []
    todo = [(c, around) for c in reversed(table.children)]

    def wrapped(child: Node | str) -> Node:
        cell = Node("td", {})
        cell.children = [child]
        return cell

    while todo:
        node, seen = todo.pop()
        if isinstance(node, str):
            if node.strip() and seen:
                rows.append([(wrapped(node), seen)])
        elif not displayed(node):
            continue
        elif node.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += [(c, shown(node, seen)) for c in reversed(node.children)]
        elif node.tag == "tr":
            seen, cells = shown(node, seen), []
            for c in node.children:
                if isinstance(c, str):
                    if c.strip():
                        cells.append((wrapped(c), seen))
                elif displayed(c):
                    cells.append((c if c.tag in ("td", "th") else wrapped(c), seen))
            rows.append(cells)
        elif node.tag != "col":
            rows.append([(node if node.tag in ("td", "th", "caption") else wrapped(node), seen)])
    return rows


def width(s: str) -> int:
    """Columns that s takes in a font of even width: two for wide characters, none for combining ones."""
    return len(s) if s.isascii() else sum(0 if combining(c) else 2 if east_asian_width(c) in "WF" else 1 for c in s)


def aligned(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Lines of rows of (text, columns, rows) cells, padded to their columns' widths; a cell may have several lines.

    A cell of 0 columns stands above or below them, whatever their widths.
    """
    grid: list[list[tuple[int, list[str], int]]] = []  # first column, lines, columns
    taken: dict[int, int] = {}  # column: rows that a cell from above still takes
    for cells in rows:
        at, placed, new = 0, [], {}
        for text, columns, depth in cells:
            while taken.get(at, 0):
                at += 1
            placed.append((at, text.split("\n"), columns))
            if depth > 1:
                new |= dict.fromkeys(range(at, at + columns), depth - 1)
            at += columns
        taken = {c: n - 1 for c, n in taken.items() if n > 1} | new
        grid.append(placed)
    widths: dict[int, int] = {}
    for spanning in (False, True):  # what spans several columns widens the last of them, if need be
        for at, lines, columns in (cell for placed in grid for cell in placed if cell[2] and (cell[2] > 1) == spanning):
            need = max(map(width, lines))
            last = at + columns - 1
            widths[last] = max(widths.get(last, 0), need - sum(widths.get(c, 0) + 2 for c in range(at, last)))
    starts, x = {}, 0
    for c in range(max(widths, default=-1) + 1):
        starts[c] = x
        x += max(widths.get(c, 0), 0) + 2
    out = []
    for placed in grid:
        for k in range(max((len(lines) for _, lines, _ in placed), default=0)):
            line, used = [], 0
            for at, lines, _ in placed:
                if k < len(lines) and lines[k]:
                    line.append(" " * (starts[at] - used) + lines[k])
                    used = max(starts[at], used) + width(lines[k])
            out.append("".join(line).rstrip(" "))
    return [line for line in out if line]


def render(root: Node) -> str:
    """The visible text of a tree."""
    # Work items: a string, a node to enter, or a function to call on the way out.
    pages = [_Page()]
    pre = [False]
    seen = [True]
    lists: list[list] = []
    todo: list = [root]

    def leave_block(spaced: bool):
        return lambda: pages[-1].block(spaced)

    def leave_item(indent: int):
        def out() -> None:
            pages[-1].block(False)
            pages[-1].indent, pages[-1].mark = indent, ""

        return out

    def enter_cell(cell: Node, around: bool):
        def out() -> None:
            pages.append(_Page())
            seen.append(shown(cell, around))
            todo.append(leave_cell(cell))
            todo.extend(reversed(cell.children))

        return out

    def leave_cell(cell: Node):
        def out() -> None:
            seen.pop()
            done = pages.pop().done()
            columns = 0 if cell.tag == "caption" else _span(cell, "colspan", MOST_COLUMNS)
            tables[-1][-1].append((done, columns, _span(cell, "rowspan", MOST_ROWS)))

        return out

    tables: list[list[list[tuple[str, int, int]]]] = []

    def leave_table() -> None:
        page = pages[-1]
        for line in aligned(tables.pop()):
            page.now.append(line)
            page.line()
        page.block(True)

    while todo:
        item = todo.pop()
        if isinstance(item, str):
            if seen[-1]:
                pages[-1].text(item, pre[-1])
            continue
        if callable(item):
            item()
            continue
        if not displayed(item):
            continue
        if (own := shown(item, seen[-1])) != seen[-1]:
            seen.append(own)
            todo.append(lambda: seen.pop())
        page, tag = pages[-1], item.tag
        if tag == "br":
            page.line(keep=True)
        elif tag == "img":
            if item.attributes.get("alt") and seen[-1]:
                page.text(item.attributes["alt"], False)
        elif tag == "table" and len(tables) < MOST_TABLES:
            page.block(True)
            rows = _table_rows(item, seen[-1])
            tables.append([])
            todo.append(leave_table)
            for cells in reversed(rows):
                for cell, around in reversed(cells):
                    todo.append(enter_cell(cell, around))
                todo.append(lambda: tables[-1].append([]))
        elif tag == "pre":
            page.block(True)
            pre.append(True)
            todo += [leave_block(True), lambda: pre.pop(), *reversed(item.children)]
        elif tag in ("ul", "ol", "menu"):
            page.block(not lists)
            turned = tag == "ol" and "reversed" in item.attributes
            first = sum(isinstance(c, Node) and c.tag == "li" for c in item.children) if turned else 1
            lists.append([tag == "ol", _number(item, "start", first), -1 if turned else 1])
            todo += [leave_block(len(lists) == 1), lambda: lists.pop(), *reversed(item.children)]
        elif tag == "li":
            page.block(False)
            mark = "- "
            if lists and lists[-1][0]:
                number = _number(item, "value", lists[-1][1])
                mark = f"{number}. "
                lists[-1][1] = number + lists[-1][2]
            todo.append(leave_item(page.indent))
            page.indent, page.mark = page.indent + len(mark), mark
            todo.extend(reversed(item.children))
        elif tag in BLOCK or tag == "text" and "block" in item.attributes:
            page.block(tag in SPACED)
            if tag == "optgroup" and item.attributes.get("label") and seen[-1]:
                page.text(item.attributes["label"], False)
                page.line()
            todo.append(leave_block(tag in SPACED))
            todo.extend(reversed(item.children))
        else:
            todo.extend(reversed(item.children))
    return pages[0].done()


def visible_text(page: str | None) -> str:
    return render(tree(page)) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns of keep, and text of each row."""
    names = [id_col, *(c for c in keep if c not in (id_col, "text"))]
    rows = pages.select(*[named(c).alias(f"c{i}") for i, c in enumerate(names)], named(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([visible_text(x) for x in b.column("html").to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=[*b.schema.names[:-1], "text"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, text string").toDF(*names, "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
