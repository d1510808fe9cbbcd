"""HTML extraction: layout-aware rendering.

A tree builder turns tags into a tree, with implied end tags (p, li, td, tr, option, dt, dd), end tags that reach no further than their
scope, and a stray </p> that begins a line; visibility rules drop what a browser never paints (head, script, style,
template, comments, what is not displayed, closed dialogs, all of a closed details but its summary, the fallback content of iframes and
of scripts) and text that is invisible, which visible descendants are not; the renderer then emits all visible text: blocks on lines of
their own with a blank line round paragraphs and headings, list items with bullets or numbers (start, value, reversed), indented by
depth, table cells in aligned columns (rowspan and colspan), pre text as it stands, br as a line break, both in cells too. Of
declarations of a style the last counts, or the last important one; a style's display outweighs hidden. aria-hidden says nothing
about what is painted. Options of a select, text of svg and math, and the text of a textarea are painted.

A column of a table but the last is as wide as its widest line, at most WIDEST characters and at most SPREAD times the mean (or LEAST);
longer cells are wrapped between words within their column, a longer word hangs over. Where padding would still exceed SPREAD times the
table's text, its cells stand side by side without padding, so that the output is linear in the page.

Cases: null and empty html give an empty text. Unclosed and stray tags never lose text; what stands in a table outside its cells comes
before it; quotes only hold a tag open after an equals sign. Nesting may have any depth: nothing here recurses, and an end tag is
matched in constant time. Repeated rows get equal rows; other columns play no part.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from .common import per_row

#: Characters that a padded column may have, how far it may exceed the mean of its cells, and what it may have anyhow.
WIDEST, SPREAD, LEAST = 80, 8, 20
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=(?:\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)))?)*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*)))?""")
_DECLARATION = re.compile(r"(?i)(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)")
_COMMENT = re.compile(r"(?s)/\*.*?\*/")
_SPACE = re.compile(r"[ \t\n\r\f]+")
# Names of HTML elements by how they are laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea iframe title xmp plaintext".split())
UNSEEN = frozenset("head script style noscript template iframe datalist title".split())
FOREIGN = frozenset("svg math".split())
CONTROL = frozenset("option optgroup select textarea button".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre listing xmp plaintext ul ol dl table figure hr article section".split())
BLOCK = SPACED | frozenset("html body div main header footer nav aside address form fieldset figcaption details summary dialog li dt dd tr caption center legend".split())
CLOSED_BY = {
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]), "option": frozenset(["option"]), "tbody": frozenset(["thead", "tbody", "tr", "td", "th"]), "tfoot": frozenset(["tbody", "thead", "tr", "td", "th"]),
}
_HOLDERS = frozenset("table td th caption blockquote section article aside header footer nav main fieldset form details figure button pre".split())
#: An implied end tag does not reach beyond these.
BOUND = {"li": _HOLDERS | frozenset(["ul", "ol"]), "dt": _HOLDERS | frozenset(["dl"]), "dd": _HOLDERS | frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["tr", "table"]), "th": frozenset(["tr", "table"]), "tbody": frozenset(["table"]), "tfoot": frozenset(["table"])}
#: An end tag does not reach beyond these, unless it is a table's, a section's or a row's; those of text-level elements not beyond a list item either.
SCOPE = frozenset("table td th caption button object template".split())
TEXTUAL = frozenset("p b i em strong a span".split())
CELL, SECTION = frozenset(["td", "th"]), frozenset(["thead", "tbody", "tfoot"])
VERBATIM = frozenset("pre listing xmp plaintext".split())
#: Blocks that a paragraph ends before.
ENDS_P = BLOCK - frozenset("html body tr caption legend".split())
#: What a body element may close without its end tag: the head ends where content begins.
HEAD_ONLY = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: Elements whose attributes the renderer reads.
READ = frozenset("ol li td th details".split())
_NUMBER = re.compile(r"\s*([+-]?\d{1,9})")


class Node:
    """shown: whether it is displayed; visible: whether its text is, None if that is its parent's matter."""

    __slots__ = ("attributes", "children", "foreign", "name", "shown", "visible")

    def __init__(self, name: str, shown: bool = True, visible: bool | None = None, foreign: bool = False, attributes: dict | None = None):
        self.name, self.shown, self.visible, self.foreign, self.children, self.attributes = name, shown, visible, foreign, [], attributes

    def number(self, name: str, default: int) -> int:
        found = _NUMBER.match((self.attributes or {}).get(name, ""))
        return int(found[1]) if found else default


def attributes(source: str) -> dict[str, str]:
    """Names, in lower case, and values; of names that repeat the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(source):
        value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
        found.setdefault(m[1].lower(), value)
    return found


def made(name: str, source: str, foreign: bool) -> Node:
    """An element with what its attributes say about its display and visibility."""
    if name in UNSEEN:
        return Node(name, False, None, foreign)
    if not source.strip(" /\t\r\n\f"):
        return Node(name, name != "dialog", None, foreign)
    own = attributes(source)
    told: dict[str, tuple[bool, str]] = {}
    if "style" in own:
        for m in _DECLARATION.finditer(_COMMENT.sub("", html.unescape(own["style"]))):
            what, important = m[1].lower(), bool(m[3])
            if important or not told.get(what, (False, ""))[0]:
                told[what] = important, m[2].lower()
    if "display" in told:
        shown = told["display"][1] != "none"
    else:
        shown = not ("hidden" in own and own["hidden"].strip().lower() != "until-found") and (name != "dialog" or "open" in own)
    visible = {"visible": True, "hidden": False, "collapse": False}.get(told.get("visibility", (False, ""))[1])
    return Node(name, shown, visible, foreign, own if name in READ else None)


class Open:
    """The open elements, and where each name, scope and holder of text stands among them."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """The place of the innermost element of these names; 0 if there is none."""
        return max((p[-1] for n in names if (p := self.places.get(n))), default=0)

    def first_within(self, names, bound: int) -> int:
        """The place of the outermost of these names inside bound; 0 if there is none."""
        found = [p[k] for n in names if (p := self.places.get(n)) and (k := bisect_right(p, bound)) < len(p)]
        return min(found, default=0)


def build(source: str) -> Node:
    root = Node("html")
    open_, at, end = Open(root), 0, len(source)
    stack = open_.stack

    def leave_head() -> None:
        if stack[-1].name == "head":
            open_.cut(len(stack) - 1)

    while at < end:
        m = _TAG.search(source, at)
        text = source[at : m.start() if m else end]
        if text:
            if not text.isspace():
                leave_head()
            stack[-1].children.append(text)
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            place = open_.last([name])
            if place and name not in SECTION and name not in ("table", "tr"):
                bound = open_.last(SCOPE - {name})
                place *= place > (max(bound, open_.last(["li"])) if name in TEXTUAL else bound)
            if place:
                open_.cut(place)
            elif name in ("p", "br"):  # a stray </p> is an empty paragraph: what follows begins a line
                stack[-1].children.append(Node("br"))
            continue
        if name not in HEAD_ONLY:
            leave_head()
        closes = CLOSED_BY.get(name)
        if closes:
            place = open_.first_within(closes, open_.last(BOUND.get(name, frozenset())))
            if place:
                open_.cut(place)
        if name in ENDS_P:
            place = open_.last(["p"])
            if place > open_.last(SCOPE):
                open_.cut(place)
        foreign = name in FOREIGN or (stack[-1].foreign and stack[-1].name != "foreignobject")
        node = made(name, m[3], foreign)
        stack[-1].children.append(node)
        # A slash ends an element of svg and math only; on others it means nothing.
        if foreign and m[3].endswith("/"):
            continue
        if name in RAW and not foreign:
            close = None if name == "plaintext" else re.compile(rf"(?i)</{re.escape(name)}\b[^>]*>").search(source, at)
            body_end = close.start() if close else end
            node.children.append(source[at:body_end])
            at = close.end() if close else end
        elif name not in VOID:
            open_.push(node)
    return root


class Page:
    """Lines under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank, self.gap, self.indent, self.mark = True, False, 0, ""

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if self.blank:
            s = s.lstrip(" ")
        if s:
            self.parts.append(s)
            self.blank = s[-1] == " "

    def end(self, spaced: bool = False) -> None:
        line = "".join(self.parts).rstrip(" ")
        self.parts, self.blank = [], True
        if line:
            self.put(f"{'  ' * self.indent}{self.mark}{line}")
            self.mark = ""
        self.gap = self.gap or spaced

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.lines.append(line)
        self.gap = False


class Table:
    """Cells of a table by row and column; a cell is (column, span, lines)."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.held: dict[int, int] = {}  # columns that cells from rows above still fill, and for how many rows
        self.next = 0

    def row(self) -> None:
        if self.rows:
            self.held = {c: n - 1 for c, n in self.held.items() if n > 1}
        self.rows.append([])
        self.next = 0

    def section(self) -> None:
        self.held = {}

    def cell(self, node: Node) -> list[str]:
        """The place for a cell's lines."""
        if not self.rows:
            self.row()
        while self.next in self.held:
            self.next += 1
        span, down = min(max(node.number("colspan", 1), 1), 1000), node.number("rowspan", 1)
        lines: list[str] = []
        self.rows[-1].append((self.next, span, lines))
        if down != 1:
            for c in range(self.next, self.next + span):
                self.held[c] = 65534 if down < 1 else min(down, 65534)
        self.next += span
        return lines


def _pieces(table: Node) -> tuple[list, list]:
    """What stands outside the cells, and (op, node) for rows, sections and cells in order; a row that is not displayed goes."""
    loose: list = []
    parts: list = []
    todo: list = [(c, None) for c in reversed(table.children)]
    while todo:
        node, visible = todo.pop()
        if isinstance(node, str):
            loose.append((node, visible))
        elif not node.shown:
            continue
        else:
            own = visible if node.visible is None else node.visible
            if node.name in CELL:
                parts.append(("cell", node, visible))
            elif node.name == "tr":
                parts.append(("row", node, own))
                todo += [(c, own) for c in reversed(node.children)]
            elif node.name in SECTION or node.name == "colgroup":
                parts.append(("section", node, own))
                todo += [(c, own) for c in reversed(node.children)]
            else:
                loose.append((node, visible))
    return loose, parts


def _wrapped(line: str, width: int) -> list[str]:
    """line in pieces of at most width characters, cut at blanks; a longer word stays whole."""
    if len(line) <= width:
        return [line]
    out, held = [], line[: len(line) - len(line.lstrip(" "))]
    begun = False
    for word in line.split():
        if begun and len(held) + 1 + len(word) > width:
            out.append(held)
            held, begun = "", False
        held += f" {word}" if begun else word
        begun = True
    return [*out, held]


def _laid_out(table: Table) -> list[str]:
    rows = [[(c, span, [x for x in lines if x]) for c, span, lines in r] for r in table.rows if r]
    starts = sorted({c for r in rows for c, _, _ in r})
    place = {c: k for k, c in enumerate(starts)}
    width, total, count = [0] * len(starts), [0] * len(starts), [0] * len(starts)
    text = 0
    for r in rows:
        for c, span, lines in r:
            k, longest = place[c], max(map(len, lines), default=0)
            text += sum(map(len, lines)) + 3
            total[k] += longest
            count[k] += 1
    limit = [min(WIDEST, max(SPREAD * (t // max(n, 1)), LEAST)) for t, n in zip(total, count)]
    for r in rows:
        for c, span, lines in r:
            k = place[c]
            if bisect_left(starts, c + span) == k + 1:  # a word beyond the limit hangs over and widens nothing
                width[k] = max([width[k], *(len(y) for x in lines for y in _wrapped(x, limit[k]) if len(y) <= limit[k])])
    # A cell over several columns widens the last of them.
    for r in rows:
        for (c, _, lines), (following, _, _) in zip(r, r[1:]):
            k, to = place[c], place[following]
            if to - k > 1:
                width[to - 1] += max(max((len(y) for x in lines for y in _wrapped(x, limit[k]) if len(y) <= limit[k]), default=0) - sum(width[k:to]) - 3 * (to - k - 1), 0)
    # Where each column begins, with its mark " | " before it.
    left = [0]
    for w in width:
        left.append(left[-1] + w + 3)
    padded = sum(left[place[r[-1][0]]] * max(max((len(x[2]) for x in r), default=1), 1) for r in rows) <= SPREAD * text + 1000
    out = []
    for r in rows:
        cells = []
        for at, (c, span, lines) in enumerate(r):
            k = place[c]
            following = r[at + 1][0] if at + 1 < len(r) else None
            room = left[place[following]] - left[k] - 3 if following is not None else None
            cells.append((k, lines if room is None or not padded else [y for x in lines for y in _wrapped(x, max(room, 1))]))
        for n in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for at, (k, lines) in enumerate(cells):
                if padded:
                    line = line.ljust(left[k] - 3) + " | " if k else line
                elif at:
                    line += " | "
                line += lines[n] if n < len(lines) else ""
            out.append(line.rstrip())
    return [x for x in out if x.strip(" |")]


def _verbatim(node: Node, visible: bool) -> str:
    """The text of a pre element as it stands."""
    out: list[str] = []
    todo: list = [(c, visible) for c in reversed(node.children)]
    raw = node.name in RAW
    while todo:
        c, seen = todo.pop()
        if isinstance(c, str):
            out.append((c if raw else html.unescape(c)) if seen else "")
        elif c.shown:
            own = seen if c.visible is None else c.visible
            out.append("\n" if c.name == "br" else "")
            todo += [(x, own) for x in reversed(c.children)]
    return "".join(out)


def render(root: Node) -> str:
    """The lines of a tree. What is still to be done stands on a stack: elements to enter, and functions to call when all before is done."""
    page = first = Page()
    work: list = [(root, True, 0, None)]

    def later(call) -> None:
        work.append((call, None, 0, None))

    def children(nodes, visible, depth, order) -> None:
        work.extend((c, visible, depth, order) for c in reversed(nodes))

    def enter_cell(node, visible, lines):
        nonlocal page
        outer, page = page, Page()

        def leave():
            nonlocal page
            page.end()
            lines.extend(page.lines)
            page = outer

        later(leave)
        children(node.children, visible, 0, None)

    def put_table(grid, spaced):
        for line in _laid_out(grid):
            page.put(f"{'  ' * page.indent}{page.mark}{line}")
            page.mark = ""
        page.end(spaced)

    while work:
        node, visible, depth, order = work.pop()
        if callable(node):
            node()
            continue
        if isinstance(node, str):
            if visible:
                page.text(html.unescape(node))
            continue
        if not node.shown:
            continue
        name, visible = node.name, visible if node.visible is None else node.visible
        block, spaced = name in BLOCK or name in VERBATIM, name in SPACED and depth < 1
        if name == "br":
            if page.parts:
                page.end()
        elif name == "hr":
            page.end(True)
        elif name in VERBATIM:
            page.end(spaced)
            for line in _verbatim(node, visible).strip("\n").split("\n"):
                page.put(f"{page.mark}{line}".rstrip())
                page.mark = ""
            page.end(True)
        elif name == "table":
            page.end(spaced)
            loose, parts = _pieces(node)
            grid = Table()
            later(lambda grid=grid: put_table(grid, True))
            for kind, part, seen in reversed(parts):
                own = visible if seen is None else seen
                if kind == "cell" and part.visible is not None:
                    own = part.visible
                # Rows and cells get their places in the order in which they stand.
                if kind == "cell":
                    later(lambda p=part, v=own, g=grid: enter_cell(p, v, g.cell(p)))
                else:
                    later(grid.row if kind == "row" else grid.section)
            later(lambda: page.end(True))
            work.extend((x, visible if seen is None else seen, depth, None) for x, seen in reversed(loose))
        else:
            if block:
                page.end(spaced)
            if name == "li":
                if order is not None:
                    order[0] = node.number("value", order[0])
                    page.mark = f"{order[0]}. "
                    order[0] += order[1]
                else:
                    page.mark = "- "
            inner = None
            listed = name in ("ul", "ol")
            if name == "ol":
                backward = "reversed" in (node.attributes or {})
                inner = [node.number("start", sum(not isinstance(c, str) and c.name == "li" for c in node.children) if backward else 1), -1 if backward else 1]
            if listed:
                page.indent += depth > 0
            if name in CONTROL:
                page.text(" ")
            shown = node.children
            if name == "details" and "open" not in (node.attributes or {}):
                shown = [c for c in shown if not isinstance(c, str) and c.name == "summary"][:1]

            def leave(name=name, block=block, spaced=spaced, outdent=listed and depth > 0):
                page.indent -= outdent
                if name in CELL or name in CONTROL:
                    page.text(" ")
                if block:
                    page.end(spaced)
                    if name == "li":
                        page.mark = ""

            later(leave)
            children(shown, visible, depth + listed, inner)
    first.end()
    return "\n".join(first.lines)


def extract(source: str | None) -> str:
    return render(build(source)) if source else ""


def extract_text(pages: DataFrame, carry: list[str], column: str = "html") -> DataFrame:
    """The columns carry, text, and n_chars of every page."""

    def one(source):
        text = extract(source)
        return text, len(text)

    return per_row(pages, carry, column, "text string, n_chars long", lambda: one)


def query(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"), ["page_id", "url"])
