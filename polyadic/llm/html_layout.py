"""Layout-aware text of HTML pages: a tree with implied tags, then all that is visible, as laid out."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Generator, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head title template noscript datalist iframe audio video canvas".split())
#: What is not drawn inside svg and math, though text under other elements of theirs is.
UNDRAWN = frozenset("desc metadata defs symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
#: Elements of svg and math that hold HTML, and tags that end svg and math.
HOLDERS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Blocks with a blank line around them, and blocks on lines of their own.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr".split())
PLAIN = frozenset("html body address article aside details dialog dd div dt fieldset figcaption footer form header hgroup legend li main menu nav option optgroup search section summary caption tr".split())
BLOCKS = SPACED | PLAIN
#: What a start tag closes, if it is open, and the elements beyond which that does not reach.
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {tag: (frozenset({"p"}), frozenset("td th caption button table".split())) for tag in BLOCKS - frozenset("tr caption li dt dd option optgroup html body".split())}
CLOSES |= {
    "li": (frozenset({"li"}), frozenset("ul ol menu table".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "td": (frozenset({"td", "th"}), frozenset({"table"})),
    "th": (frozenset({"td", "th"}), frozenset({"table"})),
    "tr": (frozenset({"tr", "caption", "colgroup"}), frozenset({"table"})),
    **{t: (frozenset({"thead", "tbody", "tfoot", "caption", "colgroup"}), frozenset({"table"})) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset({"head"}), frozenset()),
}
SECTIONS, CELLS = frozenset("thead tbody tfoot".split()), frozenset("td th caption".split())
#: Open elements that take nothing but parts of a table.
CONTEXT = SECTIONS | {"table", "tr", "colgroup"}
#: The open elements that take a part of a table; other ones within the table are closed first.
PARTS: dict[str, frozenset[str]] = {t: frozenset({"table"}) for t in SECTIONS | {"caption", "colgroup"}}
PARTS |= {"tr": SECTIONS | {"table"}, "td": SECTIONS | {"table", "tr"}, "th": SECTIONS | {"table", "tr"}, "col": frozenset({"table", "colgroup"})}
_SPACES = re.compile(r"[ \t\n\r\f]+")
#: HTML's own limits of how far a cell reaches.
MOST_COLUMNS, MOST_ROWS = 1_000, 65_534
#: What a declaration may say: not laid out at all, or laid out but not painted (which descendants may undo).
GONE, UNPAINTED, PAINTED = "gone", "unpainted", "painted"
_MEDIA = frozenset({"", "all", "screen", "only screen"})
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_SELECTOR = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[.#][\w-]+)*)$")


def declared(style: str | None) -> dict[str, tuple[bool, str]]:
    """What some CSS declarations say about showing, under "display" and "visibility": whether it is !important, and what.

    The last of each holds, but an !important one over all that are not.
    """
    out: dict[str, tuple[bool, str]] = {}
    for part in (style or "").split(";"):
        name, _, value = part.partition(":")
        value, _, mark = value.partition("!")
        name, value, important = name.strip().lower(), value.strip().lower(), mark.strip().lower() == "important"
        if name == "display" and value:
            says = GONE if value == "none" else PAINTED
        elif name == "content-visibility" and value == "hidden":
            name, says = "display", GONE
        elif name == "visibility":
            says = UNPAINTED if value in ("hidden", "collapse") else PAINTED if value == "visible" else ""
        else:
            continue
        if important or not out.get(name, (False, ""))[0]:
            out[name] = (important, says)
    return out


def _rules(css: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations outside @-blocks, in one pass."""
    at, depth, start, head, skipped = 0, 0, 0, "", False
    for m in re.finditer(r"/\*|[{};]", css):
        if m.start() < at:
            continue
        mark = m[0]
        if mark == "/*":
            end = css.find("*/", m.end())
            at = len(css) if end < 0 else end + 2
        elif mark == "{":
            if depth == 0:
                head = _COMMENT.sub("", css[start : m.start()]).strip()
                skipped, start = head.startswith("@"), m.end()
            depth += 1
        elif mark == "}":
            depth = max(0, depth - 1)
            if depth == 0:
                if head and not skipped:
                    yield head, _COMMENT.sub("", css[start : m.start()])
                head, start = "", m.end()
        elif depth == 0 and css[start : m.start()].lstrip().startswith("@"):
            start = m.end()  # an @-rule without a block


class Sheet:
    """The page's own style rules about showing, with selectors of one tag, identifier and classes.

    Of what rules and style attributes say, what is !important holds first, then the attribute, then
    the more specific rule, then the later one.  Rules inside @-blocks and other selectors do not count.
    """

    def __init__(self) -> None:
        self.count = 0
        #: Rules by one identifier, class or tag that their elements must have.
        self.rules: dict[str, list[tuple[tuple[int, int, int, int], str, frozenset[str], frozenset[str], dict[str, tuple[bool, str]]]]] = {}

    def add(self, css: str) -> None:
        for selectors, body in _rules(css):
            says = declared(body)
            for selector in selectors.split(",") if says else ():
                m = _SELECTOR.match(selector.strip())
                if m and selector.strip():
                    marks = re.findall(r"[.#][\w-]+", m[2])
                    ids, classes = (frozenset(x[1:] for x in marks if x[0] == c) for c in "#.")
                    tag = (m[1] or "*").lower()
                    key = "#" + min(ids) if ids else "." + min(classes) if classes else tag
                    self.rules.setdefault(key, []).append(((len(ids), len(classes), int(tag != "*"), self.count), tag, ids, classes, says))
                    self.count += 1

    def close(self) -> None:
        """Of rules with one selector only what the last and the last !important one say is kept."""
        for key, rules in self.rules.items():
            last: dict[tuple, dict[str, tuple[bool, str]]] = {}
            place: dict[tuple, tuple[int, int, int, int]] = {}
            for rank, tag, ids, classes, says in rules:
                held = last.setdefault((tag, ids, classes), {})
                for name, (important, what) in says.items():
                    if important or not held.get(name, (False, ""))[0]:
                        held[name] = (important, what)
                        place[tag, ids, classes, name] = rank
            self.rules[key] = [(place[*who, name], *who, {name: said}) for who, held in last.items() for name, said in held.items()]

    def of(self, node: Node) -> dict[str, str]:
        found: dict[str, tuple[tuple, str]] = {"display": ((False, -1), GONE)} if "hidden" in node.attrs else {}

        def put(rank: tuple, says: dict[str, tuple[bool, str]]) -> None:
            for name, (important, what) in says.items():
                if name not in found or (important, *rank) >= found[name][0]:
                    found[name] = ((important, *rank), what)

        if self.rules:
            mine, name = frozenset((node.attrs.get("class") or "").split()), node.attrs.get("id")
            for key in ("*", node.tag, f"#{name}", *("." + c for c in mine)):
                for rank, tag, ids, classes, says in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and ids <= {name} and classes <= mine:
                        put((0, *rank), says)
        if node.attrs.get("style"):
            put((1,), declared(node.attrs["style"]))
        return {name: what for name, (_, what) in found.items()}


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None):
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []


class _Builder(HTMLParser):
    """Builds the tree; unclosed and misplaced tags are mended as browsers mostly do."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.counts: dict[str, int] = {}
        self.foreign = [""]  # svg, math or nothing for each open element
        self.begun = False
        self.styles: list[str] = []

    def _pop_to(self, k: int) -> None:
        while len(self.open) > k:
            self.counts[self.open.pop().tag] -= 1
            self.foreign.pop()

    def _push(self, node: Node) -> None:
        within = self.foreign[-1]
        self.foreign.append(node.tag if node.tag in ("svg", "math") else "" if node.tag in HOLDERS else within)
        self.open.append(node)
        self.counts[node.tag] = self.counts.get(node.tag, 0) + 1

    def _in_table(self) -> int:
        """The place of the open table of which only parts are taken now, or 0."""
        k = len(self.open) - 1
        if self.open[k].tag not in CONTEXT or not self.counts.get("table") or self.counts.get("template"):
            return 0
        while self.open[k].tag in CONTEXT and self.open[k].tag != "table":
            k -= 1
        return k if self.open[k].tag == "table" else 0

    def _put(self, child: Node | str) -> None:
        """Adds to the open element; what is no part of an open table goes before the table."""
        k = self._in_table()
        if k and not (isinstance(child, Node) and (child.tag in PARTS or child.tag in ("script", "style", "template"))):
            self.open[k - 1].children.insert(-1, child)  # an open table is the last of its parent's children
        else:
            self.open[-1].children.append(child)

    def _make_room(self, tag: str) -> None:
        """Closes cells and misplaced elements in front of a part of the open table, and implies its row."""
        while self.open[-1].tag not in CONTEXT:
            self._pop_to(len(self.open) - 1)
        while self.open[-1].tag not in PARTS[tag] and self.open[-1].tag in CONTEXT and self.open[-1].tag != "table":
            self._pop_to(len(self.open) - 1)
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            row = Node("tr")
            self.open[-1].children.append(row)
            self._push(row)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.foreign[-1] and tag in BREAKOUT:
            while self.foreign[-1]:
                self._pop_to(len(self.open) - 1)
        if tag == "head" and self.begun:
            return
        self.begun |= tag != "html"
        part = tag in PARTS and self.counts.get("table") and not self.counts.get("template") and not self.foreign[-1]
        if part:
            self._make_room(tag)
        elif tag == "form" and self._in_table():
            return
        elif tag == "table" and self.counts.get("table") and not self.counts.get("template"):
            k = next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag in CELLS or self.open[k].tag in CONTEXT)
            if self.open[k].tag in CONTEXT:
                self.handle_endtag("table")
        if self.counts.get("head") and not self.counts.get("template") and tag not in ("title", "meta", "link", "base", "style", "script", "noscript", "template", "body"):
            self.handle_endtag("head")
        closes, limits = CLOSES.get(tag, ((), ()))
        if not part and any(self.counts.get(t) for t in closes):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in closes:
                    self._pop_to(k)
                    if tag not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif self.open[k].tag in limits:
                    break
        node = Node(tag, dict(attrs))
        if self.foreign[-1] and tag in UNDRAWN:
            node.attrs["hidden"] = None
        self._put(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no self-closing tags: <div/> stays open
        if (tag in ("svg", "math") or self.counts.get(tag) and len(self.foreign) > 1 and self.foreign[-2]) and self.open[-1].tag == tag:
            self._pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
        if self.counts.get(tag):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag == tag:
                    self._pop_to(k)
                    break
                if self.open[k].tag in ("td", "th", "table") and tag not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html", "template"):
                    break  # an end tag does not reach out of its cell

    def handle_data(self, data: str) -> None:
        if self.open[-1].tag == "style" and not (self.counts.get("noscript") or self.counts.get("template")):
            if (self.open[-1].attrs.get("media") or "").strip().lower() in _MEDIA:
                self.styles.append(data)
        if data.strip(" \t\n\r\f"):
            self.begun = True
            if self.open[-1].tag == "head":
                self.handle_endtag("head")
            self._put(data)
        else:
            self.open[-1].children.append(data)


def parse(html: str) -> tuple[Node, Sheet]:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    sheet = Sheet()
    for css in builder.styles:
        sheet.add(css)
    sheet.close()
    return builder.root, sheet


def shown(node: Node, sheet: Sheet, painted: bool) -> bool | None:
    """Whether an element's own text is painted, as its parent's is unless it says otherwise; None if nothing under it is shown."""
    if node.tag in HIDDEN or node.tag == "dialog" and "open" not in node.attrs:
        return None
    says = sheet.of(node)
    if says.get("display") == GONE:
        return None
    return {UNPAINTED: False, PAINTED: True}.get(says.get("visibility", ""), painted)


class _Page:
    """Text under construction: words go to a line, blocks ask for line ends and blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.blank = False
        self.indent = 0
        self.marker = ""

    def end_line(self, blank: bool = False) -> None:
        text = "".join(self.line).rstrip()
        if text:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            first = " " * max(0, self.indent - len(self.marker)) + self.marker if self.marker else " " * self.indent
            self.lines.append(first + text)
            self.marker = ""
        self.line, self.space = [], False
        self.blank |= blank

    def words(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if not text:
            return
        if (self.space or text[0] == " ") and self.line:
            self.line.append(" ")
        core = text.strip(" ")
        if core:
            self.line.append(core)
            self.space = text[-1] == " "
        else:
            self.space = False if self.line and self.line[-1] == " " else self.space
            if self.line and self.line[-1] == " ":
                self.line.pop()
                self.space = True

    def kept(self, text: str) -> None:
        first, *rest = text.split("\n")
        if self.space and self.line:
            self.line.append(" ")
        self.space = False
        self.line.append(first)
        for part in rest:
            if not "".join(self.line).strip():
                self.blank |= bool(self.lines)
            self.end_line()
            self.line.append(part)


def _rows(table: Node, sheet: Sheet, painted: bool) -> Iterator[list[tuple[Node, bool]]]:
    """The cells of each row, and whether their own text is painted."""
    stack = [(iter(table.children), painted)]
    while stack:
        children, painted = stack[-1]
        for child in children:
            own = shown(child, sheet, painted) if isinstance(child, Node) else None
            if own is not None and child.tag in SECTIONS:
                stack.append((iter(child.children), own))
                break
            if own is not None and child.tag == "tr":
                cells = [(c, shown(c, sheet, own)) for c in child.children if isinstance(c, Node) and c.tag in ("td", "th")]
                yield [(c, p) for c, p in cells if p is not None]
        else:
            stack.pop()


def _number(value: str | None, most: int) -> int:
    return min(max(int(value), 1), most) if value and re.fullmatch(r"\d{1,9}", value.strip()) else 1


#: A part of a page being rendered: it asks for the texts of cells and is sent them.
Work = Generator[tuple["Node", bool], str, str]


def _table(table: Node, page: _Page, sheet: Sheet, painted: bool) -> Generator[tuple[Node, bool], str, None]:
    """Rows of aligned cells; a cell of several lines makes its row as high."""
    grid: list[dict[int, list[str]]] = []
    below: list[tuple[int, int, int]] = []  # from where to where cells from above still cover columns, and up to which row
    for number, cells in enumerate(_rows(table, sheet, painted)):
        row: dict[int, list[str]] = {}
        at, fresh, k = 0, [], 0
        for cell, own in cells:
            while k < len(below) and below[k][0] <= at:
                at, k = max(at, below[k][1]), k + 1
            row[at] = (yield cell, own).split("\n")
            span, down = _number(cell.attrs.get("colspan"), MOST_COLUMNS), _number(cell.attrs.get("rowspan"), MOST_ROWS) - 1
            if down:
                fresh.append((at, at + span, number + down))
            at += span
        below = sorted(x for x in (*below, *fresh) if x[2] > number)
        grid.append(row)
    widths: dict[int, int] = {}
    for row in grid:
        for k, lines in row.items():
            widths[k] = max(widths.get(k, 0), *map(len, lines))
    order = sorted(widths)
    for row in grid:
        last = max((k for k, lines in row.items() if any(lines)), default=-1)
        used = order[: bisect_right(order, last)]
        for n in range(max(map(len, row.values()), default=1)):
            page.end_line()
            page.line.append("  ".join((row[k][n] if k in row and n < len(row[k]) else "").ljust(widths[k]) for k in used))
            page.end_line()


def _render(root: Node, sheet: Sheet, painted: bool) -> Work:
    """All visible text under a node."""
    page = _Page()
    lists: list[list] = []  # kind, next number and step of each open list
    pre = 0
    stack: list[tuple[bool, Node | str, bool]] = [(True, c, painted) for c in reversed(root.children)]
    while stack:
        enter, node, painted = stack.pop()
        if isinstance(node, str):
            if not painted:
                continue
            if pre:
                page.kept(node)
            else:
                page.words(node)
            continue
        tag = node.tag
        if not enter:
            if tag in ("pre", "textarea"):
                pre -= 1
            if tag in BLOCKS:
                page.end_line(blank=tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
            if tag in ("ul", "ol", "menu"):
                lists.pop()
                page.indent -= 2 if not lists else 4
            elif tag in ("blockquote", "dd"):
                page.indent -= 2
            elif tag == "li":
                page.marker = ""
            elif tag in ("text", "textarea", "select", "button"):
                page.words(" ")
            continue
        painted = shown(node, sheet, painted)
        if painted is None:
            continue
        if tag == "br":
            if not "".join(page.line).strip():
                page.blank = True
            page.end_line()
            continue
        if tag == "img":
            if node.attrs.get("alt") and painted:
                page.words(f" {node.attrs['alt']} ")
            continue
        if tag in BLOCKS:
            page.end_line(blank=tag in SPACED and not (tag in ("ul", "ol") and lists))
        if tag in ("ul", "ol", "menu"):
            page.indent += 2 if not lists else 4
            start, step = node.attrs.get("start"), -1 if "reversed" in node.attrs else 1
            first = sum(isinstance(c, Node) and c.tag == "li" for c in node.children) if step < 0 else 1
            lists.append([tag, int(start) if start and re.fullmatch(r"-?\d{1,9}", start.strip()) else first, step])
        elif tag in ("blockquote", "dd"):
            page.indent += 2
        elif tag == "li" and lists:
            if lists[-1][0] == "ol":
                value = node.attrs.get("value")
                if value and re.fullmatch(r"-?\d{1,9}", value.strip()):
                    lists[-1][1] = int(value)
                page.marker = f"{lists[-1][1]}. " if painted else ""
                lists[-1][1] += lists[-1][2]
            else:
                page.marker = "- " if painted else ""
        elif tag in ("td", "th", "text", "textarea", "select", "button"):  # text is of svg
            page.words(" ")
        if tag in ("pre", "textarea"):
            pre += 1
        if tag == "table":
            captions = ((c, shown(c, sheet, painted)) for c in node.children if isinstance(c, Node) and c.tag == "caption")
            for caption, own in captions:
                for line in (yield caption, own).split("\n") if own is not None else ():
                    page.words(line)
                    page.end_line()
            yield from _table(node, page, sheet, painted)
            page.end_line(blank=True)
            loose = [c for c in node.children if isinstance(c, Node) and c.tag not in ("caption", "thead", "tbody", "tfoot", "tr", "colgroup", "col") or isinstance(c, str) and c.strip()]
            stack += [(True, c, painted) for c in reversed(loose)]
            continue
        if tag not in VOID:
            stack.append((False, node, painted))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            stack += [(True, c, painted) for c in reversed(children)]
    page.end_line()
    return "\n".join(page.lines)


def render(root: Node, sheet: Sheet) -> str:
    """All visible text of a page; tables in tables take turns on a stack, however deep they are."""
    working, answer = [_render(root, sheet, True)], None
    while True:
        try:
            node, painted = working[-1].send(answer)
            working.append(_render(node, sheet, painted))
            answer = None
        except StopIteration as end:
            working.pop()
            if not working:
                return end.value
            answer = end.value


def text_of(html: str | None) -> str:
    """The visible text of a page; empty for null and empty pages."""
    return render(*parse(html)) if html else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: id, text, n_chars, n_lines.

    Null and empty pages have an empty text; very long pages are rendered whole, and an empty table
    gives no rows.  Rows that repeat an identifier are rendered each.  Broken markup never fails.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(html) for html in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page", "text", "n_chars", "n_lines"])

    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page long, text string, n_chars long, n_lines long").withColumnRenamed("page", id_col)
