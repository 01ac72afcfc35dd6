"""Visible text of HTML pages with their layout.

A tokenizer feeds a tree builder that knows void elements, raw-text elements and
implied tags (a block closes an open paragraph; list items, definition terms,
options, rows and cells close their like; a row or cell opens what it lacks; an end
tag closes everything inside its element and is ignored if nothing is open by that
name). The tree is walked without recursion. Invisible are head, scripts, styles,
templates, comments (bogus ones too), and what ``hidden``, the style attribute or a
rule of the page's own style sheets says is not displayed; ``visibility`` is inherited,
so a visible element inside a hidden one shows. Rules count whose selector is an
element name, classes and ids of one element; those with combinators, and those inside
at-rules, do not. White space collapses except in preformatted text; paragraphs,
headings, lists and tables stand apart by an empty line, other blocks by a line break;
list items get a dash or their number and are indented; table cells are padded to
their column's width, and cells that span columns or rows keep the others in place.

Defined results: null HTML gives null text; empty HTML empty text; a null page id is
carried through; repeated rows are rendered each; pages of any length and depth are
rendered whole; only the two named columns are read, so others may have any name; an
empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, lean, table

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</(?![a-zA-Z])[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
SPACE = re.compile(r"[ \t\n\r\f]+")
# Element names of the HTML standard by how they are parsed and laid out.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template title noscript iframe noembed noframes datalist".split())
BLANK = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote hr figure menu".split())
BLOCK = BLANK | frozenset("html body div section article aside header footer nav main address form fieldset legend figcaption details summary center dir li dt dd tr caption thead tbody tfoot option optgroup search hgroup dialog".split())
CLOSES_P = BLOCK - frozenset("html body li dt dd tr caption thead tbody tfoot option optgroup".split()) | {"xmp"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, and the elements that stop the search for it.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "caption", "colgroup"}), frozenset({"table"})),
    "tbody": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset({"table"})),
    "thead": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset({"table"})),
    "tfoot": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset({"table"})),
}
_SCOPE = frozenset("table td th caption html body".split())


class Node:
    __slots__ = ("children", "raw", "tag")

    def __init__(self, tag: str, raw: str = ""):
        self.tag, self.raw, self.children = tag, raw, []

    def attributes(self) -> dict[str, str]:
        return {k.lower(): html.unescape((v or "").strip("\"'")) for k, v in ATTRIBUTE.findall(self.raw)}


Rule = tuple[tuple[int, int, int], str, frozenset, dict[str, str]]
_COMMENT, _AT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile(r"@[^{};]*+(?:;|\{(?:[^{}]*+\{[^{}]*+\})*+[^{}]*+\}?)")
_RULE, _SIMPLE = re.compile(r"([^{}]*+)\{([^{}]*+)\}"), re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)")


def declarations(style: str) -> dict[str, str]:
    """The last display and visibility of a list of declarations; important ones win."""
    out, strong = {}, set()
    for part in style.split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip().lower(), value.lower()
        if name in ("display", "visibility"):
            important = "!important" in value.replace(" ", "")
            if important or name not in strong:
                out[name] = value.split("!")[0].strip()
                strong |= {name} if important else set()
    return out


def sheet(css: str) -> list[Rule]:
    """(specificity, element name or empty, classes and ids, declarations) of rules that decide visibility."""
    rules = []
    for selectors, body in _RULE.findall(_AT.sub("", _COMMENT.sub("", css))):
        what = declarations(body)
        for one in selectors.split(",") if what else ():
            m = _SIMPLE.fullmatch(one.strip())
            if m and m[0]:
                parts, name = re.findall(r"[.#][\w-]+", m[2]), (m[1] or "").lower().replace("*", "")
                rules.append(((sum(p[0] == "#" for p in parts), sum(p[0] == "." for p in parts), int(bool(name))), name, frozenset(parts), what))
    return rules


def looks(node: Node, rules: list[Rule]) -> tuple[bool, bool | None]:
    """(not displayed, visible; None: as the parent) of an element."""
    low = node.raw.lower()
    if node.tag in HIDDEN:
        return True, None
    if not rules and "hidden" not in low and "style" not in low:
        return False, None
    a = node.attributes()
    style = {"display": "none"} if "hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") else {}
    if rules:
        own = {f".{c}" for c in a.get("class", "").split()} | {f"#{a['id'].strip()}" for _ in range("id" in a)}
        for _, name, parts, what in rules:  # in order of specificity
            if (not name or name == node.tag) and parts <= own:
                style |= what
    style |= declarations(a.get("style", ""))
    seen = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility", ""))
    return style.get("display") == "none", seen


def parse(source: str) -> tuple[Node, list[Rule]]:
    """The tree and the rules of its style sheets, in order of specificity."""
    root, css = Node("#root"), []
    stack = [root]
    names: dict[str, int] = {}  # open elements by name, so that stray end tags cost nothing

    def push(tag: str, raw: str = "") -> None:
        node = Node(tag, raw)
        stack[-1].children.append(node)
        stack.append(node)
        names[tag] = names.get(tag, 0) + 1

    def pop() -> str:
        tag = stack.pop().tag
        names[tag] -= 1
        return tag

    def close(tags: frozenset, stops: frozenset) -> None:
        if not any(names.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                while len(stack) > k:
                    pop()
                return
            if stack[k].tag in stops:
                return

    at = 0
    while True:
        m = TOKEN.search(source, at)
        if m is None:
            if at < len(source):
                stack[-1].children.append(html.unescape(source[at:]))
            return root, sorted((r for c in css for r in sheet(c)), key=lambda r: r[0])
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "p" and not names.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            elif names.get(tag):
                barrier = frozenset() if tag in _SCOPE or tag in BLOCK else _SCOPE
                close(frozenset({tag}), barrier)
            continue
        raw = m[3] or m[6] or ""
        if tag in CLOSES_P:
            close(frozenset({"p"}), _SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in ("td", "th") and names.get("table") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                push("tr")
        if tag == "body" and names.get("head"):
            close(frozenset({"head"}), frozenset())
        if tag in VOID or (raw.rstrip().endswith("/") and tag in ("path", "rect", "circle", "use")):
            stack[-1].children.append(Node(tag, raw))
            continue
        push(tag, raw)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            body = source[at : end.start() if end else len(source)]
            stack[-1].children.append(html.unescape(body) if tag == "textarea" else body)
            if tag == "style":
                css.append(body)
            at = end.end() if end else len(source)
            pop()


def width(s: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s) if not s.isascii() else len(s)


class Flow:
    """Lines of one formatting context (the page, or a table cell)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.space, self.gap, self.first = "", False, 0, ""

    def text(self, s: str, pre: bool, indent: str) -> None:
        if pre:
            for k, part in enumerate(s.split("\n")):
                if k:
                    self.end(keep=True)
                if part:
                    self._open(indent)
                    self.line += part
            return
        s = SPACE.sub(" ", s)
        if not s.strip(" "):
            self.space |= bool(s)
            return
        if self.line and (self.space or s[0] == " "):
            self.line += " "
        self._open(indent)
        self.line += s.strip(" ")
        self.space = s[-1] == " "

    def _open(self, indent: str) -> None:
        if self.line:
            return
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        self.line = indent + self.first
        self.first, self.space = "", False

    def end(self, blank: bool = False, keep: bool = False) -> None:
        """Finish the line; ``blank``: an empty line before the next; ``keep``: even if empty."""
        if self.line or (keep and self.lines):
            self.lines.append(self.line.rstrip() if self.line.strip() else "")
        self.line, self.space = "", False
        if blank:
            self.gap = 1

    def put(self, lines: list[str], indent: str) -> None:
        for s in lines:
            self._open(indent)
            self.line += s
            self.end(keep=True)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns and rows spanned) with columns padded to one width."""
    placed, taken = [], {}  # taken: column -> rows it is still covered by a cell from above
    for cells in rows:
        row, c, covered = [], 0, {k: n - 1 for k, n in taken.items() if n > 1}
        for lines, wide, deep in cells:
            while taken.get(c, 0) > 0:
                c += 1
            row.append((c, c + wide, lines))
            if deep != 1:
                covered |= dict.fromkeys(range(c, c + wide), deep - 1 if deep else len(rows))
            c += wide
        placed.append(row)
        taken = covered
    # columns in which no cell starts have no width of their own
    starts = sorted({c for row in placed for c, _, _ in row})
    at = {c: i for i, c in enumerate(starts)}
    placed = [[(at[c], max(at[c] + 1, bisect.bisect_left(starts, e)), lines) for c, e, lines in row] for row in placed]
    wide = [0] * len(starts)
    for single in (True, False):
        for row in placed:
            for c, e, lines in row:
                if (e == c + 1) == single:
                    short = max(map(width, lines), default=0) - sum(wide[c:e]) - 2 * (e - c - 1)
                    wide[e - 1] += max(0, short)
    left = [sum(wide[:c]) + 2 * c for c in range(len(starts))]
    out = []
    for row in placed:
        for k in range(max((len(lines) for _, _, lines in row), default=0)):
            line = ""
            for c, _, lines in row:
                s = lines[k] if k < len(lines) else ""
                if s:
                    line += " " * (left[c] - width(line)) + s
            out.append(line)
    return out


def spans(node: Node) -> tuple[int, int]:
    """Columns and rows of a cell, within the standard's limits; no rows: to the table's end."""
    a = node.attributes() if "span" in node.raw.lower() else {}
    number = lambda k, least, most: min(int(a[k]), most) if a.get(k, "").isdigit() and int(a[k]) >= least else 1
    return number("colspan", 1, 1000), number("rowspan", 0, 65534)


def render(source: str) -> str:
    flows, tables, lists, indents = [Flow()], [], [], [""]
    pre, seen = 0, [True]
    tree, rules = parse(source)
    todo: list = [(tree, None)]
    while todo:
        node, state = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen[-1]:
                flow.text(node, pre > 0, indents[-1])
            continue
        tag = node.tag
        if state is None:
            gone, shown = looks(node, rules)
            if gone:
                continue
            if tag == "br":
                if flow.line:
                    flow.end()
                else:
                    flow.end(keep=True)
                continue
            if tag == "hr":
                flow.end(blank=True)
                continue
            after = tag
            nested = bool(lists) and tag in ("ul", "ol", "menu")
            if tag in ("td", "th") and tables:
                flows.append(Flow())
                indents.append("")
            elif tag == "table":
                flow.end(blank=True)
                tables.append([])
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCK:
                flow.end(blank=tag in BLANK and not nested)
            if tag in ("ul", "ol", "menu"):
                start = node.attributes().get("start", "1") if tag == "ol" else ""
                lists.append(int(start) - 1 if start.lstrip("-").isdigit() and len(start) < 10 else (0 if tag == "ol" else None))
                indents.append(indents[-1] + ("  " if nested else ""))
            elif tag == "li":
                if lists and lists[-1] is not None:
                    lists[-1] += 1
                    flow.first = f"{lists[-1]}. "
                else:
                    flow.first = "- "
            elif tag in ("dd", "blockquote"):
                indents.append(indents[-1] + "  ")
            elif tag in ("pre", "xmp", "textarea"):
                pre += 1
            elif tag == "input":
                a = node.attributes()
                if a.get("type", "text").lower() in ("submit", "button", "reset", "text") and a.get("value") and (seen[-1] if shown is None else shown):
                    flow.text(a["value"], False, indents[-1])
            seen.append(seen[-1] if shown is None else shown)
            todo.append((node, after))
            todo.extend((c, None) for c in reversed(node.children))
            continue
        seen.pop()
        if tag in ("td", "th") and tables:
            cell = (flows.pop().done(), *spans(node))
            indents.pop()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append(cell)
        elif tag == "table":
            flow.end()
            flow.put(aligned([r for r in tables.pop() if r]), indents[-1])
            flow.end(blank=True)
        elif tag in BLOCK:
            flow.end(blank=tag in BLANK and not (tag in ("ul", "ol", "menu") and len(lists) > 1))
        if tag in ("ul", "ol", "menu"):
            lists.pop()
            indents.pop()
        elif tag == "li":
            flow.first = ""
        elif tag in ("dd", "blockquote"):
            indents.pop()
        elif tag in ("pre", "xmp", "textarea"):
            pre -= 1
    return "\n".join(flows[0].done())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page; one narrow stage."""
    id_type = pages.select(column(id_col)).schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = pa.array([None if s is None else render(s) for s in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["id", "text"])

    out = pages.select(column(id_col).alias("id"), column(html_col).cast("string").alias("html"))
    return out.mapInArrow(lean(run), f"id {id_type}, text string").withColumnRenamed("id", id_col)


def op3_layout_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
