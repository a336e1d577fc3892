"""Visible text of web pages, laid out roughly as a browser would.

A tolerant tree builder supplies implied tags (paragraphs, list items, table rows and cells close
each other), the renderer walks the tree, skips what is not shown, and keeps block spacing, list
markers, preformatted text and tables with aligned cells.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.common import text_chunks

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object "
                   "datalist select canvas audio video desc metadata defs symbol clippath annotation annotation-xml".split())
# Elements that stay inside <head>; any other tag, and text, ends it.
HEAD_CONTENT = frozenset("head title meta link style script base basefont bgsound noframes template noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
                  "ol p pre search section summary table ul caption thead tbody tfoot tr optgroup option".split())
# Blocks with an empty line before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset".split())
LISTS = frozenset(("ul", "ol", "menu", "dir"))
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption "
                           "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search "
                           "section table ul".split())
# An opening tag closes the open elements of its second group, but looks no further out than the third.
CLOSES = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "tr": (frozenset(("tr", "td", "th", "caption", "colgroup")), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select", "optgroup", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset(("html",))),
} | {name: (frozenset("tr td th caption colgroup thead tbody tfoot".split()), frozenset(("table",)))
     for name in ("thead", "tbody", "tfoot")}
# A closing tag does not reach beyond these.
BARRIERS = {"li": LISTS} | {name: frozenset(("table",)) for name in "td th tr thead tbody tfoot caption".split()}
CELLS = frozenset(("td", "th"))
# Tables nested deeper than this show their text without alignment.
MAX_NESTED_TABLES = 20

# One attribute, by the states of the HTML tokenizer: a name and maybe a quoted or unquoted value.
_ONE = r"""[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+"""
# Comments, declarations and tags run to the end of the page if nothing ends them, and nothing is read twice: time stays linear.
_MARKUP = re.compile(rf"<!--(?:.*?-->|.*+)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|{_ONE})*+)(>|\Z)", re.S)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_SPACES = re.compile(r"[ \t\n\f\r]+")


class Node:
    """An element: its name, attributes (as text) and children, which are nodes or strings."""

    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes, self.children = name, attributes, []

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return html.unescape((m[2] or "").strip("\"'"))
        return None

    def shown(self) -> bool:
        if self.name in HIDDEN:
            return False
        if not self.attributes:
            return True
        low = self.attributes.lower()
        if "hidden" in low and (self.attribute("hidden") is not None):
            return False
        return not ("style" in low and _HIDES.search(self.attribute("style") or ""))


def build_tree(source: str) -> Node:
    """The tree of a page; unclosed, misnested and unknown tags are tolerated."""
    root = Node("#root")
    stack, at = [root], 0
    opened = Counter()  # names on the stack

    def push(node: Node) -> None:
        stack[-1].children.append(node)
        stack.append(node)
        opened[node.name] += 1

    def close_upto(index: int) -> None:
        opened.subtract([node.name for node in stack[index:]])
        del stack[index:]

    def end_head() -> None:
        """Close an open head, unless what comes is inside a template, noscript or the like."""
        if stack[-1].name == "head":
            close_upto(len(stack) - 1)

    while at < len(source):
        tag = _MARKUP.search(source, at)
        text = source[at:tag.start() if tag else None]
        if text:
            if not _SPACES.fullmatch(text):
                end_head()
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not tag:
            break
        at = tag.end()
        if not tag[2]:
            continue
        if not tag[4]:
            break  # a tag without an end is none
        name = tag[2].lower()
        if tag[1]:
            barrier = BARRIERS.get(name, frozenset())
            for i in range(len(stack) - 1, 0, -1) if opened[name] else ():
                if stack[i].name == name:
                    close_upto(i)
                    break
                if stack[i].name in barrier or (stack[i].name in CELLS and name not in ("table", "tr")):
                    break
            continue
        if name not in HEAD_CONTENT:
            end_head()
        if name in ENDS_PARAGRAPH and opened["p"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == "p":
                    close_upto(i)
                    break
                if stack[i].name in BLOCK or stack[i].name in CELLS:
                    break
        if name in CLOSES and any(opened[c] for c in CLOSES[name][0]):
            closed, limit = CLOSES[name]
            outermost = None
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in limit:
                    break
                if stack[i].name in closed:
                    outermost = i
            if outermost is not None:
                close_upto(outermost)
        if name in CELLS and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            push(Node("tr"))
        node = Node(name, tag[3])
        if name not in VOID and name not in RAW and not (tag[3].endswith("/") and (opened["svg"] or opened["math"] or name in ("svg", "math"))):
            push(node)
            continue
        stack[-1].children.append(node)
        if name in RAW and not (tag[3].endswith("/") and (opened["svg"] or opened["math"])):
            end = re.compile(rf"</{name}[\s/>]", re.I).search(source, at)
            inner = source[at:end.start() if end else None]
            node.children.append(html.unescape(inner) if name in ("textarea", "title") else inner)
            at = source.find(">", end.start()) + 1 if end else len(source)
            if at == 0:
                break
    return root


class Renderer:
    """Lines of text collected from a tree."""

    def __init__(self, depth: int = 0):
        self.depth = depth
        self.lines: list[str] = []
        self.words: list[str] = []
        self.prefix = self.first_prefix = ""
        self.blank_due = False

    def _flush(self) -> None:
        line = "".join(self.words).strip(" ")
        self.words = []
        if not line:
            return
        if self.blank_due and self.lines:
            self.lines.append("")
        self.blank_due = False
        self.lines.append((self.first_prefix or self.prefix) + line)
        self.first_prefix = ""

    def _text(self, text: str) -> None:
        text = _SPACES.sub(" ", text)
        if text.startswith(" ") and (not self.words or self.words[-1].endswith(" ")):
            text = text[1:]
        if text:
            self.words.append(text)

    def walk(self, root: Node) -> None:
        """Render without recursion, so that deep nesting does no harm."""
        stack: list = [(root, False)]
        while stack:
            node, closing = stack.pop()
            if closing:
                node()
            elif isinstance(node, str):
                self._text(node)
            elif node.name == "br":
                if not self.words:
                    self.words.append(" ")
                self._flush()
            elif node.name == "img":
                self._text(node.attribute("alt") or "")
            elif not node.shown():
                continue
            elif node.name == "table" and self.depth < MAX_NESTED_TABLES:
                self._block(node)
                self._table(node)
                self._block(node)
            elif node.name == "pre":
                self._block(node)
                self._preformatted(node)
                self._block(node)
            else:
                after = self._open(node)
                if after:
                    stack.append((after, True))
                children = node.children
                if node.name == "ol":
                    children = self._numbered(node)
                stack.extend((c, False) for c in reversed(children))
        self._flush()

    def _block(self, node: Node) -> None:
        self._flush()
        if node.name in SPACED and not (node.name in LISTS and self.prefix):
            self.blank_due = True

    def _open(self, node: Node):
        """Start an element; returns what to do at its end."""
        if node.name not in BLOCK:
            return None
        self._block(node)
        prefix = self.prefix
        if node.name == "li":
            marker = node.attribute("data-number") if node.attributes.startswith(" data-number=") else None
            self.first_prefix = prefix + (f"{marker}. " if marker else "- ")
            self.prefix = prefix + "  "
        elif node.name == "blockquote":
            self.prefix = prefix + "> "
        elif node.name == "dd":
            self.prefix = prefix + "  "

        def end() -> None:
            self._block(node)
            self.prefix = prefix
            if node.name == "li":
                self.first_prefix = ""
        return end

    @staticmethod
    def _numbered(node: Node) -> list:
        start = node.attribute("start") or "1"
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, Node) and child.name == "li":
                child.attributes = f" data-number={number}{child.attributes}"
                number += 1
        return node.children

    def _preformatted(self, node: Node) -> None:
        text = "".join(_strings(node)).strip("\n")
        if text.strip():
            if self.blank_due and self.lines:
                self.lines.append("")
            self.blank_due = False
            self.lines.extend((self.prefix + line).rstrip() for line in text.split("\n"))

    def _table(self, table: Node) -> None:
        rows = [[render(cell, self.depth + 1).replace("\n", " ") for cell in cells] for cells in _rows(table)]
        rows = [r for r in rows if any(r)]
        widths = [max((len(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
        for row in rows:
            line = " | ".join(cell.ljust(width) for cell, width in zip(row, widths)).rstrip(" ")
            self.words = [line]
            self._flush()


def _strings(node: Node) -> Iterator[str]:
    stack: list = [node]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            yield at
        elif at.name == "br":
            yield "\n"
        elif at.shown():
            stack.extend(reversed(at.children))


def _rows(table: Node) -> list[list[Node]]:
    """Cells of the table's own rows, a caption or stray content being a row of its own."""
    out, stack = [], list(reversed(table.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip():
                stray = Node("div")
                stray.children = [node]
                out.append([stray])
        elif not node.shown() or node.name in ("colgroup", "col"):
            continue
        elif node.name in ("thead", "tbody", "tfoot"):
            stack.extend(reversed(node.children))
        elif node.name == "tr":
            cells = [c for c in node.children if isinstance(c, Node) and c.name in CELLS and c.shown()]
            others = [c for c in node.children if isinstance(c, str) and c.strip()
                      or isinstance(c, Node) and c.name not in CELLS and c.shown()]
            out.append(cells)
            if others:
                stray = Node("div")
                stray.children = others
                out.append([stray])
        else:
            wrapped = Node("div")
            wrapped.children = [node]
            out.append([wrapped])
    return out


def render(node: Node, depth: int = 0) -> str:
    renderer = Renderer(depth)
    if node.name in CELLS:  # the content of a cell stands for itself
        inner = Node("div")
        inner.children = node.children
        node = inner
    renderer.walk(node)
    return "\n".join(renderer.lines)


def visible_text(source: str) -> str:
    return render(build_tree(source))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, text, n_chars`` of every page (page_id, html).

    A null or empty html gives an empty text. Repeated rows and null ids stay; other columns
    are ignored; an empty table gives an empty result. Nothing is shuffled.
    """
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sources in text_chunks(batches, "html"):
            texts = [visible_text(s.decode("utf-8", "replace")) for s in sources]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(
        extract, "page_id long, text string, n_chars long")
