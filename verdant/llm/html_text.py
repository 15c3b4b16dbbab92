"""HTML to text with the layout kept: a tree with implied tags, visibility rules, blocks, lists and tables.

The standard tokenizer's events build a tree: end tags that HTML lets authors leave out are implied
(``head``, ``p``, ``li``, ``dt``/``dd``, ``option``, table parts), missing table rows are added, stray end tags are
dropped. A node is invisible by its kind, by ``hidden``, or where the cascade of the page's style sheets and inline
styles (see ``_css``) ends in ``display: none`` or ``visibility: hidden``; of closed ``details`` the summary shows. The
tree is then walked once, without recursion, by
writers: one for the page and one for each open table cell.

- Blocks start on lines of their own, paragraphs, headings, lists and tables after an empty line.
- List items carry ``- `` or their number, two blanks deeper per nested list.
- Cells of a table are padded to the width of their column and parted by `` | ``; ``colspan`` and
  ``rowspan`` leave empty cells, cells of several lines make several lines.
- Lists and tables nested more than ``DEEP`` deep keep their text, without further indentation and columns.
- Text that stands in a table but in no cell goes before the table, as in browsers.
- Text of ``svg`` and ``math`` is kept, but for definitions, descriptions and annotations; what ``use`` draws is not repeated.
- Runs of white space are one blank, but for ``pre`` and ``textarea``.

Cases: NULL html gives empty text; broken markup never raises; texts of any depth and length are walked
whole; repeated rows and NULL ids stay; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdant.llm._css import Cascade, applies

# Element groups of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript datalist iframe object audio video canvas".split())
# Within svg and math: what is never drawn, where HTML starts again, tags that end them, and parts that stand apart from each other.
FOREIGN_UNSEEN = frozenset("defs desc metadata symbol clippath mask marker pattern annotation annotation-xml".split())
INTEGRATION = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
APART = frozenset("mfrac mroot msub msup msubsup munder mover munderover mtable mtr mlabeledtr mmultiscripts svg".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure".split())
CLOSES_P = BLOCKS - {"body", "html", "option", "optgroup", "legend", "li", "dd", "dt"}
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
PARTS = frozenset("table tr td th caption".split())
SCOPES = frozenset("table td th caption html template".split())
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    **{part: ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}) for part in ("thead", "tbody", "tfoot")},
}

_BLANKS = re.compile(r"[ \t\n\r\f]+")
#: Lists and tables nested deeper than this get no further indentation and columns.
DEEP = 32


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Tree(HTMLParser):
    """Builds ``root``; ``sheets`` gathers the style sheets for screens.

    ``at`` holds, per tag, the places of its open elements, so that no step walks the open elements.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = defaultdict(list)
        self.at["html"].append(0)
        self.sheets: list[str] = []
        self.foreign = False  # whether the page has svg or math at all

    def _last(self, tags: frozenset | set | tuple) -> int:
        """Place of the innermost open element of these tags, or -1."""
        return max((places[-1] for tag in tags if (places := self.at.get(tag))), default=-1)

    def _foreign(self) -> str:
        """``svg`` or ``math`` where their rules hold at this place, ``text`` in text of an svg, else nothing."""
        last = self._last(("svg", "math")) if self.foreign else -1
        if last < 0 or self._last(INTEGRATION) > last:
            return ""
        tag = self.open[last].tag
        return "text" if tag == "svg" and self._last(("text",)) > last else tag

    def _open(self, node: Node) -> None:
        self.at[node.tag].append(len(self.open))
        self.open.append(node)

    def _close(self, low: int) -> None:
        """Closes the element at this place and all in it."""
        while len(self.open) > low:
            self.at[self.open.pop().tag].pop()

    def _cut(self, ends: set[str], stops: frozenset | set) -> None:
        """Closes everything down to the lowest of ``ends`` that no element of ``stops`` shields."""
        stop = max(self._last(stops), 0)
        lows = [places[i] for tag in ends if (places := self.at.get(tag)) and (i := bisect_right(places, stop)) < len(places)]
        if lows:
            self._close(min(lows))

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._open(node)

    def parse_html_declaration(self, i):
        """``<![`` starts a bogus comment, which ends at the next ``>`` or with the page; the tokenizer raises at most of them."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        return self.rawdata.find(">", i) + 1 or len(self.rawdata)

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if self._foreign():
            if tag not in BREAKOUT:
                if tag in FOREIGN_UNSEEN:
                    given["hidden"] = ""
                if tag in ("text", "foreignobject") or self.open[-1].tag in APART:
                    self.open[-1].children.append(" ")
                node = Node(tag, given)
                self.open[-1].children.append(node)
                self._open(node)
                return
            while self._foreign():
                self._close(len(self.open) - 1)
        if tag in ("svg", "math"):
            self.foreign = True
        if tag in ("html", "body"):
            if tag == "body":
                self._cut({"head"}, SCOPES)
            target = self.root if tag == "html" else self.open[self.at["body"][0]] if self.at.get("body") else None
            if target is None:
                self._push(tag, given)
            else:
                target.attrs = given | target.attrs
            return
        if tag == "head" and (len(self.open) > 1 or any(not isinstance(c, str) or c.strip() for c in self.root.children)):
            return  # a second head, or one after content, is only its content
        if self.open[-1].tag == "head" and tag not in IN_HEAD:
            self._close(len(self.open) - 1)
        if tag in CLOSES_P:
            self._cut({"p"}, SCOPES)
        if tag in IMPLIED_END:
            self._cut(*IMPLIED_END[tag])
        if tag in ("td", "th") and self.open[-1].tag != "tr":
            if self.open[-1].tag not in ("table", "thead", "tbody", "tfoot"):
                return  # a cell outside a table is only its content
            self._push("tr", {})
        if tag == "tr" and self.open[-1].tag not in ("table", "thead", "tbody", "tfoot"):
            return
        self._push(tag, given)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if (tag in ("svg", "math") or self._foreign()) and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)
        elif self.foreign and tag in INTEGRATION and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)
            if not self._foreign():  # it stood in HTML, where the slash means nothing
                self._open(self.open[-1].children[-1])

    def handle_endtag(self, tag):
        if self.open[-1].tag == "head":
            if tag not in ("head", "br", "html", "body"):
                return
            self._close(len(self.open) - 1)
        if tag == "p" and not self.at.get("p"):
            self._push("p", {})
        if tag in ("br", "html", "body"):
            if tag == "br":
                self._push("br", {})
            return
        stops = {"table"} if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else set() if tag in SCOPES else SCOPES
        low = self._last((tag,))
        if low > max(self._last(stops), 0):
            self._close(low)

    def handle_data(self, data):
        if self.open[-1].tag == "head" and data.strip(" \t\n\r\f"):
            self._close(len(self.open) - 1)
        if self.open[-1].tag == "style" and applies(self.open[-1].attrs.get("media", "")):
            self.sheets.append(data)
        if self._foreign() == "svg" and data.strip():  # only its text elements are drawn
            return
        self.open[-1].children.append(data)


class Writer:
    """Lines of one page or cell: collapses blanks, keeps the gap between blocks, indents lists."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.blank = False  # white space stands between the line so far and what comes
        self.gap = 0  # empty lines owed before the next text
        self.margins = [""]
        self.mark = ""

    def text(self, data: str) -> None:
        words = _BLANKS.sub(" ", data)
        if words.startswith(" ") and self.line:
            self.blank = True
        body = words.strip(" ")
        if body:
            self._open()
            self.line += [" " * self.blank, body]
            self.blank = False
        if words.endswith(" ") and self.line:
            self.blank = True

    def raw(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").split("\n")
        self._open()
        self.line += [" " * self.blank, first]
        self.blank = False
        for line in rest:
            self.lines.append("".join(self.line).rstrip())
            self.line = [self.margins[-1], line]

    def _open(self) -> None:
        if not self.line:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            margin = self.margins[-1]
            self.line = [margin[: len(margin) - len(self.mark)] + self.mark if self.mark else margin, ""]
            self.mark = ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        self.line, self.blank = [], False

    def line_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.gap = max(self.gap, 1)

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(spaced))

    def item(self, mark: str) -> None:
        self.margins.append(self.margins[-1] + " " * len(mark) if len(self.margins) <= DEEP else self.margins[-1])
        self.mark = mark

    def end_item(self) -> None:
        self.end_line()
        if self.mark:  # an item without any text still shows its mark
            self._open()
            self.end_line()
        self.margins.pop()

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def _number(value: str, least: int, most: int) -> int:
    return min(max(int(value), least), most) if value.isascii() and value.isdigit() and len(value) < 6 else least


def table_lines(rows: list[list[tuple[int, int, int, list[str]]]]) -> list[str]:
    """Aligned lines of a table; a cell is (column, columns, rows, lines)."""
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> rows still covered from above
    for cells in rows:
        row, at = {}, 0
        for span, depth, lines in cells:
            while taken.get(at, 0):
                at += 1
            row[at] = lines
            for c in range(at, at + span):
                taken[c] = max(taken.get(c, 0), depth)
            at += span
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        grid.append(row)
    columns = max((c for row in grid for c in row), default=-1) + 1
    width = [max((len(line) for row in grid for line in row.get(c, ())), default=0) for c in range(columns)]
    used = [c for c in range(columns) if width[c]]
    out = []
    for row in grid:
        for i in range(max((len(lines) for lines in row.values()), default=0)):
            parts = [(row.get(c, ())[i] if i < len(row.get(c, ())) else "").ljust(width[c]) for c in used]
            line = " | ".join(parts).rstrip()
            if line.strip(" |"):
                out.append(line)
    return out


def _seen(node: Node, found: dict[str, str], shown: bool) -> tuple[bool, bool]:
    """(whether to walk the node at all, whether its own text is visible) by the element, its attributes and what styles say."""
    a = node.attrs
    if node.tag in UNSEEN or (node.tag == "input" and a.get("type", "").lower() == "hidden"):
        return False, False
    plain = "none" if "hidden" in a or (node.tag == "dialog" and "open" not in a) else "block"
    display = found.get("display", plain)
    if display in ("none",) or (display in ("revert", "revert-layer") and plain == "none"):
        return False, False
    visibility = found.get("visibility", "inherit")
    if visibility == "initial":
        visibility = "visible"
    return True, visibility == "visible" or (shown and visibility not in ("hidden", "collapse"))


def render(html: str) -> str:
    """The visible text of a page."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    styles = Cascade(tree.sheets)
    writers, tables, lists = [Writer()], [], []
    flat = 0  # open tables that are nested too deep for columns
    stack: list[tuple] = [(tree.root, False, True, False)]  # node, leaving, visible, preformatted
    while stack:
        node, leaving, shown, pre = stack.pop()
        out = writers[-1]
        if isinstance(node, str):
            if shown:
                (out.raw if pre else out.text)(node)
            continue
        tag = node.tag
        if not leaving:
            walk, shown = _seen(node, styles.enter(tag, node.attrs), shown)
            if not walk or tag == "br":
                styles.leave()
                if walk:
                    out.line_break()
                continue
            if (tag == "table" and len(tables) >= DEEP) or (flat and tag in PARTS):
                flat += tag == "table"
                out.block(tag == "table")
            elif tag == "table":
                out.block(True)
                tables.append([])
            elif tag in ("td", "th", "caption") and tables:
                writers.append(Writer())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCKS:
                out.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                lists.append(_number(node.attrs.get("start", ""), 1, 99999) if tag == "ol" else None)
            elif tag == "li":
                number = lists[-1] if lists else None
                if number is not None:
                    lists[-1] = number + 1
                out.item("- " if number is None else f"{number}. ")
            pre = pre or tag in ("pre", "textarea")
            stack.append((node, True, shown, pre))
            children = node.children
            if tag == "details" and "open" not in node.attrs:  # closed: its summary is all that shows
                children = [c for c in children if not isinstance(c, str) and c.tag == "summary"][:1]
            if tag in ("table", "tr", "thead", "tbody", "tfoot", "colgroup"):  # blanks between the parts of a table are no text, other text goes before it
                children = [c for c in children if not isinstance(c, str) or c.strip(" \t\n\r\f")]
            elif tag in ("pre", "textarea") and children and isinstance(children[0], str):
                children = [children[0].removeprefix("\n"), *children[1:]]
            stack += [(c, False, shown, pre) for c in reversed(children)]
            continue
        styles.leave()
        if flat and tag in PARTS:
            flat -= tag == "table"
            out.block(tag == "table")
        elif tag in ("td", "th") and tables:
            lines = writers.pop().result()
            if tables[-1]:
                tables[-1][-1].append((_number(node.attrs.get("colspan", ""), 1, 1000), _number(node.attrs.get("rowspan", ""), 1, 65534), lines))
        elif tag == "caption" and tables:
            lines = writers.pop().result()
            for line in lines:
                writers[-1].raw(line)
                writers[-1].end_line()
        elif tag == "table":
            if out.line:
                out.block(True)
            for line in table_lines(tables.pop()):
                out.raw(line)
                out.end_line()
            out.block(True)
        elif tag == "li":
            out.end_item()
        elif tag in BLOCKS:
            out.block(tag in SPACED and not (tag in ("ul", "ol") and len(lists) > 1))
        if tag in ("ul", "ol", "menu") and lists:
            lists.pop()
    return "\n".join(writers[0].result())


def extract(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, text): the visible text of every page."""
    schema = T.StructType([T.StructField("page_id", pages.schema[page_id].dataType), T.StructField("text", T.StringType())])

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = [render(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "text"])

    return pages.select(F.col(page_id).alias("page_id"), F.col(html).alias("html")).mapInArrow(batches, schema)
