"""Layout-aware text of HTML pages.

A tree builder turns tags into properly nested elements: void and raw-text
elements, implied ends (``p`` before a block, ``li`` before ``li``, cells, rows,
options ...), implied table rows, and stray ends that are ignored. A renderer
walks the elements as they open and close and writes all visible text: blocks
on lines of their own, blank lines around paragraphs, bullets and numbers with
indents for lists, preformatted text as it is, and tables with aligned columns.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset(
    "head script style template noscript title meta link base iframe noembed noframes datalist rp svg math "
    "object video audio canvas".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul caption xmp plaintext".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset xmp plaintext".split())
PRE = frozenset("pre xmp plaintext".split())
# what may stand in a head; any other start tag there, or text, ends it
HEAD = frozenset("base basefont bgsound link meta title style script noscript noframes template head html".split())
# an opening tag closes these open elements, looking up no further than the fence
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
P_ENDS = BLOCK - {"body", "html", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
TABLE_PARTS = frozenset("td th tr thead tbody tfoot caption".split())

# Columns wider than this are not padded: bounds the blanks a table can add.
ALIGN_WIDTH = 60

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): html.unescape(v.strip("\"'")) for k, v in _ATTR.findall(raw)}


class _Out:
    """Lines of text with collapsed blanks, pending breaks and indents."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks = 0
        self.blank = False
        self.empty = True
        self.indent: list[str] = []
        self.mark = ""

    def need(self, breaks: int) -> None:
        self.breaks = max(self.breaks, breaks)

    def _start(self) -> None:
        if self.breaks or self.empty:
            if not self.empty:
                self.parts.append("\n" * self.breaks)
            lead = "".join(self.indent)
            if self.mark:
                lead = lead[: len(lead) - len(self.mark)] + self.mark
                self.mark = ""
            self.parts.append(lead)
            self.breaks, self.blank, self.empty = 0, False, False
        elif self.blank:
            self.parts.append(" ")
            self.blank = False

    def text(self, s: str) -> None:
        found = s.split(None) if "\xa0" not in s else [w for w in re.split(r"[ \t\n\r\f\v]+", s) if w]
        if not found:
            self.blank = True
            return
        if s[0] in " \t\n\r\f\v":
            self.blank = True
        self._start()
        self.parts.append(" ".join(found))
        self.blank = s[-1] in " \t\n\r\f\v"

    def lines(self, lines: list[str]) -> None:
        for k, line in enumerate(lines):
            if k:
                self.breaks += 1
            if line:
                self._start()
                self.parts.append(line)
        self.blank = False

    def value(self) -> str:
        return "".join(self.parts)


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[str]] = []
        self.caption = ""

    def lines(self) -> list[str]:
        widths: list[int] = []
        for row in self.rows:
            for k, cell in enumerate(row[:-1]):  # the last cell of a row needs no padding
                if k == len(widths):
                    widths.append(0)
                if len(cell) <= ALIGN_WIDTH:
                    widths[k] = max(widths[k], len(cell))
        out = [self.caption] if self.caption else []
        for row in self.rows:
            cells = [c.ljust(widths[k]) if k < len(row) - 1 else c for k, c in enumerate(row)]
            line = " | ".join(cells).rstrip()
            if any(row):
                out.append(line)
        return out


class _Renderer:
    """Receives elements as the tree builder opens and closes them."""

    def __init__(self) -> None:
        self.outs = [_Out()]
        self.tables: list[_Table] = []
        self.lists: list[int | None] = []
        self.pre = 0

    def enter(self, tag: str, attrs: str) -> None:
        out = self.outs[-1]
        if tag == "br":
            out.breaks += 1
            return
        if tag in ("td", "th", "caption") and self.tables:
            if tag != "caption" and not self.tables[-1].rows:
                self.tables[-1].rows.append([])
            self.outs.append(_Out())
            return
        if tag == "tr" and self.tables:
            self.tables[-1].rows.append([])
            return
        if tag in BLOCK:
            out.need(2 if tag in SPACED and not self.lists else 1)
        if tag == "table":
            self.tables.append(_Table())
            self.outs.append(_Out())  # what stands in a table outside its cells
        elif tag in ("ul", "ol", "menu", "dir"):
            start = _attributes(attrs).get("start", "1") if tag == "ol" and attrs else "1"
            self.lists.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if tag == "ol" else None)
        elif tag == "li":
            mark = "- "
            if self.lists and self.lists[-1] is not None:
                mark = f"{self.lists[-1]}. "
                self.lists[-1] += 1
            out.indent.append(" " * len(mark))
            out.mark = mark
        elif tag in ("blockquote", "dd"):
            out.indent.append("    ")
        elif tag in PRE:
            self.pre += 1
        elif tag == "hr":
            out.lines(["----"])
            out.need(1)

    def leave(self, tag: str) -> None:
        if tag in ("td", "th") and self.tables and len(self.outs) > 1:
            cell = self.outs.pop().value()
            self.tables[-1].rows[-1].append(" ".join(cell.split()))
            return
        if tag == "caption" and self.tables and len(self.outs) > 1:
            self.tables[-1].caption = " ".join(self.outs.pop().value().split())
            return
        if tag == "tr" and self.tables:
            return
        if tag == "table" and self.tables:
            stray, table = self.outs.pop(), self.tables.pop()
            out = self.outs[-1]
            out.lines([x for x in (stray.value().split("\n") if not stray.empty else []) if x] + table.lines())
        out = self.outs[-1]
        if tag == "li":
            if out.indent:
                out.indent.pop()
            out.mark = ""
        elif tag in ("blockquote", "dd") and out.indent:
            out.indent.pop()
        elif tag in ("ul", "ol", "menu", "dir") and self.lists:
            self.lists.pop()
        elif tag in PRE:
            self.pre -= 1
        if tag in BLOCK:
            out.need(2 if tag in SPACED and not self.lists else 1)

    def text(self, s: str) -> None:
        if self.pre and len(self.outs) == 1:
            self.outs[-1].lines(s.removesuffix("\n").split("\n"))
        else:
            self.outs[-1].text(s)


def render(page: str | None) -> str:
    """The visible text of one page; empty for null or empty pages. Unclosed
    and misnested tags never fail: what is open at the end is closed there."""
    if not page:
        return ""
    out = _Renderer()
    open_tags: list[str] = []  # with the elements that hide their content
    how_many: Counter = Counter()  # of each name; deep pages are not searched in vain
    hidden_from = -1  # depth of the outermost hidden element
    details: list[int] = []  # depths of closed <details>, whose summary alone shows

    def last(tag: str) -> int:
        k = len(open_tags) - 1
        while open_tags[k] != tag:
            k -= 1
        return k

    def shown() -> bool:
        if hidden_from >= 0:
            return False
        return not details or "summary" in open_tags[details[-1]:]

    def close_to(depth: int) -> None:
        nonlocal hidden_from
        while len(open_tags) > depth:
            visible = shown()
            tag = open_tags.pop()
            how_many[tag] -= 1
            if hidden_from >= len(open_tags):
                hidden_from = -1
            elif visible or tag == "details":
                out.leave(tag)
            if details and details[-1] > len(open_tags):
                details.pop()

    def open_tag(tag: str, raw: str) -> None:
        nonlocal hidden_from
        if open_tags and open_tags[-1] == "head" and tag not in HEAD:
            close_to(len(open_tags) - 1)
        targets, fence = CLOSES.get(tag, ((), ()))
        if targets and any(how_many[x] for x in targets):
            low = len(open_tags)
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k] in fence:
                    break
                if open_tags[k] in targets:
                    low = k
            close_to(low)
        if tag in P_ENDS and how_many["p"]:
            k = last("p")
            if not TABLE_PARTS.intersection(open_tags[k:]):
                close_to(k)
        if tag in ("td", "th") and how_many["table"] and "tr" not in open_tags[last("table"):]:
            open_tag("tr", "")
        if tag in TABLE_PARTS and not how_many["table"]:
            tag = "div"  # parts without a table are plain blocks
        attrs = _attributes(raw) if hidden_from < 0 and raw and (
            "hidden" in raw.lower() or "style" in raw.lower() or tag in ("details", "dialog")) else {}
        hides = tag in UNSEEN or "hidden" in attrs or bool(_HIDING.search(attrs.get("style", ""))) or (
            attrs.get("type", "").lower() == "hidden") or (tag == "dialog" and "open" not in attrs)
        if tag in VOID:
            if not hides and shown():
                out.enter(tag, raw)
            return
        open_tags.append(tag)
        how_many[tag] += 1
        if hidden_from >= 0:
            return
        if hides:
            hidden_from = len(open_tags) - 1
        elif tag == "details" and "open" not in attrs:
            if shown():
                out.enter(tag, raw)
            details.append(len(open_tags))
        elif shown():
            out.enter(tag, raw)

    at, n = 0, len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else n
        if stop > at and open_tags and open_tags[-1] == "head" and html.unescape(page[at:stop]).strip(" \t\n\r\f"):
            close_to(len(open_tags) - 1)
        if stop > at and shown():
            chunk = page[at:stop]
            out.text(html.unescape(chunk) if "&" in chunk else chunk)
        if not found:
            break
        at = found.end()
        end, start = found.group(1), found.group(2) or found.group(4)
        if start:
            tag, raw = start.lower(), found.group(3) or found.group(5) or ""
            open_tag(tag, raw)
            if tag in RAW:
                body = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag != "plaintext" else None
                stop = body.start() if body else n
                if tag == "textarea" and shown():
                    out.text(html.unescape(page[at:stop]))
                elif tag in PRE and shown():
                    out.text(page[at:stop])
                close_to(len(open_tags) - 1)
                at = body.end() if body else n
        elif end:
            tag = end.lower()
            if tag == "br":
                open_tag("br", "")
            elif tag == "p" and not how_many["p"]:
                open_tag("p", "")
                close_to(len(open_tags) - 1)
            elif how_many[tag]:
                k = last(tag)
                # an end tag does not reach out of the cell or table it stands in
                if tag in TABLE_PARTS or tag == "table" or not {"td", "th", "table"}.intersection(open_tags[k + 1:]):
                    close_to(k)
    close_to(0)
    return out.outs[0].value()


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(page_id, text, n_chars)``: the visible text of every page, row by row
    and without a shuffle. Null pages give empty texts, null and repeated ids
    are rows like any other, other columns are ignored, an empty table gives no
    rows. Nothing is cut, whatever a page's length."""
    schema = pa.schema([("page_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what is held as Python strings
                part = batch.slice(at, 256)
                texts = [render(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, "page_id long, text string")
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all pages."""
    return extract_text(read_table(spark, sf_dir, "pages"))
