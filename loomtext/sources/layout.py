"""Layout elements of HTML, by a stack of open tags: headings, paragraphs, list items with their depth, tables as Markdown, formulas as LaTeX.

Tags that HTML lets stay open are ended by what follows them.  Text between two borders of blocks is one element, so an item with a list
inside gives what stands before the list, the list's items, and what stands after it.  A table's cells lie on a grid: a cell that spans
rows or columns is repeated in each place it covers; a table inside a cell becomes that cell's text, cell by cell.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.sources.markup import Events

# Fixed values of HTML: elements without an end; those that end a run of text; those whose text is not shown; what ends what.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = set("script style template noscript iframe object select textarea".split())
NAMED = set("h1 h2 h3 h4 h5 h6 title li caption".split())  # others are paragraphs
LISTS = {"ul", "ol"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "caption": {"caption"}, "body": {"head"}}
STOPS = {"li": LISTS, "dt": {"dl"}, "dd": {"dl"}}  # beyond these nothing is ended; beyond a table never
MOST_COLUMNS, MOST_ROWS = 1000, 65534


@dataclass
class Table:
    """Rows of cells (text, rows, columns) as they come."""

    rows: list[list[tuple[list[str], int, int]]] = field(default_factory=list)

    def grid(self) -> list[list[str]]:
        """A text for each place; cells that span are repeated, spans end with the table; a place that two cells claim has the later one."""
        out: list[dict[int, str]] = [{} for _ in self.rows]
        for y, row in enumerate(self.rows):
            x = 0
            for parts, rows, columns in row:
                while x in out[y]:
                    x += 1
                text = " ".join("".join(parts).split())
                columns = max(1, min(columns, MOST_COLUMNS - x))
                for below in range(y, min(len(out), y + rows) if rows else len(out)):
                    for right in range(x, x + columns):
                        out[below][right] = text
                x += columns
        width = max((max(r) + 1 for r in out if r), default=0)
        return [[r.get(i, "") for i in range(width)] for r in out if r]

    def markdown(self) -> str:
        grid = self.grid()
        line = lambda cells: "| " + " | ".join(c.replace("|", "\\|") for c in cells) + " |"
        return "\n".join([line(grid[0]), "|" + " --- |" * len(grid[0]), *map(line, grid[1:])]) if grid else ""


def _span(value: str | None, most: int, none: int = 1) -> int:
    try:
        return min(most, max(none, int(value or 1)))
    except ValueError:
        return 1


class Layout(Events):
    """elements: (tag, text) in the order of the page."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.elements: list[tuple[str, str]] = []
        self.open: list[str] = []
        self.lists: list[list] = [[None, False]]  # of each open list the last item's number, if it has numbers, and whether its mark is still to come; first that of items without a list
        self.tables: list[Table] = []
        self.text: list[str] = []
        self.latex: list[str] | None = None
        self.read(html)
        self.end_to(0)
        self.flush()

    def cell(self) -> list[str] | None:
        """The text of the innermost open cell; None outside of cells."""
        of = len(self.tables) - 1
        for tag in reversed(self.open):
            if tag in ("td", "th") and of >= 0 and self.tables[of].rows and self.tables[of].rows[-1]:
                return self.tables[of].rows[-1][-1][0]
            of -= tag == "table"
        return None

    def into(self) -> list[str]:
        """Where text goes: the formula, the cell, or the run of text at hand."""
        if self.latex is not None:
            return self.latex
        cell = self.cell()
        return self.text if cell is None else cell

    def flush(self) -> None:
        if (cell := self.cell()) is not None:
            cell.append(" ")
            return
        text = " ".join("".join(self.text).split())
        self.text = []
        if not text:
            return
        tag = next((t for t in reversed(self.open) if t in NAMED), "p") if not (self.open and self.open[-1] == "p" and "li" not in self.open) else "p"
        if tag == "li":
            number, fresh = self.lists[-1]
            mark = ("- " if number is None else f"{number}. ") if fresh else "  "
            text, self.lists[-1][1] = "  " * max(0, len(self.lists) - 2) + mark + text, False
        self.elements.append((tag, text))

    def end_to(self, at: int) -> None:
        while len(self.open) > at:
            tag = self.open[-1]
            if tag in BLOCKS and tag != "table":
                self.flush()
            self.open.pop()
            if tag in LISTS:
                self.lists.pop()
            elif tag == "table":
                done = self.tables.pop()
                if (cell := self.cell()) is not None:
                    cell.extend([" ", " ".join(c for row in done.grid() for c in row if c), " "])
                elif text := done.markdown():
                    self.elements.append(("table", text))
            elif tag in ("math", "annotation", "tex") and self.latex is not None and (tag != "annotation" or "math" not in self.open):
                text, self.latex = " ".join("".join(self.latex).split()), None
                if text and (cell := self.cell()) is not None:
                    cell.append(f" {text} ")
                elif text:
                    self.elements.append(("formula", text))

    def end_last(self, tags: set[str], stops: set[str]) -> None:
        found = None
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i] in tags:
                found = i
                if not ENDS.get("tr", set()) & tags or self.open[i] in ("tr", "tbody", "thead", "tfoot"):
                    break
            elif self.open[i] in stops or self.open[i] == "table":
                break
        if found is not None:
            self.end_to(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        named = dict(attrs)
        if tag in BLOCKS:
            if tag in ENDS:
                self.end_last(ENDS[tag], STOPS.get(tag, set()))
            elif tag not in ("td", "th"):
                self.end_last({"p"}, {"td", "th", "caption", "li", "dd"})
            self.flush()
        if tag in VOID:
            if tag == "br":
                self.into().append(" ")
            return
        if self.too_deep(tag, len(self.open)):
            return
        if tag in LISTS:
            self.lists.append([0 if tag == "ol" else None, False])
        elif tag == "li":
            number = self.lists[-1][0]
            self.lists[-1] = [None if number is None else number + 1, True]
        elif tag == "table":
            self.tables.append(Table())
        elif self.tables and tag == "tr":
            self.tables[-1].rows.append([])
        elif self.tables and tag in ("td", "th"):
            if not self.tables[-1].rows or "tr" not in self.open:
                self.tables[-1].rows.append([])
            self.tables[-1].rows[-1].append(([], _span(named.get("rowspan"), MOST_ROWS, 0), _span(named.get("colspan"), MOST_COLUMNS)))
        elif tag == "math" or tag == "script" and (named.get("type") or "").startswith("math/tex"):
            if tag == "math":
                self.flush()
                self.latex = [named["alttext"] or ""] if "alttext" in named else []
            else:
                self.flush()
                self.latex, tag = [], "tex"
        self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag == "script" and self.open and self.open[-1] == "tex":
            tag = "tex"
        if self.ended_beyond(tag):
            if tag in BLOCKS:
                self.flush()
        elif tag in self.open:
            self.end_last({tag}, set() if tag in ("table", "html", "body") else {"table"} if tag in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption") else {"td", "th"})

    def handle_data(self, data: str) -> None:
        if self.latex is not None:
            # of a formula in MathML its LaTeX is read: the attribute, else an annotation
            if "tex" in self.open or "annotation" in self.open and not "".join(self.latex).strip():
                self.latex.append(data)
        elif not any(t in UNSEEN for t in self.open):
            self.into().append(data)

def layout(html: str | None) -> list[tuple[str, str]]:
    return Layout(html).elements if html else []


def layout_elements(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """(doc_id, pos, tag, text) of a page's headings (title, h1 to h6), paragraphs (p), list items (li), captions, tables and formulas."""
    rows = pages.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{html}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, text in enumerate(batch.column("html").to_pylist()):
                if found := layout(text):
                    tags, texts = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([i] * len(found))), pa.array(range(len(found)), pa.int32()), pa.array(tags), pa.array(texts)], ["doc_id", "pos", "tag", "text"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, pos int, tag string, text string")
