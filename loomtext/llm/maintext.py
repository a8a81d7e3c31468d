"""Main text of web pages, from the events of the standard library's streaming HTML parser.

Events build two small lists as they come: elements that can hold blocks, and lines, one for each block of text, with the tags met in it.  A
line's ratio is its characters to its tags, on a logarithmic scale; the ratios are smoothed over neighbouring lines by a Gaussian and cut by
the threshold between two clusters (two means).  Lines above it are content, and they select the region: the article, or the main element,
or the innermost element around them.  All lines of the region belong to the text, short ones too, but for those inside elements that are
set apart by their tag, role or class (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments), and lists of links.

Character references are decoded, white space inside a block is one space (so is <br>), blocks are joined by one newline.  Any text is
read to its end as browsers read it: an unclosed comment reaches that far.  A null or empty html, or one without content, gives an empty text; repeated rows are each
extracted; an empty table gives an empty one.  Rows are independent: nothing is shuffled, and a page is the most that a task holds besides
a batch.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import sliced
from loomtext.sources.markup import Events

SIGMA, REACH = 1.0, 2  # of the Gaussian, in lines
SHARE = 0.2  # of the content that an article must hold to be the region
MOST = 0.9  # of the content that an element must hold to be gone into

# Fixed values of HTML: elements without an end, those that end a block of text, and those that end others when they begin.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary table tbody td template tfoot th thead title tr ul".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HEAD = set("base link meta noscript script style template title".split())
CELL = {"td", "th", "caption"}
TABLE = {"table", "tbody", "thead", "tfoot", "tr", *CELL}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead"}, "option": {"option"}, "body": {"head"}}
#: beyond these an element does not end an earlier one of its kind
WITHIN = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}

# What is set apart from the main text: by tag, by role, and by a word of its class or id.
APART = set("aside audio button canvas dialog embed footer head iframe input label map math menu nav noscript object script search select style svg template textarea video".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar tooltip".split())
ALWAYS = set("ad ads adsbox adslot adsense advert adverts advertisement advertisements advertising aside breadcrumb breadcrumbs colophon comment comments commentlist consent cookie cookies cookiebar disqus footer gdpr masthead menu modal nav navbar navigation navi newsletter outbrain pager pagination paywall popup promo promotion promotions recommended recommendations related replies respond share sharing shares sidebar sidenav signup skip social sponsor sponsored sponsors subscribe subscription taboola topbar topnav".split())
MAYBE = set("alert banner bar disclaimer discussion follow form hidden invisible login links notice notices notification overlay popular register rail reply responses reviews search signin tags teaser toast toolbar trending widget widgets".split())
#: a class or id with such a word names content, unless another word of it is in ALWAYS
CONTENT = set("article body content entry main post story text".split())
#: a class that begins so tells of the page, not of the element
OF_PAGE = {"has", "with", "no", "not", "without"}
COMMENTS = re.compile(r"(\d+\s+)?(reader\s+|user\s+)?(comments?|responses|replies|commentaires?|kommentare?|comentarios?)(\s*\(?\d*\)?)?:?", re.IGNORECASE)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

OK, OUT, FORM, HEADER = range(4)


def apart(tag: str, attrs: dict[str, str | None]) -> int:
    """OUT if role, class, id or a hiding attribute set an element apart, HEADER if only a class makes it one, else OK."""
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or HIDING.search(attrs.get("style") or ""):
        return OUT
    if (attrs.get("role") or "").lower() in ROLES:
        return OUT
    if tag in ("html", "body", "main"):
        return OK
    kind = OK
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or words[0] in OF_PAGE:
            continue
        if not ALWAYS.isdisjoint(words):
            return OUT
        if tag in BLOCK and tag not in HEADINGS and CONTENT.isdisjoint(words):
            if not MAYBE.isdisjoint(words):
                return OUT
            if "header" in words:
                kind = HEADER
    return kind


class Page(Events):
    """Elements (parent, tag, kind) and lines (text, element, tags, characters in links) of a page."""

    def __init__(self, html: str) -> None:
        super().__init__()
        self.parent, self.tag, self.kind, self.holds = [0], [""], [OK], [False]  # element 0 is the page
        self.lines: list[tuple[str, int, int, int]] = []
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, innermost element that holds blocks, whether text inside is left out
        self.count: Counter[str] = Counter()
        self.words: list[str] = []
        self.tags = self.linked = 0
        self.read(html)
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, self.open[-1][1], max(1, self.tags), self.linked))
        if text or not self.words:
            self.tags = self.linked = 0
        self.words = []

    def pop_to(self, at: int) -> None:
        for tag, _, _ in self.open[at:]:
            self.count[tag] -= 1
        del self.open[at:]

    def end_of(self, tags: set[str], within: set[str]) -> None:
        """End the innermost open element with one of these tags, unless one of `within` lies between."""
        if any(self.count[t] for t in tags):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i][0] in tags:
                    self.pop_to(i)
                    return
                if self.open[i][0] in within:
                    return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCK
        if block:
            self.flush()
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.words.append(" ")
            return
        if self.count["head"] and tag not in HEAD and tag != "head":
            self.end_of({"head"}, set())
        if tag in ENDS:
            self.end_of(ENDS[tag], WITHIN.get(tag, set()))
        elif block and self.count["p"]:
            self.end_of({"p"}, CELL | {"button", "object"})
        if self.too_deep(tag, len(self.open)):
            return
        _, element, left_out = self.open[-1]
        named = dict(attrs)
        kind = OUT if tag in APART else apart(tag, named)
        if kind == OK:
            kind = FORM if tag == "form" else HEADER if tag == "header" else OK
        if block:
            if named.get("itemprop") == "articleBody" or named.get("role") in ("main", "article"):
                tag_of = "main" if named.get("role") == "main" else "article"
            else:
                tag_of = tag
            self.parent.append(element)
            self.tag.append(tag_of)
            self.kind.append(kind)
            self.holds.append(False)
            element = len(self.parent) - 1
            if tag in ("article", "main", "h1", "h2") and kind == OK:
                above = element
                while above and not self.holds[above]:
                    self.holds[above] = True
                    above = self.parent[above]
        self.open.append((tag, element, left_out or kind == OUT and not block))
        self.count[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # only void elements end themselves in HTML

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK:
            self.flush()
        if tag not in VOID and not self.ended_beyond(tag):
            self.end_of({tag}, set() if tag in TABLE else CELL)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.words.append(data)
            if self.count["a"]:
                self.linked += len(data.strip())

def content_lines(lines: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Which lines' smoothed ratio of text to tags lies above the threshold between two clusters."""
    ratio = np.log1p(np.array([len(text) / tags for text, _, tags, _ in lines]))
    kernel = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    smooth = np.convolve(np.pad(ratio, REACH, "edge"), kernel / kernel.sum(), "valid")
    threshold = smooth.mean()
    for _ in range(100):
        above = smooth >= threshold
        if above.all() or not above.any():
            return np.ones(len(lines), bool)
        moved = (smooth[above].mean() + smooth[~above].mean()) / 2
        if moved == threshold:
            break
        threshold = moved
    return smooth >= threshold


def left_out(page: Page) -> list[bool]:
    """For each element whether it lies in one that is set apart; a form or header that holds the article's head or the article does not count."""
    out = [False]
    inside = [False]
    for i in range(1, len(page.parent)):
        above, kind = page.parent[i], page.kind[i]
        inside.append(inside[above] or page.tag[i] in ("article", "main"))
        gone = kind == OUT or kind == FORM and not page.holds[i] or kind == HEADER and not (page.holds[i] and inside[above])
        out.append(out[above] or gone)
    return out


def _region(page: Page, lines: list[tuple[str, int, int, int]]) -> set[int] | None:
    """The elements whose lines make the text; None for the whole page."""
    content = content_lines(lines)
    n = len(page.parent)
    weight, size, title = [0] * n, [0] * n, [0] * n
    for (text, element, _, _), good in zip(lines, content.tolist(), strict=True):
        weight[element] += len(text) if good else 0
        size[element] += len(text)
        title[element] += page.tag[element] == "h1"
    for i in range(n - 1, 0, -1):
        for sums in (weight, size, title):
            sums[page.parent[i]] += sums[i]
    for tag in ("article", "main"):
        outer: list[int] = []
        last: set[int] = set()
        for i in range(1, n):
            if page.parent[i] in last:
                last.add(i)
            elif page.tag[i] == tag and size[i]:
                outer.append(i)
                last.add(i)
        if outer and (sum(weight[i] for i in outer) >= SHARE * weight[0] or sum(size[i] for i in outer) >= SHARE * size[0]):
            longest = max(outer, key=lambda i: size[i])
            return {longest} if 2 * size[longest] >= sum(size[i] for i in outer) else set(outer)
    at = 0
    while True:
        inner = [i for i in range(at + 1, n) if page.parent[i] == at and page.tag[i] in ("body", "html", "div", "section", "center", "table", "tbody", "tr", "td") and weight[i] >= MOST * weight[at] and title[i] == title[at]]
        if not inner or not weight[at]:
            return {at} if at else None
        at = inner[0]


def main_text(html: str) -> str:
    """The main text of a page."""
    page = Page(html)
    out = left_out(page)
    lines = [x for x in page.lines if not out[x[1]]]
    if not lines:
        return ""
    region = _region(page, lines)
    n = len(page.parent)
    wanted = [region is None] * n
    linked, size, links = [0] * n, [0] * n, [0] * n  # of lists and what they hold
    for text, element, _, in_links in lines:
        linked[element] += in_links
        size[element] += len(text)
        links[element] += in_links > 0
    for i in range(n - 1, 0, -1):
        for sums in (linked, size, links):
            sums[page.parent[i]] += sums[i]
    for i in range(1, n):
        menu = page.tag[i] in ("ul", "ol", "dir") and links[i] >= 3 and linked[i] >= 0.8 * size[i]
        wanted[i] = (wanted[page.parent[i]] or region is not None and i in region) and not menu
    for text, element, _, _ in lines:  # a section that begins with such a heading holds readers' comments
        if page.tag[element] in HEADINGS and COMMENTS.fullmatch(text):
            section = page.parent[element]
            if section and section not in (region or ()) and page.tag[section] in ("section", "div"):
                wanted[section] = False
                for i in range(section + 1, n):
                    wanted[i] = wanted[i] and wanted[page.parent[i]]
    return "\n".join(text for text, element, _, _ in lines if wanted[element])


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns named in keep, and text and n_chars (its code points) of each page's html; keep may not name text or n_chars."""
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are what extract returns")
    rows = pages.select(*(F.col(f"`{c}`") for c in keep), F.col("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text="html", kind="maintext"):
            texts = [main_text(h) if h else "" for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)

    names = [*keep, "text", "n_chars"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kind}, text string, n_chars long" if keep else "text string, n_chars long")
