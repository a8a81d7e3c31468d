"""Chunkers: each turns a text into an array of chunks within its row, so that chunking never shuffles.

Folds over ordered pieces run as higher-order functions on the JVM.  `chunk` explodes them to (doc_id, chunk_no, chunk_id, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.config import SECTION_HEADINGS, Chunking, Gathering
from loomtext.functions.text import MARK, dot, fold, hash_embedding, let, no_strings, rx, strip, words

PAGE_MARK = r"\n\s*---\s*Page\s*(\d+)\s*---\s*\n"
MERGED_PAGE_CHARS = 4000  # fixed value
MIN_CHUNK_CHARS = 200  # fixed value
# fixed values: beginnings of parts that are headings
HEADING_PREFIX = "abstract|introduction|background|related|prelim|method|approach|model|architect|implement|train|dataset|benchmark|experimental|setup|experiment|result|evaluat|analysis|ablation|discuss|limit|future|conclus|contribution|finding|proposed"
# fixed values: what a line that opens a section consists of
SECTION_NAMES = ("abstract", "introduction", "background", "related work", "method", "methodology", "experiment", "experiments", "result", "results", "discussion", "conclusion", "conclusions", "references")
NUMBERED_LINE = r"\d+(?:\.\d+)*\s+.+"


def _push(out: Column, value: Column) -> Column:
    return F.concat(out, F.array(value))


def _no_blank(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def paragraphs(c: Column, min_chars: int = 160) -> Column:
    """Pieces between blank lines of at least min_chars; the whole text if there is none."""
    long = F.filter(F.transform(F.split(c, "\n\n"), strip), lambda p: F.length(p) >= min_chars)
    return let(long, lambda ps: F.when(F.size(ps) > 0, ps).when(strip(c) != "", F.array(strip(c))).otherwise(no_strings()))


def tail_paragraphs(c: Column, k: int) -> Column:
    return let(_no_blank(F.split(c, "\n\n")), lambda ps: F.array_join(F.slice(ps, F.greatest(F.size(ps) - k, F.lit(0)) + 1, k), "\n\n"))


def with_overlap(chunks: Column, k: int) -> Column:
    """Each chunk but the first after the last k paragraphs of the one before, as that was without overlap."""

    def one(c: Column, i: Column) -> Column:
        return F.when(i == 0, c).otherwise(let(tail_paragraphs(F.get(chunks, i - 1), k), lambda t: F.when(t == "", c).otherwise(F.concat(t, F.lit("\n\n"), c))))

    return F.transform(chunks, one) if k > 0 else chunks


def semantic_chunks(c: Column, how: Gathering = Gathering()) -> Column:
    """Paragraphs gathered while they fit, and while they stay alike once the target length is reached."""
    state = lambda out, buf, n, emb: F.struct(out.alias("out"), buf.alias("buf"), n.alias("n"), emb.alias("emb"))
    zero = state(no_strings(), F.lit(None).cast("string"), F.lit(0), F.array().cast("array<double>"))

    def step(s: Column, p: Column) -> Column:
        size, emb = F.length(p), hash_embedding(p)
        projected = s["n"] + 2 + size
        far = (projected > how.target) & (dot(s["emb"], emb) < how.likeness)
        mean = F.zip_with(s["emb"], emb, lambda a, b: (a + b) / 2)
        return (
            F.when(s["buf"].isNull(), state(s["out"], p, size, emb))
            .when((projected > how.longest) | far, state(_push(s["out"], s["buf"]), p, size, emb))
            .otherwise(state(s["out"], F.concat(s["buf"], F.lit("\n\n"), p), projected, mean))
        )

    gathered = F.aggregate(paragraphs(c, how.shortest_paragraph), zero, step, lambda s: F.when(s["buf"].isNull(), s["out"]).otherwise(_push(s["out"], s["buf"])))
    return let(gathered, lambda chunks: with_overlap(chunks, how.repeated_paragraphs))


def section_chunks(c: Column, max_chars: int = 3500, overlap: int = 450, headings: tuple[str, ...] = SECTION_HEADINGS) -> Column:
    """Parts between headings gathered up to max_chars, headings marked ##; a chunk's last `overlap` characters open the next."""
    names = "|".join(headings).replace(" ", r"\s+")
    found = rx(rf"^(?:\d+\.|[IVX]+\.|[IVX]+\b|\d+\b)?\s*({names})\s*$", "im")
    parts = F.filter(F.split(F.regexp_replace(strip(c), found, f"{MARK}$1{MARK}"), MARK), lambda p: p != "")
    state = lambda out, cur: F.struct(out.alias("out"), cur.alias("cur"))
    joined = lambda cur, p: F.when(cur.isNull(), p).otherwise(F.concat(cur, F.lit(" "), p))

    def rest(full: Column) -> Column:
        tail = strip(F.substr(full, F.greatest(F.length(full) - overlap, F.lit(0)) + 1)) if overlap > 0 else F.lit("")
        return F.nullif(tail, F.lit(""))

    def step(s: Column, part: Column) -> Column:
        p = strip(part)
        heading = (F.length(p) < 60) & p.rlike(rx(f"^(?:{HEADING_PREFIX})", "i"))
        longer = let(joined(s["cur"], p), lambda j: let(strip(j), lambda full: F.when(F.length(full) >= max_chars, state(_push(s["out"], full), rest(full))).otherwise(state(s["out"], j))))
        return F.when(heading, state(s["out"], joined(s["cur"], F.concat(F.lit("\n\n## "), p, F.lit("\n\n"))))).otherwise(longer)

    chunks = F.aggregate(parts, state(no_strings(), F.lit(None).cast("string")), step, lambda s: F.when(s["cur"].isNull(), s["out"]).otherwise(_push(s["out"], strip(s["cur"]))))
    return F.filter(chunks, lambda x: F.length(strip(x)) >= MIN_CHUNK_CHARS)


def sliding_chunks(c: Column, window: int = 2800, step: int = 900, max_chunks: int = 30) -> Column:
    """Windows of characters at every step, of at least 200 characters, the first max_chunks of them."""

    def windows(t: Column) -> Column:
        if window <= 0 or step <= 0:
            return F.when(t == "", no_strings()).otherwise(F.array(t))
        # a window is cut from the few pieces of `step` characters that it begins in, not from the whole text
        def cut(pieces: Column) -> Column:
            each = F.transform(pieces, lambda p, i: strip(F.substr(F.array_join(F.slice(pieces, i + 1, -(-window // step)), ""), F.lit(1), F.lit(window))))
            return F.slice(F.filter(each, lambda x: F.length(x) >= MIN_CHUNK_CHARS), 1, max_chunks)

        return let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)), cut)

    return let(strip(c), windows)


def page_chunks(c: Column, min_chars: int = 150) -> Column:
    """Pages between markers, short ones merged; what stays shorter than min_chars is dropped."""
    pages = _no_blank(F.split(strip(c), rx(r"\n*--- Page \d+ ---\n*")))
    state = lambda out, buf: F.struct(out.alias("out"), buf.alias("buf"))
    flushed = lambda s: F.when((s["buf"] != "") & (F.length(s["buf"]) >= min_chars), _push(s["out"], s["buf"])).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        merge = (s["buf"] != "") & (F.length(s["buf"]) + F.length(p) < MERGED_PAGE_CHARS)
        return F.when(merge, state(s["out"], F.concat(s["buf"], F.lit("\n\n"), p))).otherwise(state(flushed(s), p))

    return F.aggregate(pages, state(no_strings(), F.lit("")), step, flushed)


def split_pages(c: Column) -> Column:
    """array<struct<page, body>>: bodies after page markers on lines of their own (text before the first goes), or the whole text as page 1."""
    mark = rx(PAGE_MARK, "i")
    row = lambda page, body: F.struct(page.cast("long").alias("page"), body.alias("body"))

    def marked(found: Column) -> Column:
        rows = F.transform(found["heads"], lambda n, i: row(n.try_cast("long"), strip(F.get(found["bodies"], i + 1))))
        return F.when(F.size(found["heads"]) > 0, F.filter(rows, lambda r: r["body"] != "")).otherwise(F.filter(F.array(row(F.lit(1), strip(c))), lambda r: r["body"] != ""))

    return let(F.struct(F.regexp_extract_all(c, F.lit(mark), 1).alias("heads"), F.split(c, mark).alias("bodies")), marked)


def split_sections(c: Column) -> Column:
    """array<struct<title, body>>: bodies after heading lines (text before the first goes), or the whole under the title `page`."""
    # one look at each beginning of a line, not one for each name
    lines = rx(rf"^\s*(?:(?:{'|'.join(sorted(SECTION_NAMES, key=len, reverse=True))})\s*|{NUMBERED_LINE})$", "im")
    row = lambda title, body: F.struct(title.alias("title"), body.alias("body"))

    def headed(found: Column) -> Column:
        rows = F.filter(F.transform(found["heads"], lambda t, i: row(fold(t), strip(F.get(found["bodies"], i + 1)))), lambda r: r["body"] != "")
        return let(rows, lambda r: F.when(F.size(r) > 0, r).otherwise(F.array(row(F.lit("page"), strip(c)))))

    return let(F.struct(F.regexp_extract_all(c, F.lit(lines), 0).alias("heads"), F.split(c, lines).alias("bodies")), headed)


def word_windows(c: Column, target: int = 900, overlap: int = 150) -> Column:
    """Paragraphs gathered up to `target` words, with the last ones of at most `overlap` words (at least one) repeated; very long ones cut at once."""
    # the fold keeps numbers only (a state is copied at every step), runs of paragraphs become texts once it is done
    paras = F.transform(_no_blank(F.split(c, rx(r"\n\s*\n+"))), lambda p: F.struct(p.alias("p"), F.size(F.split(p, rx(r"\s+"))).alias("w")))  # no blanks at the ends
    long = lambda p: p["w"] > target * 1.5
    state = lambda out, at, start, some, n: F.struct(out.alias("out"), at.alias("at"), start.alias("start"), some.alias("some"), n.alias("n"))
    run = lambda start, end: start.cast("bigint") * (1 << 31) + end
    no_runs = F.array().cast("array<bigint>")

    def kept(ps: Column, s: Column) -> Column:
        """Where the paragraphs begin that the next run repeats, how many they are and how many words they have."""
        zero = F.struct(s["at"].alias("start"), F.lit(0).alias("some"), F.lit(0).alias("n"), F.lit(False).alias("full"))
        if overlap <= 0:
            return zero

        def back(k: Column, p: Column) -> Column:
            full = k["full"] | (~long(p) & (k["n"] + p["w"] > overlap) & (k["some"] > 0))
            new = ~full & ~long(p)
            return F.struct(F.when(full, k["start"]).otherwise(k["start"] - 1).alias("start"), (k["some"] + new.cast("int")).alias("some"), F.when(new, k["n"] + p["w"]).otherwise(k["n"]).alias("n"), full.alias("full"))

        return F.aggregate(F.reverse(F.slice(ps, s["start"] + 1, s["at"] - s["start"])), zero, back)

    def step(ps: Column):
        def one(s: Column, p: Column) -> Column:
            begin = lambda some, start: F.when(some == 0, s["at"]).otherwise(start)
            flushed = let(kept(ps, s), lambda k: state(_push(s["out"], run(s["start"], s["at"])), s["at"] + 1, begin(k["some"], k["start"]), k["some"] + 1, k["n"] + p["w"]))
            return (
                F.when(long(p), state(_push(s["out"], -1 - s["at"].cast("bigint")), s["at"] + 1, s["start"], s["some"], s["n"]))
                .when((s["some"] > 0) & (s["n"] + p["w"] > target), flushed)
                .otherwise(state(s["out"], s["at"] + 1, begin(s["some"], s["start"]), s["some"] + 1, s["n"] + p["w"]))
            )

        return one

    def cut(p: Column) -> Column:
        return let(F.split(p["p"], rx(r"\s+")), lambda ws: F.transform(F.sequence(F.lit(0), F.size(ws) - 1, F.lit(max(1, target - overlap))), lambda i: F.array_join(F.slice(ws, i + 1, target), " ")))

    def texts(ps: Column, of: Column) -> Column:
        start, end = F.shiftright(of, 31).cast("int"), of.bitwiseAND((1 << 31) - 1).cast("int")
        short = F.filter(F.slice(ps, start + 1, end - start), lambda p: ~long(p))
        return F.when(of < 0, cut(F.get(ps, (-1 - of).cast("int")))).otherwise(F.array(F.array_join(F.transform(short, lambda p: p["p"]), "\n\n")))

    def gathered(ps: Column) -> Column:
        zero = state(no_runs, F.lit(0), F.lit(0), F.lit(0), F.lit(0))
        runs = F.aggregate(ps, zero, step(ps), lambda s: F.when(s["some"] > 0, _push(s["out"], run(s["start"], s["at"]))).otherwise(s["out"]))
        return F.flatten(F.transform(runs, lambda of: texts(ps, of)))

    return let(paras, gathered)


def custom_chunks(c: Column, target: int = 900, overlap: int = 150, drop_references: bool = True) -> Column:
    """array<struct<chunk_id, text>>: word windows of sections of pages, ids `NNNNN|pN|title` counted over the document."""

    def of_section(page: Column, section: Column) -> Column:
        return F.transform(word_windows(section["body"], target, overlap), lambda t: F.struct(page.alias("page"), section["title"].alias("title"), t.alias("text")))

    def of_page(page: Column) -> Column:
        sections = split_sections(page["body"])
        if drop_references:
            sections = F.filter(sections, lambda s: F.lower(strip(s["title"])) != "references")
        return F.flatten(F.transform(sections, lambda s: of_section(page["page"], s)))

    rows = F.flatten(F.transform(split_pages(c), of_page))
    name = lambda r, i: F.format_string("%05d|p%d|%s", i + 1, r["page"], strip(F.substr(r["title"], F.lit(1), F.lit(30))))
    return F.transform(rows, lambda r, i: F.struct(name(r, i).alias("chunk_id"), r["text"].alias("text")))


def _fallback(pages: Column, sections: Column, windows: Column, max_chunks: int) -> Column:
    every = F.concat(pages, sections, windows)
    return F.slice(F.array_distinct(F.filter(F.transform(every, strip), lambda x: F.length(x) >= MIN_CHUNK_CHARS)), 1, max_chunks)


#: chunkers of whole texts with the values that strategies give them
BY_NAME = {"pages": lambda c: page_chunks(c, 120), "sections": lambda c: section_chunks(c, 2600, 900), "sliding": lambda c: sliding_chunks(c, 2400, 700, 40)}


def fallback_chunks(c: Column, max_chunks: int = 40) -> Column:
    """Pages, sections and windows in this order, equal texts once."""
    return _fallback(*(make(c) for make in BY_NAME.values()), max_chunks)


def numbered(chunks: Column) -> Column:
    """array<struct<chunk_id, text>> of texts, ids from 1."""
    return F.transform(chunks, lambda t, i: F.struct((i + 1).cast("string").alias("chunk_id"), t.alias("text")))


def chunks_by_strategy(c: Column, how: Chunking = Chunking(), most: int = 40) -> Column:
    """array<struct<chunk_id, text>> by the chunker that is named; the fall-back one stops at `most`."""
    name = (how.strategy or "semantic").lower().strip()
    if name == "custom":
        return custom_chunks(c, how.windows.target, how.windows.overlap, how.windows.without_references)
    if name == "semantic":
        return numbered(semantic_chunks(c, how.gathering))
    return numbered(BY_NAME[name](c) if name in BY_NAME else fallback_chunks(c, most))


def chunks_by_strategies(c: Column, names: tuple[str, ...], most: int = 40) -> Column:
    """array<struct<strategy, chunks>>: chunks_by_strategy for each name; pages, sections and windows are made once for each text, whoever takes them."""
    known = {name: name.lower().strip() for name in names}
    needed = [part for part in BY_NAME if part in known.values() or set(known.values()) - {*BY_NAME, "semantic", "custom", ""}]

    def each(made: Column) -> Column:
        def chunks(name: str) -> Column:
            if known[name] in BY_NAME:
                return numbered(made[known[name]])
            if known[name] in ("semantic", "custom", ""):
                return chunks_by_strategy(c, Chunking(name), most)
            return numbered(_fallback(*(made[part] for part in BY_NAME), most))

        return F.array(*(F.struct(F.lit(name).alias("strategy"), chunks(name).alias("chunks")) for name in names))

    return let(F.struct(F.lit(0).alias("none"), *(BY_NAME[part](c).alias(part) for part in needed)), each)


def chunk(docs: DataFrame, chunks: Column) -> DataFrame:
    """(doc_id, chunk_no from 0, chunk_id, text) of an array<struct<chunk_id, text>> over docs."""
    return docs.select("doc_id", F.posexplode(chunks).alias("chunk_no", "c")).select("doc_id", "chunk_no", "c.chunk_id", "c.text")
