"""How far the sources of a language differ from each other and from the language, over the terms that it uses often.

Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z lower-cased; a language keeps those in at least `least` of its
documents.  All arithmetic is on integers.  Null text, lang or source count as ''; each row is a document, repeated ones too; a group whose
texts hold no term still takes part; an empty table gives no row; other columns are ignored, whatever their names.

A first pass counts, in a count-min sketch of document frequencies, how many documents hold each term of a language.  The sketch is merged
by adding up its cells, so that its least cell is never below a term's own number; of the merged sketch tasks get one bit a cell.  The
second pass leaves out, before anything is shuffled, the terms that one of whose cells is below `least`; the others are counted exactly.
More cells only leave out more: the result is the same for any number.  Their number follows the documents (`cells` for each, so that rare
terms seldom meet) up to `most_cells`, which bounds what the driver and the tasks hold: DEPTH bits for each.

Two sources are compared by a join on the terms that both use.  A term that only one of them uses adds |p - z|, where z is the p of a term
that the other has not; these sums come from running sums over each source's distinct p.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.base import byte_view, few, mix, partitions, prefix_sums, sliced, span_hashes, staged

DEPTH = 2  # rows of the sketch
BITS = 32768  # of a bitmap of Spark's bitmap functions (fixed value)
ENTRIES = 1_000_000  # counts that a task gathers before it passes them on
SCALE = 1_000_000_000

#: bytes of terms, A-Z lower-cased; all others separate
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(batch: pa.RecordBatch) -> Iterator[list[bytes]]:
    """The terms of each text of a batch, in order."""
    data, offsets = byte_view(batch.column("text"))
    folded = data.tobytes().translate(TERM_BYTES)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield folded[a:b].split()


def cells_of(lang: str, terms: list[bytes], width: int) -> np.ndarray:
    """The DEPTH cells of each term of a language, the rows of the sketch one after another."""
    ends = np.cumsum([len(t) for t in terms])
    starts = np.concatenate([[0], ends[:-1]])
    name = np.frombuffer(lang.encode(), np.uint8)
    salt = span_hashes(prefix_sums(name), np.array([0]), np.array([len(name)]))
    hashes = span_hashes(prefix_sums(np.frombuffer(b"".join(terms), np.uint8)), starts, ends)
    rows = []
    for i in range(DEPTH):
        with np.errstate(over="ignore"):
            hashes = mix(hashes ^ (salt + np.uint64(i)))
        rows.append((hashes % np.uint64(width)).astype(np.int64) + i * width)
    return np.stack(rows)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """The merged count-min sketch of the document frequencies of (lang, term): cell, n; cells without a term are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter[bytes]] = defaultdict(Counter)

        def told() -> pa.RecordBatch:
            cells = [(cells_of(lang, list(terms), width), np.fromiter(terms.values(), np.int64, len(terms))) for lang, terms in found.items() if terms]
            found.clear()
            if not cells:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["cell", "n"])
            cell, n = np.concatenate([c.reshape(-1) for c, _ in cells]), np.concatenate([np.tile(n, DEPTH) for _, n in cells])
            order = np.argsort(cell, kind="stable")
            cell, n = cell[order], n[order]
            cuts = np.flatnonzero(np.diff(cell, prepend=-1))
            return pa.RecordBatch.from_arrays([pa.array(cell[cuts]), pa.array(np.add.reduceat(n, cuts))], ["cell", "n"])

        for batch in sliced(batches, kind="divergence"):
            for lang, words in zip(batch.column("lang").to_pylist(), _words(batch), strict=True):
                found[lang].update(set(words))
            if sum(map(len, found.values())) > ENTRIES:
                yield told()
        yield told()

    rows = docs.select("lang", "text").mapInArrow(run, "cell long, n long")
    return rows.groupBy("cell").agg(F.sum("n").alias("n"))


def bitmap(cells: DataFrame, least: int, width: int) -> np.ndarray:
    """One bit for each cell of a sketch: whether its number is `least` or more.  DEPTH * width bits, whatever the corpus."""
    often = cells.filter(F.col("n") >= least).select((F.col("cell") + 1).alias("cell"))  # the bitmap functions count from 1
    maps = often.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    out = np.zeros(-(-DEPTH * width // BITS) * BITS // 8, np.uint8)
    for r in maps.toLocalIterator():
        out[(r["bucket"] - 1) * BITS // 8 : r["bucket"] * BITS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def _counts(docs: DataFrame, often: np.ndarray, width: int) -> DataFrame:
    """Exact counts of the terms that the sketch lets through: lang, source, term, n (occurrences), docs (documents that hold it)."""
    shipped = docs.sparkSession.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shipped.value
        found: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        held: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)

        def told() -> Iterator[pa.RecordBatch]:
            by_lang: dict[str, set[bytes]] = defaultdict(set)
            for (lang, _), terms in found.items():
                by_lang[lang].update(terms)
            passed: dict[str, set[bytes]] = {}
            for lang, names in by_lang.items():
                listed = list(names)
                if listed:
                    cells = cells_of(lang, listed, width)
                    through = (bits[cells >> 3] >> (cells & 7).astype(np.uint8) & 1).all(axis=0)
                    passed[lang] = {listed[i] for i in np.flatnonzero(through).tolist()}
            for (lang, source), terms in found.items():
                kept = passed.get(lang, set()).intersection(terms)
                if kept:
                    names = list(kept)
                    n, d = ([c[(lang, source)][t] for t in names] for c in (found, held))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang], pa.string()).take(pa.array(np.zeros(len(names), np.int32))), pa.array([source], pa.string()).take(pa.array(np.zeros(len(names), np.int32))), pa.array(names, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())],
                        ["lang", "source", "term", "n", "docs"],
                    )
            found.clear()
            held.clear()

        for batch in sliced(batches, kind="divergence"):
            for lang, source, words in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), _words(batch), strict=True):
                found[lang, source].update(words)
                held[lang, source].update(set(words))
            if sum(map(len, found.values())) > ENTRIES:
                yield from told()
        yield from told()

    rows = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least: int, cells: int = 16, most_cells: int = 1 << 26) -> DataFrame:
    """Counts of the terms in `least` documents of their lang or more, for each source that uses them: lang, source, term, n, lang_n, head.

    lang_n is the count in the whole language; head marks one row of each term of a language.  docs has lang, source, text without nulls.
    """
    width = min(most_cells, 1 << max(10, (cells * docs.count() - 1).bit_length()))  # of rows alone, no column is read
    counts = _counts(docs, bitmap(sketch(docs, width), least, width), width)
    term = Window.partitionBy("lang", "term")
    rows = counts.withColumn("of_lang", F.sum("docs").over(term)).filter(F.col("of_lang") >= least)
    return rows.select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), (F.min("source").over(term) == F.col("source")).alias("head"))


def share(count: Column, total: Column, terms: Column, smooth: int) -> Column:
    """1 + floor(SCALE * (count + smooth) / (total + smooth * terms)), exact for any counts of a long."""
    wide = lambda c: c.cast("decimal(20,0)")
    above, below = (wide(count) + smooth) * F.lit(SCALE).cast("decimal(11,0)"), F.greatest(wide(total) + smooth * wide(terms), F.lit(1).cast("decimal(31,0)"))
    return (F.call_function("div", above, below) + 1).cast("long")


def both_ways(**also: tuple[str, str]) -> Column:
    """Rows (source, item) of a pair (a, b) and of (b, a), with further columns named for either way."""
    way = lambda x, y, i: F.struct(F.col(x).alias("source"), F.col(y).alias("item"), *(F.col(c[i]).alias(k) for k, c in also.items()))
    return F.inline(F.array(way("a", "b", 0), way("b", "a", 1)))


def audit(docs: DataFrame, least: int = 30, smooth: int = 5, top: int = 50, cells: int = 16, most_cells: int = 1 << 26) -> DataFrame:
    """lang, source, part, item, value, rank for each (lang, source) that occurs.

    Part `pair`: each other source of the lang, with the sum of |p - q| over the lang's kept terms, all ranks.  Part `term`: the kept terms
    that the source uses more than its lang does, with p - q, the first `top`.
    """
    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = staged(kept_terms(plain, least, cells, most_cells), "kept_terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"), F.sum(F.col("head").cast("long")).alias("heads"))
    groups = plain.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total", "own", "heads"])
    langs = groups.groupBy("lang").agg(F.sum("heads").alias("terms"), F.sum("total").alias("lang_total"))
    absent = share(F.lit(0), F.col("total"), F.col("terms"), smooth)
    groups = staged(groups.join(langs, "lang").select("lang", "source", "total", "own", "terms", "lang_total", absent.alias("z")), "groups")

    here = kept.join(few(groups), ["lang", "source"])
    scored = here.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms"), smooth).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("terms"), smooth).alias("q"), "z")

    # terms of both: what |p - q| is more than |p - z of the other| from either side less |z - z|, which the other parts count
    left = scored.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    right = scored.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = left.join(right, ["lang", "term"]).filter("a < b")
    both = both.groupBy("lang", "a", "b").agg(F.sum(gap("pa", "pb") - gap("pa", "zb") - gap("pb", "za") + gap("za", "zb")).alias("value"))

    # pairs of a lang's sources, spread by salts: one lang may have most of the sources
    salts = partitions(docs.sparkSession)
    one = groups.select("lang", F.col("source").alias("a"), F.col("own").alias("na"), F.col("z").alias("za"), "terms", F.pmod(F.xxhash64("source"), F.lit(salts)).cast("int").alias("salt"))
    other = groups.select("lang", F.col("source").alias("b"), F.col("own").alias("nb"), F.col("z").alias("zb"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    pairs = one.join(other, ["lang", "salt"]).filter("a < b")
    neither = pairs.select("lang", "a", "b", ((F.col("terms") - F.col("na") - F.col("nb")) * gap("za", "zb")).alias("value"))

    # sums of |p - z| over all terms of one source, for the z of each other one
    asked = pairs.select("lang", both_ways(at=("zb", "za")))
    steps = scored.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count("*").alias("n"))
    events = steps.select("lang", "source", F.lit(None).cast("string").alias("item"), "at", "n").unionByName(asked.withColumn("n", F.lit(0).cast("long")))
    below, all_ = Window.partitionBy("lang", "source").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("lang", "source")
    mass = F.col("n") * F.col("at")
    runs = events.select("lang", "source", "item", "at", F.sum("n").over(below).alias("n_below"), F.sum(mass).over(below).alias("below"), F.sum("n").over(all_).alias("n_all"), F.sum(mass).over(all_).alias("all"))
    from_z = (2 * F.col("n_below") - F.col("n_all")) * F.col("at") - 2 * F.col("below") + F.col("all")
    lone = runs.filter("item is not null").select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), from_z.alias("value"))

    apart = both.unionByName(neither).unionByName(lone).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    apart = apart.select("lang", both_ways(), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = apart.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    more = scored.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    term = more.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= top)
    return pair.unionByName(term)
