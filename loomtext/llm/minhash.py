"""Near-duplicate groups by MinHash with tensored banding and links confirmed on whole shingle sets.

A document's set: its distinct shingles of `words` words (A-Z lower-cased, words are runs without space, tab or line breaks); with fewer
words the whole sequence is its one shingle; without words (null, empty or blank text) the set is empty and linked with nothing.
Documents with 100 * intersection >= percent * union are linked, a group is what links connect, and its smallest doc_id is kept.

Tensored banding: two collections of `halves` half keys, each of `rows` minhashes, give halves**2 table keys by pairing every half key of
one with every one of the other, for 2 * halves * rows minhashes instead of halves**2 * 2 * rows.

Sets that are equal are one class from the start, numbered when classes are written, so that texts are told apart by their sets and never
by doc_id alone: several texts may share an id, or have none.  Every class is compared with the smallest leader of its table buckets; classes of buckets
that then still hold more than one component are joined exactly by their rarest shingles, so that no bucket loses a link and copies are
never expanded into pairs.

Repeated rows with one doc_id and text are one document seen twice (each row is returned).  A null doc_id counts as the largest.  Of
linked sets under one doc_id the one with the smallest hashes is kept.
Other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.base import byte_view, mix, prefix_sums, sliced, span_hashes, staged, word_spans
from loomtext.llm.graph import components

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.ones(256, bool)
WORD[[32, *range(9, 14)]] = False
NO_ID = (1 << 63) - 1
_RANDOM = np.random.default_rng(7)
_STEPS = _RANDOM.integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct shingles."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORD)
    hashed = span_hashes(prefix_sums(data), starts, ends)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashed) - words + 1), np.uint64)
        for i in range(words):
            rolled += hashed[i : i + len(rolled)] * _STEPS[i]
        rolled = mix(rolled)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(rolled[a : b - words + 1]))
            elif b > a:
                out.append(mix(np.array([(hashed[a:b] * _STEPS[: b - a]).sum() + _STEPS[60] * np.uint64(b - a)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def table_keys(sets: list[np.ndarray], rows: int, halves: int) -> np.ndarray:
    """(sets, halves**2) keys of the non-empty sets."""
    random = np.random.default_rng(11)
    flat = np.concatenate(sets)
    begin = np.cumsum([0, *(len(s) for s in sets[:-1])])
    parts = np.zeros((2, halves, len(sets)), np.uint64)
    with np.errstate(over="ignore"):
        for side in range(2):
            for i in range(halves):
                for _ in range(rows):
                    a, b = random.integers(1, 1 << 63, 2, dtype=np.uint64)
                    parts[side, i] = mix(parts[side, i] * _STEPS[61] + np.minimum.reduceat((flat ^ b) * (a | np.uint64(1)), begin))
        pairs = parts[0][:, None] * _STEPS[62] + parts[1][None, :] * _STEPS[63] + np.arange(halves * halves, dtype=np.uint64).reshape(halves, halves, 1)
        return mix(pairs).reshape(halves * halves, len(sets)).T


def _list(values: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values).view(np.int64) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _hashes(sets: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Two 64-bit hashes of each whole set."""
    with np.errstate(over="ignore"):
        return pa.array(np.array([s.sum() for s in sets], np.uint64).view(np.int64)), pa.array(np.array([mix(s).sum() for s in sets], np.uint64).view(np.int64))


def signatures(docs: DataFrame, words: int, rows: int, halves: int) -> DataFrame:
    """doc_id and mark, n_shingles, h1 and h2 (of the whole set), keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = shingle_sets(*byte_view(batch.column("text")), words)
            full = np.array([len(s) > 0 for s in sets])
            keys = np.zeros((len(sets), halves * halves), np.uint64)
            if full.any():
                keys[full] = table_keys([s for s in sets if len(s)], rows, halves)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).reshape(-1)), halves * halves).cast(pa.list_(pa.int64()))
            out = [batch.column("doc_id"), batch.column("mark"), pa.array([len(s) for s in sets], pa.int64()), *_hashes(sets), lists]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "mark", "n_shingles", "h1", "h2", "keys"])

    return docs.mapInArrow(run, "doc_id long, mark binary, n_shingles long, h1 long, h2 long, keys array<long>")


def _sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """rep and shingles of the classes (rep, doc_id, h1, h2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = shingle_sets(*byte_view(batch.column("text")), words)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_hashes(sets), _list(sets)], ["doc_id", "h1", "h2", "shingles"])

    texts = docs.select("doc_id", "text").join(classes.select("doc_id").distinct(), "doc_id", "left_semi")
    found = texts.mapInArrow(run, "doc_id long, h1 long, h2 long, shingles array<long>").dropDuplicates(["doc_id", "h1", "h2"])
    return found.join(classes, ["doc_id", "h1", "h2"]).select("rep", "shingles")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets (rep, shingles) are similar enough."""
    one = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
    both = one.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (100 * shared >= percent * (F.size("x") + F.size("y") - shared)).alias("linked")).filter("linked").select("a", "b")


def _sharing_rare_shingles(sets: DataFrame, percent: int) -> DataFrame:
    """All pairs (a < b) of different components that can be linked: exact, by prefixes of sets in the order of rarity.

    Sets of n and m shingles that are similar enough share one of the n - ceil(percent * n / 100) + 1 rarest of the first and likewise of
    the second.  Edits make rare shingles, so copies of one text that differ too much seldom meet here, however many there are.
    """
    rows = sets.select("rep", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    order = Window.partitionBy("rep").orderBy("often", "s")
    prefix = rows.join(often, "s").withColumn("at", F.row_number().over(order)).filter(F.col("at") <= F.col("n") - F.ceil(percent * F.col("n") / 100) + 1)
    prefix = staged(prefix.filter("low < high").select("rep", "component", "n", "s", "at"), "prefixes")
    x, y = prefix.toDF("a", "c", "n", "s", "i"), prefix.toDF("b", "d", "m", "s", "j")
    apart = (F.col("a") < F.col("b")) & (F.col("c") != F.col("d"))
    # at the first shingle that two similar sets share, enough of both is still to come
    enough = (100 + percent) * (1 + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j"))) >= percent * (F.col("n") + F.col("m"))
    return x.join(y, "s").filter(apart & enough).select("a", "b").distinct()


def _grouped(docs: DataFrame, percent: int, words: int, rows: int, halves: int) -> DataFrame:
    """For rows (doc_id, mark, text) without null ids: doc_id, mark, n_shingles, h1, h2, component (the smallest doc_id of the group), kept."""
    marked = staged(signatures(docs, words, rows, halves), "signatures")
    # a class's number is fixed by being written; numbers rise with doc_id, so leaders are the texts that others were copied from
    classes = marked.filter("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"))
    classes = staged(classes.orderBy("doc_id", "h1", "h2").select(F.monotonically_increasing_id().alias("rep"), "doc_id", "h1", "h2"), "classes")

    # table buckets of two or more classes
    exploded = marked.join(classes, ["doc_id", "h1", "h2"]).select("rep", F.explode("keys").alias("key"))
    leaders = exploded.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).filter("leader < last").select("key", "leader")
    buckets = staged(exploded.join(leaders, "key"), "buckets")

    # every class against its smallest leader, which already joins most groups
    pairs = buckets.filter("rep <> leader").groupBy("rep").agg(F.min("leader").alias("leader")).select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    pairs = staged(pairs, "pairs")
    wanted = staged(classes.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep"), "wanted")
    sets = staged(_sets(docs, wanted, words), "sets")
    edges = staged(_confirmed(pairs, sets, percent), "edges")
    tested, found = pairs, components(edges)

    # classes in buckets that still hold more than one component are compared exactly
    labels = staged(found, "labels")
    known = buckets.select("key", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    open_classes = staged(known.join(mixed, "key", "left_semi").select("rep", "component").distinct(), "open")
    wanted = staged(classes.join(open_classes.select("rep"), "rep"), "wanted")
    sets = staged(_sets(docs, wanted, words).join(open_classes, "rep"), "open-sets")
    pairs = staged(_sharing_rare_shingles(sets, percent).join(tested, ["a", "b"], "left_anti"), "pairs")
    more = staged(_confirmed(pairs, sets, percent), "edges")
    if not more.isEmpty():
        found = components(edges.union(more))

    # a component's owner is its class of the smallest doc_id
    members = staged(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", "h1", "h2", F.coalesce("component", "rep").alias("component")), "members")
    first = members.groupBy("component").agg(F.min(F.struct("doc_id", "h1", "h2")).alias("owner"))
    owners = members.join(first, "component").select("h1", "h2", "owner")
    ids = marked.select("doc_id", "mark", "n_shingles", "h1", "h2")
    whole = ids.filter("n_shingles > 0").join(owners, ["h1", "h2"])
    whole = whole.select(*ids.columns, F.col("owner.doc_id").alias("component"), (F.struct("doc_id", "h1", "h2") == F.col("owner")).alias("kept"))
    return whole.union(ids.filter("n_shingles = 0").select(*ids.columns, F.col("doc_id").alias("component"), F.lit(True).alias("kept")))


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


def text_mark() -> Column:
    """A digest of the text; a null text has one of its own."""
    return F.coalesce(F.unhex(F.md5(F.col("text").cast("string"))), F.lit(b""))


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, rows: int = 2, halves: int = 8) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (smallest doc_id of its group), kept (that it is its own; rows of one doc_id are told apart by their sets, and kept all where their id is the smallest)."""
    docs = docs.select(_id().alias("doc_id"), F.lit(b"").alias("mark"), F.col("text").cast("string").alias("text"))
    whole = _grouped(docs, percent, words, rows, halves)
    return whole.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_shingles", F.nullif("component", F.lit(NO_ID)).alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, rows: int = 2, halves: int = 8) -> DataFrame:
    """One row of each group of near copies: of the smallest doc_id, and of its texts with one set that of the smallest digest.

    Texts without words are near copies of nothing; of them, rows of one doc_id and text are kept once.  Of rows with one doc_id and text
    that differ otherwise, the one stays whose other columns are first as JSON.
    """
    marked = docs.select("*", _id().alias("id of row"), text_mark().alias("mark of row"))
    whole = _grouped(marked.select(F.col("id of row").alias("doc_id"), F.col("mark of row").alias("mark"), F.col("text").cast("string").alias("text")), percent, words, rows, halves)
    kept = whole.filter("kept")
    kept = kept.filter("n_shingles > 0").groupBy("doc_id", "h1", "h2").agg(F.min("mark").alias("mark")).select("doc_id", "mark").union(kept.filter("n_shingles = 0").select("doc_id", "mark").distinct())
    keys = ["id of row", "mark of row"]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    others = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")), F.lit(0).alias("at the end")))
    one = marked.join(kept.toDF(*keys), keys, "left_semi").groupBy(*keys).agg(F.min_by(F.struct(*columns), others).alias("row"))
    return one.select(*(F.col(f"row.`{c}`") for c in docs.columns))
