"""Packing documents into sequences of bounded length by bin completion over the table of piece lengths.

A document is its ids and an end id; one longer than a sequence is cut into whole sequences of which only the first may be shorter.
A null or empty text is its end id alone; repeated rows are packed each; other columns are ignored; an empty table packs into nothing.

Lengths are integers from 1 to the size of a sequence, so their counts are a table of bounded size whatever the corpus.  Bin completion
runs on these counts: each step fills sequences around the longest piece left and branches over how many of them are filled so.  Any
size from 1 on is allowed; time and memory of the search grow with the size and the number of distinct lengths, not with documents.
Pieces then find their places by length and rank within it, without any gathering of pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtext.llm.base import partitions, sliced, staged
from loomtext.llm.tokens import encoder

FIT = 8  # nodes between those that best fit completes
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, size: int, end_id: int) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], np.uint32)
        for batch in sliced(batches, kind="tokens"):
            rows = []
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), encode([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                ids = np.concatenate([x, end])
                cuts = [0, *range(len(ids) % size or size, len(ids), size), len(ids)]
                raw = memoryview(ids.astype("<u4").tobytes())
                rows += [(doc_id, i, a, b - a, zlib.crc32(raw[4 * a : 4 * b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def least_sequences(counts: np.ndarray) -> int:
    """A lower bound of the sequences that pieces (how many of each length) need.

    For every k: pieces longer than size - k share with none of k or more; those beyond half a sequence are apart; what lies from k to half
    a sequence has their room, then sequences of its own.
    """
    size = len(counts) - 1
    upto, sums = np.cumsum(counts), np.cumsum(counts * np.arange(size + 1))
    k = np.arange(1, size // 2 + 1)
    if not len(k):
        return int(upto[-1])
    half = size // 2
    beyond, weight = upto[size - k] - upto[half], sums[size - k] - sums[half]
    rest = sums[half] - sums[k - 1] - (beyond * size - weight)
    return max(int((upto[size] - upto[half] + np.maximum(0, -(-rest // size))).max()), -(-int(sums[-1]) // size))


def fillings(room: int, counts: np.ndarray) -> Iterator[tuple[tuple[int, int], ...]]:
    """Fillings of room, as (length, how many) longest first: by falling sum, and of equal sums longer pieces first.

    No filling stops while the shortest piece still fits.  A table of what any lengths below can sum to leads straight to each filling.
    """
    lengths = [int(x) for x in np.flatnonzero(counts[: room + 1]) if x][::-1]
    reach = [1] * (len(lengths) + 1)  # bit s of reach[i]: lengths from i on can sum to s
    for i in range(len(lengths) - 1, -1, -1):
        sums, n, step = reach[i + 1], min(int(counts[lengths[i]]), room // lengths[i]), 1
        while n:
            sums |= sums << (lengths[i] * min(step, n))
            n -= min(step, n)
            step *= 2
        reach[i] = sums & ((2 << room) - 1)
    most = reach[0].bit_length() - 1
    fewest = max(0, room - lengths[-1] + 1) if lengths else 0
    for target in range(most, min(most, fewest) - 1, -1):
        open_: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(0, target, ())] if reach[0] >> target & 1 else []
        while open_:
            i, left, taken = open_.pop()
            if not left:
                yield taken
                continue
            while lengths[i] > left:
                i += 1
            for n in range(min(int(counts[lengths[i]]), left // lengths[i]) + 1):
                if reach[i + 1] >> (left - n * lengths[i]) & 1:
                    open_.append((i + 1, left - n * lengths[i], (*taken, (lengths[i], n)) if n else taken))


def dominated(inner: tuple[tuple[int, int], ...], spare: np.ndarray, room: int) -> bool:
    """Whether pieces of a filling, or none, could be swapped for one piece that is left over, as long as they or longer, and still fit.

    Any solution with such a filling stays one after the swap, as the pieces fit where the longer one lay.
    """
    none, one, many, left = 1, 0, 0, room  # sums of no, one, and several pieces of the filling, as bits
    rest = spare[: room + 1].copy()
    for x, n in inner:
        left -= n * x
        rest[x] -= n
        for _ in range(n):
            many |= (one | many) << x
            one |= none << x
    there = int.from_bytes(np.packbits(rest > 0, bitorder="little").tobytes(), "little") & ~1
    if many & there:
        return True
    sums, width = (none | one | many) << 1, 1  # raised by 1 to width, in the end by all that is left of the room
    while width < left:
        step = min(width, left - width)
        sums |= sums << step
        width += step
    return left > 0 and bool(sums & there)


def _around(counts: np.ndarray, inner: tuple[tuple[int, int], ...], longest: int) -> tuple[int, list[tuple[int, int]]]:
    """How often a filling around the longest piece can be taken, and its pieces."""
    found = dict(inner)
    found[longest] = found.get(longest, 0) + 1
    return min(int(counts[x]) // n for x, n in found.items()), sorted(found.items(), reverse=True)


def best_fit(counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings by best fit decreasing over counts: each piece, the longest first, goes where the least room is left that it fits in.

    Sequences that were filled alike are one group.  A sequence that took a piece has the least room, so it takes more of that length first.
    """
    size = len(counts) - 1
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by room: how many sequences, their pieces
    for x in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[x])
        for room in [*sorted(r for r in groups if r >= x), size]:
            each, stay = room // x, []
            for times, filling in groups.pop(room, []) if room < size else [(left, [])]:
                full = min(times, left // each)
                some = left - full * each if full < times and left - full * each else 0
                for n, took in ((full, each), (1 if some else 0, some)):
                    if n:
                        groups.setdefault(room - took * x, []).append((n, [*filling, (x, took)]))
                left -= full * each + some
                if room < size and (rest := times - full - bool(some)):
                    stay.append((rest, filling))
            if stay:
                groups.setdefault(room, []).extend(stay)
            if not left:
                break
    return [found for at in groups.values() for found in at]


def choices(left: np.ndarray, barred: frozenset[tuple[tuple[int, int], ...]]) -> Iterator[tuple[int, list[tuple[int, int]], tuple[tuple[int, int], ...]]]:
    """Undominated fillings around the longest piece, the least waste first, and how often each may be taken, the most first."""
    size, longest = len(left) - 1, int(np.flatnonzero(left)[-1])
    spare, room = left.copy(), size - longest
    spare[longest] -= 1
    for inner in fillings(room, spare):
        if inner not in barred and not dominated(inner, spare, room):
            times, filling = _around(left, inner, longest)
            alone = not inner or inner == ((room, 1),)  # it dominates all others, so that as many as can be are right
            yield from ((n, filling, inner) for n in range(times, 0 if not alone else times - 1, -1))


def plan(histogram: dict[int, int], size: int, effort: int | None = 2048) -> list[tuple[int, list[tuple[int, int]]]]:
    """Fillings as (how many sequences, [(length, how many in each)]) by bin completion: branch and bound over sequences.

    Best fit decreasing is the first incumbent, and completes every FIT-th node to a further one.  A node takes an undominated filling around
    the longest piece left, and branches over how often; below, the same filling is barred for that longest piece, as taking it once more is
    another branch.  What is left after some fillings is looked at once, with the fewest sequences it was met with.  A branch is cut when the
    sequences so far and the lower bound of the rest don't beat the incumbent; the search ends when the incumbent meets the lower bound of
    the whole.  Lengths and counts make this a table of bounded size whatever the corpus, but the problem is hard: after `effort` nodes the
    incumbent stands.  With effort=None the search goes on until the incumbent is proven to be the least.
    """
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    least = least_sequences(counts)
    best = best_fit(counts)
    total = sum(n for n, _ in best)
    if not counts.any():
        return best
    path: list[tuple[int, list[tuple[int, int]]]] = []
    seen: dict[bytes, int] = {}
    nodes = [(counts, 0, choices(counts, frozenset()), frozenset())]  # what is left, sequences so far, ways on, fillings barred
    visited = 0
    while nodes and total > least and (effort is None or visited < effort):
        left, used, ways, barred = nodes[-1]
        del path[len(nodes) - 1 :]
        way = next(ways, None) if used + least_sequences(left) < total else None
        if way is None:
            nodes.pop()
            continue
        times, filling, inner = way
        visited += 1
        after = left.copy()
        for x, n in filling:
            after[x] -= times * n
        now = used + times
        path.append((times, filling))
        if not after.any():
            if now < total:
                best, total = list(path), now
            continue
        key = blake2b(after.tobytes(), digest_size=16).digest()
        if now + least_sequences(after) >= total or seen.get(key, total) <= now:
            continue
        seen[key] = now
        if visited % FIT == 1:
            rest = best_fit(after)
            if now + sum(n for n, _ in rest) < total:
                best, total = [*path, *rest], now + sum(n for n, _ in rest)
        below = barred | {inner} if after[filling[0][0]] else frozenset()
        nodes.append((after, now, choices(after, below), below))
    return best


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    salts = 4 * partitions(spark)
    table = staged(pieces(docs, tokenizer, size, end_id).withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    groups = staged(table.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in groups.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most one row per length

    segments: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, first sequence, pieces in each, first offset
    used: dict[int, int] = {}
    base = 0
    for times, filling in plan(histogram, size):
        at = 0
        for length, n in filling:
            segments.setdefault(length, []).append((used.get(length, 0), base, n, at))
            used[length] = used.get(length, 0) + times * n
            at += length * n
        base += times
    places = {k: np.array(v, np.int64) for k, v in segments.items()}  # bounded by the size of a sequence, not by the corpus

    before = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = table.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")).cast("long") - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths):
                which, rows = np.flatnonzero(lengths == length), places[int(length)]
                first, base, each, at = rows[np.searchsorted(rows[:, 0], ranks[which], "right") - 1].T
                sequence[which] = base + (ranks[which] - first) // each
                offset[which] = at + (ranks[which] - first) % each * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PIECES + ", sequence_id long, offset long")
