"""Product-quantisation codes of integer vectors: Lloyd rounds whose work follows the parts that may have moved.

A vector's components become floor(SCALE * x); the vector is cut into equal consecutive parts, and each part position has its codebook, which
starts as that part of the first vectors by vec_id (and, of equal ids, by components).  A round gives every part its nearest entry (squared
Euclidean distance, the lower index of equal ones) and then replaces each entry by the floor of its parts' mean; unused entries stay.

Heap Lloyd: a part keeps, from its last exact scan, an upper bound (the distance to its entry) and a lower bound (to any other).  When entries
move, the difference of the bounds shrinks by at most the entry's own move and the largest move of another.  Each block of vectors holds a
heap for every entry, keyed by lower minus upper plus the drift of that entry when the part was pushed; a round pops only parts whose key
the entry's cumulative drift has reached, scans them exactly and pushes them again.  Keys are lowered, and drifts raised, by more than
floating point can err, and ties have no slack, so that results are those of plain Lloyd rounds.  Sums of entries change by what moved.

Rows whose vector is null or holds a null or non-finite component are left out, as are vectors that are not as long as the first kept one
(an empty one too, if it isn't the first).  A length that isn't a multiple of `parts`, or components too large for squared distances in 64
bits, raise ValueError.  A null vec_id counts as the largest; repeated rows are coded each; an empty table gives an empty one; with fewer
vectors than entries the codebooks are as long as there are vectors.  Other columns are ignored, whatever their names.

Blocks of vectors are written once as a table, heaps after each round as one file a block in the shared folder; the driver holds codebooks
and their sums only, which are of a size that is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import few, fresh_dir, give_back, partitions, read_file, squeezed, staged, unsqueezed, write_file

BLOCK = 16384  # vectors of a block at most
RELATIVE, ABSOLUTE = 1e-9, 1e-6  # by which bounds are loosened: far more than rounding of distances below 2**32
SCAN = 4096  # parts scanned at a time


def exact_scan(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of x its nearest entry (the lower of equal ones), the squared distance to it, and to the nearest other."""
    entry, first, second = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    small = len(book) and max(int(np.abs(x).max(initial=0)), int(np.abs(book).max())) ** 2 * 4 * x.shape[1] < 1 << 53
    kind = np.float64 if small else np.int64  # floats hold such sums exactly, and multiply faster
    c = book.astype(kind)
    norms = (c * c).sum(axis=1)
    for a in range(0, len(x), SCAN):
        v = x[a : a + SCAN].astype(kind)
        d = (v * v).sum(axis=1)[:, None] - 2 * (v @ c.T) + norms
        rows = np.arange(len(v))
        best = d.argmin(axis=1)
        entry[a : a + SCAN], first[a : a + SCAN] = best, d[rows, best]
        if len(book) > 1:
            d[rows, best] = np.iinfo(np.int64).max if kind is np.int64 else np.inf
            second[a : a + SCAN] = d.min(axis=1)
    return entry, first, second


class Heaps:
    """The heaps of one block and part position: for each entry its (key, row) pairs in heap order; and each row's entry."""

    def __init__(self, entry: np.ndarray, keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> None:
        self.entry, self.keys, self.rows, self.sizes = entry, keys, rows, sizes

    @classmethod
    def new(cls, n: int, entries: int) -> Heaps:
        """No part has an entry yet: all must be scanned."""
        return cls(np.full(n, -1, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(entries, np.int64))

    def to_bytes(self) -> bytes:
        return b"".join((squeezed(self.entry.astype(np.int32)), squeezed(self.keys), squeezed(self.rows.astype(np.int32)), squeezed(self.sizes.astype(np.int32))))

    @classmethod
    def from_bytes(cls, raw: bytes, at: int) -> tuple[Heaps, int]:
        out = []
        for kind in (np.int32, np.float64, np.int32, np.int32):
            values, at = unsqueezed(raw, kind, at=at)
            out.append(values.astype(np.int64) if kind is np.int32 else values)
        return cls(*out), at

    def turn(self, x: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One round against a codebook and each entry's drift so far: the rows that were scanned, and the entries they had before."""
        ends = np.cumsum(self.sizes)
        starts = ends - self.sizes
        tops = np.full(len(self.sizes), np.inf)
        tops[self.sizes > 0] = self.keys[starts[self.sizes > 0]]
        open_: dict[int, list[tuple[float, int]]] = {}

        def heap(entry: int) -> list[tuple[float, int]]:
            if entry not in open_:
                a, b = int(starts[entry]), int(ends[entry])
                open_[entry] = list(zip(self.keys[a:b].tolist(), self.rows[a:b].tolist(), strict=True))
            return open_[entry]

        popped = np.flatnonzero(self.entry < 0).tolist()
        for entry in np.flatnonzero(tops <= drift).tolist():
            parts, limit = heap(entry), float(drift[entry])
            while parts and parts[0][0] <= limit:
                popped.append(heapq.heappop(parts)[1])
        rows = np.sort(np.array(popped, np.int64))
        before = self.entry[rows]
        entry, first, second = exact_scan(x[rows], book)
        upper, lower = np.sqrt(first.astype(np.float64)), np.sqrt(second)
        with np.errstate(invalid="ignore"):
            keys = np.where(np.isinf(lower), np.inf, lower - upper - RELATIVE * (lower + upper) - ABSOLUTE) + drift[entry]
        self.entry[rows] = entry
        order = np.argsort(entry, kind="stable")
        cuts = np.flatnonzero(np.diff(entry[order], prepend=-1)).tolist()
        for a, b in zip(cuts, [*cuts, len(order)][1:], strict=True):
            new = list(zip(keys[order[a:b]].tolist(), rows[order[a:b]].tolist(), strict=True))
            parts = heap(int(entry[order[a]]))
            if len(new) > len(parts):  # cheaper than one push after another
                parts += new
                heapq.heapify(parts)
            else:
                for pair in new:
                    heapq.heappush(parts, pair)
        keys_, rows_ = [], []
        for e in range(len(self.sizes)):
            if e in open_:
                self.sizes[e] = len(open_[e])
                keys_.append(np.array([k for k, _ in open_[e]], np.float64))
                rows_.append(np.array([r for _, r in open_[e]], np.int64))
            else:
                keys_.append(self.keys[starts[e] : ends[e]])
                rows_.append(self.rows[starts[e] : ends[e]])
        self.keys, self.rows = np.concatenate(keys_), np.concatenate(rows_)
        return rows, before


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """By how much each entry's slack may have shrunk: its own move and the largest of another entry, rounded up."""
    d = np.sqrt(((new - old).astype(np.float64) ** 2).sum(axis=1))
    others = np.zeros(len(d))
    if len(d) > 1:
        top = np.argsort(d)[-2:]
        others[:] = d[top[1]]
        others[top[1]] = d[top[0]]
    return np.where(d + others > 0, (d + others) * (1 + RELATIVE) + ABSOLUTE, 0.0)


def cleaned(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, label and the integer components of vectors that are not null and hold finite values only."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.filter(F.col("x").isNotNull() & ~bad).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * scale).cast("long")).alias("x"))


def encode(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, entry (of each part), error (squared distances summed over parts) of each vector that is kept; and the codebooks."""
    spark = vectors.sparkSession
    kept = cleaned(vectors, scale)
    label = kept.schema["label"].dataType.simpleString()
    first = [r["x"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]  # as many as a codebook has
    size = len(first[0]) if first else 0
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    first = [x for x in first if len(x) == size]
    kept = kept.filter(F.size("x") == size)
    if len(first) < entries:  # vectors of another length stood among them
        first = [r["x"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()]
    width, n = size // parts, len(first)
    start = np.array(first, np.int64).reshape(n, size)
    books = [start[:, i * width : (i + 1) * width].copy() for i in range(parts)]
    drifts = [np.zeros(n) for _ in range(parts)]
    folder = fresh_dir(spark, "codes")
    limit = int(np.sqrt((2**62) / max(1, size))) // 2

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(a, BLOCK)
                x = rows.column("x").flatten().to_numpy()
                if len(x) and max(int(x.max()), -int(x.min())) > limit:
                    raise ValueError("components are too large for squared distances in 64 bits")
                raw = squeezed(x)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.select(["vec_id", "label"]).schema) as out:
                    out.write_batch(rows.select(["vec_id", "label"]))
                yield pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{number:06d}-{zlib.crc32(raw):08x}"]), pa.array([raw], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "x", "rows"])
                number += 1

    def heaps_of(turn: int, block: str, n_rows: int) -> list[Heaps]:
        if not turn:
            return [Heaps.new(n_rows, n) for _ in range(parts)]
        raw, at, out = read_file(f"{folder}/{turn}/{block}"), 0, []
        for _ in range(parts):
            one, at = Heaps.from_bytes(raw, at)
            out.append(one)
        return out

    def turned(turn: int, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[Heaps], list[tuple[np.ndarray, np.ndarray]]]]:
        """The blocks of a batch after a round: row of the batch, components, heaps, and what was scanned with its entries before."""
        for i, block in enumerate(batch.column("block").to_pylist()):
            x = unsqueezed(batch.column("x")[i].as_py(), np.int64)[0].reshape(-1, size)
            heaps = heaps_of(turn, block, len(x))
            yield i, x, heaps, [h.turn(x[:, p * width : (p + 1) * width], books[p], drifts[p]) for p, h in enumerate(heaps)]

    def assign(turn: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A round: heaps are written, changes of the sums of entries (place 0 counts) are passed on."""
        change = np.zeros((parts, n, width + 1), np.int64)
        for batch in batches:
            names = batch.column("block").to_pylist()
            for i, x, heaps, scanned in turned(turn, batch):
                for p, (rows, before) in enumerate(scanned):
                    now = heaps[p].entry[rows]
                    other = now != before
                    own = np.concatenate([np.ones((int(other.sum()), 1), np.int64), x[rows[other], p * width : (p + 1) * width]], axis=1)
                    np.add.at(change[p], now[other], own)
                    np.subtract.at(change[p], before[other & (before >= 0)], own[before[other] >= 0])
                write_file(f"{folder}/{turn + 1}/{names[i]}", b"".join(h.to_bytes() for h in heaps))
        at = np.flatnonzero(change)
        give_back("codes")
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(change.reshape(-1)[at])], ["place", "change"])

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x, heaps, _ in turned(rounds, batch):
                entry = np.stack([h.entry for h in heaps], axis=1)
                error = sum(((x[:, p * width : (p + 1) * width] - books[p][entry[:, p]]) ** 2).sum(axis=1) for p in range(parts))
                rows = pa.ipc.open_stream(batch.column("rows")[i].as_py()).read_all().combine_chunks()
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (rows.column("vec_id"), rows.column("label"))]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, parts * len(x) + 1, parts), pa.int32()), pa.array(entry.reshape(-1).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*columns, lists, pa.array(np.asarray(error, np.int64))], ["vec_id", "label", "entry", "error"])
        give_back("codes")

    result = f"vec_id long, label {label}, entry array<int>, error long"
    if not n:
        return spark.createDataFrame([], result), books
    table = staged(kept.mapInArrow(blocks, "block string, x binary, rows binary"), "vectors")
    sums = np.zeros((parts, n, width + 1), np.int64)
    for turn in range(rounds):
        told = table.select("block", "x").mapInArrow(lambda b, turn=turn: assign(turn, b), "place long, change long").groupBy("place").agg(F.sum("change").alias("change"))
        for r in told.toLocalIterator():  # as many as codebooks have components and counts
            sums.reshape(-1)[r["place"]] += r["change"]
        for p in range(parts):
            count = sums[p, :, :1]
            new = np.where(count > 0, sums[p, :, 1:] // np.maximum(count, 1), books[p])
            drifts[p] = drifts[p] + moved(books[p], new)
            books[p] = new
    return table.mapInArrow(coded, result), books


def codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """Per vector that is kept: vec_id, code (entries in part order, two hex digits each), error, label_error (of all rows of its label), codebooks_sha256."""
    if entries > 256:
        raise ValueError("two hex digits name 256 entries at most")
    found, books = encode(vectors, parts, entries, rounds, scale)
    found = staged(found, "codes")
    text = ",".join(str(v) for book in books for v in book.reshape(-1).tolist())
    digits = F.array_join(F.transform("entry", lambda e: F.lpad(F.lower(F.hex(e)), 2, "0")), "")
    labels = staged(found.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    salts = partitions(vectors.sparkSession)  # one label may have most of the rows
    rows = found.select("vec_id", "label", digits.alias("code"), "error", F.pmod(F.xxhash64("vec_id", "entry"), F.lit(salts)).cast("int").alias("salt")).alias("a")
    sums = labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    sums = few(sums).alias("b")
    joined = rows.join(sums, F.col("a.label").eqNullSafe(F.col("b.label")) & (F.col("a.salt") == F.col("b.salt")))
    return joined.select("a.vec_id", "a.code", "a.error", "b.label_error", F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("codebooks_sha256"))
