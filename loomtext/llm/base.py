"""Shared pieces of the training-data operators: byte views and hashes of text, slices of batches, ranges; tables and files in the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.sources.staging import few, filesystem, fresh_dir, read_file, small_batches, staged, write_file  # noqa: F401  (operators take them from here)

_C = ctypes.CDLL(None) if hasattr(ctypes.CDLL(None), "malloc_trim") else None


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, key: str, n: int) -> list[int]:
    """Up to n - 1 ascending values of key that cut its rows into about n equal ranges; reads only that column."""
    if n < 2:
        return []
    cuts = [i / n for i in range(1, n)]
    found = df.select(F.percentile_approx(F.col(key), F.array(*map(F.lit, cuts)), F.lit(max(10000, 20 * n))).alias("b")).first()["b"]
    return sorted({int(x) for x in found or []})


def range_bucket(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below key, found in two steps of about the square root of their number."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    outer = bounds[::step]
    inner = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    group = below(F.array(*[F.lit(x).cast("bigint") for x in outer]))
    lists = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in xs]) for xs in inner])
    return F.when(key.isNull() | (group == 0), F.lit(0)).otherwise((group - 1) * step + below(F.element_at(lists, F.greatest(group, F.lit(1)))))


def byte_view(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and len + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    column = column if wide or pa.types.is_string(column.type) or pa.types.is_binary(column.type) else column.cast(pa.string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_CODEC = pa.Codec("zstd", compression_level=1)


def squeezed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Integers compressed with their length before them, their bytes by place; ascending ones as differences."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    packed = _CODEC.compress(raw, asbytes=True)
    return len(raw).to_bytes(8, "little") + len(packed).to_bytes(8, "little") + packed


def unsqueezed(raw: bytes, kind: type, ascending: bool = False, at: int = 0) -> tuple[np.ndarray, int]:
    """Integers of squeezed bytes that begin at a place, and where they end."""
    n, packed = int.from_bytes(raw[at : at + 8], "little"), int.from_bytes(raw[at + 8 : at + 16], "little")
    data = np.frombuffer(_CODEC.decompress(raw[at + 16 : at + 16 + packed], n, asbytes=True), np.uint8)
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(data.reshape(size, -1).T).view(kind).reshape(-1)
    return (np.cumsum(values, dtype=kind) if ascending else values), at + 16 + packed


#: what a worker process keeps from task to task, by the kind of tasks that use it
KEPT: dict[tuple[str, str], object] = {}


def give_back(kind: str) -> None:
    """Drop what tasks of other kinds kept and return freed memory to the system: a worker process lives on from task to task, beside others."""
    for key in [k for k in KEPT if k[0] != kind]:
        del KEPT[key]
    pa.default_memory_pool().release_unused()
    if _C is not None:
        _C.malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 << 20, kind: str = "") -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows of at most limit bytes of text; a longer text comes alone."""
    give_back(kind)
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
            yield batch.slice(i, j - i)
            i = j
    give_back(kind)


#: a fixed random odd 64-bit factor with its inverse, and random values for the 256 bytes
FACTOR = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(FACTOR, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, 1 << 16), base, np.uint64)
            have[0] = 1
            np.multiply.accumulate(have, out=have)
        if n <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every bit depends on every other."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """len + 1 running sums of byte values times powers of FACTOR, for span_hashes."""
    with np.errstate(over="ignore"):
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * _power_table(FACTOR, len(data)), out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand."""
    with np.errstate(over="ignore"):
        return mix((sums[ends] - sums[starts]) * _power_table(INVERSE, len(sums))[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that don't cross texts, and for each text the index of its first word (len + 1 values)."""
    n = len(data)
    inside = np.zeros(n + 1, bool)
    inside[:n] = is_word[data]
    start = inside[:n].copy()
    start[1:] &= ~inside[: n - 1]
    end = inside[:n] & ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    both = cuts[inside[cuts] & inside[cuts - 1]]
    start[both] = True
    end[both - 1] = True
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)
