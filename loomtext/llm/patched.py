"""Token-id shards in patched frame-of-reference blocks.

Documents are written in ascending doc_id order (null first; repeated ids one after the other), shards of a bounded number of ids for each
range of doc_ids (a longer document is a shard), each document's ids followed by an end id.  A null or empty text is its end id alone.
Other columns are ignored; an empty table gives no shard.

A shard: MAGIC, then a little-endian header (documents, ids, words, exceptions), the documents' ids, null flags and lengths, and per
block of 128 values its minimum, its width, its exceptions and its start, then the packed words and the exception lists.  A block stores
value - minimum in the width that holds the given percentile of its values; larger values are exceptions and keep their place and value.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.base import fresh_dir, partitions, read_file, sliced, staged, write_file
from loomtext.llm.tokens import encoder

MAGIC = b"LTPFOR01"
BLOCK, LANES = 128, 4
SHARD_IDS = 4 << 20  # ids of a shard, unless one document has more
RANGE_BYTES = 64 << 20  # of text in a range of doc_ids, about
GROUP = 1024  # ranges whose ids are summed up together
TABLE = "table"  # of the shards, beside them
HEAD = np.dtype([("documents", "<u8"), ("ids", "<u8"), ("words", "<u8"), ("exceptions", "<u8")])


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(n, 128) values under 2**width to (n, 4 * width) words: value i of a lane takes the lane's bits from i * width on."""
    rows = values.reshape(len(values), -1, LANES)
    out = np.zeros((len(values), width, LANES), np.uint32)
    for i in range(BLOCK // LANES):
        word, shift = divmod(i * width, 32)
        out[:, word] |= rows[:, i] << np.uint32(shift)
        if shift + width > 32:
            out[:, word + 1] |= rows[:, i] >> np.uint32(32 - shift)
    return out.reshape(len(values), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    words = words.reshape(len(words), width, LANES)
    out = np.empty((len(words), BLOCK // LANES, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(BLOCK // LANES):
        word, shift = divmod(i * width, 32)
        out[:, i] = words[:, word] >> np.uint32(shift)
        if shift + width > 32:
            out[:, i] |= words[:, word + 1] << np.uint32(32 - shift)
        out[:, i] &= mask
    return out.reshape(len(words), -1)


def encode_blocks(ids: np.ndarray, percentile: float) -> list[np.ndarray]:
    """minimums, widths, exception counts, starts in words, packed words, exception places, exception values."""
    n = -(-len(ids) // BLOCK)
    blocks = np.full(n * BLOCK, ids[-1] if len(ids) else 0, np.uint32)
    blocks[: len(ids)] = ids
    blocks = blocks.reshape(n, BLOCK)
    least = blocks.min(axis=1) if n else np.zeros(0, np.uint32)
    over = blocks - least[:, None]
    at = min(BLOCK - 1, int(percentile * BLOCK))
    typical = np.partition(over, at, axis=1)[:, at] if n else least
    widths = np.frexp(typical.astype(np.float64))[1].astype(np.uint8)  # bits of an integer; 0 for 0
    odd = over >> np.minimum(widths, 31)[:, None].astype(np.uint32) > (widths > 31)[:, None]
    rows, places = np.nonzero(odd)
    starts = np.zeros(n + 1, np.uint64)
    np.cumsum(widths.astype(np.uint64) * LANES, out=starts[1:])
    words = np.zeros(int(starts[-1]), np.uint32)
    for w in np.unique(widths):
        if w:
            which = np.flatnonzero(widths == w)
            values = over[which] & np.uint32((1 << int(w)) - 1)
            words[starts[which].astype(np.int64)[:, None] + np.arange(int(w) * LANES)] = _pack(values, int(w))
    return [least, widths, odd.sum(axis=1).astype(np.uint8), starts, words, places.astype(np.uint8), over[rows, places]]


def decode_blocks(n: int, least: np.ndarray, widths: np.ndarray, counts: np.ndarray, starts: np.ndarray, words: np.ndarray, places: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.zeros((len(least), BLOCK), np.uint32)
    for w in np.unique(widths):
        if w:
            which = np.flatnonzero(widths == w)
            out[which] = _unpack(words[starts[which].astype(np.int64)[:, None] + np.arange(int(w) * LANES)], int(w))
    out[np.repeat(np.arange(len(least)), counts), places] = values
    return (out + least[:, None]).reshape(-1)[:n]


def to_shard(doc_ids: list[int | None], ids: list[np.ndarray], percentile: float = 0.9) -> bytes:
    stream = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    parts = encode_blocks(stream, percentile)
    head = np.array([(len(doc_ids), len(stream), len(parts[4]), len(parts[5]))], HEAD)
    table = [np.array([x or 0 for x in doc_ids], "<i8"), np.array([x is None for x in doc_ids], np.uint8), np.array([len(x) for x in ids], "<u4")]
    return b"".join([MAGIC, *(x.tobytes() for x in (head, *table, *parts))])


def from_shard(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, whether each is null, lengths, and all ids end to end."""
    if raw[: len(MAGIC)] != MAGIC:
        raise ValueError("not a shard of token ids")
    head = np.frombuffer(raw, HEAD, 1, len(MAGIC))[0]
    at = len(MAGIC) + HEAD.itemsize

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    d, n, blocks = int(head["documents"]), int(head["ids"]), -(-int(head["ids"]) // BLOCK)
    doc_ids, missing, lengths = take("<i8", d), take("u1", d), take("<u4", d)
    parts = [take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u8", blocks + 1), take("<u4", int(head["words"])), take("u1", int(head["exceptions"])), take("<u4", int(head["exceptions"]))]
    return doc_ids, missing.astype(bool), lengths, decode_blocks(n, *parts)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, percentile: float = 0.9, shard_ids: int = SHARD_IDS) -> str:
    """Encode and write docs (doc_id, text) as shards in ascending doc_id order, and a table of them with where each begins; returns the folder.

    Rows are dealt to ranges of doc_ids by a sample that Spark takes, their number from the bytes of text; rows of one doc_id follow each
    other as they were read, in several ranges if they are very many.  A range is written as shards of up to shard_ids ids, one after
    another, so that a task holds one shard whatever a range has.  Where shards begin are sums over groups of ranges, then within them.
    The input must give the same rows in the same order when a task runs again, as files do.
    """
    spark = docs.sparkSession
    folder = folder or fresh_dir(spark, "shards")
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    ranges = max(2 * partitions(spark), -(-size // RANGE_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        encode, end = encoder(tokenizer), np.array([end_id], np.uint32)
        part, n, doc_ids, ids = 0, 0, [], []

        def close() -> pa.RecordBatch:
            write_file(f"{folder}/{at:08d}-{part:06d}.pfor", to_shard(doc_ids, ids, percentile))
            return pa.RecordBatch.from_pydict({"range": pa.array([at], pa.int32()), "part": pa.array([part], pa.int32()), "n_ids": pa.array([n], pa.int64())})

        for batch in sliced(batches, kind="tokens"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, x in zip(batch.column("doc_id").to_pylist(), encode(texts), strict=True):
                if doc_ids and n + len(x) >= shard_ids:
                    yield close()
                    part, n, doc_ids, ids = part + 1, 0, [], []
                doc_ids.append(doc_id)
                ids.append(np.concatenate([x, end]))
                n += len(ids[-1])
        if doc_ids:
            yield close()

    keys = [F.asc_nulls_first("doc_id"), F.asc("at")]
    placed = docs.select("doc_id", F.monotonically_increasing_id().alias("at"), F.col("text").cast("string").alias("text")).repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    shards = staged(placed.select("doc_id", "text").mapInArrow(run, "range int, part int, n_ids long"), "shards").withColumn("group", F.floor(F.col("range") / GROUP))
    earlier = lambda by: F.coalesce(F.sum("n_ids").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = shards.groupBy("group").agg(F.sum("n_ids").alias("n_ids")).select("group", earlier(Window.orderBy("group")).alias("base"))  # a row for each GROUP ranges
    within = earlier(Window.partitionBy("group").orderBy("range", "part"))
    rows = shards.withColumn("before", within).join(groups, "group")
    rows.select(F.format_string("%08d-%06d", "range", "part").alias("shard"), (F.col("base") + F.col("before")).alias("start"), "n_ids").write.mode("overwrite").parquet(f"{folder}/{TABLE}")
    return folder


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its little-endian 32-bit ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                doc_ids, missing, lengths, ids = from_shard(read_file(f"{folder}/{shard}.pfor"))
                ends = np.cumsum(lengths, dtype=np.int64)
                starts = ends - lengths
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=missing), pa.array(starts + start), pa.array(lengths.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema("shard string, start long, n_ids long").parquet(f"{folder}/{TABLE}").select("shard", "start")
    return shards.repartition(4 * partitions(spark)).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
