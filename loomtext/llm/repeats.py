"""Removal of byte strings that repeat across documents, by merged Burrows-Wheeler transforms of shards.

Every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id goes; strings are judged on the input
and never cross documents.  Texts are UTF-8 bytes, null counts as empty.  A null doc_id counts as the largest, equal ids are not smaller
than each other; texts shorter than `length` keep all, and a null one comes out empty.  All columns pass through, but for those that have
a result's name (n_bytes, n_removed, n_spans, kept_sha256, removed): the result is there instead.  An empty table gives an empty one.

Any length from 1 on is allowed.  Keys and whole snippets are compared by 64-bit hashes: of n snippets in a bucket two different ones are
taken for equal with odds of about n * n / 2**65.

How it scales: every window of `length` bytes belongs to one anchor, its smallest hashed k-gram, so equal windows have equal anchors.  Only
windows whose anchor occurs in two documents can repeat; they travel, by the anchor's hash, as snippets (a run of windows with one anchor),
each distinct one once for a block of documents.  Equal snippets are one class; classes that share an anchor but not their whole context
are grouped in shards whose transforms are merged, and intervals of common prefixes of `length` bytes give the smallest document of each
window.  Blocks of documents (one file each in the shared folder) then take what concerns them.

The input must give the same rows in the same partitions when a task runs again, as files do.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import FACTOR, INVERSE, _power_table, byte_view, fresh_dir, give_back, mix, partitions, prefix_sums, read_file, sliced, span_hashes, write_file
from loomtext.llm.bwt import Shards, merged_intervals

NO_ID = (1 << 63) - 1
GRAM = 24  # at most; shorter windows have shorter grams
BLOCK_BYTES = 2 << 20  # of text in a block, unless one text is longer
BUCKET_BYTES = 16 << 20  # of text whose anchors make a bucket
MERGE_BYTES = 1 << 20  # of snippets whose transforms are merged at a time, unless one anchor has more


def runs_of_windows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first and last window start, the anchor's hash, the text's number; and prefix sums for hashes."""
    sums = prefix_sums(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, np.zeros(0, np.uint64), none, sums
    n = len(data) - gram + 1
    with np.errstate(over="ignore"):
        hashes = mix((sums[gram:] - sums[:-gram]) * _power_table(INVERSE, len(sums))[:n])
    value, place, width, window = (hashes >> np.uint64(32)).astype(np.uint32), np.arange(n, dtype=np.int32), 1, length - gram + 1
    while width < window:  # minima over twice the width, the rightmost of equal ones
        step = min(width, window - width)
        later = value[step:] <= value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        width += step
    text_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    starts = np.flatnonzero(text_of[: len(place)] == text_of[length - 1 :])
    if not len(starts):
        return none, none, np.zeros(0, np.uint64), none, sums
    place = place[starts]
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    low, high = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    return low, high, mix(hashes[place[begin]] ^ np.uint64(FACTOR)), text_of[low].astype(np.int64), sums


def _ids(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    column = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID)
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket.astype(np.uint16) if bucket.max(initial=0) < 1 << 16 else bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def _raw(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of raw arrays end to end, and how many each row has."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), np.array([len(p) for p in parts], np.int64)


def smallest_documents(text: np.ndarray, lengths: np.ndarray, anchors: np.ndarray, documents: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct snippets the smallest document of each of their windows: values end to end, and where each snippet's begin.

    Snippets whose anchor no other snippet has need no comparison; the rest go into shards, anchor by anchor, some MERGE_BYTES at a time
    (one anchor's snippets stay together).
    """
    windows = lengths - length + 1
    begins = np.cumsum(windows) - windows
    least = np.repeat(documents, windows)
    places = np.cumsum(lengths) - lengths
    order = np.argsort(anchors, kind="stable")
    cuts = np.append(np.flatnonzero(np.diff(anchors[order].astype(np.int64), prepend=-1)), len(order))
    several = np.flatnonzero(np.diff(cuts) > 1)
    upto = np.cumsum([int(lengths[order[cuts[i] : cuts[i + 1]]].sum()) for i in several.tolist()])
    at = 0
    while at < len(several):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + MERGE_BYTES, "right")))
        some = np.concatenate([order[cuts[i] : cuts[i + 1]] for i in several[at:end].tolist()])
        at = end
        shards = Shards(np.concatenate([text[a : a + n] for a, n in zip(places[some].tolist(), lengths[some].tolist(), strict=True)]), lengths[some], length + 14)
        rows, first = merged_intervals(shards, length)
        if len(rows):
            string, offset = shards.string[shards.rows[rows]], shards.offset[shards.rows[rows]]
            whole = offset <= lengths[some][string] - length  # the others run past their snippet's end
            value = np.where(whole, documents[some][string], NO_ID)
            best = np.repeat(np.minimum.reduceat(value, first), np.diff(np.append(first, len(rows))))
            least[(begins[some][string] + offset)[whole]] = best[whole]
    return least, begins


def remove_repeats(docs: DataFrame, length: int = 50, texts: bool = True) -> DataFrame:
    """The columns of docs, with text replaced by what is kept (if texts), and n_bytes, n_removed, n_spans, kept_sha256, removed (byte spans).

    Bytes kept of a character that was cut are left out of text, not of the digest.
    """
    if length < 1:
        raise ValueError("length must be 1 at least")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    folder, buckets = fresh_dir(spark, "repeats"), max(4 * partitions(spark), -(-size // BUCKET_BYTES))
    schema = docs.schema
    gram = min(GRAM, (length + 1) // 2)
    small = np.uint8 if 2 * length - gram < 256 else np.uint32  # holds the size of a snippet

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(sliced(batches, limit=BLOCK_BYTES)):
            raw = _pack(pa.Table.from_batches([batch]))
            block = f"{part:06d}-{n:05d}-{zlib.crc32(raw):08x}"  # by place and content
            write_file(f"{folder}/{block}.block", raw)
            _, _, anchors, text, _ = runs_of_windows(*byte_view(batch.column("text")), length, gram)
            keys, rows = (anchors >> np.uint64(32)).astype(np.uint32), list(_by_bucket((anchors % np.uint64(buckets)).astype(np.int64))) if len(anchors) else []
            rows = rows or [(0, np.zeros(0, np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows)), _raw([keys[x] for _, x in rows]), _raw([text[x].astype(np.uint32) for _, x in rows])], ["bucket", "block", "keys", "texts"])

    def shared(table: pa.Table) -> pa.Table:
        """Of each block, the keys of this bucket that occur in more than one document."""
        keys, sizes = _joined(table.column("keys"), np.uint32)
        texts_, _ = _joined(table.column("texts"), np.uint32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(keys, kind="stable")
        sorted_, owner = keys[order], (row << 32 | texts_)[order]
        cuts = np.flatnonzero(np.diff(sorted_.astype(np.int64), prepend=-1))
        many = np.minimum.reduceat(owner, cuts) < np.maximum.reduceat(owner, cuts) if len(cuts) else np.zeros(0, bool)
        several = np.zeros(len(keys), bool)
        several[order] = np.repeat(many, np.diff(np.append(cuts, len(keys))))
        ends = np.cumsum(sizes)
        found = [np.unique(keys[a:b][several[a:b]]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        del keys, texts_, row, order, sorted_, owner, several
        give_back("repeats")
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "keys": _raw(found)})

    def snippets(table: pa.Table) -> pa.Table:
        """A block's distinct snippets with shared anchors, by bucket; what the last step needs is kept beside the block."""
        block = table.column("block")[0].as_py()
        batch = _unpack(read_file(f"{folder}/{block}.block"))
        data, offsets = byte_view(batch.column("text"))
        low, high, anchors, text, sums = runs_of_windows(data, offsets, length, gram)
        wanted = np.sort(np.concatenate([np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b << 32) for b, k in zip(table.column("bucket").to_pylist(), table.column("keys").to_pylist(), strict=True)]))
        code = (anchors % np.uint64(buckets)) << np.uint64(32) | anchors >> np.uint64(32)
        at = np.minimum(np.searchsorted(wanted, code), max(0, len(wanted) - 1))
        some = np.flatnonzero(wanted[at] == code) if len(wanted) and len(code) else np.zeros(0, np.int64)
        low, high, code, text = low[some], high[some], code[some], text[some]
        owner = _ids(batch)[text] if len(text) else np.zeros(0, np.int64)
        _, one, number = np.unique(span_hashes(sums, low, high + length), return_index=True, return_inverse=True)
        least = np.full(len(one), NO_ID)
        np.minimum.at(least, number, owner)
        bucket = (code[one] >> np.uint64(32)).astype(np.int64)
        place = np.zeros(len(one), np.int64)
        rows = []
        for b, x in _by_bucket(bucket) if len(one) else ():
            place[x] = np.arange(len(x))
            size = high[one[x]] + length - low[one[x]]
            spread = np.repeat(low[one[x]] - np.cumsum(size) + size, size) + np.arange(size.sum())
            rows.append((b, block, size.astype(small), data[spread], (code[one[x]] & np.uint64(0xFFFFFFFF)).astype(np.uint32), least[x]))
        write_file(f"{folder}/{block}.runs", _pack(pa.table({"low": low, "size": (high - low + 1).astype(np.int32), "owner": owner, "text": text.astype(np.int32), "bucket": bucket[number].astype(np.int32), "place": place[number].astype(np.int32), "least": least[number]})))
        if not rows:
            rows = [(0, block, np.zeros(0, small), np.zeros(0, np.uint8), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
        b, blocks, *arrays = zip(*rows, strict=True)
        del data, anchors, sums, code, wanted
        give_back("repeats")
        return pa.table({"bucket": pa.array(b, pa.int32()), "block": blocks} | {k: _raw(list(v)) for k, v in zip(("sizes", "data", "keys", "least"), arrays, strict=True)})

    def merge(table: pa.Table) -> pa.Table:
        """For each block's snippets the windows that begin in a smaller document than the block's own, as (snippet, first, last, document).

        Beside the snippets as they came, what it holds is in proportion to the different ones; hashes are worked out block by block.
        """
        blocks = [(np.frombuffer(a.as_py(), small).astype(np.int64), np.frombuffer(d.as_buffer(), np.uint8)) for a, d in zip(table.column("sizes"), table.column("data"), strict=True)]
        counts = np.array([len(n) for n, _ in blocks], np.int64)
        keys, least = _joined(table.column("keys"), np.uint32)[0], _joined(table.column("least"), np.int64)[0]
        # equal snippets are one class
        hashes = [span_hashes(prefix_sums(d), np.cumsum(n) - n, np.cumsum(n)) for n, d in blocks]
        _, one, number = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        del hashes
        documents = np.full(len(one), NO_ID)
        np.minimum.at(documents, number, least)
        row = np.repeat(np.arange(len(counts)), counts)
        size = np.concatenate([n for n, _ in blocks]) if blocks else np.zeros(0, np.int64)
        start = np.concatenate([np.cumsum(n) - n for n, _ in blocks]) if blocks else size
        text = b"".join(memoryview(blocks[r][1])[a : a + n] for r, a, n in zip(row[one].tolist(), start[one].tolist(), size[one].tolist(), strict=True))
        size, start, blocks = size[one], None, None
        best, begins = smallest_documents(np.frombuffer(text, np.uint8), size, keys[one], documents, length)
        # runs of windows with one smallest document
        first_window = np.zeros(len(best), bool)
        first_window[begins] = True
        cut = np.flatnonzero(first_window | (np.diff(best, prepend=-1) != 0))
        last = np.append(cut[1:], len(best)) - 1
        of = np.searchsorted(begins, cut, "right") - 1
        best = best[cut]
        per, first = np.bincount(of, minlength=len(one)), np.searchsorted(of, np.arange(len(one)))
        inner = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
        out: list[tuple[np.ndarray, ...]] = []
        ends = np.cumsum(counts)
        for x, y in zip((ends - counts).tolist(), ends.tolist(), strict=True):  # block by block
            times = per[number[x:y]]
            run = np.repeat(first[number[x:y]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            snippet = np.repeat(np.arange(x, y), times)
            keep = best[run] < least[snippet]
            run, snippet = run[keep], snippet[keep]
            out.append((inner[snippet].astype(np.uint32), (cut[run] - begins[of[run]]).astype(small), (last[run] - begins[of[run]]).astype(small), best[run]))
        columns = [_raw([o[i] for o in out]) for i in range(4)]
        del text, best, number, row, first_window, out
        give_back("repeats")
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket")} | dict(zip(("snippets", "first", "last", "documents"), columns, strict=True)))

    def finish(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        batch, runs = _unpack(read_file(f"{folder}/{block}.block")), _unpack(read_file(f"{folder}/{block}.runs"))
        data, offsets = byte_view(batch.column("text"))
        low, size, owner, bucket, place, least = (runs.column(c).to_numpy().astype(np.int64) for c in ("low", "size", "owner", "bucket", "place", "least"))
        inner, counts = _joined(table.column("snippets"), np.uint32)
        first, last, document = (_joined(table.column(c), k)[0].astype(np.int64) for c, k in (("first", small), ("last", small), ("documents", np.int64)))
        told = np.repeat(np.array(table.column("bucket").to_pylist(), np.int64), counts) << 32 | inner
        order = np.argsort(told, kind="stable")
        mine = bucket << 32 | place
        a, b = np.searchsorted(told[order], mine, "left"), np.searchsorted(told[order], mine, "right")
        use = np.repeat(a - np.cumsum(b - a) + (b - a), b - a) + np.arange((b - a).sum())
        run, use = np.repeat(np.arange(len(mine)), b - a), order[use]
        keep = document[use] < owner[run]
        run, use = run[keep], use[keep]
        here = np.flatnonzero(least < owner)  # the same snippet in a smaller document of this block
        begin = np.concatenate([low[run] + first[use], low[here]])
        end = np.concatenate([low[run] + last[use], low[here] + size[here] - 1]) + length
        del low, size, owner, bucket, place, least, inner, first, last, document, mine, a, b, run, use, keep, here, runs
        edge = np.zeros(len(data) + 1, np.int32)
        np.add.at(edge, begin, 1)
        np.subtract.at(edge, end, 1)
        gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
        kept_bytes, text_rows, stats, spans = ~gone, [], [], []
        for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            mask = gone[x:y]
            if mask.any():
                change = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).tolist()
                kept = data[x:y][kept_bytes[x:y]].tobytes()
            else:
                change, kept = [], data[x:y].tobytes()
            spans.append([{"start": s, "end": e} for s, e in zip(change[::2], change[1::2], strict=True)])
            stats.append((y - x, int(mask.sum()), len(change) // 2, hashlib.sha256(kept).hexdigest()))
            if texts:
                text_rows.append(kept.decode("utf-8", "ignore"))
        out = {c: batch.column(c) for c in batch.column_names}
        if texts:
            out["text"] = pa.array(text_rows, pa.string())
        n_bytes, n_removed, n_spans, sha = zip(*stats, strict=True)
        del data, gone, kept_bytes, edge, order, told, begin, end
        give_back("repeats")
        out |= {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))}
        return pa.table({k: out[k] for k in names})

    columns = [f for f in schema.fields if texts or f.name == "doc_id"]
    extra = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"]
    columns = [f for f in columns if f.name not in extra]
    names = [f.name for f in columns] + extra
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>"
    rows = docs.select(*(f"`{f.name}`" for f in columns), *([] if texts else ["text"]))
    anchors = rows.mapInArrow(scan, "bucket int, block string, keys binary, texts binary")
    common = anchors.groupBy("bucket").applyInArrow(shared, "block string, bucket int, keys binary")
    sent = common.groupBy("block").applyInArrow(snippets, "bucket int, block string, sizes binary, data binary, keys binary, least binary")
    told = sent.groupBy("bucket").applyInArrow(merge, "block string, bucket int, snippets binary, first binary, last binary, documents binary")
    return told.groupBy("block").applyInArrow(finish, kind).select(*[F.col(f"`{n}`") for n in names])
