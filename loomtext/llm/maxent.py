"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

Tokens: words (A-Z lower-cased, runs without space, tab or line breaks), then one end for each document.  The most frequent training words
are heads, CLASSES classes of WIDTH words by frequency; any other word, also one never seen, belongs to a tail class by its last letters.
P(token) = P(class | context) * P(word | class, context).

Features of a class, and of a head within its class: the word before (n-gram), the two before (n-gram) and the second before alone (skip).
They are hashed to rows of weights, tables of a size that is a parameter of the model.  Weights start from counts of all training tokens;
then distributed gradient rounds go once through all training documents: every task sums its documents' gradient (observed minus expected
feature counts), sums meet by slices of the weights, and the driver makes the step.  Tasks are as many as training tokens ask for, however
many partitions or blocks there are, so what they send follows the tokens.

Features of a word within its tail class: the word after the two before it, one weight for each such triple of the training texts, so these
weights grow with the corpus.  P(word | class, context) is the word's add-one share of the class (one place for all unseen words) times
exp(weight), over the sum of the same for all words of the class, which is 1 and the differences of the words that have a weight in this
context.  So a context's triples are all that a gradient needs: they meet in a bucket of contexts, summed up within blocks before, and
gradient steps (scaled by their curvature, with a Gaussian prior) run over all contexts of a bucket at once.

Scoring sums sparse rows in numpy batches.  Counts, features and gradients cover all training documents.  Words are known by 64-bit hashes,
contexts by 40 bits.  A null text is empty, its end its only token.  A null doc_id counts as an empty text for the split.  Repeated rows
are each learned from and scored; other columns are ignored; an empty table gives an empty one, and without training documents all words
are unseen.  Texts of any length are taken whole; one of more than BLOCK bytes is a block of its own.  Ties among heads go by hash.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import byte_view, fresh_dir, give_back, mix, prefix_sums, read_file, sliced, span_hashes, squeezed, staged, unsqueezed, word_spans, write_file
from loomtext.llm.minhash import LOWER, WORD
from loomtext.llm.repeats import _pack, _raw, _unpack

CLASSES, WIDTH = 32, 32
HEADS = CLASSES * WIDTH
KINDS = 2 * CLASSES  # classes of heads, then of tails
ROW_BITS = 15
ROWS, WORD_ROWS = 1 << ROW_BITS, 1 << ROW_BITS
NEAR = 4096  # rows that words beyond the heads share as a single word of context
ONE = HEADS + 1 + NEAR  # rows of single words: heads, what stands before a text, and all others
SLICES = 32
FAN = 16  # parts that are summed at once
LEVELS = 256  # of counts, four to a doubling
N_SUMS = 2 * CLASSES + LEVELS
CONTEXTS = 4096  # distinct contexts of a batch
BLOCK = 6 << 20  # bytes of text in a block, unless one text is longer
BUCKET = 16 << 20  # bytes of text whose words and triples make a bucket
TASK = 16 << 20  # training tokens of a gradient task
PRIOR = 0.1  # inverse variance of the weights of triples
STEPS = 4
END = np.uint64(0xA5A5F00DBEEF1234)
NOTHING = 0x5EED5EED  # the word before a text
SHARE = 2048  # steps to which -log(share) is rounded
_MULTIPLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and tail classes of all tokens, ends included, and where each text's begin (len + 1 values)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORD)
    n = len(starts) + len(offsets) - 1
    closes = first[1:] + np.arange(len(offsets) - 1)
    inside = np.ones(n, bool)
    inside[closes] = False
    hashes, tails = np.full(n, END), np.zeros(n, np.uint8)
    hashes[inside] = span_hashes(prefix_sums(data), starts, ends)
    last = data[ends - 1].astype(np.uint32)
    before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint32)
    tails[inside] = (last * np.uint32(40503) + before * np.uint32(30011) >> np.uint32(4)) % np.uint32(CLASSES)
    return hashes, tails, np.concatenate([[0], closes + 1])


def _shifted(values: np.ndarray, begins: np.ndarray, by: int, start: int) -> np.ndarray:
    """What stands `by` tokens before each token of its text."""
    out = np.full(len(values), start, values.dtype)
    out[by:] = values[:-by]
    for i in range(by):
        out[begins[:-1][np.diff(begins) > i] + i] = start
    return out


def single_rows(ids: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """For distinct words the row of each as a single word of context."""
    return np.where(codes < HEADS, codes, HEADS + 1 + ids.astype(np.int64) % NEAR)


def feature_rows(ids: np.ndarray, singles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Rows of weights for each token's context, one line for each feature."""
    one, two = (_shifted(singles, begins, by, HEADS) for by in (1, 2))
    a, b = (_shifted(ids, begins, by, NOTHING).astype(np.uint64) for by in (1, 2))
    with np.errstate(over="ignore"):
        both = (a * np.uint64(_MULTIPLY[0]) + b * np.uint64(_MULTIPLY[1])) >> np.uint64(34)
    return np.stack([one, ONE + two, 2 * ONE + (both % np.uint64(ROWS - 2 * ONE)).astype(np.int64)])


def triples(ids: np.ndarray, codes: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where tail words stand, and the key of each with its context: 40 bits of context and class, 24 of the word."""
    where = np.flatnonzero(codes >= HEADS)
    a, b = (_shifted(ids, begins, by, NOTHING)[where].astype(np.uint64) for by in (1, 2))
    with np.errstate(over="ignore"):
        context = mix(a * np.uint64(_MULTIPLY[0]) + b * np.uint64(_MULTIPLY[1]) + codes[where].astype(np.uint64) * np.uint64(_MULTIPLY[2]))
    return where, context >> np.uint64(24) << np.uint64(24) | ids[where].astype(np.uint64) & np.uint64((1 << 24) - 1)


def word_rows(rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
    return kind * (WORD_ROWS // CLASSES) + (rows * 2654435761 >> 5) % (WORD_ROWS // CLASSES)


def tail_logs(keys: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Log probability within its class of each triple (ascending distinct keys, training counts, log shares), by weights that gradient steps fit."""
    out = shares.astype(np.float64)
    seen = np.flatnonzero(counts)
    context = keys >> np.uint64(24)
    if not len(seen):
        return out
    own, n, share = context[seen], counts[seen].astype(np.float64), np.exp(out[seen])
    cut = np.flatnonzero(np.diff(own, prepend=own[0] + np.uint64(1)))
    of = np.repeat(np.arange(len(cut)), np.diff(np.append(cut, len(own))))
    total = np.add.reduceat(n, cut)[of]
    weight = np.maximum(np.log(n / (total + 4) / share), 0.0)
    z = lambda w: 1 + np.add.reduceat(share * np.expm1(w), cut)
    for _ in range(STEPS):
        p = share * np.exp(weight) / z(weight)[of]
        weight = np.clip(weight + (n - total * p - PRIOR * weight) / (total * p * (1 - p) + PRIOR), 0, 60)
    norm = np.log(z(weight))
    out[seen] += weight
    # all triples of a context share its sum, also those of held-out texts only
    at = np.minimum(np.searchsorted(own[cut], context), len(cut) - 1)
    return out - np.where(own[cut][at] == context, norm[at], 0.0)


class Weights:
    def __init__(self, kinds: np.ndarray, words: np.ndarray, prior: np.ndarray, share: np.ndarray) -> None:
        self.kinds, self.words, self.prior, self.share = kinds, words, prior, share

    def class_scores(self, rows: np.ndarray) -> np.ndarray:
        """Logs of classes up to a constant, one row for each context, the largest 0."""
        out = self.prior + self.kinds[rows[0]]
        for r in rows[1:]:
            out += self.kinds[r]
        out -= out.max(axis=1, keepdims=True)
        return out

    def word_scores(self, rows: np.ndarray, kind: np.ndarray) -> np.ndarray:
        out = self.share[kind] + self.words[rows[0]]
        for r in rows[1:]:
            out += self.words[r]
        out -= out.max(axis=1, keepdims=True)
        return out


def _level(counts: np.ndarray) -> np.ndarray:
    return np.floor(4 * np.log2(counts)).astype(np.int64)


def _kind(codes: np.ndarray) -> np.ndarray:
    return np.where(codes < HEADS, codes // WIDTH, codes - HEADS + CLASSES)


def _add_rows(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """total[at] += values (float32, an even number of columns), repeated rows adding up."""
    order = np.argsort(at.astype(np.uint16), kind="stable")
    cuts = np.flatnonzero(np.diff(at[order], prepend=-1))
    sizes = np.diff(np.append(cuts, len(at)))
    once = order[cuts[sizes == 1]]
    total[at[once]] += values[once]
    more = sizes > 1
    if more.any():
        order, sizes = order[np.repeat(more, sizes)], sizes[more]
        cuts = np.cumsum(sizes) - sizes
        # numpy sums each column of each run apart, so columns go in pairs
        total[at[order[cuts]]] += np.add.reduceat(values[order].view(np.complex64), cuts, axis=0).view(np.float32)


def _contexts(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Distinct contexts (rows of the features) in batches: their rows, how many tokens each has, and those tokens one context after the other."""
    keys = rows[0] << 2 * ROW_BITS | rows[1] << ROW_BITS | rows[2]
    order = np.argsort(keys)
    cuts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    ends = np.append(cuts, len(keys))
    for a in range(0, len(cuts), CONTEXTS):
        b = min(a + CONTEXTS, len(cuts))
        yield rows[:, order[cuts[a:b]]], np.diff(ends[a : b + 1]), order[ends[a] : ends[b]]


def _of_words(weights: Weights) -> Callable[[np.ndarray], np.ndarray]:
    return lambda w: weights.word_scores(w, w[0] // (WORD_ROWS // CLASSES))  # word_rows tell the class


def _picked(rows: np.ndarray, which: np.ndarray, scores: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The log of the softmax of each token's context at one place.  Equal contexts are scored once."""
    out = np.zeros(len(which))
    for r, times, of in _contexts(rows):
        s, row = scores(r), np.repeat(np.arange(len(times)), times)
        at = s[row, which[of]]
        out[of] = at - np.log(np.exp(s, out=s).sum(axis=1))[row]
    return out


def _missed(total: np.ndarray, rows: np.ndarray, which: np.ndarray, scores: Callable[[np.ndarray], np.ndarray]) -> None:
    """Add to total's rows: 1 at the observed place of each token, less the softmax of its context's scores.  Equal contexts are scored once."""
    width = total.shape[1]
    for r in rows:
        total += np.bincount(r * width + which, minlength=total.size).reshape(total.shape)
    for r, times, _ in _contexts(rows):
        g = scores(r)
        np.exp(g, out=g)
        g *= (-times / g.sum(axis=1)).astype(np.float32)[:, None]
        for x in r:
            _add_rows(total, x, g)


def text_logs(codes: np.ndarray, rows: np.ndarray, weights: Weights) -> np.ndarray:
    """The log probability of each token up to its tail class."""
    kind, head = _kind(codes), np.flatnonzero(codes < HEADS)
    out = _picked(rows, kind, weights.class_scores)
    out[head] += _picked(word_rows(rows[:, head], kind[head]), codes[head] % WIDTH, _of_words(weights))
    return out


def gradient(codes: np.ndarray, rows: np.ndarray, weights: Weights, kinds: np.ndarray, words: np.ndarray) -> None:
    """Add observed minus expected feature counts of the tokens to kinds and words."""
    kind, head = _kind(codes), np.flatnonzero(codes < HEADS)
    _missed(kinds, rows, kind, weights.class_scores)
    _missed(words, word_rows(rows[:, head], kind[head]), codes[head] % WIDTH, _of_words(weights))


def observe(codes: np.ndarray, rows: np.ndarray, kinds: np.ndarray, words: np.ndarray) -> None:
    """Add feature counts of the tokens to kinds and words."""
    kind, head = _kind(codes), np.flatnonzero(codes < HEADS)
    for r in rows:
        for total, at in ((kinds, r * KINDS + kind), (words, word_rows(r[head], kind[head]) * WIDTH + codes[head] % WIDTH)):
            where, times = np.unique(at, return_counts=True)
            total.reshape(-1)[where] += times


def _sent(*arrays: np.ndarray) -> pa.RecordBatch:
    """Arrays in slices, without the zeros, as half floats: place and value of each number that is there."""
    whole = np.concatenate([a.reshape(-1) for a in arrays])
    part, rows = TaskContext.get().partitionId(), []
    for piece in np.split(whole, SLICES):
        at = np.flatnonzero(piece)
        scale = np.float32(max(1.0, float(np.abs(piece).max(initial=0)) / 30000))
        rows.append(scale.tobytes() + len(at).to_bytes(8, "little") + squeezed(at.astype(np.uint32), True) + squeezed((piece[at] / scale).astype(np.float16).view(np.uint16)))
    return pa.RecordBatch.from_arrays([pa.array([part] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int32()), pa.array(rows, pa.binary())], ["part", "slice", "data"])


def _added(raw: bytes, total: np.ndarray) -> None:
    scale, n = np.frombuffer(raw, np.float32, 1)[0], int.from_bytes(raw[4:12], "little")
    at, end = unsqueezed(raw, np.uint32, True, 12)
    values, _ = unsqueezed(raw, np.uint16, False, end)
    assert len(at) == len(values) == n
    total[at] += values.view(np.float16).astype(np.float32) * scale


def _summed(parts: DataFrame, n: int, size: int) -> np.ndarray:
    """The sum of arrays sent by n tasks in slices (part, slice, data), FAN parts of a slice at a time."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(size // SLICES, np.float32)
        for raw in table.column("data").to_pylist():
            if table.column("whole")[0].as_py():
                total += np.frombuffer(raw, np.float32)
            else:
                _added(raw, total)
        return pa.table({"part": pa.array([table.column("part")[0].as_py() // FAN], pa.int32()), "slice": table.column("slice")[:1], "data": _raw([total]), "whole": [True]})

    parts, kind = parts.withColumn("whole", F.lit(False)), "part int, slice int, data binary, whole boolean"
    while True:
        parts = parts.groupBy(F.floor(F.col("part") / FAN).alias("some"), "slice").applyInArrow(add, kind)
        n = -(-n // FAN)
        if n == 1:
            break
    rows = parts.collect()  # SLICES rows, the size of the model
    return np.concatenate([np.frombuffer(r["data"], np.float32) for r in sorted(rows, key=lambda r: r["slice"])]) if rows else np.zeros(size, np.float32)


class Block:
    """A block's documents and tokens: ids and codes of its distinct words, and which of them each token is."""

    def __init__(self, folder: str, name: str) -> None:
        self.docs = _unpack(read_file(f"{folder}/{name}.docs"))
        self.number, _ = unsqueezed(read_file(f"{folder}/{name}.tokens"), np.uint32)
        raw = read_file(f"{folder}/{name}.words")
        self.ids, end = unsqueezed(raw, np.uint32, True)
        self.codes = unsqueezed(raw, np.uint16, False, end)[0].astype(np.int64)
        self.sizes = self.docs.column("n_tokens").to_numpy()
        self.train = ~self.docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool)

    def contexts(self, training: bool) -> tuple[np.ndarray, np.ndarray]:
        """Codes and feature rows of the tokens of training documents, or of all."""
        number, sizes = self.number, self.sizes
        if training:
            number, sizes = number[np.repeat(self.train, sizes)], sizes[self.train]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        return self.codes[number], feature_rows(self.ids[number], single_rows(self.ids, self.codes)[number], begins)


def _ranges(sorted_: np.ndarray, bits: int, buckets: int) -> Iterator[tuple[int, slice]]:
    """Buckets of ascending keys by their upper `bits` bits, each with its slice."""
    bucket = ((sorted_ >> np.uint64(64 - bits)) * np.uint64(buckets) >> np.uint64(bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cuts.tolist(), np.append(cuts, len(bucket))[1:].tolist(), strict=True):
        yield int(bucket[a]), slice(a, b)


def _parts(column: pa.ChunkedArray, kind: type, delta: bool = False) -> list[np.ndarray]:
    return [unsqueezed(x, kind, delta)[0] for x in column.to_pylist()]


def score(docs: DataFrame, held_out: Column, rounds: int = 3, rate: float = 0.6) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the whole text)."""
    spark = docs.sparkSession
    folder, cores = fresh_dir(spark, "maxent"), spark.sparkContext.defaultParallelism
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(2 * cores, -(-size // BUCKET))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write blocks, named by place and content, and send their distinct words by bucket."""
        part = TaskContext.get().partitionId()
        for n, batch in enumerate(sliced(batches, limit=BLOCK)):
            data, offsets = byte_view(batch.column("text"))
            hashes, tails, begins = tokens(data, offsets)
            held = batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False)
            block = f"{part:06d}-{n:05d}-{zlib.crc32(ids.tobytes(), zlib.crc32(offsets.tobytes(), zlib.crc32(data))):08x}"
            distinct, one, number = np.unique(hashes, return_index=True, return_inverse=True)
            times = np.bincount(number[np.repeat(~held, np.diff(begins))], minlength=len(distinct)).astype(np.uint32)
            write_file(f"{folder}/{block}.texts", _pack(pa.table({"doc_id": batch.column("doc_id"), "held_out": held, "n_tokens": np.diff(begins)})))
            write_file(f"{folder}/{block}.tokens", squeezed(number.astype(np.uint32)))
            write_file(f"{folder}/{block}.ids", squeezed((distinct >> np.uint64(32)).astype(np.uint32), True) + squeezed(tails[one]))
            rows = [(b, squeezed(distinct[x], True), squeezed(times[x]), squeezed(tails[one[x]])) for b, x in _ranges(distinct, 32, buckets)]
            bucket, *arrays = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([block] * len(rows)), *(pa.array(x, pa.binary()) for x in arrays)], ["bucket", "block", "hashes", "times", "tails"])

    def count(table: pa.Table) -> pa.Table:
        """Counts of a bucket's words over all blocks, back to each block in its order; and, without a block, the bucket's sums by tail class
        and its most frequent words, of which HEADS suffice."""
        hashes = _parts(table.column("hashes"), np.uint64, True)
        sizes = [len(x) for x in hashes]
        times, tails = (np.concatenate(_parts(table.column(c), k)) for c, k in (("times", np.uint32), ("tails", np.uint8)))
        distinct, one, number = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
        total = np.bincount(number, times, len(distinct)).astype(np.int64)
        tail, seen = tails[one], total > 0
        top = np.lexsort((distinct, -total))[:HEADS]
        top = top[total[top] > 0]
        sums = np.concatenate([np.bincount(tail, total, CLASSES), np.bincount(tail[seen], minlength=CLASSES), np.bincount(_level(total[top]), minlength=LEVELS)]).astype(np.int64)
        pieces = np.split(total[number].astype(np.uint32), np.cumsum(sizes)[:-1])
        give_back("maxent")
        return pa.table({
            "block": pa.array([*table.column("block").to_pylist(), None], pa.string()), "bucket": pa.array([*table.column("bucket").to_pylist(), None], pa.int32()),
            "a": pa.array([*map(squeezed, pieces), total[top].tobytes()], pa.binary()), "b": _raw([*[np.zeros(0)] * len(pieces), distinct[top]]), "c": _raw([*[np.zeros(0)] * len(pieces), np.concatenate([sums, tail[top].astype(np.int64)])]),
        })

    sent = source.mapInArrow(scan, "bucket int, block string, hashes binary, times binary, tails binary")
    counted = staged(sent.groupBy("bucket").applyInArrow(count, "block string, bucket int, a binary, b binary, c binary"), "counts")

    # sums of buckets, and the heads: the most frequent of the buckets' most frequent words.  Sums by level of count tell from which level
    # on there are enough, so buckets send only those.
    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, c in zip(*(batch.column(x).to_pylist() for x in "abc"), strict=True):
                n = np.frombuffer(a, np.int64)
                high = _level(n) >= least
                yield pa.RecordBatch.from_arrays([pa.array(n[high]), pa.array(np.frombuffer(b, np.uint64).view(np.int64)[high]), pa.array(np.frombuffer(c, np.int64)[N_SUMS:][high])], ["n", "hash", "tail"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SUMS, np.int64)
        for batch in batches:
            for c in batch.column("c").to_pylist():
                total += np.frombuffer(c, np.int64)[:N_SUMS]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["at", "n"])

    totals = counted.filter("block is null")
    summed = np.zeros(N_SUMS, np.int64)
    for r in totals.mapInArrow(sums, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        summed[r["at"]] = r["n"]
    sizes, from_level = summed[: 2 * CLASSES], np.cumsum(summed[: 2 * CLASSES - 1 : -1])[::-1]
    least = max(0, int(np.count_nonzero(from_level >= HEADS)) - 1)
    heads = totals.mapInArrow(tops, "n long, hash long, tail long").orderBy(F.desc("n"), "hash").limit(HEADS).collect()
    train_tokens, distinct_tokens = int(sizes[:CLASSES].sum()), int(sizes[CLASSES:].sum())
    for r in heads:  # what is left for the tails
        sizes[r["tail"]] -= r["n"]
        sizes[CLASSES + r["tail"]] -= 1
    head_counts = np.array([r["n"] for r in heads], np.int64)
    head_ids = (np.array([r["hash"] for r in heads], np.int64).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
    tail_places = np.log(sizes[:CLASSES] + sizes[CLASSES:] + 1)

    def encode(table: pa.Table) -> pa.Table:
        """Write a block's codes and what its documents have from counts alone; send the distinct triples of its tail words by bucket."""
        block = table.column("block")[0].as_py()
        texts, (number, _) = _unpack(read_file(f"{folder}/{block}.texts")), unsqueezed(read_file(f"{folder}/{block}.tokens"), np.uint32)
        raw = read_file(f"{folder}/{block}.ids")
        ids, end = unsqueezed(raw, np.uint32, True)
        codes = HEADS + unsqueezed(raw, np.uint8, False, end)[0].astype(np.int64)
        counts = np.concatenate(_parts(table.sort_by("bucket").column("a"), np.uint32)).astype(np.int64)
        # a head's word has its id and its count
        for at, (a, b) in enumerate(zip(np.searchsorted(ids, head_ids, "left").tolist(), np.searchsorted(ids, head_ids, "right").tolist(), strict=True)):
            codes[a:b] = np.where(counts[a:b] == head_counts[at], at, codes[a:b])
        write_file(f"{folder}/{block}.words", squeezed(ids, True) + squeezed(codes.astype(np.uint16)))
        lengths = texts.column("n_tokens").to_numpy()
        begins = np.concatenate([[0], np.cumsum(lengths)])
        adding = lambda x: np.add.reduceat(x, begins[:-1])
        base = adding(np.log10(counts + 1.0)[number]) - lengths * np.log10(train_tokens + distinct_tokens + 1)
        write_file(f"{folder}/{block}.docs", _pack(pa.table({c: texts.column(c) for c in texts.column_names} | {"n_known": adding((counts > 0).astype(np.int64)[number]), "base_score": base})))
        where, keys = triples(ids[number], codes[number], begins)
        train = np.repeat(~texts.column("held_out").to_numpy(zero_copy_only=False).astype(bool), lengths)
        distinct, one, which = np.unique(keys, return_index=True, return_inverse=True)
        times = np.bincount(which[train[where]], minlength=len(distinct)).astype(np.uint32)
        word = number[where[one]]
        share = np.minimum((tail_places[codes[word] - HEADS] - np.log(counts[word] + 1.0)) * SHARE, 65535).astype(np.uint16)
        rows = [(b, block, squeezed(distinct[x], True), squeezed(times[x]), squeezed(share[x])) for b, x in _ranges(distinct, 32, buckets)]
        rows = rows or [(0, block, *map(squeezed, (distinct, times, share)))]
        bucket, blocks_, *arrays = zip(*rows, strict=True)
        del keys, distinct, one, which, where, train
        give_back("maxent")
        return pa.table({"bucket": pa.array(bucket, pa.int32()), "block": pa.array(blocks_)} | {k: pa.array(v, pa.binary()) for k, v in zip(("keys", "times", "shares"), arrays, strict=True)})

    def fit_tails(table: pa.Table) -> pa.Table:
        """Log probabilities within their classes of a bucket's triples, back to each block in its order."""
        keys = _parts(table.column("keys"), np.uint64, True)
        sizes_ = [len(x) for x in keys]
        times, shares = (np.concatenate(_parts(table.column(c), k)) for c, k in (("times", np.uint32), ("shares", np.uint16)))
        distinct, one, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        logs = tail_logs(distinct, np.bincount(number, times, len(distinct)), shares[one] / -float(SHARE)).astype(np.float32)
        give_back("maxent")
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "logs": pa.array(list(map(squeezed, np.split(logs[number].view(np.uint32), np.cumsum(sizes_)[:-1]))), pa.binary())})

    triples_ = counted.filter("block is not null").groupBy("block").applyInArrow(encode, "bucket int, block string, keys binary, times binary, shares binary")
    tails_ = staged(triples_.groupBy("bucket").applyInArrow(fit_tails, "block string, bucket int, logs binary"), "tails")
    blocks = staged(tails_.select("block").distinct(), "blocks")
    shape = ROWS * KINDS + WORD_ROWS * WIDTH

    def gathered(which: DataFrame, n_tokens: int, body) -> np.ndarray:
        n = max(cores, -(-n_tokens // TASK))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds, words = np.zeros((ROWS, KINDS), np.float32), np.zeros((WORD_ROWS, WIDTH), np.float32)
            any_ = False
            for batch in batches:
                for block in batch.column("block").to_pylist():
                    body(*Block(folder, block).contexts(True), kinds, words)
                    any_ = True
            if any_:
                yield _sent(kinds, words)
            give_back("maxent")

        return _summed(which.repartition(n).mapInArrow(run, "part int, slice int, data binary"), n, shape)

    split = lambda x: (x[: ROWS * KINDS].reshape(ROWS, KINDS), x[ROWS * KINDS :].reshape(WORD_ROWS, WIDTH))
    seen_kinds, seen_words = split(gathered(blocks, train_tokens, observe))
    per_word = np.zeros(HEADS)
    per_word[: len(head_counts)] = head_counts
    per_word = per_word.reshape(CLASSES, WIDTH)
    per_kind = np.concatenate([per_word.sum(axis=1), sizes[:CLASSES]]) + 1.0
    prior = np.log(per_kind / per_kind.sum())
    share = np.log((per_word + 1e-9) / (per_word + 1e-9).sum(axis=1, keepdims=True))
    expect = np.repeat(np.exp(share), WORD_ROWS // CLASSES, axis=0)
    start = lambda seen, p: np.log((seen + 2 * p) / ((seen.sum(axis=1, keepdims=True) + 2) * p)) / 2
    weights = Weights(start(seen_kinds, np.exp(prior)).astype(np.float32), np.where(expect > 1e-6, start(seen_words, np.maximum(expect, 1e-6)), 0).astype(np.float32), prior.astype(np.float32), share.astype(np.float32))
    part_of = F.pmod(F.xxhash64("block"), F.lit(rounds))
    for r in range(rounds if train_tokens else 0):
        sent_weights = spark.sparkContext.broadcast(weights)  # of a size that is a parameter of the model
        g_kinds, g_words = split(gathered(blocks.filter(part_of == r), -(-train_tokens // rounds), lambda c, x, k, w, now=sent_weights: gradient(c, x, now.value, k, w)))
        sent_weights.destroy()
        step = lambda g, seen: rate * np.clip(g / (seen / rounds + 4), -1, 1)
        weights = Weights(weights.kinds + step(g_kinds, seen_kinds), weights.words + step(g_words, seen_words), weights.prior, weights.share)
    last = spark.sparkContext.broadcast(weights)

    def scored(table: pa.Table) -> pa.Table:
        block = Block(folder, table.column("block")[0].as_py())
        codes, rows = block.contexts(False)
        logs = text_logs(codes, rows, last.value)
        begins = np.concatenate([[0], np.cumsum(block.sizes)])
        where, keys = triples(block.ids[block.number], codes, begins)
        within = np.concatenate(_parts(table.sort_by("bucket").column("logs"), np.uint32)).view(np.float32)
        if len(where):
            logs[where] += within[np.unique(keys, return_inverse=True)[1]]
        del where, keys, within, rows, codes
        give_back("maxent")
        kept = {c: block.docs.column(c).combine_chunks() for c in ("doc_id", "held_out", "n_tokens", "n_known")}
        return pa.table(kept | {"train_tokens": np.full(len(block.sizes), train_tokens), "base_score": block.docs.column("base_score"), "score": np.add.reduceat(logs, begins[:-1]) / np.log(10)})

    return tails_.groupBy("block").applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
