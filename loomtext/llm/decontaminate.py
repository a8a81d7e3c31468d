"""Benchmark decontamination: an FM-index for each shard of training text, searched for the benchmark's windows.

Texts are lower-cased (A-Z) and cut into words of digits, letters a-z and bytes from 0x80.  A window is `width` consecutive words of an
item; an item of fewer words, but not none, is one window.  Words of a document inside any occurrence of a window are hit; hit words in a
row make a removal span.

A shard is a run of documents of a bounded number of bytes.  Its index covers the runs of words that the benchmark has and that are long
enough for a window, with a border between runs: no window can occur elsewhere.  Windows are found by backward search over ranks in a
wavelet matrix of the Burrows-Wheeler transform, and located by stepping back to sampled positions.

A null or empty text has no words and no hits; items without words are left out; items with one id count once, a null id as 'null'.
Repeated documents are each judged; other columns are ignored; an empty table of either kind gives no hits.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import byte_view, fresh_dir, prefix_sums, read_file, sliced, span_hashes, word_spans, write_file
from loomtext.llm.minhash import LOWER

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of words, and for each text the index of its first word (len + 1 values)."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, WORD)
    return span_hashes(prefix_sums(data), starts, ends), starts, ends, first


class Phrases:
    """The distinct windows of a block of items, as numbers of the block's words (from 1), by length; and the items of each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int) -> None:
        hashes, _, _, first = words_of(*byte_view(pa.array([t for _, t in items], pa.string())))
        self.vocabulary, numbers = np.unique(hashes, return_inverse=True)
        found: dict[tuple[int, ...], set[str]] = {}
        for (item, _), a, b in zip(items, first[:-1].tolist(), first[1:].tolist(), strict=True):
            words = (numbers[a:b] + 1).tolist()
            for i in range(max(1, len(words) - width + 1) if words else 0):
                found.setdefault(tuple(words[i : i + width]), set()).add(item)
        self.items = [sorted(x) for x in found.values()]
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for w in found}):
            which = [(i, w) for i, w in enumerate(found) if len(w) == n]
            self.by_length[n] = np.array([i for i, _ in which]), np.array([w for _, w in which])
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's number, 0 for words that the block doesn't have."""
        out = np.zeros(len(hashes), np.int64)
        some = np.flatnonzero(self.maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[at] == hashes[some], at + 1, 0)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling; borders (0) differ from each other, an earlier one being smaller."""
    rank = symbols + np.count_nonzero(symbols == 0)
    borders = np.flatnonzero(symbols == 0)
    rank[borders] = np.arange(len(borders))
    n, step = len(symbols), 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: n - step] = rank[step:] + 1
        key = rank * (nxt.max() + 1) + nxt
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order
        step *= 2


class Wavelet:
    """A wavelet matrix: ranks of symbols in prefixes, and the symbol of a row with its own rank, for many at a time."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        n = len(symbols)
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.zeros(n // 64 * 8 + 8, np.uint8)
            bits = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[: len(bits)] = bits
            words = packed.view(np.uint64)
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(n - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.start = self._down(np.arange(1 << self.levels), np.zeros(1 << self.levels, np.int64))

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[k][word] + np.bitwise_count(self.words[k][word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self._ones(k, at)
            at = np.where((symbols >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.start[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        symbols = np.zeros(len(at), np.int64)
        for k in range(self.levels):
            ones = self._ones(k, at)
            bit = (self.words[k][at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            symbols = symbols * 2 + bit.astype(np.int64)
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return symbols, at - self.start[symbols]


class FMIndex:
    """Over runs of symbols from 1 on; symbols is the runs with a border 0 before each."""

    def __init__(self, symbols: np.ndarray, sample: int = 16) -> None:
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.bwt = Wavelet(symbols[order - 1])
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << self.bwt.levels))])
        kept = (order % sample == 0) | (symbols[order - 1] == 0)  # starts of runs too: nothing steps over a border
        self.kept, self.before = kept, np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which patterns (one a row) occur, and the first and the end row of their suffixes."""
        alive = np.flatnonzero(patterns.max(axis=1) < 1 << self.bwt.levels)
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.n, np.int64)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[alive, k]
            low, high = self.below[c] + self.bwt.rank(c, low), self.below[c] + self.bwt.rank(c, high)
            some = low < high
            alive, low, high = alive[some], low[some], high[some]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(rows), np.int64), np.arange(len(rows))
        steps = 0
        while len(open_):
            done = self.kept[rows]
            out[open_[done]] = self.positions[self.before[rows[done]]] + steps
            open_, rows = open_[~done], rows[~done]
            if len(open_):
                symbols, rank = self.bwt.access(rows)
                rows = self.below[symbols] + rank
            steps += 1
        return out


def occurrences(hashes: np.ndarray, first: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Numbers of windows, the words where they begin, and their length, for every occurrence within a text of the shard."""
    if not phrases.by_length or not len(hashes):
        return
    numbers = phrases.numbers(hashes)
    inside = np.concatenate([[False], numbers > 0, [False]])
    begin = inside[1:-1] & ~inside[:-2]
    cuts = first[1:-1][(first[1:-1] < len(numbers))]
    begin[cuts[numbers[cuts] > 0]] = True
    starts = np.flatnonzero(begin)
    stop = inside[1:-1] & ~inside[2:]
    ends_at = cuts[cuts > 0] - 1
    stop[ends_at[numbers[ends_at] > 0]] = True
    ends = np.flatnonzero(stop) + 1
    long = ends - starts >= min(phrases.by_length)
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    sizes = ends - starts + 1
    at = np.cumsum(sizes) - sizes  # of each run's border
    word = np.repeat(starts - at - 1, sizes) + np.arange(sizes.sum())
    symbols = numbers[np.maximum(word, 0)]
    symbols[at] = 0
    index = FMIndex(symbols)
    for length, (which, patterns) in phrases.by_length.items():
        found, low, high = index.search(patterns)
        times = high - low
        rows = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        yield np.repeat(which[found], times), word[index.locate(rows)], length


def phrase_files(benchmark: DataFrame, width: int, block_bytes: int) -> list[str]:
    """Names of files in the shared folder, each with the windows of a block of items: tasks make and write them, the driver sees names only."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = fresh_dir(benchmark.sparkSession, "phrases")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stored(block: list[tuple[str, str | None]]) -> pa.RecordBatch:
            raw = zlib.compress(pickle.dumps(Phrases(block, width)), 1)
            name = f"{folder}/{TaskContext.get().partitionId():06d}-{zlib.crc32(raw):08x}-{len(raw)}"
            write_file(name, raw)
            return pa.RecordBatch.from_pydict({"file": [name]})

        block, held = [], 0
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block.append((item, text))
                held += len((text or "").encode())
                if held >= 2 * block_bytes:  # partitions have about block_bytes; one with long items has several blocks
                    yield stored(block)
                    block, held = [], 0
        if block:
            yield stored(block)

    return sorted(r["file"] for r in items.repartition(max(1, -(-size // block_bytes))).mapInArrow(write, "file string").collect())


def _phrases(name: str) -> Phrases:
    return pickle.loads(zlib.decompress(read_file(name)))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_bytes: int = 2 << 20, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document the columns of keep, n_words, n_hit, items (ids of items with occurring windows, sorted as strings), spans (bytes to
    remove), and kept_text, what is left of the text without its spans.

    The benchmark's windows lie in files, each of about block_bytes of text, twice that at most unless one item is longer.  A task holds one
    of them at a time; where there are several, it reads them for each slice of documents, and slices are larger.
    """
    files = phrase_files(benchmark, width, block_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = _phrases(files[0]) if len(files) == 1 else None
        for batch in sliced(batches, limit=(2 if only else 8) << 20):
            hashes, starts, ends, first = words_of(*byte_view(batch.column("text")))
            _, offsets = byte_view(batch.column("text"))
            edge = np.zeros(len(hashes) + 1, np.int64)
            items: dict[int, set[str]] = {}
            for name in files:
                phrases = only or _phrases(name)
                for which, words, length in occurrences(hashes, first, phrases):
                    np.add.at(edge, words, 1)
                    np.add.at(edge, words + length, -1)
                    of = np.searchsorted(first, words, "right") - 1
                    for doc, w in np.unique(np.stack([of, which], 1), axis=0).tolist():
                        items.setdefault(doc, set()).update(phrases.items[w])
            hit = np.cumsum(edge[:-1]) > 0
            upto = np.concatenate([[0], np.cumsum(hit)])
            n_hit = upto[first[1:]] - upto[first[:-1]]
            spans: list[list[dict[str, int]]] = [[] for _ in range(batch.num_rows)]
            for doc in np.flatnonzero(n_hit).tolist():
                a, b = int(first[doc]), int(first[doc + 1])
                change = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
                spans[doc] = [{"start": int(starts[a + x] - offsets[doc]), "end": int(ends[a + y - 1] - offsets[doc])} for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True)]
            kept = batch.column("text").cast(pa.string()).to_pylist()
            for doc in np.flatnonzero(n_hit).tolist():
                raw, cuts = kept[doc].encode(), [0, *(x for s in spans[doc] for x in (s["start"], s["end"])), int(offsets[doc + 1] - offsets[doc])]
                kept[doc] = b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)).decode()
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            found = [pa.array(np.diff(first)), pa.array(n_hit), pa.array([sorted(items.get(i, ())) for i in range(batch.num_rows)], pa.list_(pa.string())), pa.array(spans, kind), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], [*keep, "n_words", "n_hit", "items", "spans", "kept_text"])

    kinds = dict(docs.dtypes)
    rows = docs.select(*(f"`{c}`" for c in keep if c != "text"), "text")
    return rows.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_words long, n_hit long, items array<string>, spans array<struct<start:long,end:long>>, kept_text string")
