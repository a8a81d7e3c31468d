"""Language identification with hyperdimensional n-gram profiles.

Letters have fixed random vectors of +1 and -1.  The vector of a trigram is its letters' vectors, each rotated by its distance from the
end, multiplied together; a text's vector is the sum over its trigrams, a language's prototype the sum over all its training texts.  The
language of a text is the prototype with the largest cosine, its score that cosine cut to 0 to 1.

Letters are lower-cased; every letter of any script has a vector of its own, drawn from its code point, and everything else is a word's
border.  A null text or one without letters is `und` with score 0, as is every text when nothing could be learned.  Ties go to the first
language in alphabetical order.  Rows are independent (repeated rows repeat); other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomtext.llm.base import byte_view, sliced

COMMON, DIM = 64, 1024  # letters whose trigrams' vectors are kept; those of others are made when they are met
BLOCK = 2048  # vectors that are added at once
SLICE = 1 << 20  # bytes of text at a time, unless one text is longer


class Space:
    """Vectors of letters and, of the letters met first, of trigrams; no vector depends on data."""

    def __init__(self, dim: int = DIM, seed: int = 5) -> None:
        self.dim, self.seed = dim, seed
        self.symbol = np.full(0x110000, -1, np.int32)  # -1: not met; 0: a border
        self.letters = np.ones((1, dim), np.int8)
        self._meet(np.arange(97, 123))
        self.place = np.full(COMMON**3, -1, np.int32)
        self.vectors = np.zeros((1024, dim), np.int8)
        self.known = 0

    def _meet(self, points: np.ndarray) -> None:
        new = [c for c in points.tolist() if chr(c).isalpha()]
        self.symbol[points] = 0
        self.symbol[new] = len(self.letters) + np.arange(len(new))
        drawn = [np.random.default_rng([self.seed, c]).choice(np.array([-1, 1], np.int8), self.dim) for c in new]
        self.letters = np.concatenate([self.letters, *(x[None] for x in drawn)])

    def trigrams(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each trigram (one around every letter) its letters as a key and its row in `vectors`, -1 for those that aren't kept; and for
        each text where its trigrams begin (len + 1 values)."""
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        where = begins + np.arange(len(begins))  # with a border before each text and at the end
        found = self.symbol[points]
        if len(found) and found.min() < 0:
            self._meet(np.unique(points[found < 0]))
            found = self.symbol[points]
        symbols = np.zeros(len(points) + len(begins), np.int32)
        inside = np.ones(len(symbols), bool)
        inside[where] = False
        symbols[inside] = found
        middle = np.flatnonzero(symbols)
        a, b, c = symbols[middle - 1], symbols[middle], symbols[middle + 1]
        common = (a * COMMON + b) * COMMON + c
        keys = common
        if len(self.letters) > COMMON:
            other = (a >= COMMON) | (b >= COMMON) | (c >= COMMON)
            keys = np.where(other, (a.astype(np.int64) << 42) + (b.astype(np.int64) << 21) + c + COMMON**3, common)
            common = np.where(other, 0, common)
        else:
            other = np.zeros(len(keys), bool)
        rows = self.place[common]
        if (fresh := (rows < 0) & ~other).any():
            self._add(np.unique(common[fresh]))
            rows = self.place[common]
        rows[other] = -1
        return keys, rows, np.searchsorted(middle, where)

    def _bound(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.roll(self.letters[a], 2, axis=1) * np.roll(self.letters[b], 1, axis=1) * self.letters[c]

    def _add(self, keys: np.ndarray) -> None:
        end = self.known + len(keys)
        if end > len(self.vectors):
            self.vectors.resize((max(end, len(self.vectors) * 3 // 2), self.vectors.shape[1]), refcheck=False)
        a, rest = np.divmod(keys, COMMON * COMMON)
        for i in range(0, len(keys), BLOCK):
            self.vectors[self.known + i : min(self.known + i + BLOCK, end)] = self._bound(a[i : i + BLOCK], *np.divmod(rest[i : i + BLOCK], COMMON))
        self.place[keys] = np.arange(self.known, end)
        self.known = end

    def bundle(self, rows: np.ndarray, times: np.ndarray, kind: type) -> np.ndarray:
        """The sum of kept vectors, each so many times, a block of rows at a time."""
        total = np.zeros(self.dim, kind)
        for i in range(0, len(rows), BLOCK):
            total += times[i : i + BLOCK].astype(kind) @ self.vectors[rows[i : i + BLOCK]].astype(kind)
        return total

    def bundle_keys(self, keys: np.ndarray, kind: type) -> np.ndarray:
        """The sum of the vectors of trigrams that aren't kept."""
        total = np.zeros(self.dim, kind)
        keys, times = np.unique(keys - COMMON**3, return_counts=True)
        for i in range(0, len(keys), BLOCK):
            x = keys[i : i + BLOCK]
            total += times[i : i + BLOCK].astype(kind) @ self._bound(x >> 42, x >> 21 & ((1 << 21) - 1), x & ((1 << 21) - 1)).astype(kind)
        return total


_SPACE: list[Space] = []


def space() -> Space:
    if not _SPACE:
        _SPACE.append(Space())
    return _SPACE[0]


def _lowered(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    return byte_view(pc.utf8_lower(batch.column(name).fill_null("")))


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes by language of all rows (text, lang) with a language; a vector each, whatever the number of rows."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, counts, others = space(), {}, {}
        for batch in sliced(batches, limit=SLICE):
            keys, rows, begins = here.trigrams(*_lowered(batch))
            langs = batch.column("lang").to_pylist()
            for lang in set(langs):
                mine = np.repeat(np.array([x == lang for x in langs]), np.diff(begins))
                if (rare := mine & (rows < 0)).any():
                    others[lang] = others.get(lang, 0) + here.bundle_keys(keys[rare], np.float64)
                found = np.bincount(rows[mine & (rows >= 0)], minlength=here.known)
                found[: len(counts.get(lang, ()))] += counts.get(lang, np.zeros(0, np.int64))
                counts[lang] = found
        part = TaskContext.get().partitionId()
        for lang, n in counts.items():
            vector = here.bundle(np.arange(len(n)), n, np.float64) + others.get(lang, 0)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "part": pa.array([part % 64], pa.int32()), "vector": [vector.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v, np.float64) for v in table.column("vector").to_pylist())
        return pa.table({"lang": table.column("lang")[:1], "part": pa.array([0], pa.int32()), "vector": [total.tobytes()]})

    kind = "lang string, part int, vector binary"
    sums = labelled.select("text", "lang").filter("lang is not null").mapInArrow(bundle, kind)
    sums = sums.groupBy("lang", "part").applyInArrow(add, kind).groupBy("lang").applyInArrow(add, kind)
    return {r["lang"]: np.frombuffer(r["vector"], np.float64) for r in sums.collect()}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, then lang_pred and score, for every row."""
    langs = sorted(x for x, v in prototypes.items() if np.linalg.norm(v))
    units = np.array([prototypes[x] / np.linalg.norm(prototypes[x]) for x in langs], np.float32).reshape(len(langs), DIM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = space()
        for batch in sliced(batches, limit=SLICE):
            keys, rows, begins = here.trigrams(*_lowered(batch))
            rare = len(rows) and rows.min() < 0
            vectors = np.zeros((batch.num_rows, DIM), np.float32)
            for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                if b > a:
                    mine = rows[a:b]
                    if rare and mine.min() < 0:
                        vectors[i] = here.bundle_keys(keys[a:b][mine < 0], np.float32)
                        mine = mine[mine >= 0]
                    counts = np.bincount(mine)
                    have = np.flatnonzero(counts)
                    vectors[i] += here.bundle(have, counts[have], np.float32)
            norms = np.linalg.norm(vectors, axis=1)
            cosines = vectors @ units.T / np.maximum(norms, 1e-30)[:, None] if langs else np.zeros((batch.num_rows, 1), np.float32)
            best = cosines.argmax(axis=1)
            known = (norms > 0) & bool(langs)
            names = [langs[j] if k else "und" for j, k in zip(best.tolist(), known.tolist(), strict=True)]
            score = np.where(known, np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    inner = docs.select(*(f"`{c}`" for c in keep if c != "text"), "text")
    return inner.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"]))
