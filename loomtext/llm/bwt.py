"""Burrows-Wheeler transforms of shards of short strings, merged by iterative interleave refinement."""

from __future__ import annotations

import numpy as np

STEP = 2  # bytes by which a round of refinement deepens the order; an odd depth takes a last round of one byte


def _shard_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix starts of a shard in the order of their first `depth` bytes or more, by doubling from words of eight bytes."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    step = 8
    while True:
        order = np.argsort(key, kind="stable")
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        if step >= depth or fresh[-1] == n - 1:
            return order
        rank = np.zeros(n + step, np.int64)
        rank[order] = fresh + 1
        key = rank[:n] * (n + 1) + rank[step : step + n]
        step *= 2


class Shards:
    """Strings, each closed by STEP zero bytes to a ring, in shards of at most `size` strings with their transforms.

    rows: the suffixes of all shards, each shard's in order, as places in text; symbol: the STEP bytes before each row's suffix;
    before: the row of the suffix that begins STEP bytes earlier; for one byte likewise.
    """

    def __init__(self, text: np.ndarray, lengths: np.ndarray, depth: int, size: int = 4096) -> None:
        rings = lengths + STEP
        ends = np.cumsum(rings)
        self.text = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        self.string = np.repeat(np.arange(len(lengths)), rings)
        self.offset = np.arange(len(self.text)) - (ends - rings)[self.string]
        self.text[self.offset < lengths[self.string]] = text
        earlier = np.arange(len(self.text)) - STEP + np.where(self.offset < STEP, rings[self.string], 0)
        later = np.where(self.offset[earlier] + 1 < rings[self.string], earlier + 1, earlier + 1 - rings[self.string])
        cuts = [0, *(int(ends[min(i + size, len(ends)) - 1]) for i in range(0, len(ends), size))]
        self.rows = np.concatenate([a + _shard_order(self.text[a:b], depth) for a, b in zip(cuts, cuts[1:], strict=False)]) if len(ends) else np.zeros(0, np.int64)
        row_of = np.empty(len(self.rows), np.int64)
        row_of[self.rows] = np.arange(len(self.rows))
        self.symbol = (self.text[earlier].astype(np.uint16) << 8 | self.text[later])[self.rows]
        self.before = row_of[earlier[self.rows]]
        self.one_symbol, self.one_before = self.text[later][self.rows], row_of[later[self.rows]]


def merged_intervals(shards: Shards, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of all shards interleaved, and where intervals of equal `depth`-byte prefixes begin among them (intervals of one row left out).

    The interleave starts as the shards one after another, in order to depth 0.  A round goes through it, reads the symbol before each row
    and puts the rows before them in the order of symbols, keeping what order there was: then it is in order STEP bytes deeper, and an
    interval ends where symbol or former interval change, which is where the common prefix is that short.  Rows alone in their interval
    are in place, and so is whatever precedes them, so they take no further part.  No suffixes are compared or sorted again.
    """
    rows = np.arange(len(shards.rows))
    interval = np.zeros(len(rows), np.int64)
    wide, narrow = (shards.symbol, shards.before), (shards.one_symbol, shards.one_before)
    for symbols, before in [wide] * (depth // STEP) + [narrow] * (depth % STEP):
        symbol = symbols[rows]
        order = np.argsort(symbol, kind="stable")
        symbol, interval = symbol[order], interval[order]
        rows = before[rows[order]]
        begins = np.ones(len(rows) + 1, bool)
        begins[1:-1] = (symbol[1:] != symbol[:-1]) | (interval[1:] != interval[:-1])
        shared = ~(begins[:-1] & begins[1:])
        rows, interval = rows[shared], np.cumsum(begins[:-1])[shared]
    return rows, np.flatnonzero(np.diff(interval, prepend=-1))
