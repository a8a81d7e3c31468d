"""Vector codes against plain Lloyd rounds in Python integers, on ties, repeated rows, one hot label and rows without a code."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from loomtext.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error long"


def brute(rows: list[tuple], parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> list[tuple]:
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, v, label, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    kept = [r for r in kept if len(r[2]) == len(kept[0][2])]
    width = len(kept[0][2]) // parts if kept else 0
    cut = [[r[2][p * width : (p + 1) * width] for p in range(parts)] for r in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda p, v: min((distance(v, b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        found = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            members = defaultdict(list)
            for c, f in zip(cut, found, strict=True):
                members[f[p]].append(c[p])
            books[p] = [[sum(x) // len(members[e]) for x in zip(*members[e], strict=True)] if e in members else b for e, b in enumerate(books[p])]
    last = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for d, _ in f) for f in last]
    of_label = defaultdict(int)
    for r, e in zip(kept, errors, strict=True):
        of_label[r[1]] += e
    sha = hashlib.sha256(",".join(str(v) for b in books for x in b for v in x).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in f), d, of_label[r[1]], sha) for r, f, d in zip(kept, last, errors, strict=True)), key=str)


def vectors(n: int, size: int, seed: int = 2) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(20)]
    rows = []
    for i in range(n):
        v = [c + rng.gauss(0, 0.15) for c in rng.choice(centres)]
        rows.append((i, [float(np.float32(x)) for x in v], rng.choice([1, 1, 1, 2, None]), "c", 9))
    return rows


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("n", "size", "entries"), [(700, 16, 256), (600, 8, 5), (400, 4, 1), (90, 8, 256)])
def test_against_plain_rounds(spark, n, size, entries, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 128)
    rows = vectors(n, size)
    random.Random(1).shuffle(rows)
    assert found(codes.codes(spark.createDataFrame(rows, SCHEMA).repartition(3), entries=entries)) == brute(rows, entries=entries)


def test_ties_repeats_and_rows_without_code(spark):
    v = lambda *x: [float(a) for a in x]
    rows = [(i % 7, v(i % 3, -(i % 2), 0, i % 5), 1) for i in range(60)] + [(3, v(1, 1, 1, 1), 1)] * 5 + [(None, v(9, 9, 9, 9), None), (None, v(-9.0005, 9, 9, 9), None)]
    rows += [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, v(1, "nan", 1, 1), 2), (103, v(1, 1, "-inf", 1), 2), (104, [], 2), (105, v(1, 2), 2), (-5, None, None)]
    full = [(*r, "x", None) for r in rows]
    got = codes.codes(spark.createDataFrame(full, SCHEMA).repartition(2), entries=6)
    assert found(got) == brute(full, entries=6)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_empty_and_impossible(spark):
    assert codes.codes(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        codes.codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, "", 1)], SCHEMA))


def test_heaps_scan_only_what_may_move():
    rng = np.random.default_rng(4)
    centres = rng.integers(-2000, 2000, (40, 8))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 8))).astype(np.int64)
    book, drift, heaps, scanned = x[:40].copy(), np.zeros(40), codes.Heaps.new(3000, 40), []
    for _ in range(6):
        rows, _ = heaps.turn(x, book, drift)
        scanned.append(len(rows))
        entry, first, _ = codes.exact_scan(x, book)
        assert (heaps.entry == entry).all()
        assert sorted(heaps.rows.tolist()) == list(range(3000))  # each part is in one heap, of its entry
        assert (heaps.entry[heaps.rows] == np.repeat(np.arange(40), heaps.sizes)).all()
        new = np.array([x[entry == e].sum(axis=0) // max(1, (entry == e).sum()) if (entry == e).any() else book[e] for e in range(40)])
        drift, book = drift + codes.moved(book, new), new
        heaps, _ = codes.Heaps.from_bytes(heaps.to_bytes(), 0)
    assert scanned[0] == 3000
    assert scanned[-1] < 1000


def test_scan_beyond_what_floats_hold():
    x = np.array([[2**27, 1], [2**27, 3], [0, 0]], np.int64)
    entry, first, second = codes.exact_scan(x, np.array([[2**27, 2], [2**27, 0], [2**27, 4]], np.int64))
    assert entry.tolist() == [0, 0, 1] and first.tolist() == [1, 1, 2**54] and second.tolist() == [1, 1, 2**54 + 4]
