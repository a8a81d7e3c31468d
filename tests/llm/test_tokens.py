"""Ops 2 and 9 against plain use of the tokenizers library, and 8 against hashlib; edge rows for each."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import defaultdict
from functools import cache
from itertools import combinations, islice

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomtext.llm import packing, patched, queries, warc
from loomtext.llm.tokens import Encoder

EDGE = [(5, None, "a"), (3, "", "b"), (3, "", "b"), (9, "one two  three\n\n x's  ", "c"), (1, "Größe – naïve 漢字 <|endoftext|> \x1c\xa0!", "d"), (2, "x" * 5000 + " word" * 3000, "e"), (None, "no id", "f")]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(max_size=60) | st.just("a <|endoftext|> b<|endoftext|"), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoder_is_the_library(library, texts):
    for words in (3, 1000):
        assert [x.tolist() for x in Encoder(queries.tokenizer(), words)(texts)] == [library(t) for t in texts]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=600), st.sampled_from([0.0, 0.5, 0.9, 1.0]))
@settings(max_examples=100, deadline=None)
def test_blocks_round_trip(ids, percentile):
    raw = patched.to_shard([7, None], [np.array(ids, np.uint32), np.array([0], np.uint32)], percentile)
    doc_ids, missing, lengths, out = patched.from_shard(raw)
    assert missing.tolist() == [False, True] and lengths.tolist() == [len(ids), 1] and out.tolist() == [*ids, 0]


def expected_shards(rows, library):
    start, out = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library(text), 0]
        out.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


def test_shards(spark, sf, library):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = [tuple(r) for r in queries.op2_token_shards(spark, sf).collect()]
    assert sorted(got) == expected_shards(rows, library)


def test_shard_edges(spark, library):
    docs = spark.createDataFrame([(a, b, c, 1) for a, b, c in EDGE], "doc_id long, text string, shard string, n_tokens int")
    for ids in (1, 40, 1 << 20):
        got = [tuple(r) for r in patched.read_shards(spark, patched.write_shards(docs, queries.tokenizer(), shard_ids=ids)).collect()]
        assert sorted(got, key=lambda r: r[1]) == expected_shards([(a, b) for a, b, _ in EDGE], library)
    assert patched.read_shards(spark, patched.write_shards(docs.limit(0), queries.tokenizer())).count() == 0


def check_packing(got, rows, library, size):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    want = defaultdict(list)
    for doc_id, text in rows:
        want[doc_id].append([*library(text), 2])
    assert by_doc.keys() == want.keys()
    for doc_id, found in by_doc.items():
        ids = want[doc_id][0]
        found = [r for r in found if r["piece"] is not None]
        copies = len(want[doc_id])
        assert sorted({r["piece"] for r in found}) == list(range(len(found) // copies))
        for r in found:
            assert r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
            assert r["length"] == size or r["piece"] == 0
        assert sum(r["length"] for r in found) == sum(map(len, want[doc_id]))
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(by_sequence)


def test_packing(spark, sf, library):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()]
    got = queries.op9_best_fit_packing(spark, sf).collect()
    assert check_packing(got, rows, library, 1024) <= 1 + -(-sum(len(library(t)) + 1 for _, t in rows) // 1024)


def test_packing_edges(spark, library):
    docs = spark.createDataFrame([(a, b, c, 1) for a, b, c in EDGE], "doc_id long, text string, piece string, salt int")
    check_packing(packing.pack(docs, queries.tokenizer(), size=64).collect(), [(a, b) for a, b, _ in EDGE], library, 64)
    assert packing.pack(docs.limit(0), queries.tokenizer()).count() == 0


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 9), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plan_uses_every_piece_once(histogram):
    used = defaultdict(int)
    for times, filling in packing.plan(histogram, 50):
        assert times > 0 and sum(k * n for k, n in filling) <= 50
        for k, n in filling:
            used[k] += times * n
    assert used == histogram


def test_plan_finds_the_exact_fillings():
    assert sum(n for n, _ in packing.plan({6: 4, 4: 4, 5: 4, 3: 2, 2: 2}, 10)) == 7


def fewest(pieces: tuple[int, ...], size: int) -> int:
    """The least number of sequences, by trying every place of every piece."""
    best = len(pieces)

    def put(i: int, rooms: list[int]) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(pieces):
            best = len(rooms)
            return
        for j in range(len(rooms)):
            if rooms[j] >= pieces[i] and rooms[j] not in rooms[:j]:
                put(i + 1, [*rooms[:j], rooms[j] - pieces[i], *rooms[j + 1 :]])
        put(i + 1, [*rooms, size - pieces[i]])

    put(0, [])
    return best


@given(st.lists(st.integers(1, 40), max_size=9).map(lambda x: tuple(sorted(x, reverse=True))), st.integers(40, 60))
@settings(max_examples=150, deadline=None)
def test_plan_against_the_exact_least(pieces, size):
    histogram = {k: pieces.count(k) for k in set(pieces)}
    want = fewest(pieces, size)
    assert sum(n for n, _ in packing.plan(histogram, size)) == want
    counts = np.bincount(pieces, minlength=size + 1) if pieces else np.zeros(size + 1, np.int64)
    assert packing.least_sequences(counts) <= want <= sum(n for n, _ in packing.best_fit(counts))


def fewest_of_counts(histogram: dict[int, int], size: int) -> int:
    """The least number of sequences of a table of counts, by every filling around the longest piece left."""
    lengths = sorted(histogram, reverse=True)

    @cache
    def least(counts: tuple[int, ...]) -> int:
        if not any(counts):
            return 0
        first = next(i for i, n in enumerate(counts) if n)
        found = []

        def fill(i: int, room: int, left: tuple[int, ...]) -> None:
            if i == len(lengths):
                found.append(1 + least(left))
                return
            for n in range(min(left[i], room // lengths[i]) + 1):
                fill(i + 1, room - n * lengths[i], (*left[:i], left[i] - n, *left[i + 1 :]))

        fill(0, size - lengths[first], (*counts[:first], counts[first] - 1, *counts[first + 1 :]))
        return min(found)

    return least(tuple(histogram[x] for x in lengths))


def test_plan_takes_a_filling_fewer_times_than_it_could():
    assert sum(n for n, _ in packing.plan({35: 5, 25: 6, 21: 5, 19: 5, 14: 5}, 69, effort=None)) == 9


@given(st.integers(30, 80).flatmap(lambda size: st.tuples(st.just(size), st.dictionaries(st.integers(3, size // 2 + 4), st.integers(1, 3), min_size=1, max_size=5))))
@settings(max_examples=200, deadline=None)
def test_plan_of_counts_against_the_exact_least(case):
    size, histogram = case
    want = fewest_of_counts(histogram, size)
    assert sum(n for n, _ in packing.plan(histogram, size, effort=None)) == want == sum(n for n, _ in packing.plan(histogram, size))


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(60, 100))
@settings(max_examples=200, deadline=None)
def test_best_fit_is_piece_by_piece(pieces, size):
    """Groups of like sequences give what best fit decreasing gives for one piece after another."""
    rooms: list[int] = []
    for x in sorted(pieces, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= x]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= x
        else:
            rooms.append(size - x)
    got = packing.best_fit(np.bincount(pieces, minlength=size + 1) if pieces else np.zeros(size + 1, np.int64))
    assert sorted(r for n, f in got for r in [size - sum(k * m for k, m in f)] * n) == sorted(rooms)


@given(st.integers(5, 40), st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=6))
@settings(max_examples=200, deadline=None)
def test_dominated_fillings(room, there):
    """A filling is dominated if any of its pieces, or none, can be swapped for one piece left over that is as long as they or longer."""
    spare = np.zeros(61, np.int64)
    for x, n in there.items():
        spare[x] = n
    for filling in islice(packing.fillings(room, spare), 8):
        pieces = [x for x, n in filling for _ in range(n)]
        over = [x for x, n in there.items() if n > dict(filling).get(x, 0)]
        swaps = [(sum(some), x) for k in range(len(pieces) + 1) for some in combinations(pieces, k) for x in over if not (k == 1 and some[0] == x)]
        assert packing.dominated(filling, spare, room) == any(t <= x and sum(pieces) - t + x <= room for t, x in swaps)


@given(st.integers(1, 16_384), st.randoms(use_true_random=False))
@settings(max_examples=15, deadline=None)
def test_plan_of_any_size(size, rng):
    histogram = {rng.randint(1, size): rng.randint(1, 1000) for _ in range(40)}
    used = defaultdict(int)
    for times, filling in packing.plan(histogram, size, effort=50):
        assert sum(k * n for k, n in filling) <= size
        for k, n in filling:
            used[k] += times * n
    assert used == histogram
    assert packing.plan({k: 1 for k in range(1, 8193, 6)}, 8192, effort=1)


def expected_pages(rows):
    first = {}
    for page_id, html in rows:
        first[html or ""] = min(first.get(html or "", float("inf")), float("inf") if page_id is None else page_id)
    out = []
    for page_id, html in rows:
        payload, best = (html or "").encode(), first[html or ""]
        revisit = best != float("inf") and best != page_id
        out.append((page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", best if revisit else None))
    return sorted(out, key=str)


def test_warc(spark, sf):
    rows = [(r["page_id"], r["html"]) for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()]
    assert sorted((tuple(r) for r in queries.op8_warc(spark, sf).collect()), key=str) == expected_pages(rows)


def test_warc_edges(spark):
    rows = [(4, "u\r\nWARC/1.1", "<p>ä\r\n\r\n</p>", 1), (2, None, "<p>ä\r\n\r\n</p>", 1), (2, None, "<p>ä\r\n\r\n</p>", 1), (7, "v", None, 1), (8, "v", "", 1), (None, "v", "only", 1), (None, "v", "<p>ä\r\n\r\n</p>", 1), (9, "w", "long " * 100000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha int")
    got = warc.read_archives(spark, warc.archive(pages)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == expected_pages([(a, c) for a, _, c, _ in rows])
    assert sorted(r["payload"].decode() for r in got if r["payload"]) == ["<p>ä\r\n\r\n</p>"] * 2 + ["long " * 100000, "only"]
    assert sorted(r["url"] for r in got) == sorted(u or "" for _, u, _, _ in rows)
    assert warc.read_archives(spark, warc.archive(pages.limit(0))).count() == 0
    small = warc.read_archives(spark, warc.archive(pages, smallest=100)).filter("record_type = 'revisit'").count()
    assert small == 0
