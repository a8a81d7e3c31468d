"""Stages of the corpus pipeline against plain Python, with null and repeated ids."""

from __future__ import annotations

import random

import corpus_pipeline
from loomtext.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key int, rep int, component int"


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), n, n, n) for n, (i, t) in enumerate(rows)], SCHEMA)


def prose(seed: int, n: int = 60) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghiknorstu", k=rng.randint(2, 8))) for _ in range(n))


def order(row) -> tuple:
    return (row[0] is None, row[0] or 0, row[1] or "")


def test_near_dedup_ids(spark):
    """Different texts under one id or none all stay; one of each group of near copies does."""
    a, b, c, d, e = (prose(i) for i in range(5))
    rows = [(None, a), (None, b), (None, b + " more"), (None, c), (1, c + " end"), (5, d), (5, e), (5, e), (6, e + " x"), (7, d.upper()), (2, None), (2, ""), (2, ""), (None, " "), (None, "")]
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=order)
    assert out.columns == frame(spark, rows).columns
    one = [x for x in got if x[1] in (b, b + " more")]
    assert len(one) == 1 and one[0][0] is None
    want = [(None, a), (1, c + " end"), (5, d), (5, e), (2, None), (2, ""), (None, " "), (None, "")]
    assert sorted(map(str, got)) == sorted(map(str, [*want, *one]))


def test_minhash_links_of_texts_with_one_id(spark):
    """Each text under a shared id keeps its own links."""
    a, b = prose(11), prose(12)
    rows = [(None, a), (None, b), (8, a + " end"), (9, b + " end"), (3, a.replace(" ", "  ")), (4, prose(13)), (4, b + " fin")]
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(frame(spark, rows)).collect())
    assert got == sorted([("None", 56, 3, False), ("None", 56, 4, False), ("8", 57, 3, False), ("9", 57, 4, False), ("3", 56, 3, True), ("4", 56, 4, True), ("4", 57, 4, True)])


def test_rows_that_differ_elsewhere(spark):
    """Of rows with one doc_id and text the one stays whose other columns come first, however they are dealt."""
    rows = [(1, prose(20), lang, n) for lang, n in (("fr", 2), ("en", 9), ("en", 10), (None, 1))] + [(2, None, "x", 5), (2, None, "x", 4), (2, None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")
    for deal in (1, 3, 7):
        out = sorted(((r["doc_id"], r["lang"], r["n"]) for r in minhash.without_near_duplicates(docs.repartition(deal)).collect()))
        assert out == [(1, "en", 10), (2, "x", 4)]
