"""The corpus pipeline: every stage and the whole against plain Python on a small table with null and repeated ids, and edge tables."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.llm.test_operators import AZ, WORD4, linked
from tests.llm.test_tokens import crc

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
NO_ID = 1 << 62
STAGES = dict(corpus_pipeline.STAGES)


def rows_of_corpus() -> list[tuple]:
    rng = random.Random(12)
    words = ["".join(rng.choices("abcdehiklmnorstu", k=rng.randint(3, 9))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    base = [prose(rng.randint(30, 120)) for _ in range(14)]
    passage, leak = prose(40), prose(14)
    texts = [*base, *(t + " more" for t in base[:4]), f"{prose(20)} {passage} {prose(9)}", f"{prose(15)} {passage}", f"{prose(12)} {leak}. {prose(12)}", base[5], base[5], None, "", "  \n", "12 - 34", "ä ö", prose(4000), leak.upper()]
    ids = [*range(40, 40 + len(texts))]
    rng.shuffle(ids)
    for i in (2, 9, 15, 20):
        ids[i] = None
    ids[3] = ids[11]
    return [(i, t, rng.choice(["en", "de", None]), "s", len(t or "")) for i, t in zip(ids, texts, strict=True)], [(1, leak), (2, "two words"), (None, None)]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    folder, (rows, items) = tmp_path_factory.mktemp("corpus"), rows_of_corpus()
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    pq.write_table(pa.Table.from_pylist([dict(zip(COLUMNS, r, strict=True)) for r in rows], schema), folder / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([{"item_id": a, "text": b} for a, b in items], pa.schema([("item_id", pa.int64()), ("text", pa.string())])), folder / "benchmark.parquet")
    return str(folder), rows, items


def sorted_rows(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=str)


def plain_language(rows, _):
    return [r for r in rows if re.search(r"[^\W\d_]", r[1] or "")]


def plain_near(rows, _):
    groups, out = defaultdict(list), []
    for r, (i, n, component, group) in zip(rows, linked([r[:2] for r in rows], 80), strict=True):
        groups[group if n else (r[0], r[1])].append((i, r))
    for found in groups.values():
        least = min(i for i, _ in found)
        out.append([r for i, r in found if i == least])
    return out  # of each group the rows that may stay


def plain_repeats(rows, _):
    least, out = {}, []
    for r in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b, me = (r[1] or "").encode(), NO_ID if r[0] is None else r[0]
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least.setdefault(b[i : i + 50], me) < me:
                gone[i : i + 50] = b"\1" * 50
        text = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
        out.append((r[0], text, *r[2:4], len(text)))
    return out


def plain_leaks(rows, items):
    windows = set()
    for _, t in items:
        w = WORD4.findall((t or "").translate(AZ))
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    out = []
    for r in rows:
        found = list(WORD4.finditer((r[1] or "").translate(AZ)))
        w, hit = [m[0] for m in found], set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
        text, at = "", 0
        for k, m in enumerate(found):
            if k in hit and k - 1 not in hit:
                text += r[1][at : m.start()]
            if k in hit:
                at = m.end()
        text = None if r[1] is None else text + r[1][at:]
        out.append((r[0], text, *r[2:4], None if text is None else len(text)))
    return out


def check_packed(got, rows):
    from tokenizers import Tokenizer

    from loomtext.llm import queries

    library = Tokenizer.from_file(queries.tokenizer())
    want, pieces, sequences = defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)]
        want[r[0]] += [(i, a, b - a, crc(ids[a:b])) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    for r in got:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024


PLAIN = {"language_id": plain_language, "suffix_dedup": plain_repeats, "decontamination": plain_leaks}


@pytest.mark.parametrize("name", PLAIN)
def test_stage(spark, corpus, name):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = STAGES[name](spark, docs, folder)
    assert got.columns == COLUMNS and got.dtypes == docs.dtypes
    assert sorted_rows(got.collect()) == sorted_rows(PLAIN[name](rows, items))


def test_near_dedup_stage(spark, corpus):
    """One row of each group of different texts stays, and no row without a near copy goes, whatever ids it shares."""
    folder, rows, items = corpus
    got = [tuple(r) for r in STAGES["near_dedup"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()]
    groups = plain_near(rows, items)
    assert len(got) == len(groups)
    for may in groups:
        assert sum(r in may for r in got) >= 1


def test_whole_pipeline(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = [tuple(r) for r in STAGES["near_dedup"](spark, STAGES["language_id"](spark, docs, folder), folder).collect()]
    assert {r[1] for r in kept} <= {r[1] for r in plain_language(rows, items)} and len(kept) == len(plain_near(plain_language(rows, items), items))
    check_packed(corpus_pipeline.run(spark, folder).collect(), plain_leaks(plain_repeats(kept, items), items))


@pytest.mark.parametrize("name", STAGES)
def test_edge_tables(spark, corpus, name):
    """Empty tables, repeated rows, and extra columns with the names that operators use pass every stage."""
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert STAGES[name](spark, docs.limit(0), folder).count() == 0
    extra = docs.union(docs).toDF("doc_id", "text", "lang", "key", "n_bytes")
    for c in ("component", "score", "lang_pred", "n_words", "removed", "kept_text", "spans", "mark", "rank", "salt", "length"):
        extra = extra.withColumn(c, extra.n_bytes)
    got = STAGES[name](spark, extra.withColumn("n_chars", extra.n_bytes).withColumn("source", extra.key), folder)
    once = STAGES[name](spark, docs, folder).count()
    assert got.count() == (once if name == "near_dedup" else 2 * once)
    if name != "best_fit_packing":
        assert got.columns[:4] == ["doc_id", "text", "lang", "key"] and got.columns[-2:] == ["n_chars", "source"]
