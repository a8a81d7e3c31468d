"""Cleaning, chunking and ranking: worked examples and plain-Python versions of the folds."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

import __spark_entry__
from loomtext.config import Chunking, Cleaning
from loomtext.functions import text as T
from loomtext.operators import chunk, clean, rank


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_clean(spark):
    assert one(spark, "infor-\nmation [1, 2] (2019) • x", clean.clean_text) == "information x"
    assert one(spark, "x\n--- Page 2 ---\ny", clean.clean_text) == "x\n Page 2 \ny"
    assert one(spark, None, clean.clean_text) == ""
    assert one(spark, "a\0b\r\nﬁ \\[x\n\\] $y$", lambda c: clean.clean_text(c, Cleaning().also("display_latex", "inline_latex"))) == "ab\nfi"
    assert one(spark, "A\n2. References\nB", clean.cut_at_stop_heading) == "A"
    once = one(spark, "The Transformer and LLMs", clean.expand_synonyms)
    assert once == "The Transformer Architecture and Large Language Models"
    assert one(spark, once, clean.expand_synonyms) == "The Transformer Architecture Architecture and Large Language Models"


def test_expansions_in_one_pass(spark):
    """One search gives what nine replacements one after another give, also for signs that fold to letters and for expansions of expansions."""
    rng = random.Random(7)
    pieces = ["llm", "LLMs", "\u212ag", "kgs", "llm\u017f", "transformer", "Transformer Architecture", "cnn", "-", " ", "_", "x", ".", "\n", "$1", "\\", "\ufdd0", "é", "gnn2"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 12))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for expansions in (Cleaning().expansions, {"abc": "kg and x", "kg": "cnn", "cnn": "deep $1 net", "x": "llm"}, {"llm": "-kg", "kg": "c d", "x y": "z"}, {}):
        how = Cleaning(expansions=expansions)
        ordered = sorted(expansions.items(), key=lambda kv: len(kv[0]), reverse=True)
        assert (clean.closed_expansions(ordered) is None) == ("x y" in expansions)
        rows = df.select("t", clean.expand_synonyms(F.col("t"), how).alias("a"), clean._one_after_another(F.col("t"), ordered).alias("b")).collect()
        assert all(r["a"] == r["b"] for r in rows), next((r for r in rows if r["a"] != r["b"]), None)


def test_strip_is_pythons(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices(" \t\n\x0b\x1c\x1f\x85\xa0\u2003\u3000ab\u200b", k=6)) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s"), T.words(F.col("t")).alias("w")).collect()
    assert all(r["s"] == r["t"].strip() and r["w"] == r["t"].split() for r in rows)


def test_chunkers(spark):
    assert one(spark, "\n\n".join(["x" * 100] * 3), chunk.paragraphs) == ["\n\n".join(["x" * 100] * 3)]
    long = "".join(chr(97 + i % 26) for i in range(5000))
    assert one(spark, long, lambda c: chunk.section_chunks(c, 2600, 900)) == [long, long[-900:]]
    assert [len(x) for x in one(spark, long[:3000], lambda c: chunk.sliding_chunks(c, 2400, 700, 40))] == [2400, 2300, 1600, 900, 200]
    got = one(spark, "Introduction\n\nfoo\n\nReferences\n\nbar", chunk.custom_chunks)
    assert [tuple(r) for r in got] == [("00001|p1|Introduction", "foo")]
    for empty in ("", " \n "):
        for strategy in ("semantic", "custom", "sections", "sliding", "pages", "other", ""):
            assert one(spark, empty, lambda c, s=strategy: chunk.chunks_by_strategy(c, Chunking(s))) == []


def windows(paras: list[str], target: int, overlap: int) -> list[str]:
    """Word windows, by another road: indices of the pending paragraphs."""
    out, begin, pending = [], 0, []
    size = [len(p.split()) for p in paras]
    for i, p in enumerate(paras):
        if size[i] > 1.5 * target:
            ws = p.split()
            out += [" ".join(ws[k : k + target]) for k in range(0, len(ws), max(1, target - overlap))]
            continue
        if pending and sum(size[k] for k in pending) + size[i] > target:
            out.append("\n\n".join(paras[k] for k in pending))
            begin = len(pending) - 1
            while begin > 0 and sum(size[k] for k in pending[begin - 1 :]) <= overlap:
                begin -= 1
            pending = pending[begin:] if overlap > 0 else []
        pending.append(i)
    return [*out, "\n\n".join(paras[k] for k in pending)] if pending else out


def test_word_windows(spark):
    rng = random.Random(2)
    texts = [[" ".join(rng.choices(["a", "bb", "ccc"], k=rng.choice([1, 3, 8, 20, 40]))) for _ in range(rng.randint(1, 12))] for _ in range(40)]
    rows = spark.createDataFrame([("\n\n".join(p),) for p in texts], "t string").select("t", chunk.word_windows(F.col("t"), 20, 5).alias("w"), chunk.word_windows(F.col("t"), 20, 0).alias("n")).collect()
    for r in rows:
        paras = re.split(r"\n\n", r["t"])
        assert r["w"] == windows(paras, 20, 5) and r["n"] == windows(paras, 20, 0)


def test_rank(spark):
    rows = [(1, 0, "0", "nothing"), (1, 1, "1", "method model ##"), (1, 2, "2", "F1"), (1, 3, "3", "bleu")]
    ranked = rank.rank_chunks(spark.createDataFrame(rows, "doc_id long, chunk_no int, chunk_id string, text string"), 3)
    assert [(r["chunk_no"], r["score"]) for r in ranked.orderBy("chunk_rank").collect()] == [(1, 3), (2, 1), (3, 1)]
    assert one(spark, "a\u2014b", T.canonical_key) == "a-b" and one(spark, "The (A) ﬁne", T.canonical_key) == "fine"


def test_texts_go_to_python_in_small_batches(spark):
    """The normal form of long texts is made from a few megabytes at a time, whatever the number of rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key)
        rows = clean.preprocess(spark.range(3).select(F.col("id").alias("doc_id"), F.lit("\ufb01ne").alias("text")))
        assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20 and {r["text"] for r in rows.collect()} == {"fine"}
        spark.conf.unset(key)
        __spark_entry__.queries()["clean_nfkc"](spark, "/root/testdata/sf0.001")
        assert int(spark.conf.get(key).rstrip("b")) <= 4 << 20
    finally:
        spark.conf.set(key, before)


def test_blanks_are_those_of_patterns(spark):
    """Ends are trimmed of the characters that \\s takes in patterns, and of no others."""
    every = spark.range(1, 0xFFFF).filter("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    assert every.filter((T.strip(F.col("c")) == "") != F.col("c").rlike(T.rx(r"^\s$"))).count() == 0
    assert one(spark, "　\x1fa \xa0b\n\x85", T.strip) == "a \xa0b" and one(spark, " a  ", T.rstrip) == " a"


def test_strategies_share_what_they_make(spark, sf):
    """Chunks of several strategies at once are those of each alone, and the query reads and chunks each text once for all of them."""
    text = "--- Page 1 ---\n" + "Abstract\n" + "some words of it. " * 200 + "\n--- Page 2 ---\nResults\n" + "more words. " * 300
    names = ("sections", "pages", "Sliding ", "all", "semantic", "custom", " ")
    docs = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    made = docs.select("doc_id", chunk.chunks_by_strategies(F.col("text"), names).alias("by")).collect()
    for name in names:
        alone = {r["doc_id"]: r["c"] for r in docs.select("doc_id", chunk.chunks_by_strategy(F.col("text"), Chunking(name)).alias("c")).collect()}
        assert alone[1] and {r["doc_id"]: next(b["chunks"] for b in r["by"] if b["strategy"] == name) for r in made} == alone
    plan = __spark_entry__.queries()["chunk_strategies"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
