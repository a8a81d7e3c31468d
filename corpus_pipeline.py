"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of documents; where text changes, n_chars follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, langid, minhash, packing, queries, repeats
from loomtext.llm.base import small_batches, staged


def _plain(docs: DataFrame) -> DataFrame:
    """docs with names that no operator uses for its own columns, but for doc_id and text."""
    small_batches(docs.sparkSession)
    return docs.toDF(*(c if c in ("doc_id", "text") else f"column_{i}" for i, c in enumerate(docs.columns)))


def _restored(docs: DataFrame, plain: DataFrame, found: DataFrame, text: str) -> DataFrame:
    """The columns of docs out of found, with a new text and the n_chars it has."""
    changed = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return found.select(*(changed.get(c, F.col(p)).alias(c) for c, p in zip(docs.columns, plain.columns, strict=True)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language: prototypes come from all labelled texts; texts without a letter (`und`) go."""
    plain = _plain(docs)
    found = langid.predict(plain, langid.fit(docs.select("text", "lang")), keep=tuple(plain.columns))
    return found.filter("lang_pred <> 'und'").select(*(F.col(p).alias(c) for c, p in zip(docs.columns, plain.columns, strict=True)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group of near copies (five words, 0.8 or more); rows of one doc_id and text count once."""
    return minhash.without_near_duplicates(_plain(docs), percent=80, words=5).toDF(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of 50-byte strings that also start in a document with a smaller doc_id."""
    plain = _plain(docs)
    return _restored(docs, plain, repeats.remove_repeats(plain, length=50), "text")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that lie in benchmark windows."""
    plain = _plain(docs)
    return _restored(docs, plain, decontaminate.contamination(plain, queries.table(spark, sf_dir, "benchmark"), width=10, keep=tuple(plain.columns)), "kept_text")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of at most 1024 tokens."""
    small_batches(spark)
    return packing.pack(docs, queries.tokenizer(), size=1024, end_id=2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
#: no SQL expresses tokenizer ids and packing: tested against plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
