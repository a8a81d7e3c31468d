"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm import codes, decontaminate, divergence, langid, licenses, maintext, maxent, minhash, packing, patched, repeats, warc, winnow
from loomtext.llm.base import small_batches


def tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = langid.fit(docs.filter(remainder("doc_id", 3) != 1))
    found = langid.predict(docs, prototypes)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patched.read_shards(spark, patched.write_shards(table(spark, sf_dir, "documents"), tokenizer(), end_id=0))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85, words=5)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.compare(table(spark, sf_dir, "documents"), k=5, window=12)
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        winnow.fingerprint(F.col("picked")).alias("fingerprint"), winnow.fingerprint(F.col("edited_picked")).alias("edited_fingerprint"), "near_edited", "near_next",
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=50, texts=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive(table(spark, sf_dir, "pages"), smallest=0)
    return warc.read_archives(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(), size=1024, end_id=2)


def op10_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"), held_out=remainder("doc_id", 7) == 2)


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(table(spark, sf_dir, "pages"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least=30, smooth=5, top=50)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def winnow_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op6 makes its edited fingerprints from."""
    return op6_winnowing(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def maxent_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10's model is held against."""
    return op10_maxent_scores(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_token_shards, op3_minhash, op4_decontamination, op5_license_scan, op6_winnowing, op7_suffix_dedup, op8_warc, op9_best_fit_packing, op10_maxent_scores, op11_main_text, op12_source_divergence, op13_vector_codes, winnow_edits, maxent_base_scores)}
