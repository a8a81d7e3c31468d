"""Keyword scores of chunks and the best of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.config import PRIORITY_KEYWORDS, Ranking


def chunk_score(text: Column, keywords: tuple[str, ...] = PRIORITY_KEYWORDS) -> Column:
    """How many of the keywords occur in the lower-cased text, and one more for a ##."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.contains(text, F.lit("##")).cast("int"))


def rank_chunks(chunks: DataFrame, top: int | None = None, keywords: tuple[str, ...] = PRIORITY_KEYWORDS) -> DataFrame:
    """chunks with score and chunk_rank (from 1, by score, then chunk_no) in each document; the `top` first if given."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "chunk_no")
    ranked = chunks.withColumn("score", chunk_score(F.col("text"), keywords)).withColumn("chunk_rank", F.row_number().over(order))
    return ranked if top is None else ranked.filter(F.col("chunk_rank") <= top)


def best_chunks(chunks: Column, how: Ranking = Ranking()) -> Column:
    """rank_chunks within a row: an array<struct<chunk_id, text>> in the order of rank, cut to both caps, without a shuffle."""
    keyed = F.transform(chunks, lambda c, i: F.struct((-chunk_score(c["text"], how.keywords)).alias("s"), i.alias("i"), c.alias("c")))
    return F.transform(F.slice(F.array_sort(keyed), 1, min(how.best, how.most)), lambda x: x["c"])
