"""Evidence: union, rerank by shared words, and the text that an answer is written from."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import fixed3, rstrip, strip, words

#: a reranker turns (question, text, score) columns into a new score
Reranker = Callable[[Column, Column, Column], Column]
#: a model scores lists of questions and texts, pair by pair
PairModel = Callable[[list[str], list[str]], list[float]]

log = logging.getLogger(__name__)

TITLE = "# Verified Context Blocks"


def evidence_union(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Vector hits, then facts: (query_id, branch, ctx_ord, id, text, source_type, score)."""
    return hits.withColumn("branch", F.lit(0)).unionByName(facts.withColumn("branch", F.lit(1)))


def lexical_overlap(question: Column, text: Column, score: Column) -> Column:
    """The score and a tenth for every distinct lower-cased word that question and text share."""
    return score + F.size(F.array_intersect(words(F.lower(question)), words(F.lower(text)))) * 0.1


def model_scores(question: Column, text: Column, make: Callable[[], PairModel]) -> Column:
    """Scores of a model that each task makes once; null for a batch of pairs that it fails on."""

    @F.pandas_udf("double")
    def told(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for questions, texts in batches:
            try:
                model = model or make()
                scores = pd.Series(model(questions.tolist(), texts.tolist()), dtype="float64")
                if len(scores) != len(texts):
                    raise ValueError(f"{len(scores)} scores for {len(texts)} pairs")
            except Exception:  # whatever the model raises, the former way stands in for it
                log.exception("the reranking model failed")
                scores = pd.Series([None] * len(texts), dtype="float64")
            yield scores

    return told(question, text)


def rerank(contexts: DataFrame, questions: DataFrame, k: int = 5, reranker: Reranker = lexical_overlap, make: Callable[[], PairModel] | None = None) -> DataFrame:
    """The k best contexts of each question (query_id, question) by the reranker's score, ties in their former order; rank from 1.

    With a model (make), its scores decide; a question with a context that the model gave no score goes by the reranker as a whole.
    """
    met = contexts.join(questions.select("query_id", "question"), "query_id")
    score = reranker(F.col("question"), F.col("text"), F.col("score"))
    if make is not None:
        met = met.withColumn("told", model_scores(F.col("question"), F.col("text"), make))
        score = F.when(F.count_if(F.col("told").isNull()).over(Window.partitionBy("query_id")) == 0, F.col("told")).otherwise(score)
    met = met.withColumn("score", score).drop("question", "told")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "branch", "ctx_ord")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def shortened(text: Column, max_chars: int = 1200) -> Column:
    return F.when(F.length(text) > max_chars, F.concat(rstrip(F.substr(text, F.lit(1), F.lit(max_chars))), F.lit("…"))).otherwise(text)


def display(text: Column, max_chars: int = 1500) -> Column:
    return F.when(F.length(text) > max_chars, F.concat(F.substr(text, F.lit(1), F.lit(max_chars)), F.lit("..."))).otherwise(text)


def synthesis_context(ranked: DataFrame, max_chars: int = 1200, title: str = TITLE) -> DataFrame:
    """(query_id, context): a title and a block for each ranked context (a handful for each question, as rerank leaves them)."""
    head = F.concat(F.lit("\n## ["), "id", F.lit("] (Source: "), "source_type", F.lit(" | Score="), fixed3(F.col("score")), F.lit(")\n"))
    block = F.concat(head, shortened(F.col("text"), max_chars), F.lit("\n"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda b: b["block"])
    return ranked.groupBy("query_id").agg(strip(F.concat_ws("\n", F.lit(title), blocks)).alias("context"))


def evidence_context(hits: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(query_id, context) of hits (query_id, rank, id, text, score), with an optional part of facts (query_id, facts_text)."""
    block = F.concat(F.lit("\n## Chunk "), F.col("id").cast("string"), F.lit(" (score="), fixed3(F.col("score")), F.lit(")\n"), "text", F.lit("\n"))
    blocks = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda b: b["block"])
    out = hits.groupBy("query_id").agg(blocks.alias("blocks"))
    out = out.withColumn("facts_text", F.lit(None).cast("string")) if facts is None else out.join(facts.select("query_id", "facts_text"), "query_id", "left")
    told = F.when(F.coalesce("facts_text", F.lit("")) != "", F.concat(F.lit("\n# Graph Facts\n"), "facts_text"))
    return out.select("query_id", strip(F.concat_ws("\n", F.lit("# Retrieved Evidence Chunks\n"), "blocks", told)).alias("context"))
