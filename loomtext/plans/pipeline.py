"""From documents to a graph and a vector index, and from questions to contexts, as one lineage each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.config import Asking, Calling, Chunking, Cleaning, Ranking
from loomtext.functions.text import hash_embedding
from loomtext.operators import chunk, clean, extract, graph, rank, retrieve, vector


@dataclass(frozen=True)
class Knowledge:
    """chunks (doc_id, chunk_rank, chunk_id, text, emb), nodes and edges."""

    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame


def prepared_chunks(docs: DataFrame, chunking: Chunking = Chunking(), ranking: Ranking = Ranking(), cleaning: Cleaning = Cleaning()) -> DataFrame:
    """(doc_id, chunk_rank from 1, chunk_id, text) of the best chunks: cleaning, chunking and both caps in one pass, without a shuffle."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if not chunking.before_cleaning:
        text = clean.preprocess(text, cleaning)
    best = rank.best_chunks(chunk.chunks_by_strategy(F.col("text"), chunking, ranking.most), ranking)
    rows = text.filter("text <> ''").select("doc_id", F.posexplode(best).alias("i", "c"))
    rows = rows.select("doc_id", (F.col("i") + 1).alias("chunk_rank"), "c.chunk_id", "c.text")
    return clean.preprocess(rows, cleaning) if chunking.before_cleaning else rows


def graph_of(parsed: DataFrame, distinct_edges: bool = False, kept: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed answers (doc_id, chunk_rank, parsed); `kept` may write a table under a name and read it back, as each is read several times."""
    parsed = kept(parsed, "parsed")
    entities, relations = graph.clean_entities_relations(extract.entities_of(parsed), extract.relations_of(parsed))
    relations = kept(relations, "relations")
    nodes = kept(graph.build_nodes(entities, relations), "nodes")
    return nodes, kept(graph.build_edges(relations, nodes, distinct_edges), "edges")


def build(
    docs: DataFrame, make: Callable[[], extract.Extractor], folder: str, chunking: Chunking = Chunking(), ranking: Ranking = Ranking(), calling: Calling = Calling(),
    cleaning: Cleaning = Cleaning(), embedder: vector.Embedder = hash_embedding, distinct_edges: bool = False,
) -> Knowledge:
    """The knowledge of all documents; chunks, parsed answers and the graph are written below folder, as several branches read them, and the model's answers stored there."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    chunks = kept(vector.embed(prepared_chunks(docs, chunking, ranking, cleaning), embedder), "chunks")
    raw = extract.responses(chunks.drop("emb"), make, calling, f"{folder}/answers")
    nodes, edges = graph_of(raw.select("doc_id", "chunk_rank", extract.parse_strict(F.col("raw")).alias("parsed")), distinct_edges, kept)
    return Knowledge(chunks, nodes, edges)


def ask(
    questions: DataFrame, known: Knowledge, how: Asking = Asking(), embedder: vector.Embedder = hash_embedding, reranker: retrieve.Reranker = retrieve.lexical_overlap,
    rerank_model: Callable[[], retrieve.PairModel] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Ranked evidence and the context of each question (query_id, question): vector hits and facts around the question's terms."""
    items = known.chunks.select(F.concat_ws("/", "doc_id", "chunk_id").alias("id"), "text", "emb")
    hits = vector.search_many(items, questions.select("query_id", embedder(F.col("question")).alias("emb")), how.hits)
    facts = graph.k_hop_facts(known.edges, graph.seed_match(known.nodes, questions), how.hops, how.facts)
    contexts = retrieve.evidence_union(vector.as_contexts(hits), graph.facts_as_contexts(facts))
    ranked = retrieve.rerank(contexts, questions, how.evidence, reranker, rerank_model)
    return ranked, retrieve.synthesis_context(ranked, how.evidence_chars)


ANSWER_PROMPT = "Answer the question only from the context below.\n\nQuestion: {question}\n\nContext:\n{context}"


def answers(contexts: DataFrame, questions: DataFrame, make: Callable[[], extract.Extractor]) -> DataFrame:
    """(query_id, answer) by a model that is called in tasks; an error's text stands for the answer."""
    import pandas as pd

    def run(frames):
        call = make()

        def one(question: str, context: str) -> str:
            try:
                return call(ANSWER_PROMPT.format(question=question, context=context))
            except Exception as e:  # the failed call is the answer
                return f"Synthesis Failed: {e}"

        for f in frames:
            yield pd.DataFrame({"query_id": f["query_id"], "answer": [one(q, c) for q, c in zip(f["question"], f["context"], strict=True)]})

    rows = questions.join(contexts, "query_id").select("query_id", "question", "context")
    return rows.mapInPandas(run, f"query_id {dict(rows.dtypes)['query_id']}, answer string")
