"""Documents that arrive as files: each micro-batch is chunked and embedded for the index, or read by a model for the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtext.config import Calling, Chunking, Cleaning, Ranking
from loomtext.operators import extract
from loomtext.operators.vector import embed
from loomtext.plans.pipeline import graph_of, prepared_chunks
from loomtext.sources import sinks


def index_stream(docs: DataFrame, path: str, checkpoint: str, chunking: Chunking = Chunking(), ranking: Ranking = Ranking(), cleaning: Cleaning = Cleaning()) -> StreamingQuery:
    """Run over what is there now of a stream (doc_id, text) and append to the Parquet index at path; the file sink makes it exactly once."""
    rows = embed(prepared_chunks(docs, chunking, ranking, cleaning))
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def graph_stream(
    docs: DataFrame, make: Callable[[], extract.Extractor], path: str, checkpoint: str, chunking: Chunking = Chunking(), ranking: Ranking = Ranking(), calling: Calling = Calling(), cleaning: Cleaning = Cleaning(),
) -> StreamingQuery:
    """Run over what is there now of a stream (doc_id, text) and commit its graph below path.

    A micro-batch that is tried again pays for no answer twice and commits nothing twice: its number is the name of its version.
    """

    def add(batch: DataFrame, number: int) -> None:
        raw = extract.responses(prepared_chunks(batch, chunking, ranking, cleaning), make, calling, f"{path}/answers")
        nodes, edges = graph_of(raw.select("doc_id", "chunk_rank", extract.parse_strict(F.col("raw")).alias("parsed")))
        sinks.commit({"nodes": nodes, "edges": edges}, path, f"batch {number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
