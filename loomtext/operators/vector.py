"""Hash embeddings and exhaustive similarity search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import dot, hash_embedding
from loomtext.sources.staging import staged

#: an embedder maps a text column to an array<double> column
Embedder = Callable[[Column], Column]
BLOCK = 2_000  # questions of a block
ITEMS = 8_192  # items of a block
PIVOTS = 16  # groups of a block of items
SCORES = 4_000_000  # of a task at a time
SENT = 32 << 20  # bytes of questions that are sent to all tasks at most


def embed(df: DataFrame, embedder: Embedder = hash_embedding, column: str = "text") -> DataFrame:
    return df.withColumn("emb", embedder(F.col(column)))


def search(items: DataFrame, question: str, k: int = 5, embedder: Embedder = hash_embedding, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """The k items (…, emb) most similar to one question: score added; equal scores in the given order."""
    scored = items.withColumn("score", dot(F.col("emb"), embedder(F.lit(question)))).drop("emb")
    return scored.orderBy(F.desc("score"), *order).limit(k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix of dim columns: shorter lists and nulls within filled with 0, longer ones cut."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row[at < dim], at[at < dim]] = flat[at < dim]
    return out


def _stored(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (…, emb) with a vector in blocks of at most `size`, as Arrow bytes with the length of the longest vector.

    Rows without a vector are left out here: Spark would move a filter on vectors before a repartition of their texts, and so make each
    vector twice, once in the few tasks that read the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("emb").is_valid())
            for i in range(0, batch.num_rows, size):
                piece = batch.slice(i, size)
                raw = _stored(piece)
                dim = pc.max(pc.list_value_length(piece.column("emb"))).as_py() or 0
                yield pa.RecordBatch.from_arrays([pa.array([raw], pa.binary()), pa.array([dim], pa.int32())], ["rows", "dim"])

    return rows.mapInArrow(run, "rows binary, dim int")


class Clusters:
    """Vectors grouped around a few of them: where each group begins, its centre and its radius, which bound all its products."""

    def __init__(self, x: np.ndarray, groups: int = PIVOTS) -> None:
        pivots = [0]
        nearest = self._far(x, x[0])
        label = np.zeros(len(x), np.int64)
        while len(pivots) < min(groups, len(x)) and nearest.max() > 0:  # each next pivot is the farthest from those before
            pivots.append(int(nearest.argmax()))
            d = self._far(x, x[pivots[-1]])
            label[d < nearest] = len(pivots) - 1
            nearest = np.minimum(nearest, d)
        self.order = np.argsort(label, kind="stable")
        self.cuts = np.append(np.flatnonzero(np.diff(label[self.order], prepend=-1)), len(x))
        self.x = x[self.order]
        sizes = np.diff(self.cuts)
        self.centres = np.add.reduceat(self.x, self.cuts[:-1], axis=0) / sizes[:, None]
        self.radii = np.sqrt(np.maximum.reduceat(((self.x - np.repeat(self.centres, sizes, axis=0)) ** 2).sum(axis=1), self.cuts[:-1]))

    @staticmethod
    def _far(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return ((x - p) ** 2).sum(axis=1)

    def most(self, asking: np.ndarray) -> np.ndarray:
        """For each group and question a product that none of the group's vectors is above: with the centre, plus norm times radius."""
        norms = np.sqrt((asking**2).sum(axis=1))
        return self.centres @ asking.T + self.radii[:, None] * norms


def _slack(bar: np.ndarray) -> np.ndarray:
    """bar, lowered by more than sums of products can err."""
    with np.errstate(invalid="ignore"):
        return np.where(np.isinf(bar), bar, bar - 1e-9 * (1 + np.abs(bar)))


def search_many(items: DataFrame, questions: DataFrame, k: int = 10, order: tuple[str, ...] = ("id",)) -> DataFrame:
    """For each of the questions (query_id, emb) the k most similar items: query_id, rank from 1, the items' columns and score.

    A grid of blocks of items and blocks of questions, met by an equal join: a few blocks of questions are sent to all tasks, and items
    never move; more of them are dealt to the parts that blocks of items lie in.  In either case items are read once, and no question comes
    to the driver.  A task knows for each question the k-th best score so far, and looks at no group of items whose bound (centre and
    radius) is below it; what it finds is ranked together with what others found.  Products of matrices find who can be among the best;
    scores are sums in the order of the vectors, equal for equal vectors.  Items and questions without a vector are left out.
    """
    asked = questions.filter("emb is not null").select("query_id", "emb")
    kept = [c for c in items.columns if c != "emb"]
    kinds = dict(items.dtypes)
    kind = ", ".join([f"query_id {dict(asked.dtypes)['query_id']}", *(f"`{c}` {kinds[c]}" for c in kept), "score double"])
    sorting = [("query", "ascending"), ("score", "descending"), *((c, "ascending") for c in order)]
    size = asked.agg(F.count("*").alias("n"), F.sum(F.size("emb").cast("long")).alias("values")).first()
    asked = asked.repartition(max(1, -(-size["n"] // BLOCK)))
    asking_blocks = staged(_blocks(asked, BLOCK).select(F.expr("uuid()").alias("block"), F.col("rows").alias("asking"), F.col("dim").alias("asking_dim")), "questions")
    item_blocks = _blocks(items, ITEMS)
    if 8 * (size["values"] or 0) <= SENT:
        grid = item_blocks.withColumn("part", F.lit(0)).join(F.broadcast(asking_blocks.withColumn("part", F.lit(0))), "part")
    else:
        parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = asking_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        grid = item_blocks.withColumn("part", F.pmod(F.xxhash64("rows"), F.lit(parts)).cast("int")).join(dealt, "part")

    def best(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=sorting, null_placement="at_start"))
        query = table.column("query").to_numpy()
        first = np.searchsorted(query, query, "left")
        return table.filter(pa.array(np.arange(len(query)) - first < k))

    def met(rows: pa.Table, groups: Clusters, asking: np.ndarray, ids: pa.Array, bar: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        """The best k of a block for each question, as far as they can be among the best of all; and the bars raised."""
        dim, found = asking.shape[1], []
        may = groups.most(asking)
        for g in np.argsort(-may.max(axis=1)).tolist():  # the most promising first, as it raises bars
            some = np.flatnonzero(may[g] >= _slack(bar))
            a, b = int(groups.cuts[g]), int(groups.cuts[g + 1])
            step = max(1, SCORES // max(1, len(some)))
            for i in range(a, b if len(some) else a, step):
                x = groups.x[i : min(b, i + step)]
                about = x @ asking[some].T
                if len(x) >= k:
                    bar[some] = np.maximum(bar[some], np.partition(about, len(x) - k, axis=0)[len(x) - k])
                row, query = np.nonzero(about >= _slack(bar[some]))
                score = np.zeros(len(row))
                for d in range(dim):
                    score += x[row, d] * asking[some[query], d]
                found.append((some[query], groups.order[i + row], score))
        query, row, score = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        table = best(pa.table({"query": query} | {c: rows.column(c).take(pa.array(row)) for c in kept} | {"score": score}))
        query, scores = table.column("query").to_numpy(), table.column("score").to_numpy()
        full = np.flatnonzero(np.bincount(query, minlength=len(bar)) == k)
        if len(full):
            last = np.searchsorted(query, full, "right") - 1
            bar[full] = np.maximum(bar[full], scores[last])
        out = {"query_id": ids.take(pa.array(query))} | {c: table.column(c) for c in [*kept, "score"]}
        return pa.table(out), bar

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bars: dict[str, np.ndarray] = {}  # a number for each question that the task meets
        last: tuple[bytes, pa.Table, dict[int, Clusters]] | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                raw, block = batch.column("rows")[i].as_py(), batch.column("block")[i].as_py()
                dim = max(1, batch.column("dim")[i].as_py(), batch.column("asking_dim")[i].as_py())
                if last is None or last[0] != raw:
                    last = (raw, pa.ipc.open_stream(raw).read_all().combine_chunks(), {})
                _, rows, groups = last
                if dim not in groups:
                    groups[dim] = Clusters(_matrix(rows.column("emb").chunk(0), dim))
                asked = pa.ipc.open_stream(batch.column("asking")[i].as_py()).read_all().combine_chunks()
                asking = _matrix(asked.column("emb").chunk(0), dim)
                found, bars[block] = met(rows, groups[dim], asking, asked.column("query_id").chunk(0), bars.get(block, np.full(len(asking), -np.inf)))
                yield from found.to_batches()

    found = grid.select("rows", "dim", "block", "asking", "asking_dim").mapInArrow(run, kind)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))).filter(F.col("rank") <= k)


def as_contexts(hits: DataFrame) -> DataFrame:
    """Hits (query_id, rank, id, text, score) as evidence: query_id, ctx_ord, id, text, source_type, score."""
    return hits.select("query_id", F.col("rank").cast("long").alias("ctx_ord"), F.concat(F.lit("Chunk "), F.col("id").cast("string")).alias("id"), "text", F.lit("Vector Chunk").alias("source_type"), "score")
