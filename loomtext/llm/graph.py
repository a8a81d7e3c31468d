"""Connected components of an edge table by alternating star contraction, as joins and sums only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.base import staged


def _star(pairs: DataFrame) -> DataFrame:
    """Link each u's larger neighbours, and u's smaller ones among them, to the least of u and its neighbours."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    down = large.filter("a < b").distinct()
    least = down.groupBy("b").agg(F.min("a").alias("m"))
    small = down.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return small.filter("a < b").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) for every node of edges (a, b), the component being its smallest node.

    Each round writes its pairs to the shared folder; rounds grow with the logarithm of the longest path.  Loops and repeated edges are
    allowed; an empty table gives an empty one.  Edges with a null end are dropped.
    """
    edges = edges.select("a", "b").filter("a <> b")
    pairs = staged(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        # a star forest: no node is both a centre and a leaf, and each leaf has one centre
        state = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
        if state == mark or not state["n"]:
            break
        mark = state
        pairs = staged(_star(pairs), name)
    leaves = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return leaves.union(pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
