"""From extracted rows to nodes and edges, and facts around seeds.

Dedupes are first-wins by (chunk_rank, pos): the smallest struct of a key, which is summed up before the shuffle, so a key with very many
rows is no burden for one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomtext.functions.text import edge_type, fold, is_number, relation_type, strip, words
from loomtext.sources.staging import few, staged

NODE_ORDER = ("branch", "chunk_rank", "pos", "side")
SEED_CHARS = 4


def _first(rows: DataFrame, keys: list[str], order: tuple[str, ...], values: list[str]) -> DataFrame:
    """Of each key the row that is first in order; values and order columns are kept."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(*order, *values)).alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in (*order, *values)))


def dedupe_entities(entities: DataFrame) -> DataFrame:
    """First row of each lower-cased name and type in a document, without empty and numeric names; a blank type shows as Concept."""
    kind = strip(F.when(F.coalesce("type", F.lit("")) == "", "Concept").otherwise(F.col("type")))
    rows = entities.select("doc_id", "chunk_rank", "pos", strip(F.coalesce("name", F.lit(""))).alias("name"), kind.alias("type"))
    rows = rows.filter((F.col("name") != "") & ~is_number(F.col("name"))).withColumn("low", F.lower("name"))
    first = _first(rows, ["doc_id", "low", "type"], ("chunk_rank", "pos"), ["name"])
    return first.select("doc_id", "chunk_rank", "pos", "name", F.when(F.col("type") == "", "Concept").otherwise(F.col("type")).alias("type"))


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """First row of each lower-cased head, tail and relation type in a document; direction counts."""
    kind = lambda c: F.when(F.coalesce(c, F.lit("")) == "", "Concept").otherwise(F.col(c)).alias(c)
    rows = relations.select(
        "doc_id", "chunk_rank", "pos", strip(F.col("head")).alias("head"), kind("head_type"), relation_type(F.col("relation")).alias("relation"), strip(F.col("tail")).alias("tail"), kind("tail_type"), "evidence"
    ).filter("head <> '' and tail <> ''")
    rows = rows.withColumn("low_head", F.lower("head")).withColumn("low_tail", F.lower("tail"))
    first = _first(rows, ["doc_id", "low_head", "low_tail", "relation"], ("chunk_rank", "pos"), ["head", "head_type", "tail", "tail_type", "evidence"])
    return first.select("doc_id", "chunk_rank", "pos", "head", "head_type", "relation", "tail", "tail_type", "evidence")


def clean_entities_relations(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    return dedupe_entities(entities), dedupe_relations(relations)


def keeps_node(node_id: Column) -> Column:
    """Ids of two characters or more that are no number."""
    return (F.length(node_id) > 1) & ~is_number(node_id)


def _sound(relations: DataFrame) -> DataFrame:
    rows = relations.withColumns({"head": fold(F.col("head")), "tail": fold(F.col("tail")), "rel_type": edge_type(F.col("relation"))})
    return rows.filter(keeps_node(F.col("head")) & keeps_node(F.col("tail")))


def build_nodes(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(doc_id, node_key, branch, chunk_rank, pos, side, id, type): a node for each lower-cased id, entities (branch 0) before ends of relations (1)."""
    kind = lambda c: F.when(fold(F.col(c)) == "", "Concept").otherwise(fold(F.col(c))).alias("type")
    place = ("doc_id", "chunk_rank", "pos")
    named = entities.select(*place, F.lit(0).alias("branch"), F.lit(0).alias("side"), fold(F.col("name")).alias("id"), kind("type")).filter(keeps_node(F.col("id")))
    ends = _sound(relations)
    for side, end in enumerate(("head", "tail")):
        named = named.unionByName(ends.select(*place, F.lit(1).alias("branch"), F.lit(side).alias("side"), F.col(end).alias("id"), kind(f"{end}_type")))
    return _first(named.withColumn("node_key", F.lower("id")), ["doc_id", "node_key"], NODE_ORDER, ["id", "type"])


def build_edges(relations: DataFrame, nodes: DataFrame, distinct: bool = False) -> DataFrame:
    """(doc_id, chunk_rank, pos, src_key, dst_key, src_id, dst_id, rel_type): relations with sound ends, which show as their nodes do."""
    rows = _sound(relations).select("doc_id", "chunk_rank", "pos", F.lower("head").alias("src_key"), F.lower("tail").alias("dst_key"), "rel_type")
    if distinct:
        rows = _first(rows, ["doc_id", "src_key", "dst_key", "rel_type"], ("chunk_rank", "pos"), [])
    for side in ("src", "dst"):
        rows = rows.join(nodes.select("doc_id", F.col("node_key").alias(f"{side}_key"), F.col("id").alias(f"{side}_id")), ["doc_id", f"{side}_key"])
    return rows.select("doc_id", "chunk_rank", "pos", "src_key", "dst_key", "src_id", "dst_id", "rel_type")


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, n_nodes, n_edges)."""
    both = nodes.select("doc_id", F.lit(1).alias("n"), F.lit(0).alias("e")).union(edges.select("doc_id", F.lit(0), F.lit(1)))
    return both.groupBy("doc_id").agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges"))


def seed_terms(question: Column) -> Column:
    """Words of a question of SEED_CHARS characters or more."""
    return F.filter(words(question), lambda w: F.length(w) >= SEED_CHARS)


def seed_match(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, node_key) of nodes whose id contains one of the question's terms, whatever the case.

    An id that contains a term contains each of the term's runs of SEED_CHARS characters, so ids meet terms by runs, in an equal join.  Of
    its runs a term takes the rarest among the ids (counted, one row for each run of a term), so that no common beginning of words gathers
    ids and terms in one place, and fewest pairs are compared; a term of which a run occurs in no id is out before the join.
    """
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - SEED_CHARS + 1, F.lit(1))), lambda i: F.substr(F.col(c), i, F.lit(SEED_CHARS))))
    asked = questions.select("query_id", F.explode(F.array_distinct(F.transform(seed_terms(F.col("question")), F.lower))).alias("term"))
    terms = asked.select("term").distinct().withColumn("runs", runs("term"))
    ids = nodes.select("node_key", F.lower("id").alias("low")).distinct().withColumn("run", F.explode(runs("low")))
    wanted = terms.select("term", F.size("runs").alias("n"), F.explode("runs").alias("run"))
    counted = ids.select("run").join(wanted.select("run").distinct(), "run", "left_semi").groupBy("run").agg(F.count("*").alias("ids"))
    met = wanted.join(counted, "run").groupBy("term", "n").agg(F.count("*").alias("found"), F.min(F.struct("ids", "run")).alias("rarest"))
    keyed = few(staged(met.filter("found = n").select("term", F.col("rarest.run").alias("run")), "terms"))  # ids don't move for a few terms
    pairs = ids.join(keyed, "run").filter(F.contains("low", "term")).select("term", "node_key")
    return pairs.join(asked, "term").select("query_id", "node_key").distinct()


HUB = 10_000  # edges of a node from which on its adjacency is dealt out
HUBS = 10_000  # nodes that can be hubs at once


def dealt_adjacency(edges: DataFrame, hub: int = HUB, hubs: int = HUBS) -> tuple[DataFrame, DataFrame]:
    """Both ends' view of edges (node_key, part, other, head, rel, tail), and the parts of hubs (node_key, parts).

    A node with more than `hub` edges, and more than a `hubs`-th of all, is a hub: its edges lie in parts of about that number, by their
    other end.  So there are fewer than `hubs` hubs, whatever the graph, and they can be sent to all tasks.
    """
    ways = [("src_key", "dst_key"), ("dst_key", "src_key")]
    views = [edges.select(F.col(a).alias("node_key"), F.col(b).alias("other"), F.col("src_id").alias("head"), F.col("rel_type").alias("rel"), F.col("dst_id").alias("tail")) for a, b in ways]
    views = views[0].union(views[1]).filter("node_key is not null")
    degrees = views.groupBy("node_key").agg(F.count("*").alias("degree"))
    most, heavy = hub, staged(degrees.filter(F.col("degree") > hub), "hubs")
    if heavy.count() >= hubs:
        most = max(hub, -(-(degrees.agg(F.sum("degree")).first()[0] or 0) // hubs))
        heavy = heavy.filter(F.col("degree") > most)
    heavy = heavy.select("node_key", F.ceil(F.col("degree") / most).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("other", "head", "rel", "tail"), F.col("parts")), F.lit(0)).cast("int")
    return views.join(F.broadcast(heavy), "node_key", "left").withColumn("part", part).drop("parts"), heavy


def k_hop_facts(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int | None = 60, hub: int = HUB) -> DataFrame:
    """(query_id, head, rel, tail) of distinct edges on undirected paths of at most `hops` edges from seeds (query_id, node_key).

    An edge lies on such a path when one of its ends is within hops - 1 of a seed, so sets of nodes are joined, never paths.  A hop joins
    only the nodes that the hop before found first, and gives both the facts around them and the nodes beyond; hubs meet their edges in
    parts.  The limit, if any, takes the first facts of each question by head, rel and tail.
    """
    near, heavy = dealt_adjacency(edges, hub)
    near = staged(near, "adjacency") if hops > 1 else near
    frontier = seeds.select("query_id", "node_key").distinct()
    frontier = staged(frontier, "seeds") if hops > 1 else frontier  # read again as nodes that were visited
    visited, facts = None, []
    for hop in range(hops):
        spread = frontier.join(F.broadcast(heavy), "node_key", "left").select("query_id", "node_key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1)).alias("part"))
        met = spread.join(near, ["node_key", "part"]).select("query_id", "other", "head", "rel", "tail").distinct()
        if hop + 1 < hops:
            met = staged(met, "hop")
            visited = frontier if visited is None else visited.union(frontier)
            frontier = met.select("query_id", F.col("other").alias("node_key")).filter("node_key is not null").distinct().join(visited, ["query_id", "node_key"], "left_anti")
            if hop + 2 < hops:  # it is read again
                frontier = staged(frontier, "frontier")
        facts.append(met.filter("head is not null and rel is not null and tail is not null").select("query_id", "head", "rel", "tail"))
    found = reduce(DataFrame.union, facts).distinct()
    if limit is None:
        return found
    order = Window.partitionBy("query_id").orderBy("head", "rel", "tail")
    return found.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= limit).drop("at")


def facts_as_contexts(facts: DataFrame) -> DataFrame:
    """Facts as evidence: query_id, ctx_ord, id, text, source_type, score."""
    order = Window.partitionBy("query_id").orderBy("head", "rel", "tail")
    rows = facts.withColumn("i", F.row_number().over(order).cast("long") - 1)
    name = F.concat(F.lit("Graph Triplet "), F.col("i").cast("string"))
    return rows.select("query_id", F.col("i").alias("ctx_ord"), name.alias("id"), F.concat_ws(" ", "head", "rel", "tail").alias("text"), F.lit("Knowledge Graph").alias("source_type"), F.lit(0.0).alias("score"))
