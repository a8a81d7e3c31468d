"""Queries on whole lineages: a graph built by a model and asked about, with stand-ins for models whose answers SQL can express; and read-backs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.config import Calling
from loomtext.functions import text as T
from loomtext.operators import graph, vector
from loomtext.plans import pipeline
from loomtext.plans.graph_queries import S_EDGES, S_NODES, _graph
from loomtext.plans.register import dealt, query, quoted, s_embedding, s_words
from loomtext.sources import sinks
from loomtext.sources.staging import fresh_dir

# a document for each part; every tenth is empty or null, and for every seventh the model's answer is broken
S_DOCS = """select p_partkey as doc_id, case when p_partkey % 20 = 10 then null when p_partkey % 10 = 0 then ' ' else p_name || ' is made by ' || p_brand || ' as ' || p_type || ' number ' || p_partkey end as text from part"""
S_TOLD = "select p_partkey as doc_id, lower(p_name) as a, lower(p_brand) as b, p_name as head, p_brand as tail from part where p_partkey % 10 <> 0 and p_partkey % 7 <> 0"
ASKED = [(1, "which parts has Brand#12"), (2, "unsure about brand#7 and ring"), (3, "large rod"), (4, "who is it"), (5, "tell me of no such thing")]
S_ASKED = "select * from (values " + ", ".join(f"({i}, {quoted(q)})" for i, q in ASKED) + ") as q(query_id, question)"


def reads_parts() -> Callable[[str], str]:
    """A stand-in for an extractor: a part, its brand, and that the one is made by the other."""

    def model(prompt: str) -> str:
        text = prompt.rsplit("Text: ", 1)[1]
        name, rest = text.split(" is made by ")
        brand, number = rest.split(" as ")[0], int(text.rsplit(" ", 1)[1])
        if number % 7 == 0:
            return '{"entities":[{"id":"' + name
        return f'{{"entities":[{{"id":"{name}","type":"Part"}},{{"id":"{brand}","type":"Brand"}}],"relations":[{{"source":"{name}","target":"{brand}","predicate":"made by","evidence":"{text}"}}]}}'

    return model


def scores_pairs() -> Callable[[list[str], list[str]], list[float | None]]:
    """A stand-in for a reranking model: a text's length, modulo 97; no score for questions that begin with unsure."""
    return lambda questions, texts: [None if q.startswith("unsure") else float(len(t) % 97) for q, t in zip(questions, texts, strict=True)]


def writes_answers() -> Callable[[str], str]:
    """A stand-in for an answering model, which fails for questions that begin with tell."""

    def model(prompt: str) -> str:
        if "Question: tell" in prompt:
            raise RuntimeError("no answer")
        return f"{prompt.count('## [')} blocks in {len(prompt)} characters"

    return model


def _built(spark, sf_dir: str) -> tuple[DataFrame, pipeline.Knowledge]:
    dealt(spark, sf_dir, "part").createOrReplaceTempView("part")
    docs = spark.sql(S_DOCS)
    return docs, pipeline.build(docs, reads_parts, fresh_dir(spark, "built"), calling=Calling(pause=0.0, in_flight=4))


@query(f"""
select doc_id, case when t.head is null then 0 else 2 end::bigint as n_nodes, case when t.head is null then 0 else 1 end::bigint as n_edges, t.head as src_id, case when t.head is not null then 'MADE_BY' end as rel_type, t.tail as dst_id
from ({S_DOCS}) d left join ({S_TOLD}) t using (doc_id)
""")
def built_graphs(spark, sf_dir):
    """The graph of each document, empty ones and those with a broken answer included."""
    docs, known = _built(spark, sf_dir)
    counts = graph.graph_counts(known.nodes, known.edges)
    found = docs.select("doc_id").join(counts, "doc_id", "left").join(known.edges.select("doc_id", "src_id", "rel_type", "dst_id"), "doc_id", "left")
    return found.select("doc_id", F.coalesce("n_nodes", F.lit(0)).cast("long").alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), "src_id", "rel_type", "dst_id")


S_EVIDENCE = f"""
asked as ({S_ASKED}), told as ({S_TOLD}), chunks as (select doc_id::varchar || '/1' as id, text from ({S_DOCS}) where trim(coalesce(text, '')) <> ''),
e as materialized (select row_number() over () as e, * from (select distinct a, b, head, tail from told)), u as (select e, a as x, b as y from e union all select e, b, a from e),
seeds as (select distinct query_id, x from (select query_id, unnest({s_words("question")}) as term from asked) join (select distinct x from u) on contains(x, lower(term)) where length(term) >= 4),
one as (select distinct query_id, e, y from seeds join u using (x)), two as (select distinct query_id, u.e from one join u on u.x = one.y),
facts as (select *, row_number() over (partition by query_id order by head, tail) - 1 as i from (select distinct query_id, head, tail from (select query_id, e from one union select * from two) join e using (e)) qualify i < 60),
scored as (select query_id, id, text, list_dot_product({s_embedding("text")}, {s_embedding("question")}) as score from chunks cross join asked),
hits as (select *, row_number() over (partition by query_id order by score desc, id) as rank from scored qualify rank <= 10),
contexts as (select query_id, 0 as branch, rank as ctx_ord, 'Chunk ' || id as id, text, 'Vector Chunk' as source_type, score from hits
  union all select query_id, 1, i, 'Graph Triplet ' || i, head || ' MADE_BY ' || tail, 'Knowledge Graph', 0.0 from facts),
judged as (select query_id, branch, ctx_ord, id, text, source_type, case when question like 'unsure%' then score + 0.1 * len(list_filter(list_distinct({s_words("lower(text)")}), lambda w: list_contains({s_words("lower(question)")}, w))) else length(text) % 97 end::double as score from contexts join asked using (query_id)),
ranked as (select query_id, row_number() over (partition by query_id order by score desc, branch, ctx_ord) as rank, id, text, source_type, score from judged qualify rank <= 5)"""


def _asked(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    questions = spark.createDataFrame(ASKED, "query_id int, question string")
    return questions, *pipeline.ask(questions, _built(spark, sf_dir)[1], rerank_model=scores_pairs)


@query(f"with {S_EVIDENCE} select query_id, rank::bigint as rank, id, text, source_type, round(score, 9) as score from ranked")
def asked_evidence(spark, sf_dir):
    """Evidence for questions about the built graph, as a model ranks it; where the model has no score, by shared words."""
    ranked = _asked(spark, sf_dir)[1]
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "text", "source_type", F.round("score", 9).alias("score"))


@query(f"""
with {S_EVIDENCE}, blocks as (select query_id, count(*) as n, sum(length('## [' || id || '] (Source: ' || source_type || ' | Score=' || printf('%.3f', score) || ')' || chr(10) || text)) + 3 * (count(*) - 1) as chars from ranked group by query_id)
select query_id, case when question like 'tell%' then 'Synthesis Failed: no answer' else n || ' blocks in ' || (length({quoted(pipeline.ANSWER_PROMPT.replace("{question}", "").replace("{context}", ""))}) + length(question) + length('# Verified Context Blocks') + 2 + chars)::bigint || ' characters' end as answer from asked join blocks using (query_id)
""")
def given_answers(spark, sf_dir):
    """Answers of a model that is told question and context, and the failed call's text where it fails."""
    questions, _, contexts = _asked(spark, sf_dir)
    return pipeline.answers(contexts, questions, writes_answers)


@query(f"select 'edge' as kind, doc_id, src_key as key, rel_type || ' ' || dst_key as value from ({S_EDGES}) union all select 'node', doc_id, node_key, id || '/' || type from ({S_NODES})")
def graph_read_back(spark, sf_dir):
    """A graph that is committed in two batches, one of them twice, and read as of the last manifest."""
    nodes, edges = _graph(spark, sf_dir)
    path = fresh_dir(spark, "graph")
    odd = F.coalesce(F.pmod("doc_id", F.lit(2)) == 1, F.lit(False))  # a row without a doc_id is in a batch too
    for batch, rows in (("even", ~odd), ("odd", odd), ("even", ~odd)):
        sinks.commit({"nodes": nodes.filter(rows), "edges": edges.filter(rows)}, path, batch)  # raises, as a graph without one of its batches is no result
    told = sinks.committed(spark, path, "edges").select(F.lit("edge").alias("kind"), "doc_id", F.col("src_key").alias("key"), F.concat_ws(" ", "rel_type", "dst_key").alias("value"))
    return told.union(sinks.committed(spark, path, "nodes").select(F.lit("node"), "doc_id", "node_key", F.concat_ws("/", "id", "type")))


@query(f"select p_partkey as doc_id, p_name as text, round(list_dot_product({s_embedding('p_name')}, {s_embedding(quoted('red bolt'))}), 9) as score from part")
def index_read_back(spark, sf_dir):
    """The index of all parts, committed by brand, with the similarity of each to one question as it was read back."""
    rows = vector.embed(dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text"), F.crc32("p_brand").alias("part")))
    path = fresh_dir(spark, "index")
    for part in (0, 1, 1, 2):
        sinks.write_index(rows.filter(F.col("part") % 3 == part).drop("part"), path, f"part {part}")
    index = sinks.committed(spark, path, "index")
    return index.select("doc_id", "text", F.round(T.dot(F.col("emb"), T.hash_embedding(F.lit("red bolt"))), 9).alias("score"))
