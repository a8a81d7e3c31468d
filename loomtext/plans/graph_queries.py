"""Queries on extraction, graphs and evidence, over rows made from the relational tables with variants of case, blanks and numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.config import Calling
from loomtext.functions import text as T
from loomtext.operators import extract, graph, retrieve, vector
from loomtext.plans.register import dealt, query, quoted, s_embedding, s_fold, s_strip, s_words, table
from loomtext.sources.staging import staged

# answers of a model: one for each part, every fourth sort of which is broken in another way
BROKEN = {1: "missing evidence", 2: "number as type", 3: "prose and fences", 4: "no list", 5: "cut off"}
S_RAW = """
select p_partkey as doc_id, p_size::bigint as chunk_rank, case p_partkey % 6
  when 1 then '{"entities":[{"id":"' || p_name || '","type":"Part"}],"relations":[{"source":"' || p_name || '","target":"' || p_brand || '","predicate":"made by"}]}'
  when 2 then '{"entities":[{"id":"' || p_name || '","type":5}],"relations":[]}'
  when 3 then 'Here it is:' || chr(10) || '```json' || chr(10) || '{"entities":[{"id":" ' || p_name || ' ","type":"","extra":[1]}],"relations":[]}' || chr(10) || '``` and } more'
  when 4 then '{"entities":[{"id":"' || p_name || '","type":"Part"}],"relations":{}}'
  when 5 then '{"entities":[{"id":"' || p_name || '","type":"Part"}'
  else '{"entities":[{"id":"' || p_name || '","type":"Part"},{"id":"' || upper(p_name) || '","type":"Other"}],"relations":[{"source":"' || p_name || '","target":"' || p_brand || '","predicate":"made by","evidence":" "}]}' end as raw
from part"""


def raw_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(S_RAW)


@query(f"""
with r as ({S_RAW}), b as (select doc_id, case when contains(raw, '```') then {s_strip("regexp_extract(raw, '```(?:json)?[ \\n]*((?s:.*?))[ \\n]*```', 1)")} else {s_strip("raw")} end as body from r)
select doc_id, case when instr(body, '{{') > 0 and instr(body, '}}') > 0 then substr(body, instr(body, '{{'), length(body) - instr(reverse(body), '}}') + 1 - instr(body, '{{') + 1) end as carved from b
""")
def json_carve(spark, sf_dir):
    return raw_answers(spark, sf_dir).select("doc_id", extract.carve(F.col("raw")).alias("carved"))


@query("""
select p_partkey as doc_id, p_size::bigint as chunk_rank, unnest(range(case p_partkey % 6 when 3 then 1 else 2 end))::bigint as pos,
  unnest(case p_partkey % 6 when 3 then [p_name] else [p_name, upper(p_name)] end) as name, unnest(case p_partkey % 6 when 3 then ['Concept'] else ['Part', 'Other'] end) as type
from part where p_partkey % 6 in (0, 3)
""")
def json_entities(spark, sf_dir):
    """Strict reading: answers that are broken anywhere give nothing."""
    parsed = raw_answers(spark, sf_dir).select("doc_id", "chunk_rank", extract.parse_strict(F.col("raw")).alias("parsed"))
    return extract.entities_of(parsed).select("doc_id", F.col("chunk_rank").cast("long").alias("chunk_rank"), F.col("pos").cast("long").alias("pos"), "name", "type")


@query("select p_partkey as doc_id, p_name as head, 'Other' as head_type, 'MADE_BY' as relation, p_brand as tail, 'Concept' as tail_type, null::varchar as evidence from part where p_partkey % 6 = 0")
def json_relations(spark, sf_dir):
    parsed = raw_answers(spark, sf_dir).select("doc_id", "chunk_rank", extract.parse_strict(F.col("raw")).alias("parsed"))
    return extract.relations_of(parsed).drop("chunk_rank", "pos")


S_LISTS = """select p_partkey as doc_id, '[{"name":" ' || p_name || '","type":""},5,{"type":"x"},{"name":"' || p_brand || '","head":"' || p_name || '","tail":"' || p_brand || '","relation":"is of"}]' as raw from part"""


@query("select p_partkey as doc_id, unnest([p_name, p_brand]) as name, 'Concept' as type from part")
def json_entity_list(spark, sf_dir):
    dealt(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(S_LISTS).select("doc_id", F.explode(extract.parse_entity_list(F.col("raw"))).alias("e")).select("doc_id", "e.*")


@query("select p_partkey as doc_id, p_name as head, 'Concept' as head_type, 'IS_OF' as relation, p_brand as tail, 'Concept' as tail_type, null::varchar as evidence from part")
def json_relation_list(spark, sf_dir):
    dealt(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(S_LISTS).select("doc_id", F.explode(extract.parse_relation_list(F.col("raw"))).alias("r")).select("doc_id", "r.*")


@query(f"""select p_partkey, replace({quoted(extract.PROMPT)}, '{extract.PLACEHOLDER}', substr(p_name || ' ' || p_type, 1, 12)) as prompt from part""")
def prompts(spark, sf_dir):
    return dealt(spark, sf_dir, "part").select("p_partkey", extract.prompt(F.concat_ws(" ", "p_name", "p_type"), max_chars=12).alias("prompt"))


@query("""select p_partkey, 'Relate.' || chr(10) || chr(10) || 'Entity List (use these):' || chr(10) || '[' || array_to_string(list_transform(range(1, 121), lambda i: '{"name":"' || p_name || ' ' || i || '","type":"Part"}'), ',') || ']' || chr(10) || chr(10) || 'Text:' || chr(10) || substr(p_type, 1, 9) as prompt from part""")
def relation_prompts(spark, sf_dir):
    """Of 130 entities the first 120 are named."""
    entities = F.transform(F.sequence(F.lit(1), F.lit(130)), lambda i: F.struct(F.concat_ws(" ", "p_name", i.cast("string")).alias("name"), F.lit("Part").alias("type")))
    return dealt(spark, sf_dir, "part").select("p_partkey", extract.relation_prompt(F.col("p_type"), entities, "Relate.", max_chars=9).alias("prompt"))


class Unsteady:
    """A stand-in for a model: answers with the text's last word, but only at the second call for every text that ends so."""

    def __init__(self) -> None:
        self.asked: set[str] = set()

    def __call__(self, prompt: str) -> str:
        if prompt.endswith("00") and prompt not in self.asked:
            self.asked.add(prompt)
            raise TimeoutError("ask again")
        return '{"entities":[{"id":"' + prompt.rsplit(" ", 1)[-1] + '","type":"Part"}],"relations":[]}'


@query("select p_partkey as doc_id, 1::bigint as chunk_rank, 0::bigint as pos, 'no' || p_partkey as name, 'Part' as type from part")
def extracted_entities(spark, sf_dir):
    """Calls of a model that fails at first, tried again, read strictly."""
    chunks = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(1).cast("long").alias("chunk_rank"), F.concat(F.col("p_name"), F.lit(" no"), F.col("p_partkey").cast("string")).alias("text"))
    raw = extract.responses(chunks, Unsteady, Calling(pause=0.0))
    found = extract.entities_of(raw.select("doc_id", "chunk_rank", extract.parse_strict(F.col("raw")).alias("parsed")))
    return found.withColumn("pos", F.col("pos").cast("long"))


_hits = "select c_custkey // 7 as query_id, row_number() over (partition by c_custkey // 7 order by c_custkey) as rank, c_custkey as id, c_name as text, (c_custkey % 8) / 8.0::double as score from customer"


@query(f"""select query_id, trim('# Retrieved Evidence Chunks' || chr(10) || chr(10) || string_agg(chr(10) || '## Chunk ' || id || ' (score=' || format('{{:.3f}}', score) || ')' || chr(10) || text || chr(10), chr(10) order by rank)
  || case when query_id % 3 = 0 then chr(10) || chr(10) || '# Graph Facts' || chr(10) || 'fact ' || query_id else '' end, ' ' || chr(10)) as context from ({_hits}) group by query_id""")
def evidence_contexts(spark, sf_dir):
    """Chunks of each question, and facts for every third."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    hits = spark.sql(_hits.replace("//", "div").replace("8.0::double", "8.0D"))
    facts = hits.filter("query_id % 3 = 0").select("query_id", F.concat(F.lit("fact "), F.col("query_id").cast("string")).alias("facts_text")).distinct()
    return retrieve.evidence_context(hits, facts)


# rows as an extractor leaves them
S_ENTITIES = """
select (p_partkey // 40)::bigint as doc_id, p_size::bigint as chunk_rank, p_partkey::bigint as pos,
  case p_partkey % 5 when 0 then upper(p_name) when 1 then '  ' || p_name || ' ' when 2 then replace(p_name, ' ', '  ') when 3 then p_size::string || '.5' else p_name end as name,
  case p_partkey % 3 when 0 then '' when 1 then p_brand else ' ' || p_type end as type
from part"""
S_RELATIONS = """
select (l_orderkey // 500)::bigint as doc_id, l_linenumber::bigint as chunk_rank, l_orderkey::bigint as pos,
  case l_linenumber % 3 when 0 then 'PART ' when 1 then ' part  ' else 'Part ' end || (l_partkey % 90)::string as head, case l_linenumber when 1 then '' else 'Part' end as head_type,
  case l_returnflag when 'A' then 'uses' when 'N' then 'supplied  by' else '' end as relation,
  case l_suppkey % 4 when 0 then (l_suppkey % 10)::string else ' Supplier ' || (l_suppkey % 7)::string end as tail, 'Supplier' as tail_type,
  case l_returnflag when 'A' then 'shipped' end as evidence
from lineitem"""
_first = lambda keys, order: f"row_number() over (partition by {keys} order by {order}) = 1"
S_DEDUPED_ENTITIES = f"""
select doc_id, chunk_rank, pos, name, case when type = '' then 'Concept' else type end as type
from (select doc_id, chunk_rank, pos, {s_strip("name")} as name, case when type = '' then 'Concept' else {s_strip("type")} end as type from ({S_ENTITIES}))
where name <> '' and not regexp_matches(name, '^[0-9]+(\\.[0-9]+)?$') qualify {_first("doc_id, lower(name), type", "chunk_rank, pos")}"""
_type = "case when coalesce(relation, '') = '' then 'RELATED_TO' else replace(upper(trim(relation)), ' ', '_') end"
S_DEDUPED_RELATIONS = f"""
select * from (select doc_id, chunk_rank, pos, trim(head) as head, case when head_type = '' then 'Concept' else head_type end as head_type, {_type} as relation, trim(tail) as tail, tail_type, evidence from ({S_RELATIONS}))
where head <> '' and tail <> '' qualify {_first("doc_id, lower(head), lower(tail), relation", "chunk_rank, pos")}"""


def _spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    for name in ("part", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql.replace("//", "div"))


def entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_sql(spark, sf_dir, S_ENTITIES).withColumns({c: F.col(c).cast("long") for c in ("doc_id", "chunk_rank", "pos")})


def relation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # two rows of an order can have one place: the line number makes it whole
    return _spark_sql(spark, sf_dir, S_RELATIONS).withColumns({c: F.col(c).cast("long") for c in ("doc_id", "chunk_rank", "pos")})


@query(S_DEDUPED_ENTITIES)
def entity_dedupe(spark, sf_dir):
    return graph.dedupe_entities(entity_rows(spark, sf_dir))


@query(S_DEDUPED_RELATIONS)
def relation_dedupe(spark, sf_dir):
    return graph.dedupe_relations(relation_rows(spark, sf_dir))


_sound = lambda x: f"length({x}) > 1 and not regexp_matches({x}, '^[0-9]+(\\.[0-9]+)?$')"
S_NODES = f"""
select doc_id, lower(id) as node_key, id, type from (
  select doc_id, 0 as branch, chunk_rank, pos, 0 as side, {s_fold("name")} as id, coalesce(nullif({s_fold("type")}, ''), 'Concept') as type from ({S_DEDUPED_ENTITIES})
  union all select doc_id, 1, chunk_rank, pos, 0, {s_fold("head")}, head_type from ({S_DEDUPED_RELATIONS}) where {_sound(s_fold("tail"))}
  union all select doc_id, 1, chunk_rank, pos, 1, {s_fold("tail")}, tail_type from ({S_DEDUPED_RELATIONS}) where {_sound(s_fold("head"))})
where {_sound("id")} qualify {_first("doc_id, lower(id)", "branch, chunk_rank, pos, side")}"""
S_EDGES = f"""
select r.doc_id, r.chunk_rank, r.pos, h.node_key as src_key, t.node_key as dst_key, h.id as src_id, t.id as dst_id, replace(upper({s_fold("relation")}), ' ', '_') as rel_type
from ({S_DEDUPED_RELATIONS}) r join ({S_NODES}) h on h.doc_id = r.doc_id and h.node_key = lower({s_fold("head")}) join ({S_NODES}) t on t.doc_id = r.doc_id and t.node_key = lower({s_fold("tail")})
where {_sound(s_fold("head"))} and {_sound(s_fold("tail"))}"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    entities, relations = graph.clean_entities_relations(entity_rows(spark, sf_dir), relation_rows(spark, sf_dir))
    relations = staged(relations, "relations")  # each table is read several times by what follows
    nodes = staged(graph.build_nodes(entities, relations), "nodes")
    return nodes, staged(graph.build_edges(relations, nodes), "edges")


@query(S_NODES)
def graph_nodes(spark, sf_dir):
    return _graph(spark, sf_dir)[0].select("doc_id", "node_key", "id", "type")


@query(S_EDGES)
def graph_edges(spark, sf_dir):
    return _graph(spark, sf_dir)[1]


@query(f"select doc_id, coalesce(n, 0)::bigint as n_nodes, coalesce(e, 0)::bigint as n_edges from (select doc_id, count(*) as n from ({S_NODES}) group by 1) full join (select doc_id, count(*) as e from ({S_EDGES}) group by 1) using (doc_id)")
def graph_counts(spark, sf_dir):
    return graph.graph_counts(*_graph(spark, sf_dir))


# a graph of places: customers and suppliers in nations in regions
QUESTIONS = [(1, "Where is Supplier#000000001 at home?"), (2, "what about EUROPE and asia now"), (3, "who is it"), (4, "Customer#000000011 or germany")]
PLACES = """
select s_name as src, 'located in' as rel, n_name as dst from supplier join nation on s_nationkey = n_nationkey
union all select c_name, 'located in', n_name from customer join nation on c_nationkey = n_nationkey
union all select n_name, 'part of', r_name from nation join region on n_regionkey = r_regionkey"""
S_QUESTIONS = "select * from (values " + ", ".join(f"({i}, {quoted(q)})" for i, q in QUESTIONS) + ") as q(query_id, question)"
S_PLACE_EDGES = f"select distinct lower(src) as a, lower(dst) as b, src as head, replace(upper(rel), ' ', '_') as rel, dst as tail from ({PLACES})"
S_SEEDS = f"""
select distinct query_id::int as query_id, node_key from (select query_id, unnest({s_words("question")}) as term from ({S_QUESTIONS}))
join (select lower(src) as node_key from ({PLACES}) union select lower(dst) from ({PLACES})) on contains(node_key, lower(term)) where length(term) >= 4"""


def _s_facts(hops: int, limit: int | None) -> str:
    """Facts by paths, unlike the neighbourhoods of the Spark query: the last edge of every path of distinct edges from a seed."""
    sql = f"with recursive e as materialized (select *, row_number() over (order by a, b, rel) as id from ({S_PLACE_EDGES})), u as (select id, a as x, b as y from e union all select id, b, a from e), seeds as materialized ({S_SEEDS})"
    steps = ["select distinct query_id, u.id, u.y from seeds join u on u.x = node_key"]
    for _ in range(hops - 1):
        steps.append(f"select distinct p.query_id, u.id, u.y from ({steps[-1]}) p join u on u.x = p.y and u.id <> p.id")
    union = " union ".join(f"select query_id, id from ({s})" for s in steps)
    cut = "" if limit is None else f" qualify row_number() over (partition by query_id order by head, rel, tail) <= {limit}"
    return f"{sql} select query_id, head, rel, tail from (select distinct query_id, head, rel, tail from ({union}) join e using (id)){cut}"


def place_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    for name in ("supplier", "customer", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    rows = spark.sql(PLACES)
    edges = rows.select(F.lower("src").alias("src_key"), F.lower("dst").alias("dst_key"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), T.edge_type(F.col("rel")).alias("rel_type"))
    return edges.select(F.explode(F.array(F.struct(F.col("src_key").alias("node_key"), F.col("src_id").alias("id")), F.struct(F.col("dst_key").alias("node_key"), F.col("dst_id").alias("id")))).alias("n")).select("n.*"), edges


def questions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id int, question string")


def _facts(spark: SparkSession, sf_dir: str, hops: int, limit: int | None) -> DataFrame:
    nodes, edges = place_graph(spark, sf_dir)
    return graph.k_hop_facts(edges, graph.seed_match(nodes, questions(spark)), hops, limit)


@query(S_SEEDS)
def seed_match(spark, sf_dir):
    return graph.seed_match(place_graph(spark, sf_dir)[0], questions(spark))


@query(_s_facts(2, 60))
def two_hop_facts(spark, sf_dir):
    return _facts(spark, sf_dir, 2, 60)


@query(_s_facts(1, None))
def one_hop_facts(spark, sf_dir):
    return _facts(spark, sf_dir, 1, None)


@query(_s_facts(3, None))
def k_hop_facts(spark, sf_dir):
    return _facts(spark, sf_dir, 3, None)


# terms out of all names of parts against all parts
S_PARTS = "select distinct p_name || ' ' || p_brand as id from part"
S_NAMES = "select min(p_partkey)::bigint as query_id, 'any ' || upper(p_name) || ' or ' || replace(p_name, ' ', '') as question from part group by p_name"


@query(f"""
select distinct query_id, lower(id) as node_key from (select query_id, unnest({s_words("question")}) as term from ({S_NAMES})) join ({S_PARTS}) on contains(lower(id), lower(term)) where length(term) >= 4
""")
def part_seeds(spark, sf_dir):
    """Each name of a part as a question: terms that many names share, and some that none has."""
    nodes = _spark_sql(spark, sf_dir, S_PARTS).select(F.lower("id").alias("node_key"), "id")
    return graph.seed_match(nodes, _spark_sql(spark, sf_dir, S_NAMES.replace("::bigint", "")))


# a star: each line of an order at the nation that it comes from
LINES = """
select 'line ' || l_orderkey || '/' || l_linenumber as src, 'comes from' as rel, n_name as dst from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
union all select n_name, 'part of', r_name from nation join region on n_regionkey = r_regionkey"""
HUB_SEEDS = [(1, "germany"), (2, "line 1/1"), (3, "nowhere"), (4, "europe"), (4, "asia")]
S_LINE_EDGES = f"select distinct lower(src) as a, lower(dst) as b, src as head, replace(upper(rel), ' ', '_') as rel, dst as tail from ({LINES})"


@query(f"""
with e as materialized ({S_LINE_EDGES}), u as (select a as x, b as y, head, rel, tail from e union all select b, a, head, rel, tail from e),
seeds as (select * from (values {", ".join(f"({q}, {quoted(k)})" for q, k in HUB_SEEDS)}) as t(query_id, x)),
one as (select distinct query_id, y, head, rel, tail from seeds join u using (x)), two as (select query_id, u.head, u.rel, u.tail from (select distinct query_id, y from one) o join u on u.x = o.y)
select distinct query_id, head, rel, tail from (select query_id, head, rel, tail from one union all select * from two)
""")
def hub_facts(spark, sf_dir):
    """Facts two hops around nodes that have thousands of edges, which lie in parts of a few hundred."""
    for name in ("lineitem", "supplier", "nation", "region"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    edges = spark.sql(LINES).select(F.lower("src").alias("src_key"), F.lower("dst").alias("dst_key"), F.col("src").alias("src_id"), F.col("dst").alias("dst_id"), T.edge_type(F.col("rel")).alias("rel_type"))
    return graph.k_hop_facts(edges, spark.createDataFrame(HUB_SEEDS, "query_id int, node_key string"), 2, None, hub=500)


S_HITS = f"""select query_id::int as query_id, 0 as branch, rank as ctx_ord, 'Chunk ' || id as id, text, 'Vector Chunk' as source_type, score from (
  select query_id, p_partkey as id, p_name || ' in Europe' as text, list_dot_product({s_embedding("p_name || ' in Europe'")}, {s_embedding("question")}) as score,
    row_number() over (partition by query_id order by list_dot_product({s_embedding("p_name || ' in Europe'")}, {s_embedding("question")}) desc, p_partkey) as rank from part cross join ({S_QUESTIONS})) where rank <= 10"""
S_FACTS = f"select query_id, 1 as branch, i as ctx_ord, 'Graph Triplet ' || i::varchar as id, head || ' ' || rel || ' ' || tail as text, 'Knowledge Graph' as source_type, 0.0::double as score from (select *, row_number() over (partition by query_id order by head, rel, tail) - 1 as i from ({_s_facts(2, 60)}))"
S_RANKED = f"""
with met as (select query_id, branch, ctx_ord, id, text, source_type, score + 0.1 * len(list_filter(list_distinct({s_words("lower(text)")}), lambda w: list_contains({s_words("lower(question)")}, w))) as score
  from (({S_HITS}) union all ({S_FACTS})) join ({S_QUESTIONS}) using (query_id))
select query_id, row_number() over (partition by query_id order by score desc, branch, ctx_ord) as rank, id, text, source_type, score from met qualify rank <= 5"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = dealt(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" in Europe")).alias("text"))
    asked = questions(spark)
    hits = vector.search_many(vector.embed(items), asked.select("query_id", T.hash_embedding(F.col("question")).alias("emb")), 10)
    facts = graph.facts_as_contexts(_facts(spark, sf_dir, 2, 60))
    return retrieve.rerank(retrieve.evidence_union(vector.as_contexts(hits), facts), asked, 5)


@query(f"select query_id, rank::bigint as rank, id, text, source_type, round(score, 9) as score from ({S_RANKED})")
def evidence_union_rerank(spark, sf_dir):
    return _ranked(spark, sf_dir).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "text", "source_type", F.round("score", 9).alias("score"))


@query(f"""
select query_id, {s_strip(f"{quoted(retrieve.TITLE)} || chr(10) || string_agg(block, chr(10) order by rank)")} as context
from (select query_id, rank, chr(10) || '## [' || id || '] (Source: ' || source_type || ' | Score=' || printf('%.3f', score) || ')' || chr(10) || text || chr(10) as block from ({S_RANKED})) group by query_id
""")
def synthesis_context(spark, sf_dir):
    return retrieve.synthesis_context(_ranked(spark, sf_dir))
