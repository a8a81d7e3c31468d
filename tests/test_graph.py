"""Extraction, graph, retrieval and the whole plan on worked examples; queries against their SQL."""

from __future__ import annotations

import hashlib
import json
import os
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__
from loomtext.config import Calling
from loomtext.operators import extract, graph, retrieve
from loomtext.plans import built_queries, catalogue, graph_queries, pipeline
from loomtext.sources import readers, sinks
from loomtext.streaming.ingest import graph_stream, index_stream

E = "doc_id long, chunk_rank int, pos int, name string, type string"
R = "doc_id long, chunk_rank int, pos int, head string, head_type string, relation string, tail string, tail_type string, evidence string"


def test_dedupe_and_nodes(spark):
    entities = spark.createDataFrame([(1, 0, 0, "BERT", "Model"), (1, 0, 1, "bert", "Model"), (1, 0, 2, "bert", "Method"), (1, 0, 3, "28.4", "Metric")], E)
    relations = spark.createDataFrame([(1, 0, i, h, None, r, t, "X", None) for i, (h, r, t) in enumerate([("AA", "uses", "BERT"), ("aa", "USES", "bert"), ("BERT", "USES", "AA"), ("x", "uses", "BERT")])], R)
    first = graph.dedupe_entities(entities)
    assert sorted((r["name"], r["type"]) for r in first.collect()) == [("BERT", "Model"), ("bert", "Method")]
    kept = graph.dedupe_relations(relations)
    assert kept.count() == 3
    nodes = graph.build_nodes(first, kept)
    assert sorted((r["id"], r["type"]) for r in nodes.collect()) == [("AA", "Concept"), ("BERT", "Model")]
    edges = graph.build_edges(kept, nodes)
    assert sorted((r["src_id"], r["rel_type"], r["dst_id"]) for r in edges.collect()) == [("AA", "USES", "BERT"), ("BERT", "USES", "AA")]


def test_json(spark):
    good = {"entities": [{"id": "a", "type": "T"}, {"id": "A", "type": "U"}], "relations": [{"source": "a", "target": "b", "predicate": "p q", "evidence": ""}]}
    broken = {"entities": [{"id": "a", "type": "T"}], "relations": [{"source": "a", "target": "b", "predicate": "p"}]}
    raws = [json.dumps(good), f"so:\n```json\n{json.dumps(good)}\n``` }}", json.dumps(broken), "[1]", None, "{", '{"entities": null}']
    rows = spark.createDataFrame(list(enumerate(raws)), "doc_id long, raw string").select("doc_id", F.lit(1).alias("chunk_rank"), extract.parse_strict(F.col("raw")).alias("parsed"))
    assert sorted((r["doc_id"], r["name"]) for r in extract.entities_of(rows).collect()) == [(0, "A"), (0, "a"), (1, "A"), (1, "a")]
    assert [tuple(r)[3:] for r in extract.relations_of(rows).filter("doc_id = 0").collect()] == [("a", "U", "P_Q", "b", "Concept", None)]


def failing(folder: str, after: int):
    """Makes models that answer with a prompt's length and end and note each call in a folder; while a file named fail is there, calls after the first ones fail."""

    def make():
        done = []

        def model(text: str) -> str:
            if os.path.exists(f"{folder}/fail") and len(done) >= after:
                raise RuntimeError("no more")
            done.append(text)
            with open(f"{folder}/{hashlib.md5(text.encode()).hexdigest()}", "a") as f:
                f.write("x")
            return f"answer {len(text)} {text[-12:]}"

        return model

    return make


def calls(folder) -> dict[str, int]:
    return {p.name: len(p.read_text()) for p in folder.iterdir() if p.name != "fail"}


def test_answers_are_asked_for_once(spark, tmp_path):
    """A run that fails midway keeps what it was told; the next one asks only for the rest, and a third for nothing; equal prompts are one."""
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "fail").touch()
    folder, store = str(notes), str(tmp_path / "store")
    texts = [f"text of chunk {i % 40}" for i in range(60)] + [None]
    chunks = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    how = Calling(attempts=1, in_flight=3, stored_at_once=2)
    with pytest.raises(PySparkException):
        extract.responses(chunks, failing(folder, 4), how, store)
    first = calls(notes)
    assert 0 < len(first) < 40 and extract.stored_answers(spark, store).count() > 0
    kept = {r["digest"] for r in extract.stored_answers(spark, store).collect()}
    (notes / "fail").unlink()
    rows = extract.responses(chunks, failing(folder, 4), how, store).collect()
    want = {t: extract.PROMPT.replace(extract.PLACEHOLDER, t) for t in texts if t}
    assert {(r["doc_id"], r["raw"]) for r in rows} == {(i, f"answer {len(want[t])} {want[t][-12:]}" if t else None) for i, t in enumerate(texts)}
    again = calls(notes)
    name = lambda t: hashlib.md5(want[t].encode()).hexdigest()
    digest = lambda t: hashlib.sha256(want[t].encode()).hexdigest()
    assert len(again) == 40 and all(again[name(t)] == first[name(t)] for t in want if digest(t) in kept)
    assert sum(again.values()) - sum(first.values()) == 40 - len(kept)
    assert extract.responses(chunks, failing(folder, 0), how, store).count() == 61 and calls(notes) == again


def test_calls_stay_in_order(spark):
    """Many calls at once, of which later ones end sooner."""
    slow = lambda: lambda text: (time.sleep(0.02 if text.endswith("0") else 0), text[-3:])[1]
    chunks = spark.createDataFrame([(i, f"{i:03d}") for i in range(50)], "doc_id long, text string").coalesce(1)
    assert [(r["doc_id"], int(r["raw"])) for r in extract.responses(chunks, slow, Calling(in_flight=8)).collect()] == [(i, i) for i in range(50)]


def test_failed_calls_wait_aside():
    """Waits for a next try run beside each other and beside other calls, of which in_flight are under way at most; answers keep their places."""
    seen, under_way, most = set(), [0], [0]
    lock = threading.Lock()

    def model(text: str) -> str:
        with lock:
            under_way[0] += 1
            most[0] = max(most[0], under_way[0])
        try:
            if int(text) % 4 == 0 and text not in seen:
                seen.add(text)
                raise TimeoutError("ask again")
            return text
        finally:
            with lock:
                under_way[0] -= 1

    for in_flight in (1, 3):
        seen.clear()
        most[0] = 0
        start = time.monotonic()
        told = list(extract._answered(model, map(str, range(400)), Calling(pause=0.1, in_flight=in_flight)))
        assert time.monotonic() - start < 5  # one after another they take 10 s at least
        assert sorted((at, text, raw) for at, text, raw in told) == [(i, str(i), str(i)) for i in range(400)] and most[0] <= in_flight


def test_calls_end_with_one_that_fails_at_every_try():
    def model(text: str) -> str:
        if text == "3":
            raise ValueError("never")
        return text

    told = []
    with pytest.raises(ValueError, match="never"):
        for at, _, raw in extract._answered(model, map(str, range(10**6)), Calling(pause=0.0, attempts=2, in_flight=2)):
            told.append((at, raw))
    assert {(i, str(i)) for i in range(3)} <= set(told) and all(str(i) == raw != "3" for i, raw in told)


def test_narrow_rows_are_dealt_out(spark, sf):
    """One small file of rows that take long each is no work for one task."""
    for name in ("extracted_entities", "json_entities", "json_relation_list"):
        assert catalogue.QUERIES[name](spark, sf).rdd.getNumPartitions() >= 4, name


def test_graphs_are_made_once(spark, sf, tmp_path):
    """Nodes and edges are read from what was written: whoever reads them makes neither the dedupes nor the parsing again."""
    docs = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    answer = '{"entities":[{"id":"AA","type":"T"}],"relations":[{"source":"AA","target":"BB","predicate":"p","evidence":"e"}]}'
    known = pipeline.build(docs, lambda: lambda _: answer, str(tmp_path / "built"), calling=Calling(pause=0.0))
    for df in (known.nodes, known.edges, *graph_queries._graph(spark, sf)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert not any(x in plan for x in ("Aggregate", "Join", "Python", "UDF")), plan


def test_hops_and_rerank(spark):
    edges = spark.createDataFrame([(a, b, a, b, "r") for a, b in ("ab", "bc", "cd")], "src_key string, dst_key string, src_id string, dst_id string, rel_type string")
    seeds = spark.createDataFrame([(1, "a")], "query_id int, node_key string")
    facts = lambda k: sorted(r["head"] + r["tail"] for r in graph.k_hop_facts(edges, seeds, k).collect())
    assert [facts(1), facts(2), facts(3)] == [["ab"], ["ab", "bc"], ["ab", "bc", "cd"]]
    ctx = spark.createDataFrame([(1, 0, 1, "c", "b c", "s", 0.5), (1, 1, 0, "d", "b c", "s", 0.5)], "query_id int, branch int, ctx_ord long, id string, text string, source_type string, score double")
    ranked = retrieve.rerank(ctx, spark.createDataFrame([(1, "a b b")], "query_id int, question string"))
    assert [(r["id"], round(r["score"], 9)) for r in ranked.orderBy("rank").collect()] == [("c", 0.6), ("d", 0.6)]
    assert retrieve.synthesis_context(ranked.withColumn("score", F.lit(0.0625))).first()["context"].count("Score=0.062") == 2


def test_rerank_model(spark):
    """A model's scores decide; where it fails, or can't be made, a question goes by shared words."""
    ctx = spark.createDataFrame([(q, 0, i, t, t, "s", 0.5) for q in (1, 2) for i, t in enumerate(("b c", "longer text", "bad"))], "query_id int, branch int, ctx_ord long, id string, text string, source_type string, score double")
    questions = spark.createDataFrame([(1, "a b"), (2, "fail b")], "query_id int, question string")
    ids = lambda make, q: [r["id"] for r in retrieve.rerank(ctx.repartition(1), questions.filter(f"query_id = {q}"), make=make).orderBy("rank").collect()]

    def make():
        def model(asked, texts):
            if any(q.startswith("fail") for q in asked):
                raise RuntimeError("no score")
            return [len(t) for t in texts]

        return model

    assert ids(make, 1) == ["longer text", "b c", "bad"]
    assert ids(make, 2) == ids(lambda: 1 / 0, 2) == ids(None, 2) == ["b c", "longer text", "bad"]
    assert ids(lambda: lambda asked, texts: [1.0] * (len(texts) + 1), 1) == ["b c", "longer text", "bad"]


def test_seeds(spark):
    ids = ["Deep Transformer", "transform", "TRANSFORMERS", "ran", "", "née Ångström", "aaaa", "xaaaaax", "%_ab"]
    nodes = spark.createDataFrame([(x.lower(), x) for x in ids], "node_key string, id string")
    asked = {1: "Which Transformer aaaa is Ångström", 2: "ran a bc", 3: "%_ab aaaaa transform", 4: ""}
    got = graph.seed_match(nodes, spark.createDataFrame(list(asked.items()), "query_id int, question string"))
    want = {(q, x.lower()) for q, text in asked.items() for w in text.lower().split() if len(w) >= 4 for x in ids if w in x.lower()}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_rarest_runs(spark):
    """Common beginnings are no keys: terms meet ids by the run that fewest ids have."""
    ids = [f"transfer {i:03d}" for i in range(300)] + ["transformer", "transport x", "übertrag"]
    nodes = spark.createDataFrame([(x, x) for x in ids], "node_key string, id string")
    asked = spark.createDataFrame([(1, "transformer transport"), (2, "Transfer"), (3, "transfix übertrag")], "query_id int, question string")
    got = graph.seed_match(nodes, asked)
    want = {(1, "transformer"), (1, "transport x"), (3, "übertrag")} | {(2, x) for x in ids[:300]}
    assert set(map(tuple, got.collect())) == want
    assert compared(got._jdf.queryExecution().executedPlan()) == 300 + 3  # pairs of an id and a term that were looked at, not 303 for each of "transformer" and "transport"


def compared(plan) -> int:
    """Rows out of the join of ids and terms on runs, whose condition is that the id contains the term."""
    seen, todo = [], [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.finalPhysicalPlan())
            continue
        if "QueryStage" in name:
            todo.append(node.plan())
            continue
        if "Join" in name and "Contains" in node.simpleString(1000):
            seen.append(node)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return max(int(n.metrics().apply("numOutputRows").value()) for n in seen)


def test_hubs_are_dealt_out(spark):
    """Edges of a node beyond the bound lie in parts of about the bound, and hops over them give what they give without parts."""
    star = [(f"s{i}", "hub", f"s{i}", "hub", "r") for i in range(4000)] + [(f"s{i}", f"s{i + 1}", f"s{i}", f"s{i + 1}", "t") for i in range(0, 4000, 7)] + [("hub", None, "hub", "x", "r"), ("s1", "s2", None, "s2", "r")]
    edges = spark.createDataFrame(star, "src_key string, dst_key string, src_id string, dst_id string, rel_type string")
    near, heavy = graph.dealt_adjacency(edges, hub=100)
    assert [tuple(r) for r in heavy.collect()] == [("hub", 41)]
    sizes = [r["count"] for r in near.filter("node_key = 'hub'").groupBy("part").count().collect()]
    assert len(sizes) == 41 and max(sizes) < 3 * sorted(sizes)[20]
    assert graph.dealt_adjacency(edges, hub=100, hubs=1)[1].count() == 0  # fewer hubs than the bound says, whatever the graph
    seeds = spark.createDataFrame([(1, "s0"), (2, "hub"), (2, "s5"), (3, None)], "query_id int, node_key string")
    for hops in (1, 2, 3):
        got, want = (sorted(map(tuple, graph.k_hop_facts(edges, seeds, hops, None, hub=hub).collect())) for hub in (100, 10**9))
        assert got == want and len(got) > 1


def test_graph_page(spark, tmp_path):
    """All edges of a document, more than a page's reader sees at once, and no other document's."""
    edges = spark.createDataFrame([(d, f"<a{i}>", "R", f"b{i}") for d in (1, 2) for i in range(3000)], "doc_id long, src_id string, rel_type string, dst_id string")
    nodes = spark.createDataFrame([(1, f"<a{i}>", "T") for i in range(5000)], "doc_id long, id string, type string")
    page = open(sinks.graph_page(nodes, edges, 1, str(tmp_path / "page.html")), encoding="utf-8").read()
    data = page.split("id='graph'>")[1].removesuffix("</script>")
    assert page.count("<tr>") == len(json.loads(data)["edges"]) == 3000 and len(json.loads(data)["nodes"]) == 5000 and "<" not in data


def test_commits(spark, tmp_path):
    """A job that fails between its tables leaves nothing to see; a batch that is written again adds nothing."""
    path = str(tmp_path / "graph")
    nodes = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "doc_id long, id string")
    edges = lambda *ids: spark.createDataFrame([(i, f"e{i}") for i in ids], "doc_id long, src_id string")
    broken = edges(2).withColumn("src_id", F.raise_error(F.lit("midway")).cast("string"))
    seen = lambda: [sorted(r["doc_id"] for r in t.collect()) if (t := sinks.committed(spark, path, n)) is not None else None for n in ("nodes", "edges")]
    assert seen() == [None, None]
    assert not sinks.write_graph(nodes(2), broken, path, "b") and seen() == [None, None]
    assert sinks.write_graph(nodes(1), edges(1), path, "a") and seen() == [[1], [1]]
    assert not sinks.write_graph(nodes(2), broken, path, "b") and seen() == [[1], [1]]
    assert sinks.write_graph(nodes(2, 3), edges(2, 3), path, "b") and sinks.write_graph(nodes(2, 3), edges(2, 3), path, "b") and seen() == [[1, 2, 3]] * 2
    assert sinks.write_index(nodes(7), path, "a index") and not sinks.write_index(nodes(7), path, "a index")
    assert sinks.committed(spark, path, "index").count() == 1 and seen() == [[1, 2, 3]] * 2
    with ThreadPoolExecutor(4) as pool:  # several at once: each batch once, none lost
        list(pool.map(lambda i: sinks.commit({"nodes": nodes(100 + i % 5)}, path, f"t{i % 5}"), range(10)))
    assert seen() == [[1, 2, 3, 100, 101, 102, 103, 104], [1, 2, 3]]


def test_graph_stream(spark, tmp_path):
    """Files become versions of the graph; a run over what was read before adds nothing, also where the stream has lost its place."""
    answer = lambda: lambda prompt: '{"entities":[{"id":"' + prompt.rsplit(" ", 1)[1] + '","type":"Word"}],"relations":[]}'
    docs = spark.createDataFrame([(i, f"a text that ends in word{i}") for i in range(6)], "doc_id long, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    names = lambda: sorted(r["id"] for r in sinks.committed(spark, str(tmp_path / "g"), "nodes").collect())
    for checkpoint in ("ck", "ck", "other"):
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs"))
        graph_stream(stream, answer, str(tmp_path / "g"), str(tmp_path / checkpoint), calling=Calling(pause=0.0)).awaitTermination()
        assert names() == [f"word{i}" for i in range(6)]


def test_plan(spark, tmp_path):
    answer = '{"entities":[{"id":"Alpha","type":"Model"}],"relations":[{"source":"Alpha","target":"Beta set","predicate":"uses","evidence":"e"}]}'
    docs = spark.createDataFrame([(1, "Alpha uses the Beta set. " * 40), (2, ""), (3, None)], "doc_id long, text string")
    known = pipeline.build(docs, lambda: lambda prompt: answer, str(tmp_path), calling=Calling(pause=0.0))
    questions = spark.createDataFrame([(7, "what does Alpha use")], "query_id int, question string")
    ranked, contexts = pipeline.ask(questions, known)
    assert {r["source_type"] for r in ranked.collect()} == {"Vector Chunk", "Knowledge Graph"}
    assert "Alpha USES Beta set" in contexts.first()["context"]
    assert pipeline.answers(contexts, questions, lambda: lambda p: 1 / 0).first()["answer"].startswith("Synthesis Failed")
    assert sinks.write_graph(known.nodes, known.edges, str(tmp_path / "g")) and sinks.graph_page(known.nodes, known.edges, 1, str(tmp_path / "g.html")) and sinks.graph_page(known.nodes, known.edges, 9, "x") is None
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("é".encode("latin-1"))
    assert readers.read_texts(spark, str(tmp_path / "in")).first()["text"] == "é"
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    index_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "index"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "index")).count() == 1


def test_elements(spark):
    rows = [(1, 0, "p", " lead "), (1, 1, "h1", "One"), (1, 2, "formula", "x"), (1, 3, "table", "|t|"), (1, 4, "h2", "Empty"), (1, 5, "h2", "Two"), (1, 6, "li", "end")]
    got = readers.element_sections(spark.createDataFrame(rows, "doc_id long, pos int, tag string, text string"))
    assert [(r["section_no"], r["heading"], r["text"], r["formulas"], r["tables"]) for r in got.orderBy("section_no").collect()] == [(0, "Abstract", "lead", [], []), (1, "One", "[Formula: x]\n\n\n|t|", ["x"], ["|t|"]), (2, "Two", "end", [], [])]
    assert readers.flatten_sections(got).first()["text"].startswith("## Abstract\n\nlead\n\n## One")


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "lineitem", "documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf)
    want = con.execute(f"select {', '.join(df.columns)} from ({catalogue.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 10


def test_seeds_are_found_once(spark):
    """Hops read what was found as seeds, and don't look for it again to know what was visited."""
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def found(key):
        looked.add(1)
        return key

    edges = spark.createDataFrame([(a, b, a.upper(), b.upper(), "R") for a, b in ("ab", "bc", "cd", "de")], "src_key string, dst_key string, src_id string, dst_id string, rel_type string")
    seeds = spark.createDataFrame([(1, "a"), (2, "e"), (2, "zz")], "query_id int, node_key string").withColumn("node_key", found("node_key"))
    got = sorted((r["query_id"], r["head"], r["tail"]) for r in graph.k_hop_facts(edges, seeds, 2, None).collect())
    assert got == [(1, "A", "B"), (1, "B", "C"), (2, "C", "D"), (2, "D", "E")]
    assert looked.value == 3


def test_read_back_is_whole_or_fails(spark, sf, monkeypatch):
    """A graph of which a batch can't be written is no result, and rows without a doc_id are in one of the batches."""
    nodes = spark.createDataFrame([(1, "a", "A", "T"), (2, "b", "B", "T"), (None, "c", "C", "T")], "doc_id long, node_key string, id string, type string")
    edges = spark.createDataFrame([(1, "a", "R", "a"), (2, "b", "R", "b")], "doc_id long, src_key string, rel_type string, dst_key string")
    broken = lambda doc_id: edges.withColumn("dst_key", F.when(F.col("doc_id") == doc_id, F.raise_error(F.lit("midway"))).otherwise(F.col("dst_key")))
    for doc_id in (1, 2):
        monkeypatch.setattr(built_queries, "_graph", lambda *_, table=broken(doc_id): (nodes, table))
        with pytest.raises(PySparkException, match="midway"):
            built_queries.graph_read_back(spark, sf)
    monkeypatch.setattr(built_queries, "_graph", lambda *_: (nodes, edges))
    assert sorted((r["kind"], r["key"]) for r in built_queries.graph_read_back(spark, sf).collect()) == [("edge", "a"), ("edge", "b"), ("node", "a"), ("node", "b"), ("node", "c")]
