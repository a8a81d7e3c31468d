"""Exhaustive search of many questions against plain sums: ties, several blocks, ragged and missing vectors, fewer items than asked for."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import vector


@pytest.mark.parametrize(("k", "block", "sent"), [(3, 5_000, 1 << 20), (3, 4, 1 << 20), (3, 4, 0), (100, 7, 0)])
def test_search_many(spark, monkeypatch, k, block, sent):
    monkeypatch.setattr(vector, "BLOCK", block)
    monkeypatch.setattr(vector, "ITEMS", 9)
    monkeypatch.setattr(vector, "SCORES", 40)
    monkeypatch.setattr(vector, "SENT", sent)
    rng = random.Random(k)
    value = lambda n: [rng.choice([-1.0, 0.0, 0.5, 0.25]) for _ in range(n)]
    items = [(i, value(rng.choice([3, 4, 5])) if i % 9 else None, f"t{i}") for i in range(40)]
    questions = [(f"q{i}", value(4)) for i in range(12)] + [("none", None)]
    got = vector.search_many(spark.createDataFrame(items, "id long, emb array<double>, text string").repartition(3), spark.createDataFrame(questions, "query_id string, emb array<double>"), k)
    want = []
    for q, v in questions:
        scored = sorted(((-sum(a * b for a, b in zip(e, v, strict=False)), i, t) for i, e, t in items if e is not None) if v else [])
        want += [(q, n + 1, i, t, -s) for n, (s, i, t) in enumerate(scored[:k])]
    assert sorted((r["query_id"], r["rank"], r["id"], r["text"], r["score"]) for r in got.collect()) == sorted(want)


def test_search_many_of_nothing(spark):
    items = spark.createDataFrame([(1, [1.0])], "id long, emb array<double>")
    none = spark.createDataFrame([], "query_id int, emb array<double>")
    assert vector.search_many(items, none).count() == 0
    assert vector.search_many(items.limit(0), spark.createDataFrame([(1, [1.0])], none.schema)).count() == 0


def test_bounds_leave_out_only_what_is_below():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.05, (50, 6)) for c in rng.normal(0, 2, (12, 6))])
    groups, asking = vector.Clusters(x), rng.normal(0, 1, (20, 6))
    assert sorted(groups.order.tolist()) == list(range(len(x))) and (groups.x == x[groups.order]).all()
    products, most = groups.x @ asking.T, groups.most(asking)
    for g, (a, b) in enumerate(zip(groups.cuts, groups.cuts[1:], strict=False)):
        assert (products[a:b] <= most[g] + 1e-9).all()
    fifth = np.sort(products, axis=0)[-5]
    assert (most < fifth).mean() > 0.5  # so that most groups need no look


def test_items_are_read_once(spark):
    items = spark.range(1000).selectExpr("id", "array(cast(id as double), 1.0D) as emb")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    questions = spark.range(50).selectExpr("id as query_id", "array(cast(id - 25 as double), 0.0D) as emb")
    got = vector.search_many(items.mapInArrow(count, items.schema), questions, 2).collect()
    assert seen.value == 1000
    assert {(r["query_id"], r["rank"]): r["id"] for r in got if r["query_id"] != 25} == {(q, n): (999 - n + 1 if q > 25 else n - 1) for q in range(50) if q != 25 for n in (1, 2)}


def test_vectors_are_made_once(spark):
    """Also where rows were dealt out before, and rows without a vector are left out."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def embedder(text):
        made.add(1)
        return None if text == "7" else [1.0, float(text)]

    items = vector.embed(spark.range(40).withColumn("text", F.col("id").cast("string")).repartition(4), embedder)
    asked = spark.createDataFrame([(1, [0.0, 1.0])], "query_id int, emb array<double>")
    hits = sorted((r["rank"], r["id"]) for r in vector.search_many(items, asked, 40).collect())
    assert hits == list(enumerate([i for i in range(39, -1, -1) if i != 7], 1))
    assert made.value == 40
