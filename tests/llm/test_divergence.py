"""Source divergence against plain Python, with sketches so narrow that cells are shared."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomtext.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, docs long"


def brute(rows: list[tuple], least: int, smooth: int, top: int) -> set[tuple]:
    held: dict[str, Counter] = defaultdict(Counter)
    groups: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        words = TERM.findall((text or "").translate(AZ))
        held[lang or ""].update(set(words))
        groups[lang or "", source or ""].update(words)
    out = set()
    for lang, docs in held.items():
        kept = {t for t, n in docs.items() if n >= least}
        here = {s: Counter({t: n for t, n in c.items() if t in kept}) for (g, s), c in groups.items() if g == lang}
        share = lambda c, t: 1 + 10**9 * (c[t] + smooth) // (c.total() + smooth * len(kept))  # noqa: B023, E731
        whole = sum(here.values(), Counter())
        for s, c in here.items():
            found = sorted(((-sum(abs(share(c, t) - share(d, t)) for t in kept), o.encode()) for o, d in here.items() if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(found)}
            terms = sorted((share(whole, t) - share(c, t), t.encode()) for t in kept if c[t] and share(c, t) > share(whole, t))
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms[:top])}
    return out


def corpus() -> list[tuple]:
    rng = random.Random(11)
    words = ["".join(rng.choices("abcdeéß漢", k=rng.randint(1, 4))) for _ in range(150)] + ["Ab", "aB", "É"]
    rows = []
    for i in range(300):
        lang, source = rng.choice(["en", "en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "ü", "", None])
        rows.append((i, rng.choice([" ", "1", "\n", "-", "\0"]).join(rng.choices(words, k=rng.randint(0, 60))), lang, source, "x", 1, 2))
    return [*rows, (None, None, "en", "no text"), (5, "", "xx", "lone"), (5, "a " * 20_000, "en", "a"), *rows[:20], (7, "!!", None, "b"), (8, "1 2", "none", "p"), (9, None, "none", "q")]


@pytest.mark.parametrize(("cells", "least"), [(1, 3), (16, 8), (1, 1)])
def test_against_plain_python(spark, cells, least, monkeypatch):
    rows = [(*r, *[None] * (7 - len(r))) for r in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = divergence.audit(docs, least=least, smooth=5, top=4, cells=cells)
    assert {tuple(r) for r in found.collect()} == brute(rows, least, 5, 4)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert found.schema["value"].dataType.simpleString() == "bigint" and found.schema["rank"].dataType.simpleString() == "int"


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sketch_never_underestimates_and_prunes(spark):
    rows = [(*r, *[None] * (7 - len(r))) for r in corpus()]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("coalesce(lang, '') as lang", "coalesce(text, '') as text").repartition(5)
    held: dict[tuple[str, str], int] = Counter()
    for r in docs.collect():
        held.update((r["lang"], t) for t in set(TERM.findall(r["text"].translate(AZ))))
    for width in (64, 1 << 16):
        cells = {r["cell"]: r["n"] for r in divergence.sketch(docs, width).collect()}
        least = {k: min(cells[c] for c in divergence.cells_of(k[0], [k[1].encode()], width)[:, 0].tolist()) for k in held}
        assert all(least[k] >= n for k, n in held.items())
    assert sum(least[k] != n for k, n in held.items()) < 0.02 * len(held)  # a wide sketch is nearly exact
    bits = divergence.bitmap(divergence.sketch(docs, width), 30, width)
    set_ = {c for c in cells if np.unpackbits(bits, bitorder="little")[c]}
    assert set_ == {c for c, n in cells.items() if n >= 30}


def test_shares_are_exact_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n, total, terms = 6 * 10**17, 7 * 10**18, 10**9
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms), 5).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 5) // (total + 5 * terms)
