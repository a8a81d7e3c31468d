"""Each operator's query against a brute-force version on a small table, and its defined results on edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomtext.llm import decontaminate, langid, licenses, maxent, minhash, queries, repeats, winnow
from loomtext.llm.graph import components
from loomtext.llm.sql import ORACLES

WORD3 = re.compile(r"[^\x20\x09-\x0D]+")
WORD4 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = {c: c + 32 for c in range(65, 91)}
SCHEMA = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])


def grown_texts() -> list[str | None]:
    """Texts with exact and near copies, shared passages, benchmark passages, blank, empty, null and long ones."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghiknorstu", k=rng.randint(1, 9))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    texts: list[str | None] = [prose(rng.randint(1, 300)) for _ in range(60)]
    for _ in range(60):
        base = rng.choice(texts[:60]).split(" ")
        for _ in range(rng.randint(0, max(1, len(base) // 25))):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base))
    passage = prose(60)
    texts += [f"{prose(20)} {passage} {prose(9)}" for _ in range(5)] + [texts[4].upper(), texts[4] + "  ", f"\t{texts[4]}\n"] + [texts[7]] * 4
    texts += [None, "", " \n\t ", "one two three", "One  two\nthree", "a b c d e", "x" * 400, "ab" * 300, "Ünïcödé – straße " * 40, prose(20_000)]
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def small(tmp_path_factory) -> str:
    folder, texts = tmp_path_factory.mktemp("small"), grown_texts()
    rng = random.Random(5)
    ids = rng.sample(range(10_000), len(texts))
    rows = [{"doc_id": i, "text": t, "lang": rng.choice(["en", "de", None]), "source": "s", "n_chars": len(t or "")} for i, t in zip(ids, texts, strict=True)]
    pq.write_table(pa.Table.from_pylist(rows, SCHEMA), folder / "documents.parquet")
    items = []
    for n in (1, 3, 9, 10, 11, 40):
        source = next(t for t in sorted((x for x in texts if x), key=len) if len(WORD4.findall(t)) > n + 60)
        items += [{"item_id": n, "text": ", ".join(WORD4.findall(source)[7 : 7 + n]).upper()}]
    items += [{"item_id": 100, "text": "words that no text has anywhere in it at all today"}, {"item_id": 101, "text": None}, {"item_id": 102, "text": "..."}]
    pq.write_table(pa.Table.from_pylist(items, pa.schema([("item_id", pa.int64()), ("text", pa.string())])), folder / "benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module", params=["small", "sf"])
def data(request, small, sf):
    return small if request.param == "small" else sf


def rows_of(data: str, name: str = "documents") -> list[dict]:
    return pq.read_table(f"{data}/{name}.parquet").to_pylist()


def found(spark, name: str, data: str) -> list[tuple]:
    return sorted(tuple(r) for r in queries.QUERIES[name](spark, data).collect())


def shingles(text: str | None) -> frozenset:
    w = WORD3.findall((text or "").translate(AZ))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_op3(spark, data):
    docs = [(r["doc_id"], shingles(r["text"])) for r in rows_of(data)]
    root = {i: i for i, _ in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(docs):
        for j, b in docs[:k]:
            if a and b and 100 * len(a & b) >= 85 * len(a | b) and find(i) != find(j):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    assert found(spark, "op3_minhash", data) == sorted((i, len(s), find(i), find(i) == i) for i, s in docs)


def linked(rows: list[tuple], percent: int) -> list[tuple]:
    """(doc_id, set size, smallest id of the group, whether kept) of rows (doc_id, text), texts told apart by their sets; ids null last."""
    sets = [(1 << 62 if i is None else i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:k]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(k)] = find(j)
    return [(i, len(s), min(sets[j][0] for j in range(len(sets)) if find(j) == find(k)) if s else i, find(k)) for k, (i, s) in enumerate(sets)]


def test_op3_null_and_repeated_ids(spark):
    """Different texts under one id, or without one, are told apart, and link each with their own copies."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    prose = lambda: rng.choices(words, k=80)
    one, two, three, four = prose(), prose(), prose(), prose()
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(one)), (2, " ".join(two)), (None, near(one)), (None, near(two)), (5, " ".join(three)), (5, " ".join(four)), (8, near(four)), (9, near(three)), (None, " ".join(prose())), (None, None), (3, ""), (3, "a b"), (None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 1 << 62, r["n_shingles"], r["component_id"] if r["component_id"] is not None else 1 << 62) for r in minhash.near_duplicates(docs, percent=85).collect())
    assert got == sorted(x[:3] for x in linked(rows, 85))
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in minhash.without_near_duplicates(docs, percent=85).collect())
    want = [(1, 0), (2, 1), (5, 4), (5, 5), (None, 8), (None, 9), (3, 10), (3, 11)]
    assert kept == sorted((str(i), rows[k][1] or "") for i, k in want)


def test_op4(spark, data):
    windows: dict[tuple, set[str]] = defaultdict(set)
    for r in rows_of(data, "benchmark"):
        w = WORD4.findall((r["text"] or "").translate(AZ))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(str(r["item_id"]))
    lengths, out = {len(w) for w in windows}, []
    for r in rows_of(data):
        w, hit, items = WORD4.findall((r["text"] or "").translate(AZ)), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (key := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    items |= windows[key]
        out.append((r["doc_id"], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    assert found(spark, "op4_decontamination", data) == sorted(out)
    assert any(x[5] for x in out)


@pytest.mark.parametrize("length", [1, 2, 5, 20, 23, 25, 51, 138, 160, 201, 300])
def test_op7_of_any_length(spark, length):
    rng = random.Random(length)
    text = lambda n: "".join(rng.choices("abé\0 ", k=n))
    parts = [text(rng.randint(length // 2, 2 * length)) for _ in range(6)]
    rows = [(rng.choice([None, *range(20)]), "".join(rng.choices(parts, k=rng.randint(0, 3))) + text(rng.randint(0, 9))) for _ in range(30)]
    least: dict[bytes, int] = {}
    want = []
    for doc_id, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        b, me = t.encode(), 1 << 62 if doc_id is None else doc_id
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if least.setdefault(b[i : i + length], me) < me:
                gone[i : i + length] = b"\1" * length
        want.append((str(doc_id), len(b), sum(gone), len(re.findall(b"\1+", gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = repeats.remove_repeats(docs, length=length).select(F.col("doc_id").cast("string"), "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(("None" if r[0] is None else r[0], *r[1:]) for r in found) == sorted(want)


def test_op7(spark, data):
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in rows_of(data))
    least: dict[bytes, int] = {}
    out = []
    for doc_id, b in docs:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if least.setdefault(b[i : i + 50], doc_id) < doc_id:
                gone[i : i + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", gone))
        out.append((doc_id, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    assert found(spark, "op7_suffix_dedup", data) == out
    assert any(x[2] for x in out)


def test_op6(spark, data):
    docs = sorted((r["doc_id"], r["text"] or "") for r in rows_of(data))
    out = {r["doc_id"]: r for r in queries.op6_winnowing(spark, data).collect()}
    texts = []
    for i, (doc_id, text) in enumerate(docs):
        follows, half = docs[(i + 1) % len(docs)][1], len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        texts.append((doc_id, text, edited, follows))
        assert out[doc_id]["n_chars"] == len(text) and out[doc_id]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()

    def words_of(t: str) -> list[str]:
        w = [x for x in re.split("[\t-\r ]+", t.lower()) if x]
        return [y for x in w for y in (x if len(x) > 32 else [x])]

    every = {x for _, a, b, _ in texts for t in (a, b) for x in words_of(t)}
    short = {tuple(w) for _, a, b, _ in texts for t in (a, b) if 0 < len(w := words_of(t)) < 5}
    one = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in every], "w string").select("w", F.expr(f"pmod(xxhash64(w), {winnow.PRIME})").alias("h")).collect()}
    whole = {tuple(r["w"]): r["h"] for r in spark.createDataFrame([(list(w),) for w in short], "w array<string>").select("w", F.expr(f"pmod(xxhash64(w), {winnow.PRIME})").alias("h")).collect()}

    def rolling(w: list[str]) -> list[int]:
        h, found = 0, []
        for i, x in enumerate(w):
            h = (h * winnow.BASE + one[x] - (one[w[i - 5]] * winnow.BASE**5 if i >= 5 else 0)) % winnow.PRIME
            if i >= 4:
                found.append(h)
        return found

    def winnowed(text: str) -> list[tuple[int, int]]:
        w = words_of(text)
        h = rolling(w) if len(w) >= 5 else [whole[tuple(w)]] if w else []
        picked: list[tuple[int, int]] = []
        for i in range(max(1, len(h) - 11) if h else 0):
            part = h[i : i + 12]
            at = i + max(j for j, x in enumerate(part) if x == min(part))
            if not picked or picked[-1][1] != at:
                picked.append((h[at], at))
        return picked

    def alike(a: list, b: list) -> float:
        x, y = {h for h, _ in a}, {h for h, _ in b}
        return len(x & y) / len(x | y) if x | y else 1.0

    for doc_id, text, edited, follows in texts:
        a, b, c = winnowed(text), winnowed(edited), winnowed(follows)
        r = out[doc_id]
        assert r["fingerprint"] == ",".join(f"{h:x}:{i}" for h, i in a) and r["edited_fingerprint"] == ",".join(f"{h:x}:{i}" for h, i in b)
        assert r["near_edited"] == pytest.approx(alike(a, b)) and r["near_next"] == pytest.approx(alike(a, c))


def test_op6_without_blanks(spark):
    """Texts of scripts without blanks, and long runs, share hashes with their near copies; other texts none."""
    rng = random.Random(2)
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(n))
    run = lambda n: "".join(rng.choices("abcdef0123456789{};=\U00010437", k=n))
    rows = []
    for make in (han, run):
        text = make(200)
        rows += [(len(rows), text), (len(rows) + 1, text[:90] + make(20) + text[90:]), (len(rows) + 2, make(200))]
    out = {r["doc_id"]: r for r in winnow.compare(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0]["near_next"] > 0.6 and out[3]["near_next"] > 0.6 and out[1]["near_next"] < 0.02 and out[4]["near_next"] < 0.02
    assert out[0]["near_edited"] > 0.3


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf, small, name):
    for folder in (sf,) if name in ("op8_warc", "op13_vector_codes") else (sf, small):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "embeddings"):
            con.execute(f"create view {t} as select * from '{sf if t in ('pages', 'embeddings') else folder}/{t}.parquet'")
        df = queries.QUERIES[name](spark, folder)
        want = con.execute(f"select {', '.join(df.columns)} from ({ORACLES[name]})").fetchall()
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))


def test_op1_accuracy(spark, sf):
    got = {r["doc_id"]: r for r in queries.op1_language_id(spark, sf).collect()}
    rows = [r for r in rows_of(sf) if r["lang"]]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [r for r in rows if got[r["doc_id"]]["held_out"] and re.search("[^\\W\\d_]", r["text"] or "")]
    assert sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) >= 0.9 * len(held)


def test_op1_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 1), (2, "", "en", 2), (3, "12 – 34", None, 3), (4, "the words of this text", "en", 4), (5, "die Wörter in diesem Text", "de", 5), (None, "the words", None, 6)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == got[None][0] == "en" and got[5][0] == "de"
    assert langid.predict(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(docs.limit(0))).collect()} == {"und"}


def test_op1_brute_force(spark):
    """Profiles of plain loops over code points give the same languages and cosines, in any script; ties go to the first name."""
    import numpy as np

    texts = ["the cat and the dog", "der Hund und die Katze", "кот и собака и дом", "собака кота", "犬と猫と家がある", "猫がいる家", "cat", "Ünï", "12", "", None, "the cat and the dog"]
    langs = ["en", "de", "ru", "ru", "ja", "ja", None, None, None, "en", None, "aa"]
    letter = lambda c: np.random.default_rng([5, ord(c)]).choice(np.array([-1, 1], np.int8), langid.DIM).astype(float)
    turned = lambda c, by: np.roll(letter(c), by) if c.isalpha() else np.ones(langid.DIM)

    def profile(text: str | None) -> np.ndarray:
        t = f" {(text or '').lower()} "
        return sum((turned(t[i - 1], 2) * turned(t[i], 1) * turned(t[i + 1], 0) for i in range(1, len(t) - 1) if t[i].isalpha()), np.zeros(langid.DIM))

    sums = {x: sum(profile(t) for t, y in zip(texts, langs, strict=True) if y == x) for x in sorted({x for x in langs if x})}
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    long = spark.createDataFrame([(100, " ".join(["кот и the dog 猫"] * 20_000), None)], docs.schema)
    got = {r["doc_id"]: r for r in langid.predict(docs.union(docs).union(long), langid.fit(docs)).collect()}
    for i, text in [*enumerate(texts), (100, " ".join(["кот и the dog 猫"] * 3000))]:
        p = profile(text)
        if not p.any():
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cosines = {x: float(p @ v / np.linalg.norm(p) / np.linalg.norm(v)) for x, v in sums.items() if np.any(v)}
        best = max(sorted(cosines), key=lambda x: round(cosines[x], 5))
        assert got[i]["lang_pred"] == best and got[i]["score"] == pytest.approx(max(0, cosines[best]), abs=2e-3), (i, cosines)


def test_op10(spark, data):
    docs, counts, total = rows_of(data), Counter(), 0
    toks = lambda t: [*WORD3.findall((t or "").translate(AZ)), None]
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in docs}
    for r in docs:
        if not held[r["doc_id"]]:
            counts.update(toks(r["text"]))
    total = counts.total()
    got = {r["doc_id"]: r for r in queries.op10_maxent_scores(spark, data).collect()}
    assert len(got) == len(docs)
    for r in docs:
        t, g = toks(r["text"]), got[r["doc_id"]]
        assert (g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"]) == (held[r["doc_id"]], len(t), sum(counts[x] > 0 for x in t), total)
        assert g["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (total + len(counts) + 1)) for x in t))
        assert g["score"] <= 0
    if data.endswith("sf0.001"):
        mine = [g for g in got.values() if g["held_out"]]
        assert sum(g["score"] for g in mine) > sum(g["base_score"] for g in mine)


def test_edge_tables(spark):
    """Null ids and texts, repeated rows, clashing extra columns, and empty tables don't crash any operator."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text, 1), (3, text, 2), (3, text, 2), (2, None, 3), (2, "", 3), (1, text + " more", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int")
    for c in ("component", "key", "rep", "bucket", "block", "n_words", "picked", "mark", "rank"):
        docs = docs.withColumn(c, docs.n_bytes)
    bench = spark.createDataFrame([(None, text), (1, None)], "item_id long, text string")
    near = sorted(((r["doc_id"] or -1), r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect())
    assert near == [(-1, 1, False), (1, 1, True), (2, 2, True), (2, 2, True), (3, 1, False), (3, 1, False)]
    leaks = sorted((r["doc_id"] or -1, r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(docs, bench).collect())
    assert leaks == [(-1, 60, ("null",)), (1, 60, ("null",)), (2, 0, ()), (2, 0, ()), (3, 60, ("null",)), (3, 60, ("null",))]
    cut = sorted((r["doc_id"] or -1, r["n_removed"], r["text"]) for r in repeats.remove_repeats(docs).collect())
    n = len(text.encode())
    assert cut == [(-1, n, ""), (1, 0, text + " more"), (2, 0, ""), (2, 0, ""), (3, n, ""), (3, n, "")]
    assert docs.columns[:3] == ["doc_id", "text", "n_bytes"] and {r["n_bytes"] for r in repeats.remove_repeats(docs).collect()} == {0, n, n + 5}  # not docs' own column
    found = sorted((r["doc_id"] or -1, r["license_id"], r["notices"], r["n_notices"]) for r in licenses.scan(docs).collect())
    assert found == [(-1, None, None, 0), (1, None, None, 0), (2, None, None, 0), (2, None, None, 0), (3, None, None, 0), (3, None, None, 0)]
    wound = {}
    for r in winnow.compare(docs).collect():
        wound.setdefault(r["doc_id"] or -1, []).append((r["text"], r["edited"], r["near_next"]))
    half = len(text) // 2
    kept, begin = text[: len(text) - half], lambda t: t[:half]
    assert wound[2] == [("", "", 1.0), ("", "", 0.0)]
    assert sorted(wound[3]) == sorted([(text, kept + begin(text), 1.0), (text, kept + begin(text), 1.0)])
    scores = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in maxent.score(docs, docs.doc_id == 3).collect())
    assert scores == [(-1, False, 61, 61, 125), (1, False, 62, 62, 125), (2, False, 1, 1, 125), (2, False, 1, 1, 125), (3, True, 61, 61, 125), (3, True, 61, 61, 125)]
    none = docs.limit(0)
    for frame in (minhash.near_duplicates(none), decontaminate.contamination(none, bench), decontaminate.contamination(docs.limit(0), bench.limit(0)), repeats.remove_repeats(none), winnow.compare(none), licenses.scan(none), maxent.score(none, none.doc_id == 3)):
        assert frame.count() == 0


def test_op4_blocks(spark):
    """The same rows whether the benchmark is one block or many, with an item longer than a block, a null id and one id twice."""
    rng = random.Random(12)
    words = ["".join(rng.choices("abcde", k=3)) for _ in range(30)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    items = [(i, prose(rng.choice([3, 11, 14]))) for i in range(30)] + [(3, prose(12)), (None, prose(10)), (77, prose(400)), (78, None), (79, "")]
    texts = [(i, f"{prose(20)} {(rng.choice(items)[1] or '')[: rng.choice([40, 400])]} {prose(5)}") for i in range(40)] + [(40, None)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(2)
    runs = [sorted(map(str, decontaminate.contamination(docs, bench, block_bytes=n).collect())) for n in (1, 60, 700, 1 << 20)]
    assert runs[0] == runs[1] == runs[2] == runs[3]
    assert len(decontaminate.phrase_files(bench, 10, 60)) > 5 and len(decontaminate.phrase_files(bench, 10, 1 << 20)) == 1


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100}
    for a, b in edges:
        if a is not None and a != b:
            assert got[a] == got[b] <= min(a, b)


def test_op10_tail_weights():
    """Words within a tail class: probabilities of a context sum to one, more counts mean more, and each weight solves its equation."""
    import numpy as np

    rng = random.Random(4)
    shares = {w: x for w, x in enumerate(np.random.default_rng(2).dirichlet(np.ones(50)) * 0.9)}  # 0.1 for words never seen
    counts = Counter((rng.randrange(6), min(int(rng.expovariate(0.2)), 49)) for _ in range(200))
    pairs = sorted((c, w) for c in range(7) for w in shares)
    keys = np.array([c << 24 | w for c, w in pairs], np.uint64)
    logs = maxent.tail_logs(keys, np.array([counts[p] for p in pairs]), np.log([shares[w] for _, w in pairs]))
    got = {p: math.exp(x) for p, x in zip(pairs, logs, strict=True)}
    for c in range(7):
        total = sum(counts[c, w] for w in shares)
        unseen = [w for w in shares if not counts[c, w]]
        left = got[c, unseen[0]] / shares[unseen[0]]  # what a share is multiplied by where no triple was seen
        assert sum(got[c, w] for w in shares) + 0.1 * left == pytest.approx(1)
        for w in shares:
            if counts[c, w]:
                weight = math.log(got[c, w] / shares[w] / left)
                assert weight == 0 or abs(counts[c, w] - total * got[c, w] - maxent.PRIOR * weight) < 0.05 * (total + 4)
        assert total or left == pytest.approx(1)


def test_op10_classes():
    """Scores of classes and words by numpy batches equal a plain softmax, the gradient its numerical derivative; sums of parts are their sum."""
    import numpy as np

    rng = np.random.default_rng(6)
    ids = np.sort(rng.integers(0, 1 << 32, 300, dtype=np.uint32))
    codes = np.where(np.arange(300) < 200, rng.permutation(maxent.HEADS + maxent.CLASSES)[:300] % maxent.HEADS, maxent.HEADS + rng.integers(0, maxent.CLASSES, 300))
    number, begins = rng.integers(0, 300, 5000), np.array([0, 1, 3, 700, 5000])
    rows = maxent.feature_rows(ids[number], maxent.single_rows(ids, codes)[number], begins)
    weights = maxent.Weights(*(rng.normal(size=s).astype(np.float32) for s in ((maxent.ROWS, maxent.KINDS), (maxent.WORD_ROWS, maxent.WIDTH), (maxent.KINDS,), (maxent.CLASSES, maxent.WIDTH))))
    logs = maxent.text_logs(codes[number], rows, weights)
    for i in [0, 1, 2, 3, 699, 700, 701, *range(4000, 4050)]:
        start = begins[np.searchsorted(begins, i, "right") - 1]
        near = lambda j: maxent.HEADS if j < start else codes[number[j]] if codes[number[j]] < maxent.HEADS else maxent.HEADS + 1 + int(ids[number[j]]) % maxent.NEAR
        assert rows[0, i] == near(i - 1) and rows[1, i] == maxent.ONE + near(i - 2)
        x = weights.prior.astype(float) + sum(weights.kinds[r].astype(float) for r in rows[:, i])
        code = int(codes[number[i]])
        kind = code // maxent.WIDTH if code < maxent.HEADS else code - maxent.HEADS + maxent.CLASSES
        want = x[kind] - math.log(sum(map(math.exp, x)))
        if code < maxent.HEADS:
            y = weights.share[kind].astype(float) + sum(weights.words[maxent.word_rows(r, kind)].astype(float) for r in rows[:, i])
            want += y[code % maxent.WIDTH] - math.log(sum(map(math.exp, y)))
        assert logs[i] == pytest.approx(want, abs=1e-4)
    kinds, words = np.zeros((maxent.ROWS, maxent.KINDS), np.float32), np.zeros((maxent.WORD_ROWS, maxent.WIDTH), np.float32)
    maxent.gradient(codes[number], rows, weights, kinds, words)
    for table, found in ((weights.kinds, kinds), (weights.words, words)):
        for at in [tuple(x) for x in np.argwhere(np.abs(found) > 0.3)[::97][:12]]:
            table[at] += 0.01
            up = maxent.text_logs(codes[number], rows, weights).sum()
            table[at] -= 0.02
            down = maxent.text_logs(codes[number], rows, weights).sum()
            table[at] += 0.01
            assert (up - down) / 0.02 == pytest.approx(found[at], rel=0.05, abs=0.05)


def test_op10_equal_contexts_meet(monkeypatch):
    """A gradient scores equal contexts once, however often a block repeats them, and adds them up as often as they occur."""
    import numpy as np

    rng = np.random.default_rng(8)
    ids = np.sort(rng.integers(0, 1 << 32, 60, dtype=np.uint32))
    codes = np.where(np.arange(60) < 40, np.arange(60) * 7, maxent.HEADS + np.arange(60) % maxent.CLASSES)
    once, copies = rng.integers(0, 60, 200), 30
    weights = maxent.Weights(*(rng.normal(size=s).astype(np.float32) for s in ((maxent.ROWS, maxent.KINDS), (maxent.WORD_ROWS, maxent.WIDTH), (maxent.KINDS,), (maxent.CLASSES, maxent.WIDTH))))
    looked, scores, found = [], maxent.Weights.class_scores, []
    monkeypatch.setattr(maxent.Weights, "class_scores", lambda self, rows: looked.append(rows.shape[1]) or scores(self, rows))
    for number, begins in ((once, np.array([0, 200])), (np.tile(once, copies), np.arange(copies + 1) * 200)):
        kinds, words = np.zeros((maxent.ROWS, maxent.KINDS), np.float32), np.zeros((maxent.WORD_ROWS, maxent.WIDTH), np.float32)
        maxent.gradient(codes[number], maxent.feature_rows(ids[number], maxent.single_rows(ids, codes)[number], begins), weights, kinds, words)
        found.append((kinds, words))
    assert sum(looked) <= 2 * 200
    for one, many in zip(*found, strict=True):
        assert np.abs(many - copies * one).max() < 1e-3 * copies
        assert np.abs(one).max() > 0.5


def test_op10_size_of_what_is_gathered(spark, sf):
    """What tasks send follows the tokens, not the partitions: as many gradient tasks, and the same counts, for 2 partitions and for 60."""
    docs = queries.table(spark, sf, "documents")
    few, many = (maxent.score(docs.repartition(n), docs.doc_id % 7 == 2).orderBy("doc_id").collect() for n in (2, 60))
    assert [r[:6] for r in few] == [r[:6] for r in many]
    assert sum(r["score"] for r in few) == pytest.approx(sum(r["score"] for r in many), rel=0.05)


def test_op8_stream_is_bounded(tmp_path):
    """A payload that inflates a thousandfold comes piece by piece; streams of one and of many members read alike, a cut one raises."""
    import gzip

    from loomtext.llm.warc import _Stream

    raw = b"".join(b"H: %d\r\n\r\n" % i + b" " * n + b"\r\n\r\n" for i, n in enumerate((0, 5, 3_000_000, 1)))
    cuts = [0, 12, 3_000_000, len(raw)]
    for name, data in (("one", gzip.compress(raw)), ("many", b"".join(gzip.compress(raw[a:b]) for a, b in zip(cuts, cuts[1:])))):
        (tmp_path / name).write_bytes(data)
        with pa.OSFile(str(tmp_path / name)) as source:
            stream = _Stream(source, 1000)
            for n in (0, 5):
                assert stream.until(b"\r\n\r\n") and stream.take(n + 4) == b" " * n + b"\r\n\r\n"
            assert stream.until(b"\r\n\r\n") == b"H: 2\r\n\r\n" and len(stream.have) < 3000
            assert len(stream.take(3_000_004)) == 3_000_004 and stream.until(b"\r\n\r\n") == b"H: 3\r\n\r\n" and stream.take(5) == b" \r\n\r\n" and stream.until(b"\r\n\r\n") is None
        (tmp_path / name).write_bytes(data[:-40])
        with pa.OSFile(str(tmp_path / name)) as source, pytest.raises(ValueError):
            _Stream(source, 1000).take(len(raw))
