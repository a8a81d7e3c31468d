"""Extraction: prompts, calls of a pluggable model, and strict or lenient reading of its JSON."""

from __future__ import annotations

import heapq
import json
import random
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from loomtext.config import Calling
from loomtext.functions.text import relation_type, rx, strip
from loomtext.sources.staging import filesystem, write_file

#: an extractor turns prompts into raw answers; it is made once for each task
Extractor = Callable[[str], str]

PLACEHOLDER = "{{text_chunk}}"
PROMPT = """Read the text below and extract scientific entities (models, methods, metrics, baselines) together with the relations between them.
For every relation quote the sentence that supports it. Answer with valid JSON only, in this form:
{"entities": [{"id": "...", "type": "...", "desc": "..."}], "relations": [{"source": "...", "target": "...", "predicate": "USES|IMPROVES|CONTRASTS", "evidence": "..."}]}

Text: {{text_chunk}}"""

_FIELDS = {"entities": (("id", "type"), ("desc",)), "relations": (("source", "target", "predicate", "evidence"), ())}
PARSED = StructType([StructField(k, ArrayType(StructType([StructField(f, StringType()) for f in (*needed, *optional)]))) for k, (needed, optional) in _FIELDS.items()])


def prompt(text: Column, template: str = PROMPT, max_chars: int = 6000) -> Column:
    return F.replace(F.lit(template), F.lit(PLACEHOLDER), F.substr(text, F.lit(1), F.lit(max_chars)))


def relation_prompt(text: Column, entities: Column, template: str, max_chars: int = 6000, max_entities: int = 120) -> Column:
    """A template, the first entities (array<struct<name, type>>) as JSON, and the text."""
    return F.concat(F.lit(template), F.lit("\n\nEntity List (use these):\n"), F.to_json(F.slice(entities, 1, max_entities)), F.lit("\n\nText:\n"), F.substr(text, F.lit(1), F.lit(max_chars)))


WAITING = 1_000  # failed calls of a task that wait for their next try at once


def _answered(call: Extractor, prompts: Iterable[str], how: Calling) -> Iterator[tuple[int, str, str]]:
    """(place, prompt, answer) as answers come; how.in_flight calls are under way at most.

    A failed call waits for its next try outside of those, so that others are made meanwhile; a prompt that fails at every try ends the
    calls, and is raised once those under way have ended.
    """
    fresh = enumerate(prompts)
    more, failed = True, None
    waiting: list[tuple[float, int, str, int]] = []  # when due, place, prompt, calls so far
    running: dict[Future[str], tuple[int, str, int]] = {}
    with ThreadPoolExecutor(how.in_flight) as pool:
        while more or waiting or running:
            while len(running) < how.in_flight:
                if waiting and waiting[0][0] <= time.monotonic():
                    _, at, text, n = heapq.heappop(waiting)
                elif more and len(waiting) < WAITING:
                    (at, text), n = next(fresh, (None, None)), 0
                    if at is None:
                        more = False
                        continue
                else:
                    break
                running[pool.submit(call, text)] = at, text, n
            left = max(0.0, waiting[0][0] - time.monotonic()) if waiting else None
            if not running:
                time.sleep(left or 0.0)
                continue
            for told in wait(running, None if len(running) == how.in_flight else left, FIRST_COMPLETED).done:
                at, text, n = running.pop(told)
                error = told.exception()
                if error is None:
                    yield at, text, told.result()
                elif n + 1 < how.attempts and failed is None and isinstance(error, Exception):
                    heapq.heappush(waiting, (time.monotonic() + how.pause * 2**n + random.uniform(0, 0.25), at, text, n + 1))
                else:
                    more, failed = False, failed or error
                    waiting.clear()
    if failed is not None:
        raise failed


ANSWERS = "digest string, raw string"


def stored_answers(spark: SparkSession, store: str) -> DataFrame:
    """(digest, raw) of a folder of answers, one for each digest of a prompt; the folder is made if it isn't there."""
    fs, path = filesystem(store)
    fs.create_dir(path, recursive=True)
    found = spark.read.schema(ANSWERS).option("recursiveFileLookup", "true").parquet(store)
    return found.groupBy("digest").agg(F.min("raw").alias("raw"))  # two attempts of a task may have asked for one prompt


def ask_for(prompts: DataFrame, make: Callable[[], Extractor], how: Calling, store: str) -> int:
    """Call the model for the prompts (prompt) that the store has no answer to, each once, and store what it says; how many were asked for.

    A task stores its answers as it goes, in files of its own; an attempt that follows a failed one reads those of its partition first.  So
    a lost executor, or a job that fails as the model does, costs the answers of one increment at most.
    """
    run = uuid.uuid4().hex

    def called(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        folder = f"{store}/{run}/{TaskContext.get().partitionId():06d}"
        fs, path = filesystem(folder)
        fs.create_dir(path, recursive=True)
        files = [i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(path)) if i.is_file and not i.base_name.startswith(".")]
        have = {d for f in files for d in pq.read_table(f, filesystem=fs, columns=["digest"]).column("digest").to_pylist()}
        digest_of: dict[str, str] = {}
        held: list[tuple[str, str]] = []
        n = 0

        def wanted() -> Iterator[str]:
            for frame in frames:
                for digest, text in zip(frame["digest"], frame["prompt"], strict=True):
                    if digest not in have:
                        digest_of[text] = digest
                        yield text

        def store_held() -> None:
            if held:
                sink = pa.BufferOutputStream()
                pq.write_table(pa.table({"digest": [d for d, _ in held], "raw": [r for _, r in held]}, pa.schema([("digest", pa.string()), ("raw", pa.string())])), sink)
                write_file(f"{folder}/{held[0][0]}.parquet", sink.getvalue().to_pybytes())
                held.clear()

        try:
            for _, text, raw in _answered(make(), wanted(), how):
                held.append((digest_of.pop(text), raw))
                n += 1
                if len(held) >= how.stored_at_once:
                    store_held()
        finally:
            store_held()  # what is paid for stays, also when a later call fails
        yield pd.DataFrame({"asked": [n]})

    spark = prompts.sparkSession
    new = prompts.select(F.sha2("prompt", 256).alias("digest"), "prompt").groupBy("digest").agg(F.first("prompt").alias("prompt"))
    new = new.join(stored_answers(spark, store).select("digest"), "digest", "left_anti")
    return new.mapInPandas(called, "asked long").agg(F.sum("asked")).first()[0] or 0


def responses(chunks: DataFrame, make: Callable[[], Extractor], how: Calling = Calling(), store: str | None = None) -> DataFrame:
    """chunks with `raw`, the model's answer to each prompt: tried several times with doubling pauses, after which the task fails.

    With a folder as store, answers come from there, by the digest of the prompt: equal prompts are asked once, calls are made at once
    (this is an action), and no later run asks for them again.  Without one, calls are made whenever the result is read, so write it before
    it is read more than once.  Partitions and how.in_flight bound how many calls run at once; answers stay with their rows.
    """
    asked = chunks.withColumn("prompt", prompt(F.col("text"), max_chars=how.prompt_chars))
    if store is not None:
        ask_for(asked.filter("prompt is not null").select("prompt"), make, how, store)
        told = stored_answers(chunks.sparkSession, store).withColumnRenamed("digest", "prompt_digest")
        return asked.join(told, F.sha2("prompt", 256) == F.col("prompt_digest"), "left").drop("prompt", "prompt_digest")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for frame in frames:
            raw = [None] * len(frame)
            for at, _, told in _answered(call, frame["prompt"], how):
                raw[at] = told
            yield frame.drop(columns="prompt").assign(raw=raw)

    kinds = ", ".join(f"`{n}` {t}" for n, t in chunks.dtypes)
    return asked.mapInPandas(run, f"{kinds}, raw string")


def carve(raw: Column, first: str = "{", last: str = "}") -> Column:
    """From the first to the last bracket, within the first fenced block if there is one; null without both."""
    text = strip(F.coalesce(raw, F.lit("")))
    fence = rx(r"```(?:json)?\s*([\s\S]*?)\s*```")
    body = F.when(text.rlike(fence), strip(F.regexp_extract(text, fence, 1))).otherwise(text)
    start, end = F.instr(body, first), F.length(body) - F.instr(F.reverse(body), last) + 1
    return F.when((start > 0) & (F.instr(body, last) > 0) & (end > start), F.substr(body, start, end - start + 1))


def _valid(raw: str | None) -> dict:
    empty: dict = {k: [] for k in _FIELDS}
    try:
        found = json.loads(raw or "")
        out = {k: found.get(k, []) for k in _FIELDS}
    except (ValueError, AttributeError, RecursionError):
        return empty
    for key, (needed, optional) in _FIELDS.items():
        if not isinstance(out[key], list):
            return empty
        for row in out[key]:
            if not isinstance(row, dict) or not all(isinstance(row.get(f), str) for f in needed) or not all(isinstance(row.get(f, ""), str | None) for f in optional):
                return empty
    return {k: [{f: row.get(f) for f in (*needed, *optional)} for row in out[k]] for k, (needed, optional) in _FIELDS.items()}


@pandas_udf(PARSED)
def _parsed(raw: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_valid(r) for r in raw], columns=list(_FIELDS))


def parse_strict(raw: Column) -> Column:
    """The entities and relations of an answer, or none of either if any field that must be there is missing or no string.

    from_json reads numbers as strings and keeps the valid half, so the check itself is a small Python function over Arrow batches.
    """
    return _parsed(carve(raw))


def entities_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, chunk_rank, pos, name, type) of (doc_id, chunk_rank, parsed): trimmed, without empty names."""
    rows = parsed.select("doc_id", "chunk_rank", F.posexplode("parsed.entities").alias("pos", "e"))
    kind = strip(F.when(F.coalesce("e.type", F.lit("")) == "", "Concept").otherwise(F.col("e.type")))
    return rows.select("doc_id", "chunk_rank", "pos", strip(F.col("e.id")).alias("name"), kind.alias("type")).filter("name <> ''")


def relations_of(parsed: DataFrame) -> DataFrame:
    """(doc_id, chunk_rank, pos, head, head_type, relation, tail, tail_type, evidence): an end's type is its last definition in the chunk."""
    rows = parsed.select("doc_id", "chunk_rank", F.col("parsed.entities").alias("entities"), F.posexplode("parsed.relations").alias("pos", "r"))

    def type_of(end: str) -> Column:
        same = F.filter("entities", lambda e: (F.lower(strip(e["id"])) == F.lower(F.col(end))) & (strip(e["id"]) != ""))
        last = F.try_element_at(same, F.lit(-1))
        return F.when(F.size(same) == 0, "Concept").otherwise(strip(F.when(F.coalesce(last["type"], F.lit("")) == "", "Concept").otherwise(last["type"])))

    rows = rows.select("*", strip(F.col("r.source")).alias("head"), strip(F.col("r.target")).alias("tail"), relation_type(F.col("r.predicate")).alias("relation"))
    evidence = F.nullif(strip(F.coalesce("r.evidence", F.lit(""))), F.lit(""))
    kept = rows.filter("head <> '' and tail <> '' and relation <> ''")
    return kept.select("doc_id", "chunk_rank", "pos", "head", type_of("head").alias("head_type"), "relation", "tail", type_of("tail").alias("tail_type"), evidence.alias("evidence"))


def _texts(value: Column, key: str, default: str = "") -> Column:
    return strip(F.coalesce(F.nullif(value[key], F.lit("")), F.lit(default)))


def _objects(raw: Column, fields: str) -> Column:
    """The objects of a JSON array, one by one, so that an odd item spoils no other."""
    items = F.filter(F.from_json(carve(raw, "[", "]"), "array<string>"), lambda x: x.startswith("{"))
    return F.coalesce(F.transform(items, lambda x: F.from_json(x, fields)), F.array().cast(f"array<struct<{fields.replace(' string', ':string')}>>"))


def parse_entity_list(raw: Column) -> Column:
    """Lenient reading of a JSON array of {name, type}: array<struct<name, type>>; items that are no objects are skipped."""
    named = F.transform(_objects(raw, "name string, type string"), lambda r: F.struct(_texts(r, "name").alias("name"), _texts(r, "type", "Concept").alias("type")))
    return F.filter(named, lambda r: r["name"] != "")


def parse_relation_list(raw: Column) -> Column:
    """Lenient reading of a JSON array of relations, with RELATED_TO and Concept where nothing is given."""
    ends = lambda r: [_texts(r, "head").alias("head"), _texts(r, "head_type", "Concept").alias("head_type"), relation_type(r["relation"]).alias("relation"), _texts(r, "tail").alias("tail"), _texts(r, "tail_type", "Concept").alias("tail_type")]
    named = F.transform(_objects(raw, "head string, head_type string, relation string, tail string, tail_type string, evidence string"), lambda r: F.struct(*ends(r), F.nullif(_texts(r, "evidence"), F.lit("")).alias("evidence")))
    return F.filter(named, lambda r: (r["head"] != "") & (r["tail"] != "") & (r["relation"] != ""))
