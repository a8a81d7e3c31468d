"""Sinks: the graph and the vector index as Parquet, in versions that are there as a whole or not at all; and one document's graph as a page."""

from __future__ import annotations

import html
import itertools
import json
import logging
import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)


LOG = "_commits"


def _place(spark: SparkSession, path: str):
    """Hadoop's path, file system and file context."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)


def _commits(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """The number of the last manifest below path (0: none) and its versions, oldest first."""
    at, fs, _ = _place(spark, f"{path}/{LOG}")
    if not fs.exists(at):
        return 0, []
    numbers = [int(name[:-5]) for s in fs.listStatus(at) if re.fullmatch(r"\d{10}\.json", name := s.getPath().getName())]
    if not numbers:
        return 0, []
    last = spark.read.text(f"{path}/{LOG}/{max(numbers):010d}.json", wholetext=True).first()["value"]
    return max(numbers), json.loads(last)["versions"]


def _put_if_absent(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """Write a whole file under a name that no other has; False if there is one. Renaming does that on stores, where it never replaces a file; on a disk it would, so a link does."""
    at, fs, context = _place(spark, f"{folder}/.{uuid.uuid4().hex}")
    to = _place(spark, f"{folder}/{name}")[0]
    if fs.getScheme() == "file":
        temp, target = at.toUri().getPath(), to.toUri().getPath()
        os.makedirs(os.path.dirname(temp), exist_ok=True)
        with open(temp, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(temp, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(temp)
        return True
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        context.rename(at, to, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    return True


def commit(tables: dict[str, DataFrame], path: str, batch: str) -> bool:
    """Add tables below path as one version, named for a batch; False if that batch is there already, so that a retry adds nothing.

    Each table is written to a folder of its own, then a manifest that lists all versions is put under the next free number.  What a failed
    attempt has written is in no manifest, so no reader sees it; of two writers at once, the second takes the number after.
    """
    spark = next(iter(tables.values())).sparkSession
    if batch in (v["batch"] for v in _commits(spark, path)[1]):
        return False
    folder = uuid.uuid4().hex
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}/{folder}")
    while True:
        number, versions = _commits(spark, path)
        if batch in (v["batch"] for v in versions):
            return False
        text = json.dumps({"versions": [*versions, {"batch": batch, "folder": folder, "tables": {n: t.schema.jsonValue() for n, t in tables.items()}}]})
        if _put_if_absent(spark, f"{path}/{LOG}", f"{number + 1:010d}.json", text):
            return True


def committed(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """A table below path as of the last manifest; None if no version has it."""
    found = [v for v in _commits(spark, path)[1] if name in v["tables"]]
    if not found:
        return None
    return spark.read.schema(StructType.fromJson(found[0]["tables"][name])).parquet(*(f"{path}/{name}/{v['folder']}" for v in found))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, batch: str = "all") -> bool:
    """Commit both tables of a batch below path; False, with a log entry, if Spark can't.

    False has to be looked at, as readers then see the graph without this batch; who reads on from what was written calls commit, which raises.
    """
    try:
        commit({"nodes": nodes, "edges": edges}, path, batch)
    except (PySparkException, Py4JJavaError):
        log.exception("the graph was not written to %s", path)
        return False
    return True


def write_index(embedded: DataFrame, path: str, batch: str = "all") -> bool:
    """Commit chunks with vectors to the index below path; ids are not made distinct. False if the batch is there already."""
    return commit({"index": embedded}, path, batch)


def graph_page(nodes: DataFrame, edges: DataFrame, doc_id: int, file: str) -> str | None:
    """A page with all nodes and edges of one document as a table and as JSON, for viewers; None if it has no node.

    Rows come partition by partition and go straight to the file, so the page may be longer than the driver's memory.
    """
    here = lambda df, *columns: df.filter(F.col("doc_id") == doc_id).select(*columns).orderBy(*columns)
    ends = here(edges, "src_id", "rel_type", "dst_id")
    named = here(nodes, "id", "type").toLocalIterator()
    first = next(named, None)
    if first is None:
        return None
    safe = lambda row: json.dumps(row).replace("<", "\\u003c")
    with open(file, "w", encoding="utf-8") as out:
        out.write(f"<!doctype html><meta charset=utf-8><title>Graph of {doc_id}</title><table>")
        for r in ends.toLocalIterator():
            out.write("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>")
        out.write('</table><script type=\'application/json\' id=\'graph\'>{"nodes": [')
        for i, n in enumerate(itertools.chain([first], named)):
            out.write((", " if i else "") + safe({"id": n["id"], "label": n["id"], "title": n["type"]}))
        out.write('], "edges": [')
        for i, r in enumerate(ends.toLocalIterator()):
            out.write((", " if i else "") + safe({"from": r["src_id"], "to": r["dst_id"], "label": r["rel_type"], "arrows": "to"}))
        out.write("]}</script>")
    return file
