"""WARC archives: write, normalise a whole-file gzip stream into one member per record with an offset index, and read back.

Rows: a null html is an empty payload, a null url an empty one; every input row gives one record, repeated rows too.
Among records with equal payloads those with the smallest page_id are responses (a null page_id counts as the largest),
the others revisits that name it.  Columns beside page_id, url and html are ignored.  An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.base import filesystem, fresh_dir, partitions, staged, write_file

INDEX = "file string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PREFIX = "urn:loomtext:page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def with_revisits(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """page_id, url, html and refers_to: the smallest page_id with the same payload if that is another one, for payloads of at least `smallest` bytes.

    Only digests and ids are grouped (with partial sums before the shuffle), from a staged table of distinct ones; only payloads that occur
    more than once are looked up.  Texts move once, by page_id and digest, to meet their decision, so those of a common payload spread.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.unhex(F.sha1(html)).alias("sha"))
    ids = staged(keyed.filter(F.octet_length("html") >= smallest).select("page_id", "sha").distinct(), "payloads")
    first = ids.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("sha", "first_id")
    decided = ids.join(first, "sha").filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    a, b = keyed.alias("a"), decided.alias("b")
    return a.join(b, F.col("a.page_id").eqNullSafe(F.col("b.page_id")) & (F.col("a.sha") == F.col("b.sha")), "left").select("a.page_id", "a.url", "a.html", F.col("b.first_id").alias("refers_to"))


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{PREFIX}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{PREFIX}{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write_monolithic(pages: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """One archive per partition, its records in one gzip stream; returns the files' names.  File names follow the partition, so a retried task replaces its own file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, pack = f"part-{TaskContext.get().partitionId():06d}.warc.gz", None, zlib.compressobj(level, zlib.DEFLATED, 31)
        fs, path = filesystem(f"{folder}/whole/{name}.{TaskContext.get().taskAttemptId()}")
        for batch in batches:
            for page_id, url, html, refers in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to")), strict=True):
                if out is None:
                    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                out.write(pack.compress(_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), refers.as_py())))
        if out is not None:
            out.write(pack.flush())
            out.close()
            fs.move(path, path.rsplit(".", 1)[0])
            yield pa.RecordBatch.from_pydict({"file": [name]})

    return pages.mapInArrow(write, "file string")


class _Stream:
    """A whole-file gzip stream read once, front to back, at most chunk inflated bytes at a time; also reads streams of many members."""

    def __init__(self, source, chunk: int = 1 << 20) -> None:
        self.source, self.chunk, self.have, self.left, self.inflate = source, chunk, bytearray(), b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        """Inflate some more; False at the end of the file."""
        if self.inflate.eof:
            self.left, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
        data = self.left or self.source.read(self.chunk)
        self.have += self.inflate.decompress(data, self.chunk)
        self.left = self.inflate.unconsumed_tail
        return bool(data)

    def until(self, mark: bytes) -> bytes | None:
        """What comes up to and with mark; None at the end."""
        seen = 0
        while (at := self.have.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.have)
            if not self._more():
                if self.have.strip():
                    raise ValueError("the archive ends inside a record's header")
                return None
        return self.take(at + len(mark))

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
        out = bytes(self.have[:n])
        del self.have[:n]
        return out


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:] if x)}


def normalise(spark: SparkSession, files: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Inflate each whole-file stream once, rewrite every record as a member of its own and write `<file>.idx`, one JSON line per record; returns the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                fs, path = filesystem(f"{folder}/whole/{name}")
                to = filesystem(f"{folder}/members/{name}")[1]
                part, rows, at = f"{to}.{TaskContext.get().taskAttemptId()}", [], 0
                fs.create_dir(to.rsplit("/", 1)[0], recursive=True)
                with fs.open_input_file(path) as source, fs.open_output_stream(part, compression=None) as out:
                    stream = _Stream(source)
                    while (head := stream.until(b"\r\n\r\n")) is not None:
                        body = stream.take(int(_headers(head)["content-length"]) + 4)
                        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = pack.compress(head) + pack.compress(body) + pack.flush()
                        out.write(member)
                        rows.append({"file": name, "offset": at, "length": len(member)})
                        at += len(member)
                fs.move(part, to)
                write_file(f"{folder}/index/{name}.idx", "".join(json.dumps(r) + "\n" for r in rows).encode())
                yield pa.RecordBatch.from_pydict({"file": [name], "records": [len(rows)]})

    return files.mapInArrow(run, "file string, records long")


def read_archives(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of normalised archives, each read at its place in the sidecar index; digests and lengths of responses come from their payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows = []
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != name:
                    fs, path = filesystem(f"{folder}/members/{file}")
                    name, source = file, fs.open_input_file(path)
                source.seek(offset)
                record = zlib.decompress(source.read(length), 31)
                head, _, block = record.partition(b"\r\n\r\n")
                head = _headers(head)
                http, _, body = block[: int(head["content-length"])].partition(b"\r\n\r\n")
                number = lambda k, h=head: int(x) if (x := h.get(k, "").strip("<>").removeprefix(PREFIX)) else None
                revisit = head["warc-type"] == "revisit"
                rows.append({
                    "page_id": number("warc-record-id"), "url": unquote(head["warc-target-uri"]), "record_type": head["warc-type"], "refers_to": number("warc-refers-to"),
                    "payload_bytes": int(_headers(http)["content-length"]) if revisit else len(body), "payload_digest": head["warc-payload-digest"].removeprefix("sha1:") if revisit else digest(body), "payload": body if payloads and not revisit else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    index = spark.read.schema(INDEX).json(f"{folder}/index")
    return index.repartition(partitions(spark), "file").sortWithinPartitions("file", "offset").mapInArrow(run, RECORDS)


def archive(pages: DataFrame, folder: str | None = None, smallest: int = 0) -> str:
    """Write pages as normalised archives under folder (whole/, members/, index/) and return it."""
    spark = pages.sparkSession
    folder = folder or fresh_dir(spark, "warc")
    names = write_monolithic(with_revisits(pages, smallest), folder).collect()  # one row per archive file, as a job's commit has
    files = spark.createDataFrame([(r["file"],) for r in names], "file string").repartition(max(1, len(names)))
    normalise(spark, files, folder).collect()
    if not names:
        write_file(f"{folder}/index/empty.idx", b"")
    return folder
