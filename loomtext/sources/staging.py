"""Tables and files in the folder that driver and executors share, for results that are read more than once or must outlive an executor."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
FEW = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that driver and executors share (spark.checkpoint.dir); removed when the application ends.

    Where none is set, as in tests, a temp folder serves if all runs on one machine; a cluster needs the setting.
    """
    sc = spark.sparkContext
    if sc.applicationId not in _OWN:
        configured = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
        if not configured and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        _OWN[sc.applicationId] = f"{configured.rstrip('/')}/loomtext-{sc.applicationId}-{uuid.uuid4().hex[:8]}" if configured else tempfile.mkdtemp(prefix="loomtext-")
        path = sc._jvm.org.apache.hadoop.fs.Path(_OWN[sc.applicationId])
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return _OWN[sc.applicationId]


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and return the table: cuts lineage and survives lost executors."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python tasks in Arrow batches of at most BATCH_BYTES, unless the session asks for fewer: texts are long, and a
    batch is held outside the heap, twice while it grows, for every task of an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


def few(df: DataFrame, rows: int = FEW) -> DataFrame:
    """df, to be sent to all tasks if it has at most so many rows, which are counted; else left to a shuffled join.  df is a table, so that counting is cheap."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """A file system and path that tasks can open, for any scheme that pyarrow knows; a bare path is local."""
    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return pyarrow.fs.FileSystem.from_uri(uri)
    return pyarrow.fs.LocalFileSystem(), uri


def write_file(uri: str, data: bytes) -> None:
    """Write a whole file under another name and move it into place, so that a retried task leaves one whole file."""
    fs, path = filesystem(uri)
    folder, name = path.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"  # readers of the folder leave out such names
    with fs.open_output_stream(part, compression=None) as out:
        out.write(data)
    fs.move(part, path)


def read_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()
