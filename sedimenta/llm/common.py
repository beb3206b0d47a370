"""Shared helpers of the training-data operators: tables, shared scratch space, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python: bounds a worker's memory whatever the text lengths.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20

#: ``[^\x20\x09-\x0D]+``, the word of several contracts, as a Java regular expression.
WORD = "[^\\x20\\x09-\\x0D]+"


def tune(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of a session that sets no bounds of its own; results don't depend on them.

    They must hold when the caller runs the DataFrame, so that they stay set.
    """
    own = spark.conf.getAll
    for name, value in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if f"spark.sql.execution.arrow.{name}" not in own:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    return spark


#: Shuffle files go when the statement that wrote them ends, not when the driver's JVM comes to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for the length of a block."""
    before = spark.conf.getAll.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table of ``sf_dir``, all rows."""
    df = tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where that is unset, a new local one (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found and jsc.getCheckpointDir().isDefined():
        found = jsc.getCheckpointDir().get()
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="sedimenta-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read again, so that a lost executor costs a reread only."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialize() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (file, hdfs, s3, gs) or an absolute local path."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, data: bytes, attempt: str) -> None:
    """Write whole files only: under a temporary name of this attempt, then rename; a repeated task replaces equal bytes."""
    at, path = open_fs(folder)
    at.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{attempt}"
    with at.open_output_stream(temporary) as out:
        out.write(data)
    at.move(temporary, f"{path}/{name}")


def read_file(folder: str, name: str) -> bytes:
    at, path = open_fs(folder)
    with at.open_input_file(f"{path}/{name}") as f:
        return f.read()


def attempt_id() -> tuple[int, str]:
    """Partition number, and a name of this task's attempt."""
    from pyspark import TaskContext

    ctx = TaskContext.get()
    return ctx.partitionId(), f"{ctx.partitionId()}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text, modulo 5, is 0. A null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def is_held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 0

