"""Shared storage and small helpers of the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one of our own in local mode where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, batch_rows: int | None = None, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and outlives executors.

    ``batch_rows`` holds the rows of an Arrow batch down while it is written, for rows with whole texts.
    ``options`` are the writer's.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, before = fresh_path(spark, label), spark.conf.get(name)
    try:
        if batch_rows:
            spark.conf.set(name, str(batch_rows))
        df.write.options(**options or {}).parquet(path)
    finally:
        spark.conf.set(name, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folder = path
    return out


def bounded(df: DataFrame, label: str, batch_rows: int) -> DataFrame:
    """A small result of large rows, written now with Arrow batches of ``batch_rows``.

    A plan that is run by the caller takes 10,000 rows a batch, whatever their size.
    """
    return materialize(df, label, batch_rows, {"compression": "zstd"})


def forget(spark: SparkSession, tables: list[DataFrame]) -> None:
    """Delete tables that ``materialize`` wrote and that no later result reads."""
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a folder URI, for files that Python workers write or read themselves."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


def write_once(files, path: str, chunks: Iterator[bytes]) -> int:
    """Write under a name of this attempt, then rename: a repeated task replaces the file by an equal one."""
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with files.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    files.move(part, path)
    return size


def arrow_map(df: DataFrame, rows: Callable, schema: str, step: int = 256) -> DataFrame:
    """``mapInArrow`` over slices of ``step`` rows: ``rows(dict of lists) -> dict of lists`` bounds what a worker holds."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = rows({n: part.column(i) for i, n in enumerate(part.schema.names)})
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=kind)

    return df.mapInArrow(run, schema)
