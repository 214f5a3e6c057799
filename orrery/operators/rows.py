"""Row selections as data: run-length coding of (file, row), expansion, gathering, merging, saving."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows of a file that are ordered together; only runs that touch the ends of such a stretch meet again.
STRETCH = 1 << 20


def to_runs(rows: DataFrame, row: str = "row", by: tuple[str, ...] = ("file",)) -> DataFrame:
    """(by, index, n_to_read): maximal runs of consecutive rows of each file; repeated rows count once.

    Rows are ordered by stretches of STRETCH rows, so a file is as many tasks as it has stretches.
    """
    own = Window.partitionBy(*by, "__s").orderBy(row)
    rows = rows.select(*by, row).distinct().withColumn("__s", F.floor(F.col(row) / STRETCH))
    flagged = rows.withColumn("__g", F.col(row) - F.row_number().over(own))
    return _stitch(flagged.groupBy(*by, "__s", "__g").agg(F.min(row).alias("index"), (F.max(row) + 1).alias("__e")), by)


def _stitch(parts: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Join runs (index to __e) of stretches where they touch: at most two of each stretch are ordered by file."""
    border = (F.col("index") % STRETCH == 0) | (F.col("__e") % STRETCH == 0)
    own = Window.partitionBy(*by, "__p").orderBy("index")
    parts = parts.withColumn("__p", F.when(border, F.lit(-1)).otherwise(F.col("__s")))
    new = F.when(F.lag("__e").over(own) == F.col("index"), 0).otherwise(1)
    parts = parts.withColumn("__new", new).withColumn("__g", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    out = parts.groupBy(*by, "__p", "__g").agg(F.min("index").alias("index"), F.max("__e").alias("__e"))
    return out.select(*by, "index", (F.col("__e") - F.col("index")).alias("n_to_read"))


def expand(runs: DataFrame, row: str = "row") -> DataFrame:
    """Rows of runs; empty runs give none (a sequence would count down)."""
    keep = [c for c in runs.columns if c not in ("index", "n_to_read")]
    return runs.where("n_to_read > 0").select(*keep, F.explode(F.sequence("index", F.col("index") + F.col("n_to_read") - 1)).alias(row))


def total(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.sum("n_to_read"), F.lit(0)).cast("bigint").alias("n_part"))


def gather(df: DataFrame, runs: DataFrame, row: str = "row", by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Rows of ``df`` that the runs select: an equi-join on the rows themselves."""
    return df.join(expand(runs, row), [*by, row], "left_semi")


def merge_runs(runs: DataFrame, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Join runs that touch or overlap: (by, index, n_to_read); runs are split at stretches, merged there and stitched."""
    end = F.col("index") + F.col("n_to_read")
    parts = runs.where("n_to_read > 0").withColumn("__s", F.explode(F.sequence(F.floor(F.col("index") / STRETCH), F.floor((end - 1) / STRETCH))))
    at = F.col("__s") * STRETCH
    parts = parts.select(*by, "__s", F.greatest("index", at).alias("index"), F.least(end, at + STRETCH).alias("__e")).distinct()
    own = Window.partitionBy(*by, "__s").orderBy("index")
    ends = F.max("__e").over(own.rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.withColumn("__new", F.when(F.col("index") <= ends, 0).otherwise(1))
    parts = parts.withColumn("__g", F.sum("__new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return _stitch(parts.groupBy(*by, "__s", "__g").agg(F.min("index").alias("index"), F.max("__e").alias("__e")), by)


def save(runs: DataFrame, path: str) -> None:
    """Persist a selection as Parquet."""
    runs.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def encode_positions(runs: dict[int, tuple[list[int], list[int]]]) -> bytes:
    """The binary form of a selection: counts, then per file its number, run starts and run lengths."""
    n_part = sum(sum(n) for _, n in runs.values())
    out = struct.pack("<qq", n_part, len(runs))
    for file, (index, n) in sorted(runs.items()):
        out += struct.pack("<qq", file, len(index)) + np.array(index, "<i8").tobytes() + np.array(n, "<i8").tobytes()
    return out


def decode_positions(data: bytes) -> tuple[dict[int, tuple[list[int], list[int]]], int]:
    n_part, files = struct.unpack_from("<qq", data)
    at, out = 16, {}
    for _ in range(files):
        file, n = struct.unpack_from("<qq", data, at)
        index, count = np.frombuffer(data, "<i8", 2 * n, at + 16).reshape(2, n).tolist()
        out[file] = (index, count)
        at += 16 + 16 * n
    return out, n_part
