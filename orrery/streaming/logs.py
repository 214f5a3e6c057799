"""Timing logs as a stream: steps of log files as they appear."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Streaming (step, time, active) of the log files in ``folder``: a row for each line that names a step."""
    field = F.split("value", "=")
    rows = spark.readStream.text(folder).where(F.col("value").contains("Step"))
    return rows.select(
        F.trim(F.substring(field[1], 1, 9)).cast("bigint").alias("step"),
        F.trim(F.substring(field[2], 1, 10)).cast("double").alias("time"),
        F.trim(F.substring(field[3], 1, 11)).cast("bigint").alias("active"),
    )
