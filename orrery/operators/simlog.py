"""Timing logs of a simulation: parsing and a performance summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """(step, time, active, line_no) from (line_no, line): the last line of a step wins; ordered by its first."""
    field = F.split("line", "=")
    rows = lines.where(F.col("line").contains("Step")).select(
        "line_no",
        F.trim(F.substring(field[1], 1, 9)).cast("bigint").alias("step"),
        F.trim(F.substring(field[2], 1, 10)).cast("double").alias("time"),
        F.trim(F.substring(field[3], 1, 11)).cast("bigint").alias("active"),
    )
    last = rows.groupBy("step").agg(F.max_by(F.struct("time", "active"), "line_no").alias("v"), F.min("line_no").alias("line_no"))
    return last.select("step", "v.time", "v.active", "line_no")


def summary(steps: DataFrame) -> DataFrame:
    """Last step, hours in total and of the longest step, and means."""
    return steps.agg(
        F.max_by("step", "line_no").alias("last_step"),
        F.round(F.sum("time") / 3600, 6).alias("total_hours"),
        F.round(F.max("time") / 3600, 6).alias("max_hours"),
        F.round(F.avg("time"), 6).alias("mean_time"),
        F.round(F.avg("active"), 3).alias("mean_active"),
        F.round(F.avg(F.when(F.col("active") != 0, F.col("time") / F.col("active"))), 9).alias("mean_time_per_active"),
        F.max("active").alias("max_active"),
    )
