"""Value lookups: positions of values in a list, by hash or merge pairing, and points in intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def positions_hash(find: DataFrame, check: DataFrame) -> DataFrame:
    """(ordinal, value, pos): for each row of ``find`` (ordinal, value), the last position of its value in ``check`` (pos, value)."""
    last = check.groupBy("value").agg(F.max("pos").alias("pos"))
    return find.join(last, "value").select("ordinal", "value", "pos")


def positions_merge(find: DataFrame, check: DataFrame) -> DataFrame:
    """(value, pos): equal values are paired one to one, the k-th with the k-th."""
    rank = lambda by: F.row_number().over(Window.partitionBy("value").orderBy(by))
    return find.withColumn("__k", rank("ordinal")).join(check.withColumn("__k", rank("pos")), ["value", "__k"]).select("value", "pos")


def positions_all(find: DataFrame, check: DataFrame) -> DataFrame:
    """(pos, value): every row of ``check`` whose value is in ``find``."""
    return check.join(find.select("value"), "value", "left_semi").select("pos", "value")


#: Bits between the block sizes that intervals may have.
LEVEL_BITS = 4


def intervals_of(points: DataFrame, intervals: DataFrame, point: str = "point") -> DataFrame:
    """Intervals (low, high, ...) that hold a point, as an equi-join on blocks of values.

    The blocks' size follows from an interval's length, so it touches at most 2**LEVEL_BITS + 1 of them;
    points look up their block of each size that some interval has (at most 64 / LEVEL_BITS).
    """
    level = F.least(F.lit(60 // LEVEL_BITS), F.floor(F.log2(F.col("high").cast("double") - F.col("low").cast("double") + 1) / LEVEL_BITS)).cast("int")
    spread = intervals.where("low <= high").withColumn("__l", level)
    sizes = sorted(r[0] for r in spread.select("__l").distinct().collect())
    at = lambda c, n: F.shiftright(F.col(c), n * LEVEL_BITS)
    block = lambda c: F.coalesce(*(F.when(F.col("__l") == n, at(c, n)) for n in sizes), F.lit(0))
    spread = spread.withColumn("__k", F.explode(F.sequence(block("low"), block("high"))))
    asked = points.select(F.col(point).cast("bigint").alias("__p")).distinct()
    blocks = asked.select("__p", F.explode(F.array(*(F.struct(F.lit(n).alias("__l"), at("__p", n).alias("__k")) for n in sizes))).alias("__b")).select("__p", "__b.*") if sizes else asked.select("__p", F.lit(0).alias("__l"), F.lit(0).cast("bigint").alias("__k"))
    hit = spread.join(blocks, (spread["__l"] == blocks["__l"]) & (spread["__k"] == blocks["__k"]) & F.col("__p").between(F.col("low"), F.col("high")), "left_semi")
    return hit.drop("__k", "__l").distinct()


def files_for_keys(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct files, in order, whose key ranges (low, high, file) hold a key (key)."""
    return intervals_of(keys, ranges, "key").select("file").distinct().orderBy("file")
