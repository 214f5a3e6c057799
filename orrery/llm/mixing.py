"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, materialize

WEIGHTS = (5, 2, 1)
BUCKETS = 1024
BINS = 4096
#: At most so many rows around the cut are ordered on the driver.
CUT_ROWS = 4000


def targets(sizes: DataFrame, weights=WEIGHTS, ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(z, k, source_size) -> with ``target``: sources by code point share ``ratio`` of all by weight.

    A source stops at ``cap`` times its size; what it leaves is shared again by weight. In order
    of cap over weight the capped sources come first, so the water level is one running sum. One
    row per source: the windows are over sources, not documents.
    """
    rank = F.row_number().over(Window.orderBy("z", "k")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank % len(weights) + 1).cast("int"))
    out = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "z", "k")
    every = Window.partitionBy()
    out = out.withColumns({
        "total": F.sum("source_size").over(every).cast("double") * ratio,
        "before": F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "rest": F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)),
    })
    out = out.withColumn("full", F.col("before") + F.col("cap") / F.col("weight") * F.col("rest") <= F.col("total"))
    level = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)
    return out.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight"))).select("z", "k", "source_size", "target", "total")


def _queue(docs: DataFrame, seed: str, carry: list[str]) -> DataFrame:
    """Each row with the virtual finish times of its first and second appearance (``v1``, ``v2``)."""
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    base = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"),
        F.col("source").isNull().alias("z"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("k"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        key.alias("key"),
        F.xxhash64("text").alias("t"),
        F.col("doc_id").alias("id"),
    ).withColumn("b", (F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint") % BUCKETS).cast("int"))
    # the order within a source is (bucket, key): any fixed order that ignores the content is a shuffle
    base = materialize(base, "mix-base")
    part = base.groupBy("z", "k", "b").agg(F.sum("size").alias("s"))
    part = part.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("z", "k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    part = part.join(targets(part.groupBy("z", "k").agg(F.sum("s").alias("source_size"))), ["z", "k"])
    own = Window.partitionBy("z", "k", "b").orderBy("key", "id", "size", "t")
    queue = base.withColumns({"cum": F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)), "rn": F.row_number().over(own)})
    queue = queue.join(part.drop("s"), ["z", "k", "b"])
    served = (F.col("before") + F.col("cum")).cast("double")
    return queue.withColumns({
        "v1": F.when(F.col("size") > 0, served / F.col("target")),
        "v2": F.when(F.col("size") > 0, (F.col("source_size") + F.col("before") + F.col("cum")).cast("double") / F.col("target")),
    })


def _cut(queue: DataFrame, budget: float) -> tuple | None:
    """The last appearance taken, as (v, z, k, epoch, b, rn), or None if all or none is.

    The queue is sorted by range: a histogram of BINS ranges of virtual time finds the range in
    which the budget ends, which is refined until it holds few rows; only those are ordered.
    """
    shown = queue.select(F.explode(F.array(
        F.struct(F.col("v1").alias("v"), F.lit(1).alias("e")), F.struct(F.col("v2").alias("v"), F.lit(2).alias("e")))).alias("a"), "z", "k", "b", "rn", "size").select("a.v", "a.e", "z", "k", "b", "rn", "size").where("v is not null")
    low, high, served = 0.0, None, 0
    high = shown.agg(F.max("v")).first()[0]
    if high is None:
        return None
    while True:
        width = (high - low) / BINS
        inside = shown.where((F.col("v") >= low) & (F.col("v") <= high))
        bin_of = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1)) if width > 0 else F.lit(0).cast("bigint")
        bins = sorted(inside.groupBy(bin_of.alias("bin")).agg(F.sum("size"), F.count("*"), F.min("v"), F.max("v")).collect())
        for _, tokens, rows, first, last in bins:
            if served + tokens > budget:
                break
            served += tokens
        else:
            return (float("inf"),)
        narrow = (first, last) != (low, high)
        low, high = first, last
        if rows <= CUT_ROWS or not narrow or low == high:
            break
    taken = None
    edge = shown.where((F.col("v") >= low) & (F.col("v") <= high)).orderBy("v", "z", "k", "e", "b", "rn")
    for r in edge.toLocalIterator():
        served += r["size"]
        if served > budget:
            break
        taken = (r["v"], r["z"], r["k"], r["e"], r["b"], r["rn"])
    return taken or (low, False, "", 0, 0, 0)


def mix(docs: DataFrame, seed: str = "mix", carry: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (its columns ``carry``, by default all, as ``row``) with size, source_size, target, taken and its finish times.

    Each document, shuffled within its source, gets as virtual finish time the source's words so
    far over the source's target, once for each of two passes; in global order of that time whole
    appearances are taken until the next would exceed the total budget. A source's running sum
    is split over BUCKETS buckets, so a source with a third of all rows is not one task's work.
    Null texts and texts without words have size 0 and are taken 0; a null source is a source of its
    own, last; repeated rows count each; an empty table gives an empty table.
    """
    queue = materialize(_queue(docs, seed, carry or docs.columns), "mix-queue")
    head = queue.select("total").first()
    cut = _cut(queue, head[0]) if head else None

    def takes(v: str, epoch: int):
        if cut is None:
            return F.lit(0)
        if len(cut) == 1:
            return F.col(v).isNotNull().cast("int")
        here = F.struct(F.col(v).alias("v"), F.col("z"), F.col("k"), F.lit(epoch).alias("e"), F.col("b"), F.col("rn"))
        last = F.struct(F.lit(cut[0]).alias("v"), F.lit(cut[1]).alias("z"), F.lit(cut[2]).alias("k"), F.lit(cut[3]).alias("e"), F.lit(cut[4]).alias("b"), F.lit(cut[5]).alias("rn"))
        return F.coalesce((F.col(v).isNotNull() & (here <= last)).cast("int"), F.lit(0))

    out = queue.withColumns({"t1": takes("v1", 1), "t2": takes("v2", 2)})
    return out.withColumn("taken", ((F.col("t1") + F.col("t2")) * F.col("size")).cast("bigint"))


def mixed_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, sorted by virtual finish time."""
    out = mix(docs, seed)
    times = F.filter(F.array(F.when(F.col("t1") == 1, F.col("v1")), F.when(F.col("t2") == 1, F.col("v2"))), lambda v: v.isNotNull())
    return out.select("row", F.explode(times).alias("v")).orderBy("v").select("row.*")


def op7_source_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs, carry=["doc_id"]).select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source IS NULL AS z, coalesce(source, '') AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
e AS (SELECT *, CAST(('0x' || substr(key, 1, 8))::BIGINT % 1024 AS INTEGER) AS b FROM d),
s AS (SELECT z, k, CAST(sum(size) AS BIGINT) AS source_size FROM e GROUP BY z, k),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY z, k) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             source_size::DOUBLE * 2.0::DOUBLE AS cap FROM s),
x AS (SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
             coalesce(sum(cap) OVER (ORDER BY cap / weight, z, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS before,
             sum(weight) OVER (ORDER BY cap / weight, z, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
y AS (SELECT *, before + cap / weight * rest <= total AS full_up FROM x),
t AS (SELECT z, k, source_size, total, CASE WHEN full_up THEN cap ELSE
        (total - coalesce(sum(CASE WHEN full_up THEN cap END) OVER (), 0.0::DOUBLE)) / sum(CASE WHEN NOT full_up THEN weight END) OVER () * weight END AS target FROM y),
q AS (SELECT e.*, source_size, total, target,
             CAST(sum(size) OVER (PARTITION BY e.z, e.k ORDER BY b, key, doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum,
             row_number() OVER (PARTITION BY e.z, e.k, b ORDER BY key, doc_id) AS rn
      FROM e JOIN t ON e.z = t.z AND e.k = t.k),
a AS (SELECT *, 1 AS ep, cum::DOUBLE / target AS v FROM q WHERE size > 0
      UNION ALL SELECT *, 2 AS ep, (source_size + cum)::DOUBLE / target AS v FROM q WHERE size > 0),
c AS (SELECT doc_id, size, sum(size) OVER (ORDER BY v, z, k, ep, b, rn ROWS UNBOUNDED PRECEDING) <= total AS ok FROM a),
n AS (SELECT doc_id, sum(CASE WHEN ok THEN size ELSE 0 END) AS taken FROM c GROUP BY doc_id)
SELECT q.doc_id, q.size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id
"""
