"""The driver's star-schema tables as particles, member lists, halos and a timing log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .prefix import running_sums

ID = "l_orderkey*1000000000000 + l_partkey*10000000 + l_suppkey*1000 + l_linenumber*100 + CAST(l_quantity AS BIGINT)"
PARTICLE = f"""{ID} AS id,
  (CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END)*2 + (CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END) AS parttype,
  CAST(l_suppkey % 4 AS INT) AS file, l_quantity*20.0 AS x, l_extendedprice/105.0 AS y,
  CAST((l_partkey*37) % 1000 AS DOUBLE) AS z, l_discount AS rho, l_extendedprice AS u, l_tax AS mass_block"""
PARTICLES_SQL = f"p AS (SELECT {PARTICLE} FROM lineitem)"
ROWS_SQL = "q AS (SELECT p.*, CAST(row_number() OVER (PARTITION BY file, parttype ORDER BY id) - 1 AS BIGINT) AS row FROM p)"
PIDS_SQL = f"pids AS (SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linestatus, l_partkey, l_suppkey, l_linenumber, l_quantity) - 1 AS BIGINT) AS gidx, {ID} AS pid FROM lineitem)"
HALOS_SQL = """halos AS (SELECT h.*, CAST(row_number() OVER (PARTITION BY file ORDER BY gidx) AS BIGINT) AS id FROM (
 SELECT o_orderkey AS gidx, CAST(ntile(4) OVER (ORDER BY o_orderkey) - 1 AS INT) AS file, o_totalprice AS mtop,
  CAST((o_orderkey*37) % 1000 AS DOUBLE) AS gx, o_totalprice/500.0 AS gy,
  CAST((o_custkey*13) % 1000 AS DOUBLE) AS gz, CAST(50 + o_custkey % 200 AS DOUBLE) AS r200, glen,
  CAST(coalesce(sum(glen) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS goff
 FROM (SELECT o_orderkey, o_custkey, o_totalprice, CAST(count(l_orderkey) AS BIGINT) AS glen
       FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_totalprice) c) h)"""
SUBHALOS_SQL = """subhalos AS (SELECT CAST(row_number() OVER (ORDER BY grnr, sub) - 1 AS BIGINT) AS gidx, grnr, sub, slen,
 CAST(coalesce(sum(slen) OVER (ORDER BY grnr, sub ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS soff
FROM (SELECT l_orderkey AS grnr, l_linestatus AS sub, CAST(count(*) AS BIGINT) AS slen FROM lineitem GROUP BY l_orderkey, l_linestatus) s)"""
LOG_SQL = """simlog AS (SELECT event_id AS line_no, concat('Step=', lpad(CAST(event_id - 10*CAST(floor(event_id/100) AS BIGINT) AS VARCHAR(20)), 9, ' '),
 ' Time=', lpad(CAST(value AS VARCHAR(20)), 10, ' '), ' Active=', lpad(CAST(user_id*1000 + 1 AS VARCHAR(20)), 11, ' ')) AS line FROM events)"""
MASSES = [0.0, 0.5, 0.0, 0.0, 0.25, 0.0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, parttype, file, x, y, z, rho, u, mass_block: a projection, so filters reach the scan's rows."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_split(PARTICLE))


def _split(text: str) -> list[str]:
    """Select items of a list of aliased expressions."""
    out, depth, item = [], 0, ""
    for ch in text:
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            out.append(item.strip())
            item = ""
        else:
            item += ch
    return [*out, item.strip()]


def with_rows(df: DataFrame) -> DataFrame:
    """Add ``row``: the 0-based place within (file, parttype). A binary source brings it itself."""
    return df.withColumn("row", (F.row_number().over(Window.partitionBy("file", "parttype").orderBy("id")) - 1).cast("bigint"))


def pids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gidx, pid: the member list, numbered by a running count over order keys."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linestatus", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", f"{ID} AS pid")
    return running_sums(rows, "l_orderkey", ["l_linestatus", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"], {"gidx": F.lit(1)}).select("gidx", "pid")


def halos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gidx, (file, id), mtop, gx, gy, gz, r200, glen, goff; four files of near-equal size."""
    orders = table(spark, sf_dir, "orders")
    n = orders.count()  # from the footers
    q, r = divmod(n, 4)
    lens = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("glen"))
    own = orders.join(lens, "o_orderkey", "left").selectExpr(
        "o_orderkey AS gidx",
        f"CAST(CASE WHEN o_orderkey < {r * (q + 1)} THEN o_orderkey DIV {q + 1} ELSE {r} + (o_orderkey - {r * (q + 1)}) DIV {max(q, 1)} END AS INT) AS file",
        "o_totalprice AS mtop", "CAST((o_orderkey*37) % 1000 AS DOUBLE) AS gx", "o_totalprice/500.0 AS gy",
        "CAST((o_custkey*13) % 1000 AS DOUBLE) AS gz", "CAST(50 + o_custkey % 200 AS DOUBLE) AS r200", "coalesce(glen, 0L) AS glen")
    own = own.withColumn("id", F.col("gidx") - F.col("file") * q - F.least(F.col("file"), F.lit(r)) + 1)
    return running_sums(own, "gidx", [], {"goff": F.col("glen")})


def subhalos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("grnr"), F.col("l_linestatus").alias("sub")).agg(F.count("*").alias("slen"))
    return running_sums(rows, "grnr", ["sub"], {"gidx": F.lit(1), "soff": F.col("slen")}).select("gidx", "grnr", "sub", "slen", "soff")


def simlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split(LOG_SQL[len("simlog AS (SELECT ") : -len(" FROM events)")]))
