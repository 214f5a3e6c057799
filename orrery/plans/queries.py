"""Queries over the driver tables for every operator, each with the SQL that DuckDB can run beside it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hilbert
from ..functions.geometry import Cube, Cylinder, Shell, Sphere, position
from ..operators import halos as H
from ..operators import lookup, rows, selection, simlog
from ..sources import snapshot
from . import surrogate as S

BOX = 1000.0
QUERIES: dict = {}
ORACLES: dict[str, str] = {}
P = f"WITH {S.PARTICLES_SQL}"
PQ = f"{P}, {S.ROWS_SQL}"
COLS = ["id", "parttype", "file", "x", "y", "z"]
C = ", ".join(COLS)
LO, HI = (100.0, 200.0, 50.0), (400.0, 700.0, 600.0)
CENTER = (300.0, 400.0, 250.0)
EDGE = (30.0, 980.0, 15.0)
BITS, FACTOR = 5, 32 / 1000


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _p(spark, d) -> DataFrame:
    return S.particles(spark, d)


def _where(lo, hi, end="<="):
    return " AND ".join(f"{c} >= {a} AND {c} {end} {b}" for c, a, b in zip("xyz", lo, hi, strict=True))


def _d2(c):
    return " + ".join(f"({n} - {v})*({n} - {v})" for n, v in zip("xyz", c, strict=True))


@query("geom_sphere", f"{P} SELECT {C}, rho FROM p WHERE {_d2(CENTER)} <= 40000.0")
def geom_sphere(spark, d):
    return selection.in_geometry(_p(spark, d), Sphere(CENTER, 200.0)).select(*COLS, "rho")


@query("block_scan", f"{P} SELECT id, x, y, z FROM p WHERE parttype = 0")
def block_scan(spark, d):
    return selection.species(_p(spark, d), 0).select("id", "x", "y", "z")


@query("block_slice", f"{PQ}, n AS (SELECT *, row_number() OVER (ORDER BY file, row) - 1 AS g FROM q WHERE parttype = 1) SELECT id, rho FROM n WHERE g >= 100 AND g < 600")
def block_slice(spark, d):
    """A global row slice of one type over all sub-files: a range of each file's rows, from the counts."""
    own = S.with_rows(selection.species(_p(spark, d), 1))
    counts = selection.species(_p(spark, d), 1).groupBy("file").agg(F.count("*").alias("n"))
    starts = S.running_sums(counts, "file", [], {"first": F.col("n")})
    return own.join(F.broadcast(starts), "file").where((F.col("first") + F.col("row")).between(100, 599)).select("id", "rho")


@query("all_types", f"{P} SELECT parttype, file, id, u FROM p")
def all_types(spark, d):
    return selection.species(_p(spark, d), -1).select("parttype", "file", "id", "u")


@query("type_counts", f"{P} SELECT parttype, CAST(count(*) AS BIGINT) AS n, CAST(count(*) + 4 * 4294967296 AS BIGINT) AS n_high FROM p GROUP BY parttype")
def type_counts(spark, d):
    out = _p(spark, d).groupBy("parttype").agg(F.count("*").alias("n"))
    return out.withColumn("n_high", F.shiftleft(F.lit(4).cast("bigint"), 32) + F.col("n"))


@query("header_mass", f"{P} SELECT id, CASE parttype WHEN 1 THEN 0.5::DOUBLE WHEN 4 THEN 0.25::DOUBLE ELSE mass_block END AS mass FROM p")
def header_mass(spark, d):
    return _p(spark, d).select("id", selection.header_mass(F.col("parttype"), S.MASSES, F.col("mass_block")).alias("mass"))


@query("header_meta", f"{P} SELECT file, " + ", ".join(f"CAST(count(CASE WHEN parttype = {t} THEN 1 END) AS BIGINT) AS n{t}" for t in range(6)) + " FROM p GROUP BY file")
def header_meta(spark, d):
    return _p(spark, d).groupBy("file").agg(*(F.count(F.when(F.col("parttype") == t, 1)).alias(f"n{t}") for t in range(6)))


@query("subfind_header", f"WITH {S.HALOS_SQL}, {S.SUBHALOS_SQL} SELECT CAST((SELECT count(*) FROM halos) AS BIGINT) AS tothalos, CAST((SELECT count(*) FROM subhalos) AS BIGINT) AS totsubhalos, CAST((SELECT count(*) FROM lineitem) AS BIGINT) AS totpids, CAST((SELECT count(*) FROM halos WHERE glen > 3) AS BIGINT) AS totgroups")
def subfind_header(spark, d):
    lens = S.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_linestatus").alias("s"))
    totals = lens.agg(F.sum("n").alias("totpids"), F.sum("s").alias("totsubhalos"), F.count(F.when(F.col("n") > 3, 1)).alias("totgroups"))
    return totals.withColumn("tothalos", F.lit(S.table(spark, d, "orders").count()).cast("bigint"))


@query("block_presence", f"{P} SELECT parttype, CAST(count(*) AS BIGINT) AS n, max(CASE WHEN rho > 0.05 THEN 1 ELSE 0 END) = 1 AS has_rho FROM p GROUP BY parttype")
def block_presence(spark, d):
    return _p(spark, d).groupBy("parttype").agg(F.count("*").alias("n"), F.max(F.col("rho") > 0.05).alias("has_rho"))


@query("first_file", f"{P} SELECT parttype, min(file) AS file FROM p GROUP BY parttype")
def first_file(spark, d):
    return _p(spark, d).groupBy("parttype").agg(F.min("file").alias("file"))


@query("box_brute", f"{P} SELECT {C} FROM p WHERE parttype = 2 AND {_where(LO, HI)}")
def box_brute(spark, d):
    return selection.box(selection.species(_p(spark, d), 2), HI, LO).select(*COLS)


@query("box_halfopen", f"{P} SELECT {C} FROM p WHERE {_where(LO, HI, '<')}")
def box_halfopen(spark, d):
    return selection.box_half_open(_p(spark, d), LO, HI).select(*COLS)


@query("volume", f"{P} SELECT {C} FROM p WHERE {_where([c - 120 for c in CENTER], [c + 120 for c in CENTER])}")
def volume(spark, d):
    return selection.volume(_p(spark, d), CENTER, 120.0).select(*COLS)


@query("geom_cube", f"{P} SELECT {C} FROM p WHERE {_where(LO, HI)}")
def geom_cube(spark, d):
    return selection.in_geometry(_p(spark, d), Cube(LO, HI)).select(*COLS)


@query("geom_shell", f"{P} SELECT {C} FROM p WHERE {_d2(CENTER)} BETWEEN 32400.0 AND 48400.0")
def geom_shell(spark, d):
    return selection.in_geometry(_p(spark, d), Shell(CENTER, 200.0, 40.0)).select(*COLS)


A, B, RAD = (100.0, 100.0, 100.0), (800.0, 700.0, 500.0), 90.0
_D = [b - a for a, b in zip(A, B, strict=True)]
_DOT = lambda c: " + ".join(f"({n} - {v})*{w}" for n, v, w in zip("xyz", c, _D, strict=True))
_CROSS = [f"((y - {A[1]})*{_D[2]} - (z - {A[2]})*{_D[1]})", f"((z - {A[2]})*{_D[0]} - (x - {A[0]})*{_D[2]})", f"((x - {A[0]})*{_D[1]} - (y - {A[1]})*{_D[0]})"]


@query("geom_cylinder", f"{P} SELECT {C} FROM p WHERE {_DOT(A)} >= 0 AND {_DOT(B)} <= 0 AND sqrt({' + '.join(f'{c}*{c}' for c in _CROSS)}) / {sum(v * v for v in _D) ** 0.5} <= {RAD}")
def geom_cylinder(spark, d):
    return selection.in_geometry(_p(spark, d), Cylinder(A, B, RAD)).select(*COLS)


_SHIFT = ", ".join(f"CASE WHEN {n} - {v} > 500.0 THEN {n} - 1000.0 WHEN {v} - {n} > 500.0 THEN {n} + 1000.0 ELSE {n} END AS {n}" for n, v in zip("xyz", EDGE, strict=True))


@query("geom_periodic_shift", f"{P}, s AS (SELECT id, parttype, file, {_SHIFT} FROM p) SELECT {C} FROM s WHERE {_d2(EDGE)} <= 40000.0")
def geom_periodic_shift(spark, d):
    return selection.in_geometry(_p(spark, d), Sphere(EDGE, 200.0), BOX).select(*COLS)


@query("geom_periodic_noshift", f"{P} SELECT {C} FROM p WHERE {_d2(EDGE)} <= 40000.0")
def geom_periodic_noshift(spark, d):
    return selection.in_geometry(_p(spark, d), Sphere(EDGE, 200.0), BOX, shift=False).select(*COLS)


@query("custom_filter", f"{P} SELECT id, rho, u FROM p WHERE rho > 0.07 AND u < 20000")
def custom_filter(spark, d):
    return selection.filtered(_p(spark, d), "rho > 0.07 AND u < 20000", ["id", "rho", "u"])


_PICK = "parttype = 3 AND x >= 200 AND x <= 700"
_RUNS = f"{PQ}, r AS (SELECT file, row, row - row_number() OVER (PARTITION BY file ORDER BY row) AS g FROM q WHERE {_PICK}), runs AS (SELECT file, min(row) AS index, CAST(count(*) AS BIGINT) AS n_to_read FROM r GROUP BY file, g)"


def _runs(spark, d):
    return rows.to_runs(S.with_rows(selection.species(_p(spark, d), 3)).where(_PICK))


@query("read_positions", f"{_RUNS} SELECT file, index, n_to_read FROM runs")
def read_positions(spark, d):
    return _runs(spark, d)


@query("positions_count", f"{_RUNS} SELECT CAST(sum(n_to_read) AS BIGINT) AS n_part FROM runs")
def positions_count(spark, d):
    return rows.total(_runs(spark, d))


@query("positions_expand", f"{PQ} SELECT file, row FROM q WHERE {_PICK}")
def positions_expand(spark, d):
    return rows.expand(_runs(spark, d))


@query("positions_gather", f"{PQ} SELECT id, file, row, u FROM q WHERE {_PICK}")
def positions_gather(spark, d):
    return rows.gather(S.with_rows(selection.species(_p(spark, d), 3)), _runs(spark, d)).select("id", "file", "row", "u")


@query("run_merge", f"{PQ}, m AS (SELECT file, row, CAST(1 + row % 3 AS BIGINT) AS n FROM q WHERE parttype = 3 AND row % 3 <> 1), e AS (SELECT file, row AS s, row + n AS t, max(row + n) OVER (PARTITION BY file ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM m), g AS (SELECT *, sum(CASE WHEN s <= b THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY s) AS k FROM e) SELECT file, min(s) AS index, max(t) - min(s) AS n_to_read FROM g GROUP BY file, k")
def run_merge(spark, d):
    own = S.with_rows(selection.species(_p(spark, d), 3)).where("row % 3 <> 1")
    return rows.merge_runs(own.select("file", F.col("row").alias("index"), (1 + F.col("row") % 3).cast("bigint").alias("n_to_read")))


@query("positions_roundtrip", f"{_RUNS} SELECT file, index, n_to_read FROM runs")
def positions_roundtrip(spark, d):
    """Saved to Parquet in the shared folder and loaded again."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/checkpoints"
    path = f"{root}/positions-{uuid.uuid4().hex}"
    rows.save(_runs(spark, d), path)
    return rows.load(spark, path)


@query("snapshot_roundtrip", f"{PQ} SELECT id, parttype, file, row, x, y, z, rho, u, mass_block FROM q")
def snapshot_roundtrip(spark, d):
    """The whole particle table through the binary sink, one sub-file a task, in the shared folder and back."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or f"{tempfile.gettempdir()}/checkpoints"
    path = f"{root.removeprefix('file://').removeprefix('file:')}/snapshot-{uuid.uuid4().hex}/snap"
    snapshot.register(spark)
    blocks = S.with_rows(_p(spark, d)).selectExpr("file", "parttype", "row", "id AS ID", "array(x, y, z) AS POS", "rho AS RHO", "u AS U", "mass_block AS MASS")
    blocks.repartitionById(4, F.col("file")).write.format("particles").mode("append").save(path)
    back = snapshot.read(spark, path)
    return back.selectExpr("ID AS id", "parttype", "file", "row", "POS[0] AS x", "POS[1] AS y", "POS[2] AS z", "RHO AS rho", "U AS u", "MASS AS mass_block")


_IDS = "SELECT l_orderkey*1000000000000 + l_partkey*10000000 + l_suppkey*1000 + l_linenumber*100 + CAST(l_quantity AS BIGINT) AS id FROM lineitem WHERE l_partkey < 200"


def _ids(spark, d):
    return S.table(spark, d, "lineitem").where("l_partkey < 200").selectExpr(f"{S.ID} AS id")


@query("ids_semi", f"{P} SELECT {C} FROM p WHERE id IN ({_IDS})")
def ids_semi(spark, d):
    return selection.by_ids(_p(spark, d), _ids(spark, d)).select(*COLS)


@query("by_id_in_volume", f"{P} SELECT {C} FROM p WHERE id IN ({_IDS}) AND {_where([c - 250 for c in CENTER], [c + 250 for c in CENTER])}")
def by_id_in_volume(spark, d):
    return selection.by_ids(_p(spark, d), _ids(spark, d), center=CENTER, radius=250.0).select(*COLS)


_DEAR = f"SELECT {S.ID} AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_totalprice > 250000"


def _dear(spark, d):
    """The ids of all orders above a price: about half of the table at every scale."""
    dear = S.table(spark, d, "orders").where("o_totalprice > 250000")
    return S.table(spark, d, "lineitem").join(dear, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").selectExpr(f"{S.ID} AS id")


@query("ids_semi_all", f"{P} SELECT {C} FROM p WHERE id IN ({_DEAR})")
def ids_semi_all(spark, d):
    return selection.by_ids(_p(spark, d), _dear(spark, d)).select(*COLS)


@query("by_id_in_volume_all", f"{P} SELECT {C} FROM p WHERE id IN ({_DEAR}) AND {_where([c - 250 for c in CENTER], [c + 250 for c in CENTER])}")
def by_id_in_volume_all(spark, d):
    return selection.by_ids(_p(spark, d), _dear(spark, d), center=CENTER, radius=250.0).select(*COLS)


_FIND = "f AS (SELECT o_orderkey AS ordinal, o_custkey AS value FROM orders), c AS (SELECT event_id AS pos, user_id AS value FROM events)"


def _find(spark, d):
    return S.table(spark, d, "orders").select(F.col("o_orderkey").alias("ordinal"), F.col("o_custkey").alias("value")), S.table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("value"))


@query("ids_hash_last", f"WITH {_FIND} SELECT ordinal, f.value, pos FROM f JOIN (SELECT value, max(pos) AS pos FROM c GROUP BY value) m ON f.value = m.value")
def ids_hash_last(spark, d):
    return lookup.positions_hash(*_find(spark, d))


@query("ids_merge", f"WITH {_FIND} SELECT a.value, b.pos FROM (SELECT *, row_number() OVER (PARTITION BY value ORDER BY ordinal) AS k FROM f) a JOIN (SELECT *, row_number() OVER (PARTITION BY value ORDER BY pos) AS k FROM c) b ON a.value = b.value AND a.k = b.k")
def ids_merge(spark, d):
    return lookup.positions_merge(*_find(spark, d))


@query("ids_set", f"WITH {_FIND} SELECT pos, value FROM c WHERE value IN (SELECT value FROM f)")
def ids_set(spark, d):
    return lookup.positions_all(*_find(spark, d))


_IV = "iv AS (SELECT s_suppkey * 50 AS low, s_suppkey * 50 + 30 AS high, CAST(s_suppkey % 7 AS INT) AS file FROM supplier), k AS (SELECT o_custkey AS key FROM orders WHERE o_totalprice > 400000)"


@query("interval_files", f"WITH {_IV} SELECT DISTINCT file FROM iv WHERE EXISTS (SELECT 1 FROM k WHERE key BETWEEN low AND high)")
def interval_files(spark, d):
    iv = S.table(spark, d, "supplier").selectExpr("s_suppkey * 50 AS low", "s_suppkey * 50 + 30 AS high", "CAST(s_suppkey % 7 AS INT) AS file")
    return lookup.files_for_keys(S.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("key")), iv)


@query("interval_semi", f"WITH {_IV} SELECT DISTINCT low, high FROM iv WHERE EXISTS (SELECT 1 FROM k WHERE key BETWEEN low AND high)")
def interval_semi(spark, d):
    iv = S.table(spark, d, "supplier").selectExpr("s_suppkey * 50 AS low", "s_suppkey * 50 + 30 AS high")
    return lookup.intervals_of(S.table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("point")), iv)


Hq = f"WITH {S.HALOS_SQL}"


@query("halo_filter", f"{Hq} SELECT file, id FROM halos WHERE mtop > 300000")
def halo_filter(spark, d):
    return H.filter_halos(S.halos(spark, d), "mtop > 300000")


@query("halo_filter_files", f"{Hq} SELECT file, id FROM halos WHERE mtop > 300000 AND file IN (1, 3)")
def halo_filter_files(spark, d):
    return H.filter_halos(S.halos(spark, d), F.col("mtop") > 300000, [1, 3])


@query("halo_argmax", f"{Hq} SELECT file, id, mtop, gx, gy, gz, r200 FROM halos ORDER BY mtop DESC, file, id LIMIT 1")
def halo_argmax(spark, d):
    return H.most_massive(S.halos(spark, d)).select("file", "id", "mtop", "gx", "gy", "gz", "r200")


_REQ = "CAST(event_id AS BIGINT) AS ordinal, (event_id * 7919) % 1500 AS gidx FROM events WHERE event_id < 1000"


@query("halo_by_id", f"{Hq} SELECT file, id, mtop, glen FROM halos WHERE id % 10 = 3 AND file <> 2")
def halo_by_id(spark, d):
    own = S.halos(spark, d)
    return H.by_locator(own, own.where("id % 10 = 3 AND file <> 2")).select("file", "id", "mtop", "glen")


@query("halo_by_gidx", f"{Hq} SELECT ordinal, r.gidx, file, id, mtop FROM (SELECT {_REQ}) r JOIN halos h ON r.gidx = h.gidx")
def halo_by_gidx(spark, d):
    ask = S.table(spark, d, "events").where("event_id < 1000").selectExpr("CAST(event_id AS BIGINT) AS ordinal", "(event_id * 7919) % 1500 AS gidx")
    return H.by_global_index(S.halos(spark, d), ask).select("ordinal", "gidx", "file", "id", "mtop")


@query("halo_ordered", f"{Hq} SELECT ordinal, mtop FROM (SELECT {_REQ}) r JOIN halos h ON r.gidx = h.gidx ORDER BY ordinal")
def halo_ordered(spark, d):
    return halo_by_gidx(spark, d).orderBy("ordinal").select("ordinal", "mtop")


_ASK = "CAST(event_id AS BIGINT) AS ordinal, (event_id * 7919) % {n} AS gidx"


@query("halo_by_gidx_all", f"{Hq} SELECT ordinal, r.gidx, file, id, mtop FROM (SELECT {_ASK.format(n='(SELECT count(*) FROM orders)')} FROM events) r JOIN halos h ON r.gidx = h.gidx")
def halo_by_gidx_all(spark, d):
    """Every event is a request, and the requests spread over all halos."""
    n = max(S.table(spark, d, "orders").count(), 1)
    ask = S.table(spark, d, "events").selectExpr(*S._split(_ASK.format(n=n)))
    return H.by_global_index(S.halos(spark, d), ask).select("ordinal", "gidx", "file", "id", "mtop")


@query("halo_ordered_all", f"{Hq} SELECT ordinal, mtop FROM (SELECT {_ASK.format(n='(SELECT count(*) FROM orders)')} FROM events) r JOIN halos h ON r.gidx = h.gidx ORDER BY ordinal")
def halo_ordered_all(spark, d):
    return halo_by_gidx_all(spark, d).orderBy("ordinal").select("ordinal", "mtop")


@query("gidx_to_haloid", f"{Hq} SELECT gidx, file, id FROM halos WHERE gidx % 3 = 0")
def gidx_to_haloid(spark, d):
    counts = S.halos(spark, d).groupBy("file").agg(F.count("*").alias("n"))
    return H.locate(S.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("gidx")), counts)


@query("gidx_to_haloid_all", f"{Hq} SELECT gidx, file, id FROM halos")
def gidx_to_haloid_all(spark, d):
    counts = S.halos(spark, d).groupBy("file").agg(F.count("*").alias("n"))
    return H.locate(S.table(spark, d, "orders").select(F.col("o_orderkey").alias("gidx")), counts)


@query("halo_by_id_all", f"{Hq} SELECT file, id, mtop, glen FROM halos")
def halo_by_id_all(spark, d):
    """Every halo by the (file, id) that its global index has."""
    return H.by_locator(S.halos(spark, d), gidx_to_haloid_all(spark, d)).select("file", "id", "mtop", "glen")


_HR = f"{Hq}, r AS (SELECT file, id - 1 AS row, id - 1 - row_number() OVER (PARTITION BY file ORDER BY id) AS g FROM halos WHERE mtop > 150000)"


@query("haloid_runs", f"{_HR} SELECT file, min(row) AS index, CAST(count(*) AS BIGINT) AS n_to_read FROM r GROUP BY file, g")
def haloid_runs(spark, d):
    return H.locators_to_runs(H.filter_halos(S.halos(spark, d), "mtop > 150000"))


@query("haloid_from_runs", f"{Hq} SELECT file, id FROM halos WHERE mtop > 150000")
def haloid_from_runs(spark, d):
    return H.runs_to_locators(haloid_runs(spark, d))


@query("goff_prefix", f"{Hq} SELECT gidx, glen, goff FROM halos")
def goff_prefix(spark, d):
    return S.halos(spark, d).select("gidx", "glen", "goff")


@query("halo_members", f"{Hq}, {S.PIDS_SQL} SELECT h.gidx AS halo, pid FROM halos h JOIN pids p ON p.gidx >= goff AND p.gidx < goff + glen WHERE mtop > 200000")
def halo_members(spark, d):
    own = S.halos(spark, d).where("mtop > 200000").select(F.col("gidx").alias("halo"), "glen", "goff")
    return H.members(own, S.pids(spark, d)).select("halo", "pid")


@query("subhalo_members", f"WITH {S.SUBHALOS_SQL}, {S.PIDS_SQL} SELECT s.gidx AS subhalo, pid FROM subhalos s JOIN pids p ON p.gidx >= soff AND p.gidx < soff + slen WHERE slen > 2")
def subhalo_members(spark, d):
    own = S.subhalos(spark, d).where("slen > 2").select(F.col("gidx").alias("subhalo"), "slen", "soff")
    return H.members(own, S.pids(spark, d), "slen", "soff").select("subhalo", "pid")


_TOP = f"WITH {S.HALOS_SQL}, {S.PIDS_SQL}, {S.PARTICLES_SQL}, t AS (SELECT * FROM halos ORDER BY glen DESC, gidx LIMIT 1)"


@query("halo_particles", f"{_TOP} SELECT p.id, p.x, p.y, p.z FROM p, t WHERE p.id IN (SELECT pid FROM pids, t WHERE pids.gidx >= goff AND pids.gidx < goff + glen) AND abs(x - gx) <= 3 * r200 AND abs(y - gy) <= 3 * r200 AND abs(z - gz) <= 3 * r200")
def halo_particles(spark, d):
    halo = S.halos(spark, d).orderBy(F.desc("glen"), "gidx").limit(1)
    return H.particles_in_halo(_p(spark, d), halo, S.pids(spark, d), scale=3.0).select("id", "x", "y", "z")


_INT = lambda c: f"CAST(floor({c} * {FACTOR}) AS BIGINT) + CASE WHEN {c} >= 0 THEN 0 ELSE -1 END + CASE WHEN {c} * {FACTOR} >= {2**BITS - 0.5} THEN 1 ELSE 0 END"
_KEY = lambda x, y, z: f"list_reduce(list_prepend(0::BIGINT, {list(range(BITS - 1, -1, -1))}::BIGINT[]), lambda acc, i: (acc // 64) * 512 + list_extract({hilbert.flat_table()}::BIGINT[], 1 + (acc % 64) * 8 + (({x} >> i) & 1) * 4 + (({y} >> i) & 1) * 2 + (({z} >> i) & 1))) // 64"
_CELLS = f"{P}, c AS (SELECT id, {_INT('x')} AS ix, {_INT('y')} AS iy, {_INT('z')} AS iz FROM p)"


def _cells(df):
    return tuple(hilbert.int_position(p, 0.0, FACTOR, BITS) for p in position(df))


@query("ph_intpos", f"{_CELLS} SELECT id, ix, iy, iz FROM c")
def ph_intpos(spark, d):
    df = _p(spark, d)
    return df.select("id", *(c.alias(n) for c, n in zip(_cells(df), ("ix", "iy", "iz"), strict=True)))


@query("ph_key", f"{_CELLS} SELECT id, {_KEY('ix', 'iy', 'iz')} AS key FROM c")
def ph_key(spark, d):
    cells = ph_intpos(spark, d)
    return cells.select("id", hilbert.key_column(BITS, F.col("ix"), F.col("iy"), F.col("iz")).alias("key"))


@query("ph_keylist", f"WITH c AS (SELECT ix, iy, iz FROM range(2, 9) a(ix), range(5, 12) b(iy), range(1, 8) e(iz)) SELECT {_KEY('ix', 'iy', 'iz')} AS key FROM c")
def ph_keylist(spark, d):
    return hilbert.key_list(spark, (70.0, 170.0, 40.0), (270.0, 350.0, 230.0), (0.0, 0.0, 0.0), FACTOR, BITS).select("key")


@query("ph_box_cells", f"{_CELLS} SELECT id FROM c WHERE ix & 31 BETWEEN 2 AND 8 AND iy & 31 BETWEEN 5 AND 11 AND iz & 31 BETWEEN 1 AND 7")
def ph_box_cells(spark, d):
    """Whole cells of a box, as a keyed read gives them."""
    df = _p(spark, d)
    keyed = df.withColumn("ph_key", hilbert.key_column(BITS, *_cells(df)))
    return selection.box_cells(keyed, (70.0, 170.0, 40.0), (270.0, 350.0, 230.0), (0.0, 0.0, 0.0), FACTOR, BITS, exact=False).select("id")


_LOG = f"WITH {S.LOG_SQL}, f AS (SELECT line_no, CAST(trim(substr(split_part(line, '=', 2), 1, 9)) AS BIGINT) AS step, CAST(trim(substr(split_part(line, '=', 3), 1, 10)) AS DOUBLE) AS time, CAST(trim(substr(split_part(line, '=', 4), 1, 11)) AS BIGINT) AS active FROM simlog WHERE line LIKE '%Step%'), g AS (SELECT step, arg_max(time, line_no) AS time, arg_max(active, line_no) AS active, min(line_no) AS line_no FROM f GROUP BY step)"


@query("log_parse", f"{_LOG} SELECT step, time, active, line_no FROM g")
def log_parse(spark, d):
    return simlog.parse(S.simlog(spark, d))


@query("log_summary", f"{_LOG} SELECT arg_max(step, line_no) AS last_step, round(sum(time) / 3600, 6) AS total_hours, round(max(time) / 3600, 6) AS max_hours, round(avg(time), 6) AS mean_time, round(avg(active), 3) AS mean_active, round(avg(time / active), 9) AS mean_time_per_active, max(active) AS max_active FROM g")
def log_summary(spark, d):
    return simlog.summary(log_parse(spark, d))
