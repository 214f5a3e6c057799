"""Look-ups over whole tables, against their SQL in DuckDB."""

import collections
import glob
import os

import pytest

from orrery.plans import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(spark, duck, name):
    """The query's rows, which are those of its SQL, in order where it has one."""
    got = [tuple(r) for r in Q.QUERIES[name](spark, SF).collect()]
    want = duck.execute(Q.ORACLES[name]).fetchall()
    assert collections.Counter(got) == collections.Counter(want)
    assert "ORDER BY ordinal" not in Q.ORACLES[name] or got == want
    return got


def one(duck, sql):
    return duck.execute(sql).fetchone()[0]


def test_every_event_asks_for_a_halo(spark, duck):
    events, halos = one(duck, "SELECT count(*) FROM events"), one(duck, "SELECT count(*) FROM orders")
    got = rows(spark, duck, "halo_by_gidx_all")
    assert len(got) == events and len({r[1] for r in got}) == min(events, halos)
    assert max(r[1] for r in got) > 0.99 * halos and {r[2] for r in got} == {0, 1, 2, 3}
    assert [r[0] for r in rows(spark, duck, "halo_ordered_all")] == list(range(events))


def test_id_list_grows_with_the_table(spark, duck):
    ids = {r[0] for r in duck.execute(Q._DEAR).fetchall()}
    assert {r[0] for r in Q._dear(spark, SF).collect()} == ids
    assert 0.4 < len(ids) / one(duck, "SELECT count(*) FROM lineitem") < 0.6
    low, high = duck.execute("SELECT min(l_orderkey), max(l_orderkey) FROM lineitem").fetchone()
    assert min(ids) // 10**12 < low + 20 and max(ids) // 10**12 > high - 20
    assert {r[0] for r in rows(spark, duck, "ids_semi_all")} == ids
    inside = {r[0] for r in rows(spark, duck, "by_id_in_volume_all")}
    assert inside and inside < ids


def test_every_index_and_every_locator(spark, duck):
    halos = one(duck, "SELECT count(*) FROM orders")
    got = rows(spark, duck, "gidx_to_haloid_all")
    assert {r[0] for r in got} == set(range(halos)) and len(got) == halos
    assert {r[:2] for r in rows(spark, duck, "halo_by_id_all")} == {r[1:] for r in got}


def test_whole_snapshot_is_written_and_read(spark, duck):
    got = rows(spark, duck, "snapshot_roundtrip")
    assert len(got) == one(duck, "SELECT count(*) FROM lineitem") and {r[2] for r in got} == {0, 1, 2, 3}
