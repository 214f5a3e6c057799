"""Golden values that need no file, properties, and selections on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.functions import hilbert
from orrery.functions.geometry import Cube, Cylinder, Shell, Sphere, shift_periodic
from orrery.operators import halos, lookup, rows, selection, simlog

KEYS = [0, 1, 2, 3, 4, 5, 6, 7, 153391689, 153391690, 153391693, 153391694, 383479221, 383479222, 421827144, 421827145, 421827150, 421827151, 651914678, 651914679, 690262601, 920350129, 920350134, 1073741816, 1073741819, 1073741820, 1073741823]


def test_keys(spark):
    assert [hilbert.key_of(10, *c) for c in ((0, 0, 0), (0, 0, 1), (0, 1, 1))] == [0, 1, 6]
    cells = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    assert sorted(hilbert.key_of(10, *c) for c in cells) == KEYS
    df = spark.createDataFrame(cells, "x bigint, y bigint, z bigint")
    assert sorted(r[0] for r in df.select(hilbert.key_column(10, F.col("x"), F.col("y"), F.col("z"))).collect()) == KEYS
    every = {hilbert.key_of(3, x, y, z) for x in range(8) for y in range(8) for z in range(8)}
    assert every == set(range(512))


def test_key_ranges_cover_a_box(spark):
    ranges = hilbert.key_ranges((10, 20, 5), (300, 200, 400), (0, 0, 0), 0.032, 5, most=64)
    for x, y, z in ((0, 0, 0), (9, 6, 12), (5, 3, 7)):
        k = hilbert.key_of(5, x, y, z)
        assert any(a <= k <= b for a, b in ranges)


def test_keyed_box_is_the_plain_box(spark):
    rng = random.Random(3)
    pts = [(i, *(rng.uniform(0, 1000) for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(pts, "id int, x double, y double, z double")
    cell = [hilbert.int_position(F.col(c), 0, 0.032, 5) for c in "xyz"]
    keyed = df.withColumn("ph_key", hilbert.key_column(5, *cell))
    lo, hi = (100, 50, 300), (600, 700, 900)
    a = {r.id for r in selection.box_cells(keyed, lo, hi, (0, 0, 0), 0.032, 5).collect()}
    assert a == {r.id for r in selection.box(df, hi, lo).collect()} and a


def test_shift(spark):
    df = spark.createDataFrame([(1.0, 2.0), (8.0, 2.0), (2.0, 8.0)], "x double, c double")
    out = [df.where(F.col("x") == x).select(shift_periodic(F.col("x"), c, 10.0)).first()[0] for x, c in ((1.0, 2.0), (8.0, 2.0), (2.0, 8.0))]
    assert out == [1.0, -2.0, 12.0]


@pytest.mark.parametrize("shape", [Sphere((5, 5, 5), 3), Cube((1, 2, 3), (7, 8, 9)), Shell((5, 5, 5), 3, 1), Cylinder((1, 1, 1), (8, 8, 8), 2)])
def test_translation_invariance(spark, shape):
    """Moving points and shape together by a box vector changes nothing in a periodic box."""
    rng = random.Random(5)
    pts = [(i, *(rng.uniform(0, 10) for _ in range(3))) for i in range(500)]
    df = spark.createDataFrame(pts, "id int, x double, y double, z double")
    move = (3.0, 4.0, 6.0)
    moved = df.select("id", *(F.pmod(F.col(c) + m, F.lit(10.0)).alias(c) for c, m in zip("xyz", move, strict=True)))
    at = lambda v: tuple(a + b for a, b in zip(v, move, strict=True))
    other = {Sphere: lambda s: Sphere(at(s.at), s.radius), Cube: lambda s: Cube(at(s.lo), at(s.hi)), Shell: lambda s: Shell(at(s.at), s.radius, s.width), Cylinder: lambda s: Cylinder(at(s.start), at(s.end), s.radius)}[type(shape)](shape)
    a = {r.id for r in selection.in_geometry(df, shape, 10.0).collect()}
    b = {r.id for r in selection.in_geometry(moved, other, 10.0).collect()}
    assert len(a ^ b) <= 1 and a  # a point on the border may fall to either side by rounding


def test_nan_is_outside(spark):
    df = spark.createDataFrame([(1, float("nan"), 1.0, 1.0), (2, 1.0, 1.0, 1.0)], "id int, x double, y double, z double")
    assert [r.id for r in selection.box(df, (0, 0, 0), (2, 2, 2)).collect()] == [2]
    assert [r.id for r in selection.in_geometry(df, Sphere((1, 1, 1), 1)).collect()] == [2]
    m = spark.createDataFrame([(0, 1, float("nan")), (0, 2, 3.0), (1, 1, 3.0)], "file int, id int, mtop double")
    assert halos.most_massive(m).first()[:2] == (0, 2)


def test_runs(spark):
    df = spark.createDataFrame([(0, r) for r in (2441, 2442, 9, 10, 11, 39)], "file int, row bigint")
    runs = rows.to_runs(df)
    assert sorted(map(tuple, runs.collect())) == [(0, 9, 3), (0, 39, 1), (0, 2441, 2)]
    assert sorted(map(tuple, rows.expand(runs).collect())) == sorted(map(tuple, df.collect()))
    assert rows.total(runs).first()[0] == 6
    touching = spark.createDataFrame([(0, 1, 2), (0, 3, 4), (0, 9, 0), (0, 10, 1)], "file int, index bigint, n_to_read bigint")
    assert sorted(map(tuple, rows.merge_runs(touching).collect())) == [(0, 1, 6), (0, 10, 1)]
    own = {0: ([2441, 9], [2, 3]), 3: ([], [])}
    assert rows.decode_positions(rows.encode_positions(own)) == (own, 5)


@pytest.mark.parametrize("stretch", [4, 1 << 20])
def test_runs_over_stretches(spark, monkeypatch, stretch):
    """Runs of whole stretches, of parts of them and across several, with repeats and overlaps, against sets of rows."""
    import random

    monkeypatch.setattr(rows, "STRETCH", stretch)
    rng = random.Random(stretch)
    given = [(f, rng.randrange(150), rng.choice([0, 1, 2, 3, 9])) for f in (0, 1) for _ in range(25)] + [(2, 0, 16), (2, 20, 4), (2, 20, 4), (3, 5, 0)]
    picked = sorted({(f, r) for f, i, n in given for r in range(i, i + n)})
    want = []
    for f, r in picked:
        if want and want[-1][0] == f and want[-1][1] + want[-1][2] == r:
            want[-1][2] += 1
        else:
            want.append([f, r, 1])
    want = [tuple(w) for w in want]
    runs = spark.createDataFrame(given, "file int, index bigint, n_to_read bigint")
    assert sorted(map(tuple, rows.merge_runs(runs).collect())) == want
    single = spark.createDataFrame(picked + picked[:9], "file int, row bigint")
    assert sorted(map(tuple, rows.to_runs(single).collect())) == want
    assert rows.to_runs(single.limit(0)).count() == rows.merge_runs(runs.limit(0)).count() == 0


def test_lookups(spark):
    find = spark.createDataFrame([(0, 1), (1, 29), (2, 12)], "ordinal int, value int")
    check = spark.createDataFrame(list(enumerate([12, 1, 18, 19, 29], 1)), "pos int, value int")
    assert [r.pos for r in lookup.positions_hash(find, check).orderBy("ordinal").collect()] == [2, 5, 1]
    assert sorted(r.pos for r in lookup.positions_merge(find, check).collect()) == [1, 2, 5]
    assert sorted(r.pos for r in lookup.positions_all(find, check).collect()) == [1, 2, 5]


@pytest.mark.parametrize(("ids", "hit"), [([1, 2, 3], [0]), ([1, 2, 3, 10], [0, 3]), ([1, 2, 10, 17], [0, 3]), ([4, 5, 8, 12, 15], [1, 2, 3])])
def test_intervals(spark, ids, hit):
    bounds = spark.createDataFrame([(i, *b) for i, b in enumerate(zip([0, 4, 7, 10], [1, 5, 8, 16], strict=True))], "file int, low bigint, high bigint")
    keys = spark.createDataFrame([(i,) for i in ids], "key bigint")
    assert [r.file for r in lookup.files_for_keys(keys, bounds).collect()] == hit


def test_locators(spark):
    counts = spark.createDataFrame([(0, 4), (1, 0), (2, 3)], "file int, n bigint")
    g = spark.createDataFrame([(v,) for v in (2, 0, 4, 6)], "gidx bigint")
    assert sorted(map(tuple, halos.locate(g, counts).collect())) == [(0, 0, 1), (2, 0, 3), (4, 2, 1), (6, 2, 3)]


def test_members_of_empty_halos(spark):
    h = spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "gidx bigint, glen bigint")
    own = halos.with_offsets(h)
    pids = spark.createDataFrame([(i, 100 + i) for i in range(5)], "gidx bigint, pid bigint")
    assert sorted((r.gidx, r.pid) for r in halos.members(own, pids).collect()) == [(0, 100), (0, 101), (2, 102), (2, 103), (2, 104)]


def test_log(spark):
    line = lambda s, t, a: f"Step={s:>9} Time={t:>10} Active={a:>11}"
    lines = [line(1, 2.0, 10), "noise", line(2, 4.0, 30), line(1, 3.0, 20)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no bigint, line string")
    steps = simlog.parse(df)
    assert sorted(map(tuple, steps.select("step", "time", "active").collect())) == [(1, 3.0, 20), (2, 4.0, 30)]
    assert simlog.summary(steps).first().max_active == 30


def test_intervals_of_any_length(spark):
    import random

    from orrery.operators import lookup

    rng = random.Random(5)
    spans = [(a, a + rng.choice([0, 3, 200, 1 << 21, 1 << 40, 1 << 62])) for a in (rng.randrange(-(1 << 61), 1 << 61) for _ in range(60))] + [(5, 4), (0, 0), (-3, 3)]
    points = [rng.choice(spans)[0] + rng.randrange(-2, 4) for _ in range(80)] + [0, 5]
    iv = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(spans)], "n int, low bigint, high bigint")
    got = {r.n for r in lookup.intervals_of(spark.createDataFrame([(p,) for p in points], "point bigint"), iv).collect()}
    assert got == {k for k, (a, b) in enumerate(spans) if any(a <= p <= b for p in points)}
    none = lookup.intervals_of(spark.createDataFrame([(1,)], "point bigint"), iv.limit(0))
    assert none.columns == iv.columns and none.count() == 0


def test_locate_over_block_ends(spark):
    from orrery.operators import halos

    counts = [(0, 70_000), (1, 0), (2, 1), (3, 200_000)]
    asked = [0, 65_535, 65_536, 69_999, 70_000, 70_001, 131_072, 270_000, 270_001, -1]
    out = halos.locate(spark.createDataFrame([(g,) for g in asked], "gidx bigint"), spark.createDataFrame(counts, "file int, n bigint"))
    got = {r.gidx: (r.file, r.id) for r in out.collect()}
    assert got == {0: (0, 1), 65_535: (0, 65_536), 65_536: (0, 65_537), 69_999: (0, 70_000), 70_000: (2, 1), 70_001: (3, 1), 131_072: (3, 61_072), 270_000: (3, 200_000)}
    assert "NestedLoop" not in out._jdf.queryExecution().toString()
