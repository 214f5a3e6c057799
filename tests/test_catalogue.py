"""A synthetic halo catalogue in two files with its particles, through the public functions."""

import numpy as np
import pytest

from orrery import api
from orrery.functions.geometry import Sphere
from orrery.sources import layout as L


def _write(path, npart, infos, arrays, nall, files, boxsize=100.0):
    with open(path, "wb") as f:
        api.write_header(f, L.Header(npart=tuple(npart), nall=tuple(nall), num_files=files, boxsize=boxsize))
        for i, a in zip(infos, arrays, strict=True):
            api.write_block(f, np.asarray(a, i.element), i.name)
        api.write_info_block(f, infos)


@pytest.fixture(scope="module")
def paths(tmp_path_factory):
    d = tmp_path_factory.mktemp("cat")
    halo, sub, pid = (1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0)
    infos = [L.Info("MTOP", "<f4", 1, halo), L.Info("RTOP", "<f4", 1, halo), L.Info("R200", "<f4", 1, halo), L.Info("GPOS", "<f4", 3, halo), L.Info("GLEN", "<u4", 1, halo), L.Info("GOFF", "<u4", 1, halo), L.Info("MSUB", "<f4", 1, sub), L.Info("SLEN", "<u4", 1, sub), L.Info("PID", "<u4", 1, pid)]
    nall = [5, 3, 9, 0, 0, 0]
    _write(d / "sub.0", [3, 1, 4, 0, 0, 0], infos, [[6, 8, 7], [1, 2, 3], [30, 40, 50], np.arange(9) * 1.0, [2, 4, 0], [0, 2, 6], [1.5], [4], [10, 11, 12, 13]], nall, 2)
    _write(d / "sub.1", [2, 2, 5, 0, 0, 0], infos, [[9, 5], [4, 5], [60, 70], 50 + np.arange(6) * 1.0, [2, 1], [6, 8], [2.5, 3.5], [3, 2], [14, 15, 16, 17, 18]], nall, 2)
    everywhere = (1, 1, 1, 1, 1, 1)
    snap = [L.Info("POS", "<f4", 3, everywhere), L.Info("ID", "<u4", 1, everywhere)]
    pos = np.array([[i * 10.0, i * 10.0, i * 10.0] for i in range(10)])
    _write(d / "snap", [10, 0, 0, 0, 0, 0], snap, [pos, np.arange(10) + 10], [10, 0, 0, 0, 0, 0], 1)
    return str(d / "snap"), str(d / "sub")


def test_catalogue_lookups(spark, paths):
    _, sub = paths
    assert api.read_subfind_header(sub).totnfof == 9 and api.read_subfind_length(sub, "MSUB") == 3
    assert [tuple(r) for r in api.filter_subfind(spark, sub, ["MTOP"], "MTOP > 6.5").orderBy("file", "id").collect()] == [(0, 2), (0, 3), (1, 1)]
    assert api.find_most_massive_halo(spark, sub).first()[2:] == (0, 2)
    assert api.find_most_massive_halo(spark, sub, None).first()[2:] == (1, 1)
    ask = spark.createDataFrame([(0, 4), (1, 0), (2, 3)], "ordinal int, gidx bigint")
    assert [r[0] for r in api.read_subfind(spark, sub, "MTOP", ask).collect()] == [5, 6, 9]
    assert [tuple(r) for r in api.read_halo_prop_and_id(spark, sub, "MTOP", ask).collect()] == [(5, 1, 2), (6, 0, 1), (9, 1, 1)]
    assert [r[0] for r in api.read_subfind(spark, sub, "MTOP", offset=1, n_to_read=3).collect()] == [8, 7, 9]
    ids = spark.createDataFrame([(1, 2), (0, 1)], "file int, id bigint")
    assert [r[0] for r in api.read_halo_prop(spark, sub, "MTOP", ids).collect()] == [6, 5]
    with pytest.raises(ValueError, match="different kinds"):
        api.catalogue(spark, sub, ["MTOP", "MSUB"])


def test_members(spark, paths):
    snap, sub = paths
    ids = spark.createDataFrame([(0, 2), (0, 3)], "file int, id bigint")
    assert sorted(r.ID for r in api.read_ids_in_halo(spark, sub, ids).collect()) == [12, 13, 14, 15]  # one spans both files, one is empty
    sub_ids = spark.createDataFrame([(1, 1)], "file int, id bigint")
    assert sorted(r.ID for r in api.read_ids_in_halo(spark, sub, sub_ids, 2).collect()) == [14, 15, 16]
    assert sorted(r.ID for r in api.read_particles_in_halo(spark, snap, "POS", sub, 0, 2, exact=True).collect()) == [12, 13, 14, 15]
    assert sorted(r.ID for r in api.read_particles_in_halo(spark, snap, "POS", sub, 0, 2).collect()) == [12, 13, 14]
    with pytest.raises(ValueError, match="halo type"):
        api.read_ids_in_halo(spark, sub, ids, 3)


def test_saved_selections(spark, paths, tmp_path):
    snap, sub = paths
    df = api._snap.read(spark, snap, ["POS", "ID"])
    runs = api.find_read_positions(df, "ID > 15")
    api.save_read_positions(runs, str(tmp_path / "runs"))
    again = api.load_read_positions(spark, str(tmp_path / "runs"))
    assert sorted(r.ID for r in api.read_blocks_filtered(spark, snap, "ID", read_positions=again).collect()) == [16, 17, 18, 19]
    picked = api.filter_subfind(spark, sub, ["MTOP"], "MTOP > 6.5")
    api.save_halo_ids(picked, str(tmp_path / "ids"))
    loaded = api.load_halo_ids(spark, str(tmp_path / "ids"))
    assert sorted(map(tuple, api.read_positions_to_halo_ids(api.halo_ids_to_read_positions(loaded)).collect())) == [(0, 2), (0, 3), (1, 1)]
    with pytest.raises(ValueError, match="filter or row positions"):
        api.read_blocks_filtered(spark, snap, "ID")


def test_periodic_geometry(spark, paths):
    snap, _ = paths
    got = api.read_particles_in_geometry(spark, snap, "ID", Sphere((0.0, 0.0, 0.0), 20.0)).collect()
    assert sorted((r.ID, r.POS[0]) for r in got) == [(10, 0.0), (11, 10.0), (19, -10.0)]
    assert [r.ID for r in api.read_particles_in_volume(spark, snap, "ID", (50.0, 50.0, 50.0), 5.0).collect()] == [15]


def test_key_files(spark, tmp_path):
    """Two sub-files in cell order with key files: a keyed box is the plain box, with cells its superset."""
    from orrery.functions import hilbert

    rng = np.random.default_rng(2)
    pos = rng.uniform(0, 100, (200, 3)).astype("<f4")
    keys = np.array([hilbert.key_of(3, *(int(v * 0.08) for v in p)) for p in pos])
    order = np.argsort(keys, kind="stable")
    every = (1, 1, 1, 1, 1, 1)
    for k, part in enumerate(np.array_split(order, 2)):
        _write(tmp_path / f"s.{k}", [100, 0, 0, 0, 0, 0], [L.Info("POS", "<f4", 3, every), L.Info("ID", "<u4", 1, every)], [pos[part], part], [200, 0, 0, 0, 0, 0], 2)
        own, first, count = np.unique(keys[part], return_index=True, return_counts=True)
        infos = [L.Info(n, "<u4", 1, every) for n in ("KEY", "NKEY", "OKEY")]
        head = L.Header(npart=(len(own), 0, 0, 0, 0, 0), massarr=(0.0, 0.0, 0.0, 0.08, 0.0, 0.0), flag_feedback=3)
        with open(tmp_path / f"s.{k}.key", "wb") as f:
            api.write_header(f, head)
            for i, a in zip(infos, (own, count, first), strict=True):
                api.write_block(f, np.asarray(a, "<u4"), i.name)
            api.write_info_block(f, infos)
    base, lo, hi = str(tmp_path / "s"), (10.0, 20.0, 30.0), (60.0, 70.0, 80.0)
    assert api.read_keyheader(base + ".0.key").bits == 3
    plain = sorted(r.ID for r in api.read_particles_in_box(spark, base, "ID", lo, hi).collect())
    keyed = sorted(r.ID for r in api.read_particles_in_box(spark, base, "ID", lo, hi, use_keys=True).collect())
    cells = {r.ID for r in api.read_particles_in_box(spark, base, "ID", lo, hi, use_keys=True, cells=True).collect()}
    assert plain == keyed and plain and set(plain) < cells
    with pytest.raises(FileNotFoundError):
        api.read_positions_from_keys(spark, base + "x", lo, hi)


def test_log_file(spark, tmp_path):
    line = lambda s, t, a: f"Step={s:>9} Time={t:>10} Active={a:>11}\n"
    (tmp_path / "log.txt").write_text(line(1, 3600.0, 10) + "other\n" + line(2, 7200.0, 30))
    r = api.print_performance(spark, str(tmp_path / "log.txt")).first()
    assert (r.last_step, r.total_hours, r.max_active) == (2, 3.0, 30)


def test_log_stream(spark, tmp_path):
    """Files that appear later are read too; lines without a step give nothing."""
    from orrery.streaming.logs import stream_steps

    line = lambda s, t, a: f"Step={s:>9} Time={t:>10} Active={a:>11}\n"
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.txt").write_text(line(1, 3600.0, 10) + "other\n")
    query = stream_steps(spark, str(tmp_path / "logs")).writeStream.format("memory").queryName("log_steps").option("checkpointLocation", str(tmp_path / "at")).start()
    try:
        query.processAllAvailable()
        (tmp_path / "logs" / "b.txt").write_text(line(2, 7200.0, 30))
        query.processAllAvailable()
        assert sorted(map(tuple, spark.table("log_steps").collect())) == [(1, 3600.0, 10), (2, 7200.0, 30)]
    finally:
        query.stop()
