"""The public functions by the names users know, as thin wrappers that return DataFrames.

``particles`` tables come from ``orrery.sources.snapshot``; everything here is lazy but the few
look-ups that read one row or file headers on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import hilbert
from .functions.geometry import Cube, Cylinder, Geometry, Shell, Sphere, Vec  # noqa: F401
from .operators import halos as _halos
from .operators import lookup, rows, selection
from .operators import simlog as _log
from .plans.prefix import running_sums
from .sources import layout as _layout
from .sources import snapshot as _snap
from .sources import storage as _storage
from .sources.layout import Header as SnapshotHeader
from .sources.layout import Info as InfoLine
from .sources.layout import KeyHeader


class SubfindHeader:
    """A catalogue's header: counts of halos, subhalos, members and groups, with 64-bit totals."""

    def __init__(self, h: SnapshotHeader):
        self.nhalos, self.nsubhalos, self.nfof, self.ngroups = h.npart[:4]
        self.totnhalos, self.totnsubhalos, self.totnfof, self.totngroups = (h.total(t) for t in range(4))
        self.time, self.z, self.num_files, self.boxsize = h.time, h.z, h.num_files, h.boxsize
        self.omega_0, self.omega_l, self.h0 = h.omega_0, h.omega_l, h.h0


# ---- files ------------------------------------------------------------------------------------


def _open(path: str, number: int = 0):
    return _storage.open_file(_storage.select_file(path, number))


def _file_layout(path: str):
    with _open(path) as f:
        return _layout.read_layout(f)


def read_header(path: str) -> SnapshotHeader:
    return _file_layout(path).header


head_to_struct = read_header


def head_to_dict(path: str) -> dict:
    """Header values under their long names, with the format and the types' names."""
    lay = _file_layout(path)
    h = lay.header
    own = {n: getattr(h, n) for n, _ in _layout.HEAD_FIELDS if n != "fill"}
    return own | {"redshift": h.z, "omega_m": h.omega_0, "hubble": h.h0, "snap_format": lay.format, "PartTypes": [f"PartType{t}" for t in range(6)]}


def read_subfind_header(path: str) -> SubfindHeader:
    return SubfindHeader(read_header(path))


def read_info(path: str) -> list[InfoLine]:
    return list(_file_layout(path).infos.values())


def print_blocks(path: str) -> list[str]:
    """Block names in file order."""
    with _open(path) as f:
        if _layout.sniff(f) != 2:
            raise ValueError("blocks have no names in this format")
        return [str(name) for name, _, _ in _layout._records(f, 2)]


def block_present(path: str, block: str) -> bool:
    return block in print_blocks(path)


def get_block_positions(path: str) -> dict[str, int]:
    return {name: start for name, (start, _) in _file_layout(path).blocks.items()}


def check_blocks(path: str, blocks: list[str], parttype: int) -> tuple[list[str], bool]:
    """(blocks that the file has for the type, whether MASS comes from the header)."""
    lay = _file_layout(path)
    no_mass = "MASS" in blocks and not lay.has("MASS", parttype)
    if no_mass and not lay.header.massarr[parttype]:
        raise ValueError(f"block MASS is not present for type {parttype} and the header has no mass")
    out = [b for b in blocks if not (b == "MASS" and no_mass)]
    missing = [b for b in out if not lay.has(b, parttype)]
    if missing:
        raise ValueError(f"block {', '.join(missing)} is not present for type {parttype}")
    return out, no_mass


def get_total_particles(spark: SparkSession | None, source: str | SnapshotHeader, parttype: int) -> int:
    return (source if isinstance(source, SnapshotHeader) else read_header(source)).total(parttype)


def get_first_containing_file(path: str, parttype: int) -> int:
    for number, _, lay in _snap.layouts({"path": path}):
        if lay.rows(parttype):
            return number
    raise ValueError(f"no file has rows of type {parttype}")


def read_block(spark: SparkSession, path: str, block: str | int, parttype: int = 0, offset: int = 0, n_to_read: int = -1, **options) -> DataFrame:
    """file, parttype, row and one block by name or number; parttype -1 is all; a slice counts over sub-files."""
    if isinstance(block, int):
        if not 1 <= block <= len(_layout.NUMBERED):
            raise ValueError(f"there is no usual block {block}: numbers go from 1 to {len(_layout.NUMBERED)}")
        block = _layout.NUMBERED[block - 1]
    return _snap.read(spark, path, [block], parttype, offset=offset, n_to_read=n_to_read, **options)


def snap_to_dict(spark: SparkSession, path: str) -> dict:
    """Header, and a DataFrame for each populated type with the blocks that it has."""
    found = _snap.layouts({"path": path})
    out: dict = {"Header": head_to_dict(path)}
    for t in range(6):
        blocks = list(dict.fromkeys(b for _, _, lay in found for b in lay.blocks if lay.has(b, t) and lay.rows(t)))
        if sum(lay.rows(t) for _, _, lay in found):
            out[f"PartType{t}"] = _snap.read(spark, path, blocks, t) if blocks else spark.range(0)
    return out


def read_snap(spark: SparkSession, path: str, block: str = "", parttype: int = -1):
    return read_block(spark, path, block, parttype) if block else snap_to_dict(spark, path)


# ---- selections -------------------------------------------------------------------------------


def _table(spark, path, blocks, parttype, also=()) -> DataFrame:
    return _snap.read(spark, path, list(dict.fromkeys([*blocks, *also])), parttype)


def _list(blocks: str | list[str]) -> list[str]:
    return [blocks] if isinstance(blocks, str) else list(blocks)


def _in_order(df: DataFrame, ordered: bool) -> DataFrame:
    return df.orderBy("file", "row") if ordered else df


def read_particles_in_box(spark, path, blocks, lo: Vec, hi: Vec, parttype: int = 0, use_keys: bool = False, cells: bool = False, ordered: bool = False) -> DataFrame:
    """Rows in the box, both ends included; ``ordered`` sorts them by file and row.

    With key files the cells' runs are found first and nothing else is read; ``cells`` keeps all of their rows.
    """
    names = _list(blocks)
    also = [] if use_keys and cells else ["POS"]
    if use_keys:
        df = _snap.read_runs(read_positions_from_keys(spark, path, lo, hi, parttype), path, list(dict.fromkeys([*names, *also])), parttype)
    else:
        df = _table(spark, path, names, parttype, also)
    out = df if use_keys and cells else selection.box(df, lo, hi)
    return _in_order(out.select("file", "parttype", "row", *names), ordered)


def read_particles_in_volume(spark, path, blocks, center: Vec, radius: float, parttype: int = 0, **more) -> DataFrame:
    """The cube of half-width ``radius``."""
    return read_particles_in_box(spark, path, blocks, tuple(c - radius for c in center), tuple(c + radius for c in center), parttype, **more)


def read_particles_in_geometry(spark, path, blocks, shape: Geometry, parttype: int = 0, do_shift_across_box_border: bool = True) -> DataFrame:
    """Rows inside ``shape`` with POS shifted to the image nearest to its center."""
    names = list(dict.fromkeys([*_list(blocks), "POS"]))
    box = read_header(path).boxsize
    return selection.in_geometry(_table(spark, path, names, parttype), shape, box or None, do_shift_across_box_border).select("file", "parttype", "row", *names)


def find_read_positions(df: DataFrame, chosen: str | Column | Callable | Geometry) -> DataFrame:
    """Runs (file, index, n_to_read) of the rows that a filter or geometry keeps."""
    picked = selection.in_geometry(df, chosen) if isinstance(chosen, Geometry) else selection.filtered(df, chosen)
    return rows.to_runs(picked)


def read_blocks_filtered(spark, path, blocks, filter_function=None, read_positions: DataFrame | None = None, parttype: int = 0, also: tuple[str, ...] = (), ordered: bool = False) -> DataFrame:
    """Blocks of the rows that a filter keeps, or that saved runs name (only those rows are read); ``ordered`` sorts by file and row."""
    names = _list(blocks)
    if read_positions is not None:
        df = _snap.read_runs(rows.merge_runs(read_positions), path, names, parttype)
    elif filter_function is not None:
        df = selection.filtered(_table(spark, path, names, parttype, also), filter_function)
    else:
        raise ValueError("give a filter or row positions")
    return _in_order(df.select("file", "parttype", "row", *names), ordered)


save_read_positions, load_read_positions = rows.save, rows.load


def filter_cube(df: DataFrame, lo: Vec, hi: Vec) -> DataFrame:
    return selection.box(df, lo, hi)


def filter_cylinder(df: DataFrame, start: Vec, end: Vec, radius: float) -> DataFrame:
    return selection.in_geometry(df, Cylinder(start, end, radius))


def filter_sphere(df: DataFrame, center: Vec, radius: float) -> DataFrame:
    return selection.in_geometry(df, Sphere(center, radius))


def filter_ids(df: DataFrame, ids: DataFrame, key: str = "ID") -> DataFrame:
    return selection.by_ids(df, ids, key)


def read_particles_by_id(spark, path, ids: DataFrame, blocks, parttype: int = 0, pos0: Vec | None = None, r0: float = 0.0) -> DataFrame:
    """Rows whose ID is in ``ids`` (a column ID), within a cube first if one is given; ID is always returned."""
    names = list(dict.fromkeys([*_list(blocks), "ID"]))
    df = _table(spark, path, names, parttype, ["POS"] if pos0 is not None and r0 else [])
    return selection.by_ids(df, ids, "ID", pos0, r0).select("file", "parttype", "row", *names)


def get_index_list(find: DataFrame, check: DataFrame) -> DataFrame:
    """Positions in ``check`` (pos, value) of the values of ``find`` (ordinal, value); order by ordinal."""
    return lookup.positions_hash(find, check)


get_index_bounds = lookup.intervals_of


# ---- curve keys -------------------------------------------------------------------------------


def read_keyheader(path: str) -> KeyHeader:
    with _storage.open_file(path) as f:
        return KeyHeader.of(_layout.read_layout(f).header)


def read_key_index(spark: SparkSession, path: str) -> DataFrame:
    with _storage.open_file(path) as f:
        return spark.createDataFrame(_layout.read_key_index(f.read()), "low bigint, high bigint, file bigint")


def get_keylist(spark: SparkSession, h: KeyHeader, lo: Vec, hi: Vec) -> DataFrame:
    return hilbert.key_list(spark, lo, hi, h.corners, h.factor, h.bits).select("key")


def read_positions_from_keys(spark: SparkSession, path: str, lo: Vec, hi: Vec, parttype: int = 0) -> DataFrame:
    """Runs of whole cells of a box from the key files: cells joined on their key, then merged."""
    if not _storage.exists(f"{path}.0.key"):
        raise FileNotFoundError(f"there is no {path}.0.key")
    h = read_keyheader(f"{path}.0.key")
    cells = _snap.read(spark, path, ["KEY", "NKEY", "OKEY"], parttype, suffix=".key")
    wanted = hilbert.key_list(spark, lo, hi, h.corners, h.factor, h.bits).select(F.col("key").alias("KEY"))
    hit = cells.join(wanted, "KEY", "left_semi")
    return rows.merge_runs(hit.select("file", F.col("OKEY").alias("index"), F.col("NKEY").alias("n_to_read")))


# ---- catalogues -------------------------------------------------------------------------------


def subfind_block_parttype(path: str, block: str) -> int:
    info = _file_layout(path).infos.get(block)
    if info is None or not any(info.present):
        raise ValueError(f"block {block} is not present")
    return info.present.index(1)


def _catalogue_type(path: str, blocks: list[str]) -> int:
    types = {subfind_block_parttype(path, b) for b in blocks}
    if len(types) != 1:
        raise ValueError(f"blocks {', '.join(blocks)} belong to different kinds of halos")
    return types.pop()


def read_subfind_length(path: str, block: str) -> int:
    """Row count from the header, without a scan."""
    return read_header(path).total(subfind_block_parttype(path, block))


def catalogue(spark: SparkSession, path: str, blocks: list[str]) -> DataFrame:
    """Catalogue rows: file, 1-based id, global 0-based gidx and the blocks (all of one kind)."""
    t = _catalogue_type(path, blocks)
    df = _snap.read(spark, path, blocks, t)
    counts = spark.createDataFrame([(n, lay.rows(t)) for n, _, lay in _snap.layouts({"path": path})], "file int, n bigint")
    first = running_sums(counts, "file", [], {"first": F.col("n")}).select("file", "first")
    return df.join(F.broadcast(first), "file").select("file", (F.col("row") + 1).alias("id"), (F.col("first") + F.col("row")).alias("gidx"), *blocks)  # one row a file


def read_subfind(spark, path, block: str, ids: DataFrame | None = None, offset: int = 0, n_to_read: int = -1, return_haloid: bool = False) -> DataFrame:
    """A catalogue column, by slice or by global indexes (ordinal, gidx) in the request's order."""
    df = catalogue(spark, path, [block])
    extra = ["file", "id"] if return_haloid else []
    if ids is not None:
        return _halos.by_global_index(df, ids).orderBy("ordinal").select(block, *extra)
    end = offset + n_to_read if n_to_read >= 0 else 1 << 62
    return df.where((F.col("gidx") >= offset) & (F.col("gidx") < end)).orderBy("gidx").select(block, *extra)


def filter_subfind(spark, path, blocks: list[str], filter_function, files: list[int] | None = None) -> DataFrame:
    return _halos.filter_halos(catalogue(spark, path, blocks), filter_function, files)


def find_most_massive_halo(spark, path, nfiles: int | None = 1) -> DataFrame:
    """GPOS, radius and (file, id) of the largest MVIR, else MTOP, among the first files (None: all)."""
    infos = _file_layout(path).infos
    mass, radius = ("MVIR", "RVIR") if "MVIR" in infos else ("MTOP", "RTOP")
    return _halos.most_massive(catalogue(spark, path, [mass, "GPOS", radius]), mass, nfiles).select("GPOS", radius, "file", "id")


def read_halo_prop(spark, path, blocks, ids: DataFrame) -> DataFrame:
    """Properties of (file, id), in that order, or of global indexes (ordinal, gidx), in request order."""
    df = catalogue(spark, path, _list(blocks))
    if "gidx" in ids.columns:
        return _halos.by_global_index(df, ids).orderBy("ordinal").select(*_list(blocks))
    return _halos.by_locator(df, ids).orderBy("file", "id").select(*_list(blocks))


def read_halo_prop_and_id(spark, path, blocks, ids: DataFrame) -> DataFrame:
    return _halos.by_global_index(catalogue(spark, path, _list(blocks)), ids).orderBy("ordinal").select(*_list(blocks), "file", "id")


def global_idxs_to_halo_id(spark, path, gidx: DataFrame, parttype: int = 0) -> DataFrame:
    counts = spark.createDataFrame([(n, lay.rows(parttype)) for n, _, lay in _snap.layouts({"path": path})], "file int, n bigint")
    return _halos.locate(gidx, counts)


halo_ids_to_read_positions, read_positions_to_halo_ids = _halos.locators_to_runs, _halos.runs_to_locators


def save_halo_ids(ids: DataFrame, path: str) -> None:
    rows.save(ids.select("file", "id"), path)


def load_halo_ids(spark: SparkSession, path: str) -> DataFrame:
    return rows.load(spark, path)


#: Length, offset, position and radius blocks by kind of halo.
HALO_BLOCKS = {1: ("GLEN", "GOFF", "GPOS", ("R200", "RMEA")), 2: ("SLEN", "SOFF", "SPOS", ("RHMS",))}


def _halo_blocks(halo_type: int):
    if halo_type not in HALO_BLOCKS:
        raise ValueError(f"halo type {halo_type}: 1 is halos, 2 is subhalos")
    return HALO_BLOCKS[halo_type]


def read_ids_in_halo(spark, path, halo_ids: DataFrame, halo_type: int = 1) -> DataFrame:
    """(file, halo_id, ID) of the members of (file, id).

    Offsets are running sums of the lengths in 64 bits: the stored 32-bit ones wrap.
    """
    length, _, _, _ = _halo_blocks(halo_type)
    own = _halos.with_offsets(catalogue(spark, path, [length]), length, "__off").join(halo_ids.select("file", "id"), ["file", "id"], "left_semi")
    pids = catalogue(spark, path, ["PID"]).select("gidx", F.col("PID").alias("pid"))
    return _halos.members(own, pids, length, "__off").select("file", F.col("id").alias("halo_id"), F.col("pid").alias("ID"))


def read_particles_in_halo(spark, path, blocks, sub_path, file: int, halo: int, parttype: int = 0, halo_type: int = 1, rad_scale: float = 1.0, exact: bool = False) -> DataFrame:
    """Particles of one halo, within the cube of ``rad_scale`` radii around it unless ``exact``."""
    _, _, pos, radii = _halo_blocks(halo_type)
    infos = _file_layout(sub_path).infos
    radius = next((r for r in radii if r in infos), None)
    if radius is None:
        raise ValueError(f"the catalogue has none of {', '.join(radii)}")
    one = spark.createDataFrame([(file, halo)], "file int, id bigint")
    at = read_halo_prop(spark, sub_path, [pos, radius], one).first()
    if at is None:
        raise ValueError(f"there is no halo {halo} in file {file}")
    ids = read_ids_in_halo(spark, sub_path, one, halo_type).select("ID")
    if exact:
        return read_particles_by_id(spark, path, ids, blocks, parttype)
    return read_particles_by_id(spark, path, ids, blocks, parttype, tuple(at[0]), rad_scale * at[1])


# ---- writing and logs -------------------------------------------------------------------------


def write_header(f, h: SnapshotHeader, snap_format: int = 2) -> None:
    f.write(_layout.record(h.pack(), "HEAD", snap_format))


def write_block(f, data, block: str = "", snap_format: int = 2) -> None:
    """One block from an array, to an open file; whole tables go through the ``particles`` sink."""
    f.write(_layout.record(data.tobytes(), block, snap_format))


def write_info_block(f, infos: list[InfoLine], snap_format: int = 2) -> None:
    f.write(_layout.record(b"".join(i.pack() for i in infos), "INFO", snap_format))


def parse_balance(spark: SparkSession, path: str) -> DataFrame:
    """(step, time, active, line_no) of a timing log."""
    # line numbers need one ordered reader: a log is one small text file
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return _log.parse(lines.withColumn("line_no", F.col("line_no").cast("bigint")))


def print_performance(spark: SparkSession, path: str) -> DataFrame:
    return _log.summary(parse_balance(spark, path))
