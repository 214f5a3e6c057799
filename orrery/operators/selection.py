"""Row selections on particle tables: types, boxes, volumes, geometries, predicates, id lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import Geometry, Vec, between, between_periodic, half_open, position, shift_periodic
from ..functions.hilbert import in_ranges, key_ranges


def species(df: DataFrame, parttype: int) -> DataFrame:
    """One particle type; -1 is all of them."""
    return df if parttype == -1 else df.where(F.col("parttype") == parttype)


def header_mass(parttype: Column, masses: list[float], block: Column | None = None) -> Column:
    """A type's header mass where it is not 0, else the MASS block."""
    out = F.lit(None).cast("double") if block is None else block
    for t, m in enumerate(masses):
        if m:
            out = F.when(parttype == t, F.lit(float(m))).otherwise(out)
    return out


def box(df: DataFrame, lo: Vec, hi: Vec) -> DataFrame:
    """Inside the box, both ends included; corners are put in order axis by axis."""
    pairs = list(zip(lo, hi, strict=True))
    return df.where(between(position(df), tuple(map(min, pairs)), tuple(map(max, pairs))))


def box_half_open(df: DataFrame, lo: Vec, hi: Vec) -> DataFrame:
    return df.where(half_open(position(df), lo, hi))


def box_cells(df: DataFrame, lo: Vec, hi: Vec, corner: Vec, factor: float, bits: int, key: str = "ph_key", exact: bool = True) -> DataFrame:
    """Box selection on a table with a curve key: key ranges prune the scan; exact=False keeps whole cells."""
    out = df.where(in_ranges(F.col(key), key_ranges(lo, hi, corner, factor, bits)))
    return box(out, lo, hi) if exact else out


def volume(df: DataFrame, center: Vec, radius: float) -> DataFrame:
    """The cube of half-width ``radius`` around ``center``."""
    return box(df, tuple(c - radius for c in center), tuple(c + radius for c in center))


def in_geometry(df: DataFrame, shape: Geometry, boxsize: float | None = None, shift: bool = True) -> DataFrame:
    """Rows inside ``shape``; with ``boxsize`` and ``shift``, images across the periodic border count.

    The bounding box prunes first; then positions are shifted to the image nearest to the center
    and the mask decides. x, y, z (or POS) come out shifted.
    """
    lo, hi = shape.bbox()
    if not (boxsize and shift):
        return df.where(between(position(df), lo, hi)).where(shape.mask(position(df)))
    near = df.where(between_periodic(position(df), lo, hi, boxsize))
    moved = [shift_periodic(p, c, boxsize) for p, c in zip(position(near), shape.center(), strict=True)]
    if "POS" in df.columns and "x" not in df.columns:
        kind = dict(df.dtypes)["POS"]
        temp = near.withColumns({f"__p{i}": m for i, m in enumerate(moved)})
        temp = temp.where(shape.mask(tuple(F.col(f"__p{i}") for i in range(3))))
        return temp.withColumn("POS", F.array(*(F.col(f"__p{i}") for i in range(3))).cast(kind)).drop("__p0", "__p1", "__p2")
    out = near.withColumns(dict(zip("xyz", moved, strict=True)))
    return out.where(shape.mask(tuple(F.col(c) for c in "xyz")))


def filtered(df: DataFrame, predicate: str | Column | Callable[[DataFrame], DataFrame], blocks: list[str] | None = None) -> DataFrame:
    """A user's filter as SQL text, Column or function of a DataFrame; then the chosen blocks."""
    out = predicate(df) if callable(predicate) and not isinstance(predicate, Column) else df.where(predicate)
    return out.select(*blocks) if blocks else out


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id", center: Vec | None = None, radius: float = 0.0) -> DataFrame:
    """Semi-join with a table of ids (same column name); a center and radius prune by volume first.

    No side is forced to broadcast: the optimizer does so only below its size threshold.
    """
    if center is not None and radius:
        df = volume(df, center, radius)
    return df.join(ids.select(key), key, "left_semi")
