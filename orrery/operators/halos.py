"""Halo catalogues: filters, argmax, lookups by locator or global index, members and their particles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.prefix import running_sums
from .rows import to_runs
from .selection import volume


def filter_halos(halos: DataFrame, predicate: str | Column | Callable[[DataFrame], DataFrame], files: list[int] | None = None) -> DataFrame:
    """(file, id) of the rows that a filter keeps, of all or some files."""
    if files is not None:
        halos = halos.where(F.col("file").isin(files))
    out = predicate(halos) if callable(predicate) and not isinstance(predicate, Column) else halos.where(predicate)
    return out.select("file", "id")


#: Bits of a global index within a block.
BLOCK_BITS = 16


def most_massive(halos: DataFrame, mass: str = "mtop", files: int | None = None) -> DataFrame:
    """The row of the largest mass; ties go to the first (file, id); NaN masses are ignored."""
    if files is not None:
        halos = halos.where(F.col("file") < files)
    return halos.where(F.col(mass).isNotNull() & ~F.isnan(mass)).orderBy(F.desc(mass), "file", "id").limit(1)


def by_locator(halos: DataFrame, ids: DataFrame) -> DataFrame:
    """Properties of the halos named by (file, id)."""
    return halos.join(ids.select("file", "id"), ["file", "id"], "left_semi")


def by_global_index(halos: DataFrame, ids: DataFrame) -> DataFrame:
    """Properties and (file, id) of global indexes (ordinal, gidx); order by ordinal for the request's order."""
    return ids.join(halos, "gidx")


def locate(gidx: DataFrame, counts: DataFrame) -> DataFrame:
    """(gidx, file, id) of global 0-based indexes: files hold ``n`` rows each; id is 1-based.

    A file's first index is a running sum. Files are repeated for each block of 2**BLOCK_BITS indexes
    that they touch, so the range is an equi-join on blocks.
    """
    starts = running_sums(counts.where("n > 0"), "file", [], {"first": F.col("n")})
    block = lambda c: F.shiftright(c, BLOCK_BITS)
    starts = starts.withColumn("__k", F.explode(F.sequence(block(F.col("first")), block(F.col("first") + F.col("n") - 1))))
    inside = (F.col("gidx") >= F.col("first")) & (F.col("gidx") < F.col("first") + F.col("n"))
    both = gidx.withColumn("__k", block(F.col("gidx"))).join(starts, "__k").where(inside)
    return both.select("gidx", "file", (F.col("gidx") - F.col("first") + 1).alias("id"))


def locators_to_runs(ids: DataFrame) -> DataFrame:
    """(file, index, n_to_read) of (file, 1-based id)."""
    return to_runs(ids.select("file", (F.col("id") - 1).alias("row")))


def runs_to_locators(runs: DataFrame) -> DataFrame:
    return runs.where("n_to_read > 0").select("file", F.explode(F.sequence(F.col("index") + 1, F.col("index") + F.col("n_to_read"))).alias("id"))


def with_offsets(halos: DataFrame, length: str = "glen", offset: str = "goff", key: str = "gidx", order: list[str] | None = None) -> DataFrame:
    """Add each halo's 64-bit offset into the member list: the exclusive running sum of lengths."""
    return running_sums(halos, key, order or [], {offset: F.col(length)})


def members(halos: DataFrame, pids: DataFrame, length: str = "glen", offset: str = "goff") -> DataFrame:
    """Halo columns with pid and place for every member: the slice [offset, offset + length) of the list.

    The range join is an equi-join on expanded indexes, so its size is the number of members.
    """
    some = halos.where(F.col(length) > 0).withColumn("__at", F.explode(F.sequence(F.col(offset), F.col(offset) + F.col(length) - 1)))
    return some.join(pids.select(F.col("gidx").alias("__at"), "pid"), "__at").drop("__at")


def particles_in_halo(df: DataFrame, halo: DataFrame, pids: DataFrame, scale: float = 1.0, radius: str = "r200", exact: bool = False) -> DataFrame:
    """Particles of one halo: its member ids, within the cube of ``scale`` radii unless ``exact``.

    One row is read on the driver, so that the cube's bounds are literals that the scan can prune by.
    """
    if not exact:
        h = halo.select("gx", "gy", "gz", radius).first()
        if h is None:
            return df.limit(0)
        df = volume(df, (h[0], h[1], h[2]), scale * h[3])
    ids = members(halo.select("glen", "goff"), pids).select(F.col("pid").alias("id"))
    return df.join(ids, "id", "left_semi")
