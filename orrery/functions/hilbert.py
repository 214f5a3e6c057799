"""Space-filling-curve keys: the automaton, its Column form, cells of a box and key ranges for pruning."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Order of the octants (x*4 + y*2 + z) in the first cell, and in the cell's octants 0 to 7.
FIRST = (0, 7, 1, 6, 3, 4, 2, 5)
INSIDE = (
    (0, 1, 7, 6, 3, 2, 4, 5),
    (6, 7, 1, 0, 5, 4, 2, 3),
    (0, 3, 1, 2, 7, 4, 6, 5),
    (4, 7, 5, 6, 3, 0, 2, 1),
    (2, 5, 3, 4, 1, 6, 0, 7),
    (2, 5, 3, 4, 1, 6, 0, 7),
    (0, 3, 1, 2, 7, 4, 6, 5),
    (4, 7, 5, 6, 3, 0, 2, 1),
)


@lru_cache
def automaton() -> tuple[tuple[int, int], ...]:
    """(place, next state) at index state * 8 + octant, state 0 first.

    A state is a symmetry of the cube, as the permutation of octants that leads back to the first
    cell. Entering an octant composes the symmetry with that of the octant's inner order, so all
    states follow from the first cell.
    """
    where = {place: octant for octant, place in enumerate(FIRST)}
    inner = [tuple(where[p] for p in row) for row in INSIDE]
    states = [tuple(range(8))]
    number = {states[0]: 0}
    out = []
    for state in states:  # grows while it is walked
        for octant in range(8):
            at = state[octant]
            child = tuple(inner[at][o] for o in state)
            if child not in number:
                number[child] = len(states)
                states.append(child)
            out.append((FIRST[at], number[child]))
    return tuple(out)


def flat_table() -> list[int]:
    """The automaton as place * 64 + next state."""
    return [p * 64 + s for p, s in automaton()]


def key_of(bits: int, x: int, y: int, z: int) -> int:
    """Only the low ``bits`` bits count, so cells beyond a periodic box wrap."""
    table, state, key = automaton(), 0, 0
    for i in range(bits - 1, -1, -1):
        place, state = table[state * 8 + ((x >> i & 1) << 2 | (y >> i & 1) << 1 | (z >> i & 1))]
        key = key << 3 | place
    return key


def int_position(pos: Column, corner: float, factor: float, bits: int) -> Column:
    """Cell number along an axis, with the key files' corrections below zero and at the upper border."""
    val = (pos - float(corner)) * float(factor)
    return F.floor(val).cast("bigint") + F.when(pos >= 0, 0).otherwise(-1) + F.when(val >= 2**bits - 0.5, 1).otherwise(0)


def key_column(bits: int, x: Column, y: Column, z: Column) -> Column:
    """Key of integer cells (bits up to 18), one fold over the bits in the JVM."""
    table = F.array(*(F.lit(v).cast("bigint") for v in flat_table()))
    one = F.lit(1).cast("bigint")
    bit = lambda v, i: F.call_function("getbit", v, i).cast("bigint")

    def step(acc: Column, i: Column) -> Column:
        octant = bit(x, i) * 4 + bit(y, i) * 2 + bit(z, i)
        return F.shiftright(acc, 6) * 512 + F.element_at(table, (one + acc.bitwiseAND(F.lit(63).cast("bigint")) * 8 + octant).cast("int"))

    return F.shiftright(F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("bigint"), step), 6)


def key_list(spark: SparkSession, lo: tuple, hi: tuple, corner: tuple, factor: float, bits: int) -> DataFrame:
    """Keys of all cells of a box (key, cell coordinates); repeats appear where the box wraps."""
    ranges = []
    for a, b, c in zip(lo, hi, corner, strict=True):
        ranges.append((int_cell(a, c, factor, bits), int_cell(b, c, factor, bits)))
    (x0, x1), (y0, y1), (z0, z1) = ranges
    cells = spark.range(x0, x1 + 1).withColumnRenamed("id", "ix")
    cells = cells.select("ix", F.explode(F.sequence(F.lit(y0).cast("bigint"), F.lit(y1).cast("bigint"))).alias("iy"))
    cells = cells.select("ix", "iy", F.explode(F.sequence(F.lit(z0).cast("bigint"), F.lit(z1).cast("bigint"))).alias("iz"))
    return cells.withColumn("key", key_column(bits, F.col("ix"), F.col("iy"), F.col("iz")))


def int_cell(pos: float, corner: float, factor: float, bits: int) -> int:
    import math

    val = (pos - corner) * factor
    return math.floor(val) + (0 if pos >= 0 else -1) + (1 if val >= 2**bits - 0.5 else 0)


def key_ranges(lo: tuple, hi: tuple, corner: tuple, factor: float, bits: int, most: int = 4096) -> list[tuple[int, int]]:
    """Sorted key ranges that cover a box's cells, for OR-ed BETWEENs that prune files and row groups.

    Cells are enumerated at the finest depth that needs at most ``most`` of them; a coarser cell is
    the range of its keys.
    """
    box = [(int_cell(a, c, factor, bits), int_cell(b, c, factor, bits)) for a, b, c in zip(lo, hi, corner, strict=True)]
    drop = 0
    while True:
        coarse = [(a >> drop, b >> drop) for a, b in box]
        n = 1
        for a, b in coarse:
            n *= b - a + 1
        if n <= most or drop >= bits:
            break
        drop += 1
    (x0, x1), (y0, y1), (z0, z1) = coarse
    keys = sorted({key_of(bits - drop, x, y, z) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) for z in range(z0, z1 + 1)})
    out: list[list[int]] = []
    for k in keys:
        a, b = k << 3 * drop, ((k + 1) << 3 * drop) - 1
        if out and a == out[-1][1] + 1:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def in_ranges(key: Column, ranges: list[tuple[int, int]]) -> Column:
    cond = F.lit(False)
    for a, b in ranges:
        cond = cond | key.between(a, b)
    return cond
