"""Running sums over a global order without a single-task sort of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sums(df: DataFrame, key: str, order: list[str], values: dict[str, Column], width: int = 1 << 16) -> DataFrame:
    """Add exclusive running sums of ``values`` in the order of the integer ``key``, then ``order``.

    Rows are summed per block of ``width`` keys; only the block totals are ordered in one task, and
    each block is ordered by itself. Nulls count as 0.
    """
    cols = {f"__v_{n}": F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint")) for n, c in values.items()}
    rows = df.withColumns(cols | {"__b": F.floor(F.col(key) / F.lit(width)).cast("bigint")})
    totals = rows.groupBy("__b").agg(*(F.sum(c).alias(c) for c in cols))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__b", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in cols))
    inner = Window.partitionBy("__b").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"{c}_1": F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in cols}).join(totals, "__b")
    out = rows.withColumns({n: (F.col(f"__v_{n}_0") + F.col(f"__v_{n}_1")).cast("bigint") for n in values})
    return out.select(*df.columns, *values)
