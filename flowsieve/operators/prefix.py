"""Running totals over many ordered places, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsieve.functions.columns import col

BLOCK = 1024


def totals_before(df: DataFrame, keys: list[str], place: str, value: str, places: int, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the smaller places of the same keys (null-safe), 0 for the first.

    ``df`` has one row per keys and place; places are numbers from 0 to under ``places``. A window runs inside a block of BLOCK places; what lies before a
    block is the running total over the blocks, found the same way. So no window is longer than BLOCK, however many places there are.
    """
    if places <= BLOCK:
        before = Window.partitionBy(*[col(k) for k in keys]).orderBy(col(place)).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(col(value)).over(before), F.lit(0).cast("bigint")))
    block, inner, outer, at, held = (f"_{n}_{places}" for n in ("block", "inner", "outer", "at", "held"))
    cut = df.withColumn(block, F.floor(col(place) / F.lit(float(BLOCK))))
    before = Window.partitionBy(*[col(k) for k in keys], block).orderBy(col(place)).rowsBetween(Window.unboundedPreceding, -1)
    inside = cut.withColumn(inner, F.coalesce(F.sum(col(value)).over(before), F.lit(0).cast("bigint")))
    named = [f"_k{i}_{places}" for i in range(len(keys))]
    blocks = cut.groupBy(*[col(k).alias(n) for k, n in zip(keys, named)], F.col(block).alias(at)).agg(F.sum(col(value)).alias(held))
    starts = totals_before(blocks, named, at, held, -(-places // BLOCK), outer).drop(held)
    same = F.col(block) == F.col(at)
    for k, n in zip(keys, named):
        same = same & col(k).eqNullSafe(F.col(n))
    return inside.join(starts, same).select(*[col(c) for c in df.columns], (F.col(inner) + F.col(outer)).alias(name))
