"""Exact quantiles from counts per value: no buffer of a group's values, nothing that cannot spill.

Values are counted per group first, which combines in every task; a running sum of the counts in value order then tells
which value stands at a position. A group's distinct values are sorted in one task, on disk if need be.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantiles(df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Keys and, by name, the linearly interpolated quantiles of the values that are not null.

    Groups without a value are absent. Without keys there is one row, and the distinct values pass one task.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys)
    # positions from 0 that this value takes: from _to - _n up to, not including, _to
    placed = counts.withColumn("_to", F.sum("_n").over(whole.orderBy("_v"))).withColumn("_last", F.sum("_n").over(whole) - 1)

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_to") > position) & (F.col("_to") - F.col("_n") <= position), F.col("_v")))

    def point(p: float) -> Column:
        exact = F.col("_last") * F.lit(p)
        low, high = at(F.floor(exact)), at(F.ceil(exact))
        rest = F.max(exact - F.floor(exact))
        return F.when(low == high, low.cast("double")).otherwise(low * (F.lit(1.0) - rest) + high * rest)

    out = placed.groupBy(*keys).agg(*[point(p).alias(name) for name, p in points.items()])
    return out if keys else out.filter(F.col(next(iter(points))).isNotNull())


def with_quantiles(grouped: DataFrame, df: DataFrame, keys: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """``grouped`` (one row per group of ``df``) with the quantiles added; null where a group has no value."""
    found = quantiles(df, keys, value, points)
    if not keys:
        return grouped.join(F.broadcast(found), F.lit(True), "left")
    found = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [grouped[k].eqNullSafe(found[f"_{k}"]) for k in keys])
    return grouped.join(found, same, "left").drop(*[f"_{k}" for k in keys])
