"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _sign(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return r["n"], r["h"]


def _star(pairs: DataFrame) -> DataFrame:
    """(u, v) -> each v tied to the least node around u. The least node is found before the join, with partial minima."""
    least = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame) -> DataFrame:
    """Links (a, b) of long ids -> (node, label): the least id that each linked node reaches.

    Every round first ties the larger neighbours of a node to its least one, then the smaller ones; the links become stars
    in about log(n) rounds. Each round is written to the shared folder. Links of a node to itself and repeated links do no
    harm; an empty table gives an empty one.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    sign = _sign(now)
    while sign[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both).where("v > u and v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        star = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")))
        small = star.where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(star.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = stage(small.distinct(), "links")
        before, sign = sign, _sign(now)
        if sign == before:
            break
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
