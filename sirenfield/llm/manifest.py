"""Merkle manifest of a dataset: a hash tree per group, one over the groups, and a proof for every row.

Levels are built by a slot pivot: conditional aggregates put the children of a parent into ``fanout`` columns; the
columns concatenated give the parent's hash, and the columns without a child's own give its siblings. Several levels
share one exchange: rows are dealt by blocks of ``fanout ** k`` consecutive leaves, inside which all groupings are local.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: leaves of a block at most; one row holds their partial proofs
BLOCK = 1_024
_STEP = "array<struct<before string, after string>>"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length in bytes, a colon, the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def group_key(group: Column) -> Column:
    """Text that sorts as the groups do in UTF-8 order, null first; never null itself."""
    return F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group.cast("string")))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds ``idx``, the row's place from 0 within its ``g``, and ``n``, the rows of it; ties are repeated rows.

    Rows are sorted by ranges and written with their place in the range; a running sum over the few (range, group)
    counts makes places in the group of them. No group has to fit a task.
    """
    at = F.monotonically_increasing_id()
    placed = stage(
        rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order).withColumn("_at", at).withColumn("_range", F.shiftright("_at", 33)),
        "placed",
    )
    counts = placed.groupBy("g", "_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    by_range = Window.partitionBy("g").orderBy("_range")
    # written, so that Spark knows how few they are and need not move the rows to them
    starts = stage(counts.select(
        "g", "_range", "_first", (F.sum("_n").over(by_range) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy("g")).alias("n")
    ), "starts")
    return placed.join(starts, ["g", "_range"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_at", "_range", "_n", "_first", "_before"
    )


def _level(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level up within (g, block); a group with one node stays as it is."""
    slot, child = F.col("idx") % fanout, F.struct("h", "below")
    rows = nodes.groupBy("g", "block", "n", F.floor(F.col("idx") / fanout).alias("idx")).agg(
        *[F.first(F.when(slot == k, child), ignorenulls=True).alias(f"slot{k}") for k in range(fanout)]
    )
    hashes = [F.coalesce(F.col(f"slot{k}.h"), F.lit("")) for k in range(fanout)]
    single = F.col("n") == 1

    def joined(which: list[Column]) -> Column:
        return F.concat(*which) if which else F.lit("")

    def proved(k: int) -> Column:
        step = F.struct(joined(hashes[:k]).alias("before"), joined(hashes[k + 1 :]).alias("after"))
        below = F.transform(
            F.col(f"slot{k}.below"), lambda x: F.struct(x["no"].alias("no"), F.concat(x["steps"], F.array(step)).alias("steps"))
        )
        return F.coalesce(F.when(single, F.col(f"slot{k}.below")).otherwise(below), F.array())

    return rows.select(
        "g", "block", "idx", F.ceil(F.col("n") / fanout).cast("long").alias("n"),
        F.when(single, F.col("slot0.h")).otherwise(digest(*hashes)).alias("h"),
        F.concat(*[proved(k) for k in range(fanout)]).alias("below"),
    )


def climb(nodes: DataFrame, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """(g, idx, h, n) -> (g, idx, steps, top): every node's siblings on its way up, and the root of its group.

    ``steps`` has, level by level from below, the hashes of the run's others before and after the node's own.
    """
    levels, width = 1, fanout
    while width * fanout <= block:
        levels, width = levels + 1, width * fanout
    dealt = nodes.withColumn("block", F.floor(F.col("idx") / width)).repartition("g", "block")
    up = dealt.select("g", "block", "idx", "n", "h", F.array(F.struct(F.col("idx").alias("no"), F.array().cast(_STEP).alias("steps"))).alias("below"))
    for _ in range(levels):
        up = _level(up, fanout)
    tops = stage(up.select("g", F.col("block").alias("idx"), "n", "h", "below"), "tops")
    flat = F.explode("below").alias("x")
    if tops.agg(F.max("n")).first()[0] in (None, 1):
        return tops.select("g", F.col("h").alias("top"), flat).select("g", F.col("x.no").alias("idx"), "x.steps", "top")
    above = climb(tops.select("g", "idx", "n", "h"), fanout, block).select("g", "idx", F.col("steps").alias("more"), "top")
    return tops.join(above, ["g", "idx"]).select("g", "top", "more", flat).select(
        "g", F.col("x.no").alias("idx"), F.concat("x.steps", "more").alias("steps"), "top"
    )


def siblings(steps: Column) -> Column:
    """Hashes of all siblings on the way, level by level, left to right."""
    return F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "")


def fold(own: Column, steps: Column) -> Column:
    """The root that ``own`` leads to with these siblings."""
    return F.aggregate(steps, own, lambda h, s: digest(s["before"], h, s["after"]))


def manifest(rows: DataFrame, order: str, fanout: int = 2, block: int = BLOCK) -> DataFrame:
    """Adds ``idx``, ``steps``, ``subroot`` and ``root`` to ``rows``, which have a leaf hash ``h`` and a group key ``g``.

    Leaves of a group ascend by ``order`` (nulls first, ties by ``h``, then repeated rows in any order); runs of ``fanout``
    consecutive nodes become one while a group has several; a group's root is its ``subroot``. The subroots in the order of ``g``
    give ``root`` in the same way. No rows give no rows.
    """
    placed = stage(numbered(rows, order, "h"), "leaves")
    nodes = placed.select("g", "idx", "n", "h")
    found = stage(climb(nodes, fanout, block), "proofs")
    subroots = found.groupBy("g").agg(F.first("top").alias("h")).withColumnRenamed("g", "group").withColumn("g", F.lit(""))
    placed_roots = stage(numbered(subroots, "group"), "subroots")
    above = climb(placed_roots.select("g", "idx", "n", "h"), fanout, block).select("idx", F.col("steps").alias("more"), F.col("top").alias("root"))
    # written as well: a row per group, which must not move the leaves by their group
    roots = stage(placed_roots.select("group", "idx").join(above, "idx").select(F.col("group").alias("g"), "more", "root"), "roots")
    return placed.join(found, ["g", "idx"]).join(roots, "g").withColumn("steps", F.concat("steps", "more")).withColumnRenamed("top", "subroot").drop("more", "n")
