"""Least-cost travel over a weighted directed edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..session import work_tables
from .travel import estimated_matrix

#: settled parts of one size before they are merged into one
PARTS = 16


class _Settled:
    """Labels that are final: written parts, merged like a log when there are many, so a label is rewritten few times."""

    def __init__(self, write):
        self.write, self.tiers = write, [[]]

    def add(self, part: DataFrame) -> None:
        self.tiers[0].append(part)
        for tier, parts in enumerate(self.tiers):
            if len(parts) < PARTS:
                return
            if tier + 1 == len(self.tiers):
                self.tiers.append([])
            self.tiers[tier + 1].append(self.write(reduce(DataFrame.unionByName, parts)))
            self.tiers[tier] = []

    def all(self) -> DataFrame | None:
        parts = [p for tier in self.tiers for p in tier]
        return reduce(DataFrame.unionByName, parts) if parts else None


def least_costs(edges: DataFrame, origins: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(origin, node, cost) for every node reachable from an origin.

    ``edges``: src, dst, cost (non-negative). ``origins``: origin, node.
    A label is *fresh* until its edges have been relaxed. No later offer can undercut the least fresh cost, so relaxed
    labels up to it are final: they leave the open table for a part that is never rewritten. A round reads the open
    labels and writes them once with the offers of the fresh ones; the smallest fresh cost is measured while writing.
    Rounds end when nothing is fresh, at most after the hop count of the longest least-cost path.
    """
    spark = edges.sparkSession
    with work_tables(spark) as write:
        edges = write(edges.groupBy("src", "dst").agg(F.min(F.col("cost").cast("double")).alias("cost")))
        start = origins.select("origin", "node").distinct().withColumns({"cost": F.lit(0.0), "fresh": F.lit(True)})
        settled, written = _Settled(write), write(start)
        if written.isEmpty():
            return spark.createDataFrame([], written.drop("fresh").schema)
        for _ in range(max_rounds):
            fresh = written.filter("fresh")
            offers = (
                fresh.join(edges.withColumnRenamed("cost", "step"), F.col("node") == F.col("src"))
                .groupBy("origin", F.col("dst").alias("node"))
                .agg(F.min(F.col("cost") + F.col("step")).alias("offer"))
            )
            final = settled.all()
            if final is not None:
                offers = offers.join(final.select("origin", "node"), ["origin", "node"], "left_anti")
            merged = written.drop("fresh").join(offers, ["origin", "node"], "full").select(
                "origin",
                "node",
                F.least("cost", "offer").alias("cost"),
                (F.col("offer").isNotNull() & (F.col("cost").isNull() | (F.col("offer") < F.col("cost")))).alias("fresh"),
            )
            seen = Observation()
            table = write(merged.observe(seen, F.min(F.when(F.col("fresh"), F.col("cost"))).alias("least")))
            least = seen.get["least"]
            done = ~F.col("fresh") & (F.lit(True) if least is None else F.col("cost") <= least)
            settled.add(table.filter(done).drop("fresh"))
            written = table.filter(~done)
            if least is None:
                return write(settled.all(), keep=True)
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def least_costs_into(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node, cost) of the cheapest way from every node into each target.

    ``targets``: target, node. Runs over the reversed edges, so the table holds targets x nodes labels however many
    origins ask later.
    """
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost")
    costs = least_costs(back, targets.select(F.col("target").alias("origin"), "node"))
    return costs.withColumnRenamed("origin", "target")


def drive_matrix(edges: DataFrame, origin_nodes: DataFrame, zone_nodes: DataFrame, origins: DataFrame) -> DataFrame:
    """origin x zone seconds over the road graph.

    ``origin_nodes``: origin, node. ``zone_nodes``: zone, node. ``origins``:
    origin, lon, lat for all wanted origins. The cheapest ways into the zones are found once; origins join them by
    node. Zones that cannot be reached read 9999; origins without a node fall back to the great-circle estimate. Of
    several nodes of an origin or zone the cheapest pair counts.
    """
    into = least_costs_into(edges, zone_nodes.select(F.col("zone").alias("target"), "node"))
    to_zones = (
        origin_nodes.distinct().join(into, "node")
        .groupBy("origin", F.col("target").alias("dest")).agg(F.min("cost").alias("cost"))
    )
    grid = estimated_matrix(origins)
    mapped = origin_nodes.select("origin").distinct().withColumn("mapped", F.lit(True))
    return (
        grid.join(mapped, "origin", "left")
        .join(to_zones, ["origin", "dest"], "left")
        .select(
            "origin",
            "dest",
            F.when(F.col("mapped"), F.coalesce(F.col("cost").cast("int"), F.lit(dim.UNREACHABLE_SECONDS)))
            .otherwise(F.col("seconds"))
            .alias("seconds"),
        )
    )


def reachability(matrix: DataFrame) -> DataFrame:
    """Pair counts, reachable share and the range of reachable times."""
    ok = F.col("seconds") < dim.UNREACHABLE_SECONDS
    return matrix.agg(
        F.count("*").alias("pairs"),
        F.sum(ok.cast("int")).alias("reachable"),
        F.sum((~ok).cast("int")).alias("unreachable"),
        (F.avg(ok.cast("int")) * 100).alias("pct_reachable"),
        F.min(F.when(ok, F.col("seconds"))).alias("min_seconds"),
        F.max(F.when(ok, F.col("seconds"))).alias("max_seconds"),
    )


def movement_edges(trips: DataFrame) -> DataFrame:
    """Edge table from observed trips: mean cost per (src, dst), no self-loops."""
    return trips.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.avg("cost").alias("cost"))
