"""Placement of units: borough-fair allocation and demand-weighted clustering.

A scenario's zones (at most 31) travel as one small array, so the whole Lloyd
iteration of a scenario runs inside one row with built-in array functions:
one shuffle groups the zones of each scenario, and no round of the iteration
touches the network. Scenarios spread over all tasks. The iteration runs in
passes; only scenarios that have not settled take part in the next one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..session import spread, work_tables
from .travel import snap_to_zone

WEIGHT_FLOOR = 0.01
#: rounds of a pass, and passes before a scenario counts as not converging (only rounding can make it go in circles)
ROUNDS, PASSES = 50, 40


def floored(demand: Column) -> Column:
    return F.greatest(F.coalesce(demand, F.lit(WEIGHT_FLOOR)), F.lit(WEIGHT_FLOOR))


def weighted_centroid(df: DataFrame, *keys: str) -> DataFrame:
    """Demand-weighted centre of each group's zones, with the weight floor."""
    w = floored(F.col("predicted"))
    return df.groupBy(*keys).agg(
        (F.sum(w * F.col("lat")) / F.sum(w)).alias("lat"), (F.sum(w * F.col("lon")) / F.sum(w)).alias("lon")
    )


def centroid_placement(forecast: DataFrame, key: str) -> DataFrame:
    """One point per borough at its weighted centre: what the borough-fair
    placement gives when there are as many units as boroughs."""
    w = floored(F.col("predicted"))
    points = forecast.groupBy(key, "borough").agg(
        (F.sum(w * F.col("lat")) / F.sum(w)).alias("lat"),
        (F.sum(w * F.col("lon")) / F.sum(w)).alias("lon"),
        F.lit(dim.COVERAGE_RADIUS_M).alias("coverage_radius_m"),
        F.round(F.sum("predicted"), 2).alias("predicted_demand_coverage"),
        F.array_sort(F.collect_list("zone")).alias("cluster_zones"),
        F.count("*").cast("int").alias("zone_count"),
    )
    return number_by_demand(points, key)


def zone_points() -> Column:
    """A group's zones as an array in zone order (grouped aggregate)."""
    point = F.struct("zone_ord", "zone", floored(F.col("predicted")).alias("w"), "lat", "lon", "predicted")
    return F.array_sort(F.collect_list(point))


def _d2(p: Column, c: Column) -> Column:
    return (p["lat"] - c["lat"]) * (p["lat"] - c["lat"]) + (p["lon"] - c["lon"]) * (p["lon"] - c["lon"])


def _heaviest(points: Column, score) -> Column:
    """The point with the highest score (ties go to the earlier zone), as an array of one."""
    ranked = F.transform(
        points, lambda p: F.struct(score(p).alias("s"), (-p["zone_ord"]).alias("o"), p["lat"].alias("lat"), p["lon"].alias("lon"))
    )
    # a one-element transform binds the winner once
    return F.transform(
        F.array(F.array_max(ranked)), lambda t: F.struct(t["lat"].alias("lat"), t["lon"].alias("lon"))
    )


def seed_centres(points: Column, k: Column) -> Column:
    """Weighted farthest-first: the heaviest zone, then repeatedly the zone with
    the largest weight times squared distance to the centres chosen so far."""
    first = _heaviest(points, lambda p: p["w"])
    more = F.filter(F.sequence(F.lit(1), k), lambda j: j > 1)

    def add(chosen: Column, _j: Column) -> Column:
        gap = lambda p: p["w"] * F.array_min(F.transform(chosen, lambda c: _d2(p, c)))
        return F.concat(chosen, _heaviest(points, gap))

    return F.aggregate(more, first, add)


def _nearest(p: Column, centres: Column) -> Column:
    ranked = F.transform(centres, lambda c, j: F.struct(_d2(p, c).alias("d"), j.alias("j")))
    return F.array_min(ranked)["j"]


def _labelled(points: Column, label, before) -> Column:
    fields = ("zone_ord", "zone", "w", "lat", "lon", "predicted")
    return F.transform(
        points,
        lambda p: F.struct(*[p[f].alias(f) for f in fields], label(p).cast("int").alias("label"), before(p).alias("before")),
    )


def _recentre(state) -> Column:
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"))

    def centre(old: Column, j: Column) -> Column:
        def add(acc: Column, p: Column) -> Column:
            w = F.when(p["label"] == j, p["w"]).otherwise(0.0)
            return F.struct(
                (acc["w"] + w).alias("w"),
                (acc["lat"] + w * p["lat"]).alias("lat"),
                (acc["lon"] + w * p["lon"]).alias("lon"),
            )

        return F.aggregate(
            state["points"],
            zero,
            add,
            lambda acc: F.when(
                acc["w"] > 0,
                F.struct((acc["lat"] / acc["w"]).alias("lat"), (acc["lon"] / acc["w"]).alias("lon")),
            ).otherwise(old),
        )

    return F.transform(state["centres"], centre)


def _iterate(state: Column, first: int, rounds: int) -> Column:
    """``rounds`` of Lloyd's iteration, the first one beginning with step ``first``: 0 labels, 1 centres.

    The fold alternates two steps over its state, (re)label and (re)centre, so
    that every step reads a finished result of the other. Once no label changes
    the remaining steps pass the state on untouched.
    """

    def step(state: Column, i: Column) -> Column:
        again = _labelled(state["points"], lambda p: _nearest(p, state["centres"]), lambda p: p["label"])
        relabelled = F.struct(
            state["centres"].alias("centres"), again.alias("points"), F.lit(False).alias("settled")
        )
        recentred = F.struct(
            _recentre(state).alias("centres"),
            state["points"].alias("points"),
            F.forall(state["points"], lambda p: p["label"] == p["before"]).alias("settled"),
        )
        return F.when(state["settled"], state).when(i % 2 == 0, relabelled).otherwise(recentred)

    return F.aggregate(F.sequence(F.lit(first), F.lit(2 * rounds)), state, step)


def lloyd(points: Column, k: Column, rounds: int = ROUNDS) -> Column:
    """Weighted K-Means of one row's points: array of (lat, lon) centres, the points with their label, and whether no
    label changed any more. A centre without points stays where it is; a single cluster is its weighted centre.
    """
    start = F.struct(
        seed_centres(points, k).alias("centres"),
        _labelled(points, lambda p: F.lit(-1), lambda p: F.lit(-2)).alias("points"),
        F.lit(False).alias("settled"),
    )
    whole = _labelled(points, lambda p: F.lit(0), lambda p: F.lit(0))
    origin = F.array(F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")))
    centre = _recentre({"centres": origin, "points": whole})
    single = F.struct(centre.alias("centres"), whole.alias("points"), F.lit(True).alias("settled"))
    return F.when(k == 1, single).otherwise(_iterate(start, 0, rounds))


def settle(grouped: DataFrame, keep: list[str], rounds: int = ROUNDS, passes: int = PASSES) -> DataFrame:
    """Runs the iteration on (points, k): (keep, state), every state settled or, after ``passes``, marked as not.

    A pass writes its states; those that have not settled go on from there in the next pass.
    """
    with work_tables(grouped.sparkSession) as write:
        # the first pass settles nearly all, so its table is the result unless some are left
        state = write(grouped.select(*keep, lloyd(F.col("points"), F.col("k"), rounds).alias("state")), keep=True)
        done = []
        for _ in range(passes - 1):
            open_rows = state.filter(~F.col("state.settled"))
            if open_rows.isEmpty():
                break
            done.append(state.filter("state.settled"))
            state = write(open_rows.select(*keep, _iterate(F.col("state"), 1, rounds).alias("state")))
        return write(reduce(DataFrame.unionByName, [*done, state]), keep=True) if done else state


def _clusters(grouped: DataFrame, keep: list[str], rounds: int) -> DataFrame:
    """One row per cluster of the settled iteration."""
    return settle(grouped, keep, rounds).select(
        *keep,
        F.col("state.points").alias("points"),
        F.col("state.settled").alias("converged"),
        F.posexplode("state.centres").alias("label", "centre"),
    ).select(
        *keep,
        "label",
        F.col("centre.lat").alias("lat"),
        F.col("centre.lon").alias("lon"),
        "converged",
        F.filter("points", lambda p: p["label"] == F.col("label")).alias("members"),
    )


def point_summary(points: DataFrame) -> DataFrame:
    """Covered demand, sorted zones, zone count and radius of each placed point."""
    demand = F.aggregate("members", F.lit(0.0), lambda acc, p: acc + p["predicted"])
    return points.withColumns({
        "coverage_radius_m": F.lit(dim.COVERAGE_RADIUS_M),
        "predicted_demand_coverage": F.round(demand, 2),
        "cluster_zones": F.array_sort(F.transform("members", lambda p: p["zone"])),
        "zone_count": F.size("members"),
    }).drop("members")


def number_by_demand(points: DataFrame, key: str) -> DataFrame:
    """staging_index 0.. by covered demand, descending."""
    w = Window.partitionBy(key).orderBy(F.desc("predicted_demand_coverage"), "lat", "lon")
    return points.withColumn("staging_index", F.row_number().over(w) - 1)


def global_placement(forecast: DataFrame, key: str, k: Column, rounds: int = ROUNDS) -> DataFrame:
    """City-wide weighted K-Means per scenario; ``k`` may vary by scenario."""
    grouped = spread(forecast, key).groupBy(key).agg(zone_points().alias("points"), F.max(k).alias("k"))
    grouped = grouped.withColumn("k", F.least("k", F.size("points")))
    return point_summary(_clusters(grouped, [key], rounds))


def staging_zones(forecast: DataFrame, key: str, k: Column, rounds: int = ROUNDS) -> DataFrame:
    """The zone nearest to each centre of the city-wide placement."""
    snapped = snap_to_zone(global_placement(forecast, key, k, rounds))
    return snapped.withColumnRenamed("nearest_zone", "staging_zone")


def borough_ranks(forecast: DataFrame, key: str) -> DataFrame:
    """Boroughs of a scenario ranked by demand, descending; ties keep city order."""
    demand = forecast.groupBy(key, "borough").agg(
        F.sum("predicted").alias("demand"), F.min("zone_ord").alias("first_ord"), F.count("*").alias("n_zones")
    )
    per_key = Window.partitionBy(key)
    ranked = per_key.orderBy(F.desc("demand"), "first_ord")
    return demand.withColumns({
        "borough_rank": F.row_number().over(ranked), "n_boroughs": F.count("*").over(per_key),
    })


def allocate_units(ranks: DataFrame, units: DataFrame, key: str) -> DataFrame:
    """Clusters per borough: one each, the rest by highest quotient demand / held.

    With fewer units than boroughs only the top ones get a unit. The surplus is
    the top ``units - boroughs`` of the quotients demand / j (at most 5 x units
    of them per scenario), which equals handing units out one at a time.
    """
    # a window would need the boroughs of a key together again; the row's own array has them
    df = ranks.join(units, key)
    extra = F.col("units") - F.col("n_boroughs")
    per_key = Window.partitionBy(key)
    bids = F.when(extra > 0, F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), lambda j: F.struct(
        (F.col("demand") / j).alias("quotient"), (-F.col("borough_rank")).alias("first"), (-j).alias("j")
    )))
    every = F.flatten(F.collect_list("bids").over(per_key))
    won = F.slice(F.reverse(F.array_sort(F.col("every"))), F.lit(1), F.greatest(extra, F.lit(0)))
    mine = F.size(F.filter(won, lambda b: b["first"] == -F.col("borough_rank")))
    base = F.when((extra >= 0) | (F.col("borough_rank") <= F.col("units")), 1).otherwise(0)
    return df.withColumn("bids", bids).withColumn("every", every).withColumn(
        "clusters", (base + F.when(extra > 0, mine).otherwise(0)).cast("int")
    ).drop("bids", "every")


def borough_placement(forecast: DataFrame, units: DataFrame, key: str, rounds: int = ROUNDS) -> DataFrame:
    """Borough-fair placement. A borough's clusters never exceed its zones (any
    surplus units lapse); a single cluster is the weighted centre."""
    allocation = allocate_units(borough_ranks(forecast, key), units, key).filter("clusters > 0")
    grouped = spread(forecast, key).groupBy(key, "borough").agg(zone_points().alias("points"))
    grouped = grouped.join(allocation.select(key, "borough", "clusters"), [key, "borough"])
    grouped = grouped.withColumn("k", F.least("clusters", F.size("points")))
    return number_by_demand(point_summary(_clusters(grouped, [key, "borough"], rounds)), key)


def apportion_units(points: DataFrame, key: str, total: str) -> DataFrame:
    """Units shown per placed point: one each, extras by largest remainder of
    demand; with fewer units than points the top ones by demand get one."""
    demand = F.when(F.coalesce("predicted_demand_coverage", F.lit(0.0)) == 0, 1.0).otherwise(
        F.col("predicted_demand_coverage")
    )
    per_key = Window.partitionBy(key)
    df = points.withColumns({"d": demand, "n": F.count("*").over(per_key)})
    df = df.withColumn("extras", F.greatest(F.col(total) - F.col("n"), F.lit(0)))
    df = df.withColumn("raw", F.col("d") / F.sum("d").over(per_key) * F.col("extras"))
    df = df.withColumn("whole", F.floor("raw"))
    df = df.withColumns({
        "left_over": F.col("extras") - F.sum("whole").over(per_key),
        "by_rest": F.row_number().over(per_key.orderBy(F.desc(F.col("raw") - F.col("whole")), "staging_index")),
        "by_demand": F.row_number().over(per_key.orderBy(F.desc("d"), "staging_index")),
    })
    units = F.when(F.col(total) < F.col("n"), (F.col("by_demand") <= F.col(total)).cast("int")).otherwise(
        1 + F.col("whole") + (F.col("by_rest") <= F.col("left_over")).cast("int")
    )
    return df.withColumn("units_shown", units.cast("int")).drop(
        "d", "n", "extras", "raw", "whole", "left_over", "by_rest", "by_demand"
    )
