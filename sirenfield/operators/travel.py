"""Drive-time tables and nearest-origin searches.

Zones are 31 by definition, so a row meets every zone by exploding a literal
array in its own task. Large point sets meet through a tree of boxes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..functions.geo import drive_seconds, great_circle_km, great_circle_km_atan2, planar_d2
from ..session import spread, work_tables


def each_zone(df: DataFrame, alias: str = "z") -> DataFrame:
    """One row per input row and zone (fixed fan-out of 31, no join)."""
    return df.withColumn(alias, F.explode(dim.zone_array()))


def zone_origins(spark) -> DataFrame:
    return dim.zones(spark).select(F.col("zone").alias("origin"), "lon", "lat")


def station_origins(stations: DataFrame) -> DataFrame:
    return stations.select(F.col("station_id").alias("origin"), "lon", "lat")


def estimated_matrix(origins: DataFrame) -> DataFrame:
    """origin x zone drive seconds by circuity-corrected great circle."""
    o = each_zone(origins)
    return o.select(
        "origin",
        F.col("z.zone").alias("dest"),
        drive_seconds(F.col("lon"), F.col("lat"), F.col("z.lon"), F.col("z.lat")).alias("seconds"),
    )


def nearest_origin(matrix: DataFrame, origins: DataFrame) -> DataFrame:
    """Per zone: least drive time over the given origins, 9999 where none reaches it."""
    best = matrix.join(origins.select("origin"), "origin", "left_semi").groupBy("dest").agg(
        F.min("seconds").alias("seconds")
    )
    zones = dim.zones(matrix.sparkSession).select(F.col("zone").alias("dest"))
    return zones.join(best, "dest", "left").select(
        "dest", F.coalesce("seconds", F.lit(dim.UNREACHABLE_SECONDS)).alias("seconds")
    )


def nearest_staged(staged: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and zone: least drive time from any staging zone chosen for the key.

    ``staged`` holds (keys, staging_zone); zone-to-zone rows of the matrix are
    31 x 31 and broadcast.
    """
    legs = matrix.filter(F.col("origin").isin(dim.ZONE_CODES) & F.col("dest").isin(dim.ZONE_CODES))
    reached = (
        staged.join(F.broadcast(legs), staged["staging_zone"] == legs["origin"])
        .groupBy(*keys, F.col("dest").alias("zone"))
        .agg(F.min("seconds").alias("seconds"))
    )
    grid = each_zone(staged.select(*keys).distinct()).select(*keys, F.col("z.zone").alias("zone"))
    return grid.join(reached, [*keys, "zone"], "left").withColumn(
        "seconds", F.coalesce("seconds", F.lit(dim.UNREACHABLE_SECONDS))
    )


def snap_to_zone(points: DataFrame, own_cluster: bool = False) -> DataFrame:
    """Adds the zone nearest to (lon, lat); ties go to the earlier zone.

    With ``own_cluster`` only the point's ``cluster_zones`` compete.
    """
    candidates = dim.zone_array()
    if own_cluster:
        candidates = F.filter(candidates, lambda z: F.array_contains(F.col("cluster_zones"), z["zone"]))
    ranked = F.transform(
        candidates,
        lambda z: F.struct(
            planar_d2(z["lon"], z["lat"], F.col("lon"), F.col("lat")).alias("d2"), z["zone_ord"], z["zone"]
        ),
    )
    return points.withColumn("nearest_zone", F.array_min(ranked)["zone"])


def legs_into(matrix: DataFrame) -> DataFrame:
    """Zone-to-zone legs as one map per destination (31 rows of 31 entries)."""
    legs = matrix.filter(F.col("origin").isin(dim.ZONE_CODES) & F.col("dest").isin(dim.ZONE_CODES))
    return legs.groupBy(F.col("dest").alias("zone")).agg(
        F.map_from_entries(F.collect_list(F.struct("origin", "seconds"))).alias("legs")
    )


def zones_close_by(lon: Column, lat: Column) -> Column:
    """Codes of the zones whose centre lies within 2 km of a point."""
    close = F.filter(dim.zone_array(), lambda z: great_circle_km_atan2(lon, lat, z["lon"], z["lat"]) < dim.BORROW_RADIUS_KM)
    return F.transform(close, lambda z: z["zone"])


def staged_seconds(point: Column, lon: Column, lat: Column, legs: Column, factor: Column) -> Column:
    """Drive from a placed point (lon, lat, near) to a zone's centre: direct, or along a leg of a zone close by."""
    km = great_circle_km_atan2(point["lon"], point["lat"], lon, lat)
    direct = km / (F.lit(dim.URBAN_KMH) / factor) * 3600
    borrowed = F.array_min(F.transform(point["near"], lambda o: legs[o]))
    return F.least(direct, borrowed.cast("double"))


def staged_drive(points: DataFrame, matrix: DataFrame, keys: list[str], factor: str) -> DataFrame:
    """Best drive time per key and zone from placed points.

    A point within 2 km of a zone's centre may borrow that zone's matrix row
    (not slowed by weather); the direct great-circle time at weather-reduced
    speed always competes. One pass: points of a key meet in one partition and fan
    out to zones there, so the minimum needs no further shuffle.
    """
    near = spread(points, *keys).select(*keys, factor, "lon", "lat", zones_close_by(F.col("lon"), F.col("lat")).alias("near"))
    fan = each_zone(near).select(
        *keys, factor, F.struct("lon", "lat", "near").alias("p"), "z.zone", F.col("z.lon").alias("z_lon"), F.col("z.lat").alias("z_lat")
    )
    drive = staged_seconds(F.col("p"), F.col("z_lon"), F.col("z_lat"), F.col("legs"), F.col(factor))
    return (
        fan.join(F.broadcast(legs_into(matrix)), "zone", "left")
        .groupBy(*keys, "zone")
        .agg(F.min(drive).alias("best_drive"))
    )


#: nodes of a leaf, children of a box as a power of two, and depth of the finest cell (0.6 m)
LEAF_NODES, FANOUT_BITS, FINEST = 64, 4, 26


def _interleaved(a: Column, b: Column) -> Column:
    """Bits of two numbers in turn: neighbours on the map mostly stay neighbours in this order."""

    def gaps(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return gaps(a).bitwiseOR(F.shiftleft(gaps(b), 1))


def _unit_vector(lon: str, lat: str) -> dict[str, Column]:
    """The point on a sphere of radius 1. Straight distances there are in the order of great-circle distances, also
    across the antimeridian and at the poles."""
    return {
        "x": F.cos(F.radians(lat)) * F.cos(F.radians(lon)),
        "y": F.cos(F.radians(lat)) * F.sin(F.radians(lon)),
        "z": F.sin(F.radians(lat)),
    }


def box_tree(nodes: DataFrame, write) -> tuple[DataFrame, list[DataFrame]]:
    """Nodes with their leaf, and the levels of boxes from the root's children down: parent, box, limits in x, y, z.

    Leaves are cells of the map, each split in four until it has few nodes, so a crowded place has as many small leaves as
    it needs. Nodes are sorted by cell over all tasks; how deep a node's leaf lies shows in the cells it shares with the
    64th neighbour on either side. Runs of 16 boxes make a box above. Written by ``write``.
    """
    steps = 2**FINEST - 1
    scaled = lambda c, span: F.floor((F.col(c) / span + 0.5) * steps).cast("long")
    placed = write(
        nodes.withColumns(_unit_vector("n_lon", "n_lat"))
        .withColumn("cell", _interleaved(scaled("n_lon", 360.0), scaled("n_lat", 180.0)))
        .repartitionByRange("cell").sortWithinPartitions("cell")
        .withColumn("at", F.monotonically_increasing_id()).withColumn("range", F.shiftright("at", 33))
    )
    order = Window.partitionBy("range").orderBy("at")
    apart = F.col("cell").bitwiseXOR(F.lead("cell", LEAF_NODES).over(order))
    shared = F.when(apart == 0, FINEST).otherwise(F.floor((2 * FINEST - F.length(F.bin(apart))) / 2))
    depth = F.least(F.coalesce(F.max("shared").over(order.rowsBetween(-LEAF_NODES, 0)) + 1, F.lit(0)), F.lit(FINEST)).cast("int")
    leaf = F.struct("depth", F.expr(f"shiftright(cell, 2 * ({FINEST} - depth))").alias("cell"))
    begins = F.coalesce(F.lag("leaf").over(order) != F.col("leaf"), F.lit(True)).cast("long")
    placed = write(
        placed.withColumn("shared", shared).withColumn("depth", depth).withColumn("leaf", leaf).withColumn("begins", begins)
        .withColumn("no", F.sum("begins").over(order))
        .select("node_id", "n_lon", "n_lat", "x", "y", "z", F.shiftleft("range", 33).bitwiseOR(F.col("no")).alias("box"))
    )
    # a box is the range above bit 33 and a number below: levels between the last number's bits and 33 would repeat
    most, last = placed.agg(F.max(F.col("box").bitwiseAND((1 << 33) - 1)), F.max(F.shiftright("box", 33))).first()
    shifts = [0]
    while most is not None and (most >> shifts[-1] or last >> max(0, shifts[-1] - 33)):
        up = shifts[-1] + FANOUT_BITS
        shifts.append(up if most >> shifts[-1] or shifts[-1] >= 33 else 33 + FANOUT_BITS)
    limits = [f(c).alias(f"{c}{s}") for c in "xyz" for s, f in (("0", F.min), ("1", F.max))]
    again = [f(c).alias(c) for c, f in ((f"{c}{s}", f) for c in "xyz" for s, f in (("0", F.min), ("1", F.max)))]
    levels, boxes = [], placed.groupBy("box").agg(*limits)
    for here, above in zip(shifts, [*shifts[1:], None]):
        parent = F.lit(0).cast("long") if above is None else F.shiftright("box", above - here)
        levels.append(write(boxes.withColumn("parent", parent)))
        boxes = levels[-1].groupBy(F.col("parent").alias("box")).agg(*again)
    return placed, levels[::-1]


def candidate_leaves(points: DataFrame, levels: list[DataFrame], leaves: DataFrame, write) -> DataFrame:
    """The leaves that can hold a point's nearest node: (point_id, lon, lat, box).

    The nearest point of a box bounds its nodes' distances from below, the farthest corner from above. Level by level
    only boxes stay whose lower bound is within the least upper bound that the point has seen. Of the leaves the nearest
    is opened first; only those stay that are no farther than the node found there.
    """
    keys = ["point_id", "lon", "lat"]
    start = points.select(*keys).withColumns(_unit_vector("lon", "lat"))
    found = start.withColumns({"box": F.lit(0).cast("long"), "low": F.lit(0.0)})
    square = lambda side: reduce(lambda a, b: a + b, [side(c) * side(c) for c in "xyz"])
    outside = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    across = lambda c: F.greatest(F.abs(F.col(c) - F.col(f"{c}0")), F.abs(F.col(c) - F.col(f"{c}1")))
    # the slack covers rounding: straight and great-circle distances are computed differently
    slack = lambda distance: distance * (1 + 1e-9) + 1e-9
    for level in levels:
        opened = found.drop("low").withColumnRenamed("box", "parent").join(level, "parent").select(
            *keys, "x", "y", "z", "box", F.sqrt(square(outside)).alias("low"), F.sqrt(square(across)).alias("high")
        )
        least = F.min("high").over(Window.partitionBy(*keys))
        found = opened.withColumn("least", least).filter(F.col("low") <= slack(F.col("least"))).drop("high", "least")
    found = write(found)
    nodes = leaves.select("box", *[F.col(c).alias(f"n_{c}") for c in "xyz"])
    nearest = found.groupBy(*keys, "x", "y", "z").agg(F.min(F.struct("low", "box"))["box"].alias("box"))
    reach = nearest.join(nodes, "box").groupBy(*keys).agg(F.min(F.sqrt(square(lambda c: F.col(c) - F.col(f"n_{c}")))).alias("reach"))
    return found.join(reach, keys).filter(F.col("low") <= slack(F.col("reach"))).select(*keys, "box")


def nearest_node(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nearest node of every point with its distance in metres and a far flag (> 500 m).

    ``points``: point_id, lon, lat. ``nodes``: node_id, lon, lat. Exact: nodes at the same place collapse to the lowest
    id, which also wins ties; a tree of boxes with few nodes each is descended for all points at once, and only leaves
    that can win are compared node by node. Points without a place are left out.
    """
    places = nodes.groupBy("lon", "lat").agg(F.min("node_id").alias("node_id"))
    places = places.select("node_id", F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat"))
    metres = great_circle_km(F.col("lon"), F.col("lat"), F.col("n_lon"), F.col("n_lat")) * 1000
    with work_tables(points.sparkSession) as write:
        leaves, levels = box_tree(places, write)
        best = (
            candidate_leaves(points, levels, leaves, write)
            .join(leaves.select("box", "node_id", "n_lon", "n_lat"), "box")
            .groupBy("point_id", "lon", "lat")
            .agg(F.min(F.struct(metres.alias("metres"), F.col("node_id"))).alias("best"))
        )
        return write(best.select(
            "point_id", F.col("best.node_id").alias("node_id"), F.col("best.metres").alias("metres"),
            (F.col("best.metres") > 500).cast("int").alias("is_far"),
        ), keep=True)


def zip_zone(spark) -> DataFrame:
    """ZIP to zone; a ZIP listed under several zones belongs to the first."""
    w = Window.partitionBy("zip").orderBy("zone_ord")
    return (
        dim.zone_zips(spark)
        .withColumn("rn", F.row_number().over(w))
        .filter("rn = 1")
        .select("zip", "zone")
    )


def zip_key(*columns: str) -> Column:
    """First non-empty of several possible ZIP columns."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def zips_with_scores(areas: DataFrame, scores: DataFrame, *zip_columns: str) -> DataFrame:
    """Areas keyed by ZIP -> zone -> scored zone; unmatched areas drop out."""
    keyed = areas.withColumn("zip", zip_key(*zip_columns)).filter(F.col("zip").isNotNull())
    return keyed.join(F.broadcast(zip_zone(areas.sparkSession)), "zip").join(scores, "zone")


def zips_with_svi(areas: DataFrame, *zip_columns: str) -> DataFrame:
    svi = dim.zones(areas.sparkSession).select("zone", "svi_score")
    return zips_with_scores(areas, F.broadcast(svi), *zip_columns)


def centroid_weights(scores: DataFrame, weight: str) -> DataFrame:
    """Every zone centre with its weight, 0 for zones without a score."""
    z = dim.zones(scores.sparkSession).select("zone", "lon", "lat")
    return z.join(scores.select("zone", weight), "zone", "left").select(
        "zone", "lon", "lat", F.coalesce(weight, F.lit(0.0)).alias("weight")
    )
