"""Before/after measures of a placement, per fact and per zone and scenario."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..functions import response as rs
from ..functions.weather import travel_factor
from .aggregate import ZONE
from .quantiles import quantiles, with_quantiles
from .scenarios import hour_bins
from .travel import legs_into, staged_seconds, zones_close_by

BIN = ["hour", "dayofweek"]


# ---- bands and sampling -----------------------------------------------------

def quantile_band(df: DataFrame, column: str, label: str = "svi_quartile") -> DataFrame:
    """Q1..Q4 by exact interpolated quartile edges, right-closed. The edges are one row."""
    edges = quantiles(df, [], column, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    v = F.col(column)
    band = F.when(v <= F.col("_q1"), "Q1").when(v <= F.col("_q2"), "Q2").when(v <= F.col("_q3"), "Q3").when(v.isNotNull(), "Q4")
    return df.join(F.broadcast(edges), F.lit(True), "left").withColumn(label, band).drop("_q1", "_q2", "_q3")


def capped_sample(df: DataFrame, keys: list[str], id_column: str, cap: int, at_least: int = 0) -> DataFrame:
    """Up to ``cap`` rows per group in hash order, repeatable. Groups below
    ``at_least`` rows drop out. The row_number limit is applied before the
    shuffle too, so a hot group sends at most ``cap`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(F.md5(F.col(id_column).cast("string")), id_column)
    out = df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap).drop("rn")
    if at_least > 1:
        sizes = df.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= at_least)
        out = out.join(sizes.drop("n"), keys, "left_semi")
    return out


# ---- what-if per fact -------------------------------------------------------

def acute_test_facts(facts: DataFrame) -> DataFrame:
    kept = ["CAD_INCIDENT_ID", "BOROUGH", ZONE, *BIN, "INCIDENT_RESPONSE_SECONDS_QY", "svi_score"]
    return facts.filter((F.col("split") == "test") & (F.col("is_high_acuity") == 1)).select(*kept)


def bin_facts(facts: DataFrame, bins: DataFrame) -> DataFrame:
    """Facts of the wanted (hour, weekday) bins: at most 168 distinct ones, which bounds the broadcast."""
    wanted = bins.filter(F.col("hour").between(0, 23) & F.col("dayofweek").between(0, 6)).select(*BIN).distinct()
    return facts.join(F.broadcast(wanted), BIN)


def fact_whatif(facts: DataFrame, staged: DataFrame, fixed: DataFrame, observed: bool = True) -> DataFrame:
    """Before and after of each fact.

    ``staged``: hour, dayofweek, zone, seconds (best staged origin; 168 x 31
    rows at most are kept). ``fixed``: dest, seconds (best fixed station; 31 rows). Before is the
    observed time, or with ``observed=False`` always the fixed station. Both
    lookups are broadcast, so facts stay where they were read.
    """
    known = staged.filter(F.col("zone").isin(dim.ZONE_CODES) & F.col("hour").between(0, 23) & F.col("dayofweek").between(0, 6))
    s = known.groupBy(*BIN, F.col("zone").alias(ZONE)).agg(F.min("seconds").alias("staged_sec"))
    f = fixed.filter(F.col("dest").isin(dim.ZONE_CODES)).groupBy(F.col("dest").alias(ZONE)).agg(F.min("seconds").alias("fixed_sec"))
    df = facts.join(F.broadcast(s), [*BIN, ZONE], "left").join(F.broadcast(f), ZONE, "left")
    missing = F.lit(dim.UNREACHABLE_SECONDS)
    fallback = F.coalesce("fixed_sec", missing)
    before = rs.observed_or(F.col("INCIDENT_RESPONSE_SECONDS_QY"), fallback) if observed else fallback
    after = F.coalesce("staged_sec", missing)
    return df.select(
        "CAD_INCIDENT_ID",
        *BIN,
        F.col(ZONE).alias("incident_zone"),
        F.col("BOROUGH").alias("borough"),
        "svi_quartile",
        before.alias("baseline_drive_sec"),
        after.alias("staged_drive_sec"),
        (before - after).alias("seconds_saved"),
        rs.within_threshold(before).alias("baseline_within_8min"),
        rs.within_threshold(after).alias("staged_within_8min"),
    )


def _shares() -> list[Column]:
    return [
        (F.avg("baseline_within_8min") * 100).alias("pct_within_8min_static"),
        (F.avg("staged_within_8min") * 100).alias("pct_within_8min_staged"),
    ]


def _breakdown(whatif: DataFrame, keys: list[str], median: str) -> DataFrame:
    grouped = whatif.groupBy(*keys).agg(*_shares(), F.count("*").alias("n_incidents"))
    return with_quantiles(grouped, whatif, keys, "seconds_saved", {median: 0.5})


def bin_summary(whatif: DataFrame) -> DataFrame:
    """Per (hour, weekday): median saved, shares within the threshold, n."""
    return _breakdown(whatif, BIN, "median_seconds_saved")


def dense_bins(summary: DataFrame) -> DataFrame:
    """All 168 bins; empty ones have NULL metrics and n = 0."""
    return (
        hour_bins(summary.sparkSession)
        .join(summary, BIN, "left")
        .withColumn("n_incidents", F.coalesce("n_incidents", F.lit(0).cast("long")))
    )


def group_breakdown(whatif: DataFrame, group: str, by_bin: bool = False) -> DataFrame:
    """Shares and median saved by borough or band, overall or within each bin."""
    return _breakdown(whatif, [*(BIN if by_bin else []), group], "median_saved_sec")


def headline(summary: DataFrame) -> DataFrame:
    """Mean of bin shares, median of bin medians, gain in points."""
    filled = summary.filter(F.col("median_seconds_saved").isNotNull())
    means = filled.agg(
        F.avg("pct_within_8min_static").alias("overall_static"),
        F.avg("pct_within_8min_staged").alias("overall_staged"),
        (F.avg("pct_within_8min_staged") - F.avg("pct_within_8min_static")).alias("gain_points"),
    )
    return with_quantiles(means, filled, [], "median_seconds_saved", {"median_saved": 0.5})


# ---- what-if per zone and scenario -----------------------------------------

def zone_whatif(forecast: DataFrame, stats: DataFrame, points: DataFrame, matrix: DataFrame, key: str) -> DataFrame:
    """Before and after per scenario and zone.

    Weather slows the travel part; dispatch stays. The staged travel has a floor
    of 120 s and the result is never worse than before. Zones meet their scenario's
    points by ``key`` alone: tables bucketed by it need no exchange here.
    """
    s = stats.filter(F.col(ZONE).isin(dim.ZONE_CODES)).select(
        F.col(ZONE).alias("zone"), F.col("avg_dispatch_seconds").alias("s_dispatch"),
        F.col("avg_travel_seconds").alias("s_travel"),
    )
    z = dim.zones(forecast.sparkSession).select(
        "zone", rs.dispatch_default(F.col("response_default")).alias("d_dispatch"), "response_default",
        F.col("lon").alias("z_lon"), F.col("lat").alias("z_lat"),
    )
    df = forecast.withColumn("factor", travel_factor(F.col("precipitation"), F.col("windspeed")))
    placed = points.groupBy(key).agg(F.collect_list(F.struct("lon", "lat", zones_close_by(F.col("lon"), F.col("lat")).alias("near"))).alias("placed"))
    df = (
        df.join(F.broadcast(s), "zone", "left")
        .join(F.broadcast(z), "zone", "left")
        .join(F.broadcast(legs_into(matrix)), "zone", "left")
        .join(placed, key, "left")
    )
    dispatch = F.coalesce("s_dispatch", F.col("d_dispatch").cast("double"))
    travel = F.coalesce("s_travel", (F.col("response_default") - F.col("d_dispatch")).cast("double")) * F.col("factor")
    df = df.withColumns({"dispatch": dispatch, "static_time": dispatch + travel}).withColumn("p", F.explode_outer("placed"))
    drive = staged_seconds(F.col("p"), F.col("z_lon"), F.col("z_lat"), F.col("legs"), F.col("factor"))
    kept = [key, "zone", "zone_ord", "borough", "svi_score", "predicted", "dispatch", "static_time"]
    df = df.select(*kept, drive.alias("drive")).groupBy(*kept).agg(F.min("drive").alias("best_drive"))
    staged_travel = F.coalesce(
        F.greatest("best_drive", F.lit(float(dim.TRAVEL_FLOOR_SECONDS))), F.col("static_time") - F.col("dispatch")
    )
    df = df.withColumn("staged_time", F.least(F.col("dispatch") + staged_travel, F.col("static_time")))
    return df.select(
        key, "zone", "zone_ord", "borough", "svi_score", F.col("predicted").alias("demand"), "static_time",
        "staged_time", F.greatest(F.lit(0.0), F.col("static_time") - F.col("staged_time")).alias("seconds_saved"),
    )


BANDS = ("Q1", "Q2", "Q3", "Q4")


def _zone_array() -> Column:
    """A scenario's zones (at most 31) in order of seconds saved, with what the measures need (grouped aggregate)."""
    return F.array_sort(F.collect_list(F.struct(
        F.col("seconds_saved").alias("saved"), rs.repeat_weight(F.col("demand")).cast("long").alias("copies"), F.col("demand").alias("demand"),
        rs.share_within(F.col("static_time")).alias("static"), rs.share_within(F.col("staged_time")).alias("staged"),
        F.col("borough").alias("borough"), rs.svi_band(F.col("svi_score")).alias("band"),
    )))


def _measures(zones: Column) -> dict[str, Column]:
    """Demand-weighted shares and the median in which a zone counts once per expected call, of an ordered zone array."""

    def total(of) -> Column:
        return F.aggregate(zones, F.lit(0.0), lambda acc, z: acc + of(z))

    demand = total(lambda z: z["demand"])
    scale = F.when(demand < 0.01, 1.0).otherwise(demand)
    copies = F.aggregate(zones, F.lit(0).cast("long"), lambda acc, z: acc + z["copies"])
    nothing = F.lit(None).cast("double")
    start = F.struct(F.lit(0).cast("long").alias("n"), nothing.alias("low"), nothing.alias("high"))

    def step(acc: Column, z: Column) -> Column:
        # the calls of the middle are number floor((n + 1) / 2) and floor(n / 2) + 1, counted from 1
        upto = acc["n"] + z["copies"]
        low = F.when(acc["low"].isNull() & (upto * 2 >= copies), z["saved"]).otherwise(acc["low"])
        high = F.when(acc["high"].isNull() & (upto * 2 > copies), z["saved"]).otherwise(acc["high"])
        return F.struct(upto.alias("n"), low.alias("low"), high.alias("high"))

    median = F.aggregate(zones, start, step, lambda acc: (acc["low"] + acc["high"]) / 2)
    return {
        "pct_static": total(lambda z: z["demand"] * z["static"]) / scale * 100,
        "pct_staged": total(lambda z: z["demand"] * z["staged"]) / scale * 100,
        "median_saved": median,
    }


def scenario_impact(zone_rows: DataFrame, key: str) -> DataFrame:
    """Demand-weighted shares and median per scenario (31 rows each)."""
    rows = zone_rows.groupBy(key).agg(_zone_array().alias("zones"))
    return rows.select(key, *[c.alias(n) for n, c in _measures(F.col("zones")).items()])


def grouped_impact(zone_rows: DataFrame, key: str) -> DataFrame:
    """Overall, per borough and per band: one exchange makes a scenario a row, its groups are parts of the row's array.

    Bands without any zone read 0.0; boroughs without zones do not appear.
    """
    rows = zone_rows.groupBy(key).agg(_zone_array().alias("zones"))

    def part(scope: str, name: str, field: str) -> Column:
        return F.struct(F.lit(scope).alias("scope"), F.lit(name).alias("name"), F.filter("zones", lambda z: z[field] == name).alias("part"))

    parts = F.array(
        F.struct(F.lit("overall").alias("scope"), F.lit("all").alias("name"), F.col("zones").alias("part")),
        *[part("borough", b, "borough") for b in dim.BOROUGH_NAMES],
        *[part("svi_quartile", q, "band") for q in BANDS],
    )
    out = rows.select(key, F.explode(parts).alias("p")).select(key, "p.scope", "p.name", "p.part").filter(
        (F.col("scope") == "svi_quartile") | (F.size("part") > 0)
    )
    figures = {"pct_static": "pct_static", "pct_staged": "pct_staged", "median_saved": "median_saved_sec"}
    made = _measures(F.col("part"))
    return out.select(
        key, "scope", "name",
        *[F.when(F.size("part") == 0, 0.0).otherwise(F.round(made[m], 1)).alias(n) for m, n in figures.items()],
    )


def zone_results(zone_rows: DataFrame, key: str) -> DataFrame:
    figures = ["static_time", "staged_time", "seconds_saved"]
    return zone_rows.select(key, "zone", *[F.round(c, 1).alias(c) for c in figures])


def response_histogram(zone_rows: DataFrame, *keys: str, bins: int = 15, top_minutes: float = 20.0) -> DataFrame:
    """Demand-weighted counts of before and after times in minute bins; bin 0 and
    ``bins`` + 1 hold what lies outside the view."""
    series = F.stack(F.lit(2), F.lit("static"), F.col("static_time"), F.lit("staged"), F.col("staged_time"))
    long = zone_rows.select(*keys, rs.repeat_weight(F.col("demand")).alias("copies"), series.alias("series", "seconds"))
    bucket = F.width_bucket(F.col("seconds") / 60, F.lit(0.0), F.lit(top_minutes), F.lit(bins))
    return long.groupBy(*keys, "series", bucket.alias("bin")).agg(F.sum("copies").cast("long").alias("n"))


def response_sample(zone_rows: DataFrame, key: str, cap: int = 50) -> DataFrame:
    """At most ``cap`` whole-second responses per scenario from the distribution in which a zone occurs once per
    expected call; repeatable.

    Calls are numbered through the zones of a scenario by running sums of their weights. The row picks ``cap`` numbers
    of all calls, one at a seeded place of each of ``cap`` equal stretches, and only these become rows.
    """
    zone = F.struct(
        "zone", rs.repeat_weight(F.col("demand")).cast("long").alias("copies"),
        F.bround("static_time").cast("int").alias("static_sec"), F.bround("staged_time").cast("int").alias("staged_sec"),
    )
    rows = zone_rows.groupBy(key).agg(F.array_sort(F.collect_list(zone)).alias("zones"))
    nothing = F.array().cast("array<struct<zone: string, copies: bigint, static_sec: int, staged_sec: int, first: bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("n"), nothing.alias("zones"))

    def add(acc: Column, z: Column) -> Column:
        named = F.struct(*[z[c].alias(c) for c in ("zone", "copies", "static_sec", "staged_sec")], (acc["n"] + 1).alias("first"))
        return F.struct((acc["n"] + z["copies"]).alias("n"), F.concat(acc["zones"], F.array(named)).alias("zones"))

    rows = rows.select(key, F.aggregate("zones", start, add).alias("s")).select(key, F.col("s.n").alias("n"), F.col("s.zones").alias("zones"))
    edge = lambda i: F.floor(F.col("n") * i / cap)

    def place(i: Column) -> Column:
        drawn = F.conv(F.substring(F.md5(F.concat_ws("#", F.col(key).cast("string"), i.cast("string"))), 1, 15), 16, 10)
        return F.pmod(drawn.cast("long"), F.greatest(edge(i + 1) - edge(i), F.lit(1)))

    some = F.transform(F.sequence(F.lit(0), F.lit(cap - 1)), lambda i: edge(i) + place(i) + 1)
    picks = F.when(F.col("n") <= cap, F.sequence(F.lit(1).cast("long"), F.col("n"))).otherwise(some)
    return rows.filter("n > 0").select(key, "zones", F.explode(picks).alias("call")).withColumn(
        "z", F.element_at(F.filter("zones", lambda z: z["first"] <= F.col("call")), -1)
    ).select(key, "z.zone", "z.static_sec", "z.staged_sec", (F.col("call") - F.col("z.first") + 1).cast("int").alias("copy"))


def staging_point_effect(points: DataFrame, zone_rows: DataFrame, key: str) -> DataFrame:
    """Mean before and after over a placed point's own zones, and the saving."""
    own = points.select(key, "staging_index", F.explode("cluster_zones").alias("zone"))
    return (
        own.join(zone_results(zone_rows, key), [key, "zone"])
        .groupBy(key, "staging_index")
        .agg(F.avg("static_time").alias("avg_static"), F.avg("staged_time").alias("avg_staged"))
        .withColumn("saved", F.col("avg_static") - F.col("avg_staged"))
        .withColumn("tier", rs.service_tier(F.col("avg_staged")))
    )


def zone_before_after(zones: DataFrame, zone_result: DataFrame, borough_saving: DataFrame, key: str) -> DataFrame:
    """Before/after of a zone: its own result, otherwise its mean response less
    the borough's median saving, never below zero.

    ``zones``: key, zone, borough, avg_response_seconds.
    """
    z = zone_result.select(key, "zone", "static_time", "staged_time")
    b = borough_saving.select(key, "borough", "median_saved_sec")
    df = zones.join(z, [key, "zone"], "left").join(b, [key, "borough"], "left")
    before = F.coalesce("static_time", "avg_response_seconds")
    after = F.when(
        F.col("staged_time").isNull(), F.greatest(F.lit(0.0), before - F.col("median_saved_sec"))
    ).otherwise(F.col("staged_time"))
    return df.select(
        key, "zone", "borough", before.alias("before"), after.alias("after"), rs.service_tier(after).alias("tier")
    )


def scoped_metrics(impact: DataFrame, chosen: DataFrame, key: str) -> DataFrame:
    """Figures of the chosen borough, or the overall ones where there is none.

    ``chosen``: key, selected (borough name or NULL).
    """
    cols = ["pct_static", "pct_staged", "median_saved_sec"]
    overall = impact.filter("scope = 'overall'").select(key, *[F.col(c).alias("o_" + c) for c in cols])
    borough = impact.filter("scope = 'borough'").select(key, F.col("name").alias("selected"), *cols)
    df = chosen.join(overall, key).join(borough, [key, "selected"], "left")
    return df.select(
        key,
        F.when(F.col("pct_static").isNull(), "CITYWIDE").otherwise(F.col("selected")).alias("scope"),
        *[F.coalesce(c, "o_" + c).alias(c) for c in cols],
    )
