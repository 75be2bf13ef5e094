"""Joins (J1-J20) and set operations (U1-U5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dimensions as dim
from ..operators import enrich, impact, model, quality, scenarios, travel
from . import query
from .sql import km, km2

ID = "CAD_INCIDENT_ID"


@query(
    "j01_weather_by_hour",
    """SELECT CAD_INCIDENT_ID, round(w.temperature_2m, 4) AS temperature_2m, CAST(w.weathercode AS VARCHAR) AS weathercode FROM x_clean c LEFT JOIN x_weather w ON w.date_hour = c.date_hour""",
)
def weather_by_hour(t):
    return enrich.join_weather(t.cleaned, t.weather).select(
        ID, F.round("temperature_2m", 4).alias("temperature_2m"), F.col("weathercode").cast("string").alias("weathercode")
    )


@query(
    "j02_holiday_by_date",
    "SELECT CAD_INCIDENT_ID, CAST(is_holiday AS VARCHAR) AS is_holiday FROM x_clean LEFT JOIN x_holidays ON holiday_date = CAST(date_hour AS DATE)",
)
def holiday_by_date(t):
    return enrich.join_holidays(t.cleaned, t.holidays).select(ID, F.col("is_holiday").cast("string").alias("is_holiday"))


@query(
    "j03_school_by_date",
    "SELECT CAD_INCIDENT_ID, CAST(is_school_day AS VARCHAR) AS is_school_day FROM x_clean LEFT JOIN x_school ON school_date = CAST(date_hour AS DATE)",
)
def school_by_date(t):
    return enrich.join_school(t.cleaned, t.school).select(ID, F.col("is_school_day").cast("string").alias("is_school_day"))


@query(
    "j04_events_by_date_prefix",
    """SELECT CAD_INCIDENT_ID, CAST(is_major_event AS VARCHAR) AS is_major_event FROM x_clean LEFT JOIN x_event_days
       ON event_date = CAST(date_hour AS DATE) AND zone_prefix = left(INCIDENT_DISPATCH_AREA, 1)""",
)
def events_by_date_prefix(t):
    return enrich.join_event_days(t.cleaned, t.event_days).select(ID, F.col("is_major_event").cast("string").alias("is_major_event"))


@query(
    "j05_transit_by_month",
    """SELECT o_orderkey, round(subway_disruption_idx, 6) AS subway_disruption_idx FROM x_archive
       LEFT JOIN x_transit t ON t.year = year(day) AND t.month_num = month(day)""",
)
def transit_by_month(t):
    facts = t.archive.select("o_orderkey", F.col("day").alias("date_hour"))
    out = enrich.join_transit(facts, t.transit)
    return out.select("o_orderkey", F.round("subway_disruption_idx", 6).alias("subway_disruption_idx"))


_STAR = "temperature_2m precipitation windspeed_10m weathercode is_severe_weather is_extreme_heat is_heat_emergency is_holiday is_school_day is_major_event subway_disruption_idx".split()


@query(
    "j06_star_enrichment",
    "SELECT CAD_INCIDENT_ID, " + ", ".join(
        f"round({c}, 6) AS {c}" if c in ("temperature_2m", "subway_disruption_idx") else c for c in _STAR
    ) + " FROM x_star",
)
def star_enrichment(t):
    star = enrich.star_enrich(t.cleaned, t.weather, t.holidays, t.school, t.event_days, t.transit)
    return star.select(ID, *_STAR).withColumns(
        {c: F.round(c, 6) for c in ("temperature_2m", "subway_disruption_idx")}
    )


@query("j07_vulnerability_by_zone", "SELECT CAD_INCIDENT_ID, svi_score FROM x_clean_svi")
def vulnerability_by_zone(t):
    return enrich.join_vulnerability(t.cleaned).select(ID, "svi_score")


@query(
    "j08_feature_assembly",
    """SELECT INCIDENT_DISPATCH_AREA, dayofweek, hour, split, incident_count, round(zone_baseline_avg, 6) AS zone_baseline_avg,
       round(high_acuity_ratio, 6) AS high_acuity_ratio, round(held_ratio, 6) AS held_ratio FROM x_frame""",
)
def feature_assembly(t):
    r = [F.round(c, 6).alias(c) for c in ("zone_baseline_avg", "high_acuity_ratio", "held_ratio")]
    frame = model.training_frame(t.bins, t.baselines, t.stats)
    return frame.select("INCIDENT_DISPATCH_AREA", "dayofweek", "hour", "split", "incident_count", *r)


@query("j09_drive_matrix", "SELECT * FROM x_station_matrix UNION ALL SELECT * FROM x_zone_matrix")
def drive_matrix(t):
    origins = travel.zone_origins(t.spark).unionByName(travel.station_origins(t.stations))
    return travel.estimated_matrix(origins)


@query(
    "j10_scenario_zone_expansion",
    """SELECT scenario_id, zone, borough, round(zone_baseline_avg, 6) AS zone_baseline_avg, round(svi_score, 4) AS svi_score,
       round(high_acuity_ratio, 6) AS high_acuity_ratio, round(held_ratio, 6) AS held_ratio, is_weekend, is_severe_weather, is_extreme_heat,
       round(hour_sin, 6) + 0.0::DOUBLE AS hour_sin, round(month_cos, 6) + 0.0::DOUBLE AS month_cos FROM x_forecast""",
)
def scenario_zone_expansion(t):
    df = scenarios.expand(t.scenarios, t.baselines, t.stats)
    r = {c: 6 for c in ("zone_baseline_avg", "high_acuity_ratio", "held_ratio", "hour_sin", "month_cos")} | {"svi_score": 4}
    return df.select(
        "scenario_id", "zone", "borough", *[(F.round(c, d) + 0.0).alias(c) for c, d in r.items()], "is_weekend",
        "is_severe_weather", "is_extreme_heat",
    )


@query("j11_nearest_station", "SELECT * FROM x_fixed")
def nearest_station(t):
    return t.fixed_seconds


@query(
    "j12_nearest_staged",
    """SELECT b.hour, b.dow AS dayofweek, z.zone, coalesce(s.seconds, 9999) AS seconds FROM x_bin_scen b CROSS JOIN x_zones z
       LEFT JOIN x_staged s ON s.hour = b.hour AND s.dayofweek = b.dow AND s.zone = z.zone""",
)
def nearest_staged(t):
    return t.staged_seconds(t.top_staging)


@query("j13_staged_drive_borrowed", "SELECT scenario_id, zone, round(best_drive, 3) AS best_drive FROM x_drives")
def staged_drive_borrowed(t):
    from ..functions.weather import travel_factor

    f = t.scenarios.select("scenario_id", travel_factor(F.col("precipitation"), F.col("windspeed")).alias("factor"))
    points = t.centred.select("scenario_id", "lon", "lat").join(f, "scenario_id")
    out = travel.staged_drive(points, t.zone_matrix, ["scenario_id"], "factor")
    return out.withColumn("best_drive", F.round("best_drive", 3))


_D2 = "(z.lat - p.lat) * (z.lat - p.lat) + (z.lon - p.lon) * (z.lon - p.lon)"


@query(
    "j14_snap_to_zone",
    f"""SELECT a.scenario_id, a.staging_index, a.nearest_zone, o.own_zone
        FROM (SELECT scenario_id, staging_index, arg_min(z.zone, ({_D2}, z.zone_ord)) AS nearest_zone FROM x_centred p CROSS JOIN x_zones z GROUP BY ALL) a
        JOIN (SELECT scenario_id, staging_index, arg_min(z.zone, ({_D2}, z.zone_ord)) AS own_zone FROM x_centred p JOIN x_zones z ON list_contains(cluster_zones, z.zone) GROUP BY ALL) o
          ON o.scenario_id = a.scenario_id AND o.staging_index = a.staging_index""",
)
def snap_to_zone(t):
    own = travel.snap_to_zone(t.centred, own_cluster=True).withColumnRenamed("nearest_zone", "own_zone")
    return travel.snap_to_zone(own).select("scenario_id", "staging_index", "nearest_zone", "own_zone")


@query(
    "j15_nearest_node",
    f"""SELECT station_id AS point_id, arg_min(node_id, (m, node_id)) AS node_id, round(min(m), 3) AS metres, CAST(min(m) > 500 AS INT) AS is_far
        FROM (SELECT station_id, node_id, {km('s.lon', 's.lat', 'n.lon', 'n.lat')} * 1000 AS m FROM x_stations s CROSS JOIN x_nodes n) GROUP BY station_id""",
)
def nearest_node(t):
    points = t.stations.select(F.col("station_id").alias("point_id"), "lon", "lat")
    return travel.nearest_node(points, t.nodes).withColumn("metres", F.round("metres", 3))


@query(
    "j16_sessions_interval",
    """SELECT o_orderkey, CAST(day AS VARCHAR) AS day, CAST(session_start AS VARCHAR) AS session_start FROM x_archive JOIN x_sessions ON day BETWEEN session_start AND session_end""",
)
def sessions_interval(t):
    df = enrich.in_session(t.archive.select("o_orderkey", "day"), "day")
    return df.select("o_orderkey", F.col("day").cast("string").alias("day"), F.col("session_start").cast("string").alias("session_start"))


@query("j17_drop_closures", "SELECT o_orderkey, CAST(day AS VARCHAR) AS day FROM x_archive WHERE day NOT IN (SELECT closed FROM x_closures)")
def drop_closures(t):
    df = enrich.drop_closures(t.archive.select("o_orderkey", "day"), "day")
    return df.select("o_orderkey", F.col("day").cast("string").alias("day"))


_AREAS = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN '' ELSE CAST(10001 + c_custkey % 1700 AS VARCHAR) END AS zipcode,
 CASE WHEN c_custkey % 3 <> 2 THEN CAST(10001 + c_custkey % 1700 AS VARCHAR) END AS postal_code FROM customer"""


def _areas(t):
    zip_text = (F.col("c_custkey") % 1700 + 10001).cast("string")
    m = F.col("c_custkey") % 3
    return t.table("customer").select(
        "c_custkey", F.when(m == 0, None).when(m == 1, "").otherwise(zip_text).alias("zipcode"),
        F.when(m != 2, zip_text).alias("postal_code"),
    )


@query(
    "j18_zip_zone_score",
    f"""SELECT a.c_custkey, zip, zone, round(s.avg_response_seconds, 6) AS avg_response_seconds FROM (SELECT *, coalesce(nullif(trim(zipcode), ''), postal_code) AS zip FROM ({_AREAS})) a
        JOIN x_zip_zone USING (zip) JOIN x_stats s ON s.INCIDENT_DISPATCH_AREA = zone""",
)
def zip_zone_score(t):
    scores = t.stats.select(
        F.col("INCIDENT_DISPATCH_AREA").alias("zone"), F.round("avg_response_seconds", 6).alias("avg_response_seconds")
    )
    out = travel.zips_with_scores(_areas(t), F.broadcast(scores), "zipcode", "postal_code")
    return out.select("c_custkey", "zip", "zone", "avg_response_seconds")


@query(
    "j18_zip_zone_svi",
    f"""SELECT a.c_custkey, zip, zone, svi_score FROM (SELECT *, coalesce(nullif(trim(zipcode), ''), postal_code) AS zip FROM ({_AREAS})) a
        JOIN x_zip_zone USING (zip) JOIN x_zones USING (zone)""",
)
def zip_zone_svi(t):
    return travel.zips_with_svi(_areas(t), "zipcode", "postal_code").select("c_custkey", "zip", "zone", "svi_score")


@query(
    "j19_centroid_weights",
    """SELECT z.zone, z.lon, z.lat, coalesce(n, 0)::DOUBLE AS weight FROM x_zones z
       LEFT JOIN (SELECT INCIDENT_DISPATCH_AREA, sum(is_held)::DOUBLE AS n FROM x_clean GROUP BY ALL) c ON c.INCIDENT_DISPATCH_AREA = z.zone""",
)
def centroid_weights(t):
    held = t.cleaned.groupBy(F.col("INCIDENT_DISPATCH_AREA").alias("zone")).agg(
        F.sum("is_held").cast("double").alias("n")
    )
    return travel.centroid_weights(held, "n")


@query(
    "j20_bin_join",
    """SELECT CAD_INCIDENT_ID, a.hour, a.dayofweek, svi_quartile FROM x_acute a JOIN (SELECT DISTINCT hour, dow AS dayofweek FROM x_valid) USING (hour, dayofweek)""",
)
def bin_join(t):
    """Facts of the (hour, weekday) bins somebody asked for."""
    asked = scenarios.valid_requests(t.requests)
    bins = asked.select("hour", F.col("dow").alias("dayofweek")).distinct()
    return impact.bin_facts(t.acute, bins).select(ID, "hour", "dayofweek", "svi_quartile")


# ---- set operations -----------------------------------------------------------

@query(
    "u01_holiday_union",
    """SELECT CAST(holiday_date AS VARCHAR) AS holiday_date, count(o_orderkey) AS n FROM x_holidays LEFT JOIN x_archive ON day = holiday_date GROUP BY ALL""",
)
def holiday_union(t):
    """Union of both holiday lists, with the records on each date."""
    per_day = t.archive.groupBy(F.col("day").alias("holiday_date")).agg(F.count("*").alias("n"))
    out = t.holidays.join(per_day, "holiday_date", "left")
    return out.select(F.col("holiday_date").cast("string").alias("holiday_date"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("u02_bag_union", "SELECT month, count, line, day_type FROM x_transit_feed")
def bag_union(t):
    return t.transit_feed.select("month", "count", "line", "day_type")


@query(
    "u03_distinct_event_days",
    "SELECT DISTINCT CAST(event_start AS VARCHAR) AS event_date, prefix AS zone_prefix FROM x_major JOIN x_boroughs ON feed_name = event_borough",
)
def distinct_event_days(t):
    b = dim.boroughs(t.spark).select(F.col("feed_name").alias("event_borough"), F.col("prefix").alias("zone_prefix"))
    df = t.major_events.join(F.broadcast(b), "event_borough")
    return df.select(F.col("event_start").cast("string").alias("event_date"), "zone_prefix").dropDuplicates(
        ["event_date", "zone_prefix"]
    )


@query(
    "u04_missing_zones",
    """SELECT zone AS INCIDENT_DISPATCH_AREA, CAST(g // 7 AS INT) AS hour, CAST(g % 7 AS INT) AS dayofweek FROM x_zones CROSS JOIN (SELECT unnest(range(168)) AS g)
       EXCEPT SELECT INCIDENT_DISPATCH_AREA, hour, dayofweek FROM x_clean""",
)
def missing_zones(t):
    """Hours of the week in which a zone never had an incident."""
    bins = scenarios.hour_bins(t.spark)
    expected = quality.zone_keys(t.spark, "INCIDENT_DISPATCH_AREA").join(F.broadcast(bins), F.lit(True))
    return quality.missing_keys(expected, t.cleaned, "INCIDENT_DISPATCH_AREA", "hour", "dayofweek")


@query(
    "u05_key_sets",
    """SELECT 'raw zones: contains all expected' AS check_name, l = 0 AS passed, 'value=' || CAST(l AS VARCHAR) AS detail FROM (
         SELECT (SELECT count(*) FROM (SELECT zone FROM x_zones EXCEPT SELECT INCIDENT_DISPATCH_AREA FROM x_raw)) AS l)
       UNION ALL SELECT 'raw zones: equals expected', l + s = 0, 'value=' || CAST(l + s AS VARCHAR) FROM (
         SELECT (SELECT count(*) FROM (SELECT zone FROM x_zones EXCEPT SELECT INCIDENT_DISPATCH_AREA FROM x_raw)) AS l,
                (SELECT count(*) FROM (SELECT INCIDENT_DISPATCH_AREA FROM x_raw EXCEPT SELECT zone FROM x_zones)) AS s)""",
)
def key_sets(t):
    expected = quality.zone_keys(t.spark, "INCIDENT_DISPATCH_AREA")
    return quality.key_sets(expected, t.raw, "INCIDENT_DISPATCH_AREA", "raw zones")
