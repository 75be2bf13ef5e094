"""Projections, filters, scalar functions and generators (P1-P25, F1-F13, G1-G4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dimensions as dim
from ..functions import calendar as cal
from ..functions import geo, text, weather
from ..functions import response as rs
from ..operators import clean, enrich, impact, scenarios
from . import query
from .sql import BAND, CODES, CYCLIC, FACTOR, MATCH, SCHOOL_FLAG, TIER, ZONE_LIST, drive, km, km2, share_within

ZONE = "INCIDENT_DISPATCH_AREA"
SECONDS = "INCIDENT_RESPONSE_SECONDS_QY"
ID = "CAD_INCIDENT_ID"


# ---- filters and predicates ---------------------------------------------------

@query("p01_quality_filter", "SELECT CAD_INCIDENT_ID, INCIDENT_DISPATCH_AREA, BOROUGH FROM x_accepted")
def quality_filter(t):
    return clean.quality_filter(t.raw).select(ID, "INCIDENT_DISPATCH_AREA", "BOROUGH")


@query("p02_zone_in_list", f"SELECT CAD_INCIDENT_ID, INCIDENT_DISPATCH_AREA FROM x_raw WHERE INCIDENT_DISPATCH_AREA IN {ZONE_LIST}")
def zone_in_list(t):
    return t.raw.filter(F.col(ZONE).isin(dim.ZONE_CODES)).select(ID, "INCIDENT_DISPATCH_AREA")


@query(
    "p03_response_range",
    """SELECT CAD_INCIDENT_ID, TRY_CAST(INCIDENT_RESPONSE_SECONDS_QY AS DOUBLE) AS seconds FROM x_raw
       WHERE TRY_CAST(INCIDENT_RESPONSE_SECONDS_QY AS DOUBLE) BETWEEN 1 AND 7200""",
)
def response_range(t):
    return t.raw.filter(clean.response_in_range(F.col(SECONDS))).select(ID, F.col(SECONDS).try_cast("double").alias("seconds"))


@query("p04_borough_matches_zone", f"SELECT CAD_INCIDENT_ID, INCIDENT_DISPATCH_AREA, BOROUGH FROM x_raw WHERE {MATCH}")
def borough_matches_zone(t):
    return t.raw.filter(clean.zone_matches_borough(F.col("BOROUGH"), F.col(ZONE))).select(
        ID, "INCIDENT_DISPATCH_AREA", "BOROUGH"
    )


@query(
    "p05_typed_projection",
    """SELECT CAD_INCIDENT_ID, INCIDENT_DISPATCH_AREA, BOROUGH, TRY_CAST(INCIDENT_RESPONSE_SECONDS_QY AS DOUBLE) AS response,
       round(TRY_CAST(INCIDENT_TRAVEL_TM_SECONDS_QY AS DOUBLE), 6) AS travel, round(TRY_CAST(DISPATCH_RESPONSE_SECONDS_QY AS DOUBLE), 6) AS dispatch,
       TRY_CAST(FINAL_SEVERITY_LEVEL_CODE AS INT) AS severity, HELD_INDICATOR, strftime(INCIDENT_DATETIME, '%Y-%m-%d %H:%M:%S') AS incident_dt
       FROM x_raw""",
)
def typed_projection(t):
    return clean.typed_projection(t.raw).select(
        ID, "INCIDENT_DISPATCH_AREA", "BOROUGH", F.col(SECONDS).alias("response"),
        F.round("INCIDENT_TRAVEL_TM_SECONDS_QY", 6).alias("travel"),
        F.round("DISPATCH_RESPONSE_SECONDS_QY", 6).alias("dispatch"),
        F.col("FINAL_SEVERITY_LEVEL_CODE").alias("severity"), "HELD_INDICATOR",
        F.date_format("incident_dt", "yyyy-MM-dd HH:mm:ss").alias("incident_dt"),
    )


@query(
    "p06_calendar_parts",
    """SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST((dayofweek(ts) + 6) % 7 AS INT) AS dayofweek,
       CAST(hour(ts) AS INT) AS hour, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS date_hour,
       CAST(CAST(ts AS DATE) AS VARCHAR) AS incident_date FROM events""",
)
def calendar_parts(t):
    df = cal.with_calendar(t.table("events"), "ts")
    return df.select(
        "event_id", "year", "month", "dayofweek", "hour",
        F.date_format("date_hour", "yyyy-MM-dd HH:mm:ss").alias("date_hour"),
        F.col("incident_date").cast("string").alias("incident_date"),
    )


@query("p07_flags", "SELECT CAD_INCIDENT_ID, is_weekend, is_high_acuity, is_held, is_covid_year FROM x_clean")
def flags(t):
    return t.cleaned.select(ID, "is_weekend", "is_high_acuity", "is_held", "is_covid_year")


@query(
    "p08_split_by_year",
    """SELECT o_orderkey, CAST(year(day) AS INT) AS year, CASE WHEN year(day) = 2023 THEN 'test' WHEN year(day) = 2020 THEN 'exclude'
       WHEN year(day) BETWEEN 2019 AND 2022 THEN 'train' ELSE 'exclude' END AS split FROM x_archive""",
)
def split_by_year(t):
    df = t.archive.select("o_orderkey", F.year("day").alias("year"))
    return df.withColumn("split", clean.split_by_year()(df))


@query("p08_split_by_date", "SELECT split, CAST(incident_date AS VARCHAR) AS day, count(*) AS n FROM x_clean GROUP BY ALL")
def split_by_date(t):
    return t.cleaned.groupBy("split", F.col("incident_date").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(
    "p09_cyclical",
    "SELECT CAD_INCIDENT_ID, " + ", ".join(
        f"round({e.split(' AS ')[0].strip()}, 6) + 0.0::DOUBLE AS {e.split(' AS ')[1].strip()}"
        for e in CYCLIC.format(h="hour", d="dayofweek", m="month").split(", ")
    ) + " FROM x_clean",
)
def cyclical(t):
    names = ["hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos"]
    return cal.with_cyclical(t.cleaned).select(ID, *[(F.round(n, 6) + 0.0).alias(n) for n in names])


@query("p10_severe_codes", f"SELECT event_id, k, CASE WHEN k IN {CODES} THEN 1 ELSE 0 END AS is_severe_weather FROM x_readings")
def severe_codes(t):
    return t.readings.select("event_id", "k", weather.severe_by_code(F.col("k")).alias("is_severe_weather"))


@query("p11_extreme_heat", "SELECT event_id, CASE WHEN value * 0.2 - 10 >= 35 THEN 1 ELSE 0 END AS is_extreme_heat FROM x_readings")
def extreme_heat(t):
    return t.readings.select("event_id", weather.extreme_heat(F.col("value") * 0.2 - 10).alias("is_extreme_heat"))


@query(
    "p12_fill_defaults",
    """SELECT CAD_INCIDENT_ID, round(temperature_2m, 4) AS temperature_2m, precipitation, windspeed_10m, weathercode, is_severe_weather,
       is_extreme_heat, is_heat_emergency FROM x_star""",
)
def fill_defaults(t):
    df = enrich.fill(enrich.join_weather(t.cleaned, t.weather), enrich.ENRICHMENT_DEFAULTS)
    return df.select(
        ID, F.round("temperature_2m", 4).alias("temperature_2m"), "precipitation", "windspeed_10m", "weathercode",
        "is_severe_weather", "is_extreme_heat", "is_heat_emergency",
    )


@query("p13_clip_negative", "SELECT event_id, round(greatest(value - 50, 0), 4) AS predicted FROM events")
def clip_negative(t):
    return t.table("events").select(
        "event_id", F.round(scenarios.clip_negative(F.col("value") - 50), 4).alias("predicted")
    )


@query("p14_travel_factor", f"SELECT request_id, round({FACTOR}, 6) AS factor FROM x_requests")
def travel_factor(t):
    f = weather.travel_factor(F.col("precipitation"), F.col("windspeed"))
    return t.requests.select("request_id", F.round(f, 6).alias("factor"))


@query("p15_svi_band", f"SELECT CAD_INCIDENT_ID, {BAND.format('svi_score')} AS band FROM x_clean_svi")
def svi_band(t):
    return enrich.join_vulnerability(t.cleaned).select(ID, rs.svi_band(F.col("svi_score")).alias("band"))


@query(
    "p16_vulnerability_label",
    """SELECT CAD_INCIDENT_ID, CASE WHEN svi_score >= 0.75 THEN 'Very High' WHEN svi_score >= 0.5 THEN 'High'
       WHEN svi_score >= 0.25 THEN 'Moderate' ELSE 'Low' END AS label FROM x_clean_svi""",
)
def vulnerability_label(t):
    return enrich.join_vulnerability(t.cleaned).select(ID, rs.vulnerability_label(F.col("svi_score")).alias("label"))


@query("p17_within_threshold", "SELECT CAD_INCIDENT_ID, CAST(INCIDENT_RESPONSE_SECONDS_QY <= 480 AS INT) AS within_8min FROM x_clean")
def within_threshold(t):
    return t.cleaned.select(ID, rs.within_threshold(F.col(SECONDS)).alias("within_8min"))


@query("p18_service_tier", f"SELECT CAD_INCIDENT_ID, {TIER.format('INCIDENT_RESPONSE_SECONDS_QY')} AS tier FROM x_clean")
def service_tier(t):
    return t.cleaned.select(ID, rs.service_tier(F.col(SECONDS)).alias("tier"))


@query(
    "p19_dispatch_split",
    """SELECT CAD_INCIDENT_ID, CAST(round_even(response_default * 0.38::DOUBLE, 0) AS INT) AS default_dispatch,
       response_default - CAST(round_even(response_default * 0.38::DOUBLE, 0) AS INT) AS default_travel,
       round(CASE WHEN INCIDENT_RESPONSE_SECONDS_QY > 0 THEN DISPATCH_RESPONSE_SECONDS_QY / INCIDENT_RESPONSE_SECONDS_QY * 100 ELSE 50.0 END, 4) AS dispatch_pct
       FROM x_clean JOIN x_zones ON zone = INCIDENT_DISPATCH_AREA""",
)
def dispatch_split(t):
    z = dim.zones(t.spark).select(F.col("zone").alias("INCIDENT_DISPATCH_AREA"), "response_default")
    d = rs.dispatch_default(F.col("response_default"))
    return t.cleaned.join(F.broadcast(z), "INCIDENT_DISPATCH_AREA").select(
        ID, d.alias("default_dispatch"), (F.col("response_default") - d).alias("default_travel"),
        F.round(rs.dispatch_pct(F.col("DISPATCH_RESPONSE_SECONDS_QY"), F.col(SECONDS)), 4).alias("dispatch_pct"),
    )


@query(
    "p20_observed_or_fixed",
    """SELECT CAD_INCIDENT_ID, CASE WHEN TRY_CAST(INCIDENT_RESPONSE_SECONDS_QY AS DOUBLE) BETWEEN 1 AND 7200
         THEN CAST(trunc(TRY_CAST(INCIDENT_RESPONSE_SECONDS_QY AS DOUBLE)) AS INT) ELSE coalesce(f.seconds, 9999) END AS baseline_drive_sec
       FROM x_raw LEFT JOIN x_fixed f ON f.dest = INCIDENT_DISPATCH_AREA""",
)
def observed_or_fixed(t):
    f = t.fixed_seconds.select(F.col("dest").alias("INCIDENT_DISPATCH_AREA"), "seconds")
    alt = F.coalesce("seconds", F.lit(dim.UNREACHABLE_SECONDS))
    return t.raw.join(F.broadcast(f), "INCIDENT_DISPATCH_AREA", "left").select(
        ID, rs.observed_or(F.col(SECONDS).try_cast("double"), alt).alias("baseline_drive_sec")
    )


@query(
    "p21_major_events",
    """SELECT event_id, event_type, event_borough, CAST(event_start AS VARCHAR) AS event_start, CAST(event_end AS VARCHAR) AS event_end FROM x_major""",
)
def major_events(t):
    return t.major_events.select(
        "event_id", "event_type", "event_borough", F.col("event_start").cast("string").alias("event_start"),
        F.col("event_end").cast("string").alias("event_end"),
    )


@query("p22_valid_requests", "SELECT * FROM x_valid")
def valid_requests(t):
    return scenarios.valid_requests(t.requests)


@query(
    "p22_rejected_requests",
    """SELECT request_id, concat_ws(',', CASE WHEN NOT coalesce(hour BETWEEN 0 AND 23, false) THEN 'hour' END,
       CASE WHEN NOT coalesce(ambulances BETWEEN 1 AND 10, false) THEN 'ambulances' END) AS rejected_for
       FROM x_checked WHERE NOT (hour BETWEEN 0 AND 23 AND ambulances BETWEEN 1 AND 10)""",
)
def rejected_requests(t):
    return scenarios.rejected_requests(t.requests).select("request_id", "rejected_for")


@query(
    "p23_weather_preset",
    """SELECT request_id, CASE WHEN precipitation > 5 THEN 'heavy' WHEN precipitation > 0 THEN 'light' ELSE 'none' END AS weather,
       CASE WHEN precipitation > 5 THEN 'Heavy Storm' WHEN precipitation > 0 THEN 'Light Rain' ELSE 'Clear' END AS weather_label FROM x_valid""",
)
def weather_preset(t):
    return scenarios.with_preset(scenarios.valid_requests(t.requests)).select("request_id", "weather", "weather_label")


@query(
    "p24_zone_before_after",
    f"""SELECT scenario_id, zone, borough, round(before, 2) AS before, round(after, 2) AS after, {TIER.format('after')} AS tier
        FROM (SELECT f.scenario_id, f.zone, f.borough, coalesce(w.static_time, s.avg_response_seconds) AS before,
                     CASE WHEN w.staged_time IS NULL THEN greatest(0, s.avg_response_seconds - b.median_saved_sec) ELSE w.staged_time END AS after
              FROM x_forecast f JOIN x_stats s ON s.INCIDENT_DISPATCH_AREA = f.zone
              LEFT JOIN (SELECT scenario_id, zone, round(static_time, 1) AS static_time, round(staged_time, 1) AS staged_time FROM x_zone_whatif) w
                ON w.scenario_id = f.scenario_id AND w.zone = f.zone
              LEFT JOIN x_impact_borough b ON b.scenario_id = f.scenario_id AND b.name = f.borough)""",
)
def zone_before_after(t):
    avg = t.stats.select(F.col("INCIDENT_DISPATCH_AREA").alias("zone"), "avg_response_seconds")
    zones = t.forecast.select("scenario_id", "zone", "borough").join(F.broadcast(avg), "zone")
    own = impact.zone_results(t.zone_whatif, "scenario_id")
    borough = impact.grouped_impact(t.zone_whatif, "scenario_id").filter("scope = 'borough'").select(
        "scenario_id", F.col("name").alias("borough"), "median_saved_sec"
    )
    out = impact.zone_before_after(zones, own, borough, "scenario_id")
    return out.withColumns({"before": F.round("before", 2), "after": F.round("after", 2)})


@query(
    "p25_scoped_metric",
    """SELECT o.scenario_id, CASE WHEN b.name IS NULL THEN 'CITYWIDE' ELSE b.name END AS scope, coalesce(b.pct_static, o.pct_static) AS pct_static,
         coalesce(b.pct_staged, o.pct_staged) AS pct_staged, coalesce(b.median_saved_sec, o.median_saved_sec) AS median_saved_sec
       FROM x_impact_overall o JOIN (SELECT scenario_id, CASE WHEN hour < 12 THEN 'QUEENS' END AS selected FROM x_scen) c USING (scenario_id)
       LEFT JOIN x_impact_borough b ON b.scenario_id = o.scenario_id AND b.name = c.selected""",
)
def scoped_metric(t):
    chosen = t.scenarios.select("scenario_id", F.when(F.col("hour") < 12, "QUEENS").alias("selected"))
    return impact.scoped_metrics(impact.grouped_impact(t.zone_whatif, "scenario_id"), chosen, "scenario_id")


# ---- scalar functions ---------------------------------------------------------

@query(
    "f01_strings",
    """SELECT c_custkey, left(c_name, 3) AS prefix, c_name LIKE '%9%' AS has_nine, lower(c_mktsegment) AS lower_segment, upper(c_name) AS upper_name,
       trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_') AS slug, c_mktsegment || ', ' || c_name AS joined FROM customer""",
)
def strings(t):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    return t.table("customer").select(
        "c_custkey", F.substring(name, 1, 3).alias("prefix"), name.like("%9%").alias("has_nine"),
        F.lower(seg).alias("lower_segment"), F.upper(name).alias("upper_name"),
        F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_")).alias("slug"),
        F.array_join(F.array(seg, name), ", ").alias("joined"),
    )


@query(
    "f02_dates",
    """SELECT o_orderkey, CAST(TRY_CAST(CASE WHEN o_totalprice > 490000 THEN 'TBD' ELSE CAST(day AS VARCHAR) END AS DATE) AS VARCHAR) AS parsed,
       CAST(year(day) AS INT) AS year, CAST(month(day) AS INT) AS month, CAST(CAST(date_trunc('month', day) AS DATE) AS VARCHAR) AS month_start,
       CAST(day + 1 AS VARCHAR) AS next_day FROM x_archive""",
)
def dates(t):
    raw = F.when(F.col("o_totalprice") > 490000, "TBD").otherwise(F.col("day").cast("string"))
    return t.archive.select(
        "o_orderkey", F.to_date(F.try_to_timestamp(raw)).cast("string").alias("parsed"),
        F.year("day").alias("year"), F.month("day").alias("month"),
        F.trunc("day", "month").cast("string").alias("month_start"),
        F.date_add("day", 1).cast("string").alias("next_day"),
    )


@query(
    "f03_math",
    """SELECT event_id, round(sin(value), 6) AS s, round(cos(value), 6) AS c, round(radians(value), 6) AS r, round(asin(value / 500), 6) AS a,
       round(atan2(value, 100), 6) AS a2, round(sqrt(value), 6) AS q, round(ln(value), 6) AS l, round(exp(-value / 100), 6) AS e,
       round(abs(value - 50), 6) AS ab, CAST(floor(value) AS BIGINT) AS fl, round(value, 1) AS ro, greatest(value, 50) AS mx, least(value, 50) AS mn
       FROM events""",
)
def math_functions(t):
    v = F.col("value")
    r = lambda c, n: F.round(c, 6).alias(n)
    return t.table("events").select(
        "event_id", r(F.sin(v), "s"), r(F.cos(v), "c"), r(F.radians(v), "r"), r(F.asin(v / 500), "a"),
        r(F.atan2(v, F.lit(100.0)), "a2"), r(F.sqrt(v), "q"), r(F.ln(v), "l"), r(F.exp(-v / 100), "e"),
        r(F.abs(v - 50), "ab"), F.floor(v).alias("fl"), F.round(v, 1).alias("ro"),
        F.greatest(v, F.lit(50.0)).alias("mx"), F.least(v, F.lit(50.0)).alias("mn"),
    )


@query(
    "f04_great_circle",
    f"""SELECT node_id, round({km('n.lon', 'n.lat', 'z.lon', 'z.lat')}, 6) AS km_asin, round({km2('n.lon', 'n.lat', 'z.lon', 'z.lat')}, 6) AS km_atan2
        FROM x_nodes n JOIN x_zones z ON z.zone = 'M3'""",
)
def great_circle(t):
    _, _, _, lon, lat, *_ = dim.ZONES[dim.ZONE_CODES.index("M3")]
    p = (F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat))
    return t.nodes.select(
        "node_id", F.round(geo.great_circle_km(*p), 6).alias("km_asin"),
        F.round(geo.great_circle_km_atan2(*p), 6).alias("km_atan2"),
    )


@query("f05_drive_seconds", f"SELECT node_id, {drive('n.lon', 'n.lat', 'z.lon', 'z.lat')} AS seconds FROM x_nodes n JOIN x_zones z ON z.zone = 'M3'")
def drive_seconds(t):
    _, _, _, lon, lat, *_ = dim.ZONES[dim.ZONE_CODES.index("M3")]
    return t.nodes.select(
        "node_id", geo.drive_seconds(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)).alias("seconds")
    )


@query(
    "f06_planar_distance",
    """SELECT node_id, round((n.lat - z.lat) * (n.lat - z.lat) + (n.lon - z.lon) * (n.lon - z.lon), 8) AS d2
       FROM x_nodes n JOIN x_zones z ON z.zone = 'M3'""",
)
def planar_distance(t):
    _, _, _, lon, lat, *_ = dim.ZONES[dim.ZONE_CODES.index("M3")]
    return t.nodes.select(
        "node_id", F.round(geo.planar_d2(F.col("lon"), F.col("lat"), F.lit(lon), F.lit(lat)), 8).alias("d2")
    )


@query("f07_lognormal_share", f"SELECT event_id, round({share_within('(20 * value - 100)')}, 4) AS share FROM events")
def lognormal_share(t):
    m = F.col("value") * 20 - 100
    return t.table("events").select("event_id", F.round(rs.share_within(m), 4).alias("share"))


@query(
    "f08_circle_ring",
    """SELECT station_id, i, round(lon + 3.5::DOUBLE / (111.32::DOUBLE * cos(lat * pi() / 180)) * sin(i / 64.0::DOUBLE * 2 * pi()), 6) AS v_lon,
       round(lat + 3.5::DOUBLE / 111.32::DOUBLE * cos(i / 64.0::DOUBLE * 2 * pi()), 6) AS v_lat
       FROM x_stations CROSS JOIN (SELECT unnest(range(65)) AS i)""",
)
def circle_ring(t):
    ring = geo.circle_ring(F.col("lon"), F.col("lat"), F.lit(float(dim.COVERAGE_RADIUS_M)))
    return t.stations.select("station_id", F.posexplode(ring).alias("i", "v")).select(
        "station_id", "i", F.round("v.lon", 6).alias("v_lon"), F.round("v.lat", 6).alias("v_lat")
    )


@query(
    "f08_degree_buffer",
    """SELECT station_id, i, round(s.lon + radius_deg::DOUBLE * cos(-(i / 128.0::DOUBLE) * 2 * pi()), 6) AS v_lon,
       round(s.lat + radius_deg::DOUBLE * sin(-(i / 128.0::DOUBLE) * 2 * pi()), 6) AS v_lat
       FROM x_stations s JOIN x_boroughs b ON b.borough = s.borough CROSS JOIN (SELECT unnest(range(129)) AS i)""",
)
def degree_buffer(t):
    b = dim.boroughs(t.spark).select("borough", "radius_deg")
    ring = geo.degree_buffer_ring(F.col("lon"), F.col("lat"), F.col("radius_deg"))
    return t.stations.join(F.broadcast(b), "borough").select("station_id", F.posexplode(ring).alias("i", "v")).select(
        "station_id", "i", F.round("v.lon", 6).alias("v_lon"), F.round("v.lat", 6).alias("v_lat")
    )


@query(
    "f09_arrays",
    """SELECT scenario_id, staging_index, array_to_string(cluster_zones, ',') AS zones, CAST(len(cluster_zones) AS INT) AS n,
       array_to_string(list_transform(range(24), lambda i: 0), ',') AS slots FROM x_centred""",
)
def arrays(t):
    return t.centred.select(
        "scenario_id", "staging_index", F.array_join(F.array_sort("cluster_zones"), ",").alias("zones"),
        F.size("cluster_zones").alias("n"), F.array_join(F.array_repeat(F.lit("0"), 24), ",").alias("slots"),
    )


_REPLY = """CASE WHEN turn % 2 = 1 THEN text || ' {"controls": {"hour": ' || CAST(conv_id % 24 AS VARCHAR) || ', "weather": "heavy"}}'
 WHEN turn % 4 = 2 THEN text || ' {"controls": {oops}}' ELSE text END"""


@query(
    "f10_control_block",
    f"""SELECT conv_id, turn, CASE WHEN ok THEN raw END AS controls, CASE WHEN ok THEN json_extract_string(CASE WHEN ok THEN raw ELSE '{{}}' END, '$.hour') END AS hour,
          trim(CASE WHEN ok THEN regexp_replace(reply, '(?i)\\{{"controls"\\s*:\\s*(\\{{[^}}]+\\}})\\}}', '', 'g') ELSE reply END) AS clean_reply
        FROM (SELECT *, raw <> '' AND json_valid(raw) AS ok
              FROM (SELECT conv_id, turn, reply, regexp_extract(reply, '(?i)\\{{"controls"\\s*:\\s*(\\{{[^}}]+\\}})\\}}', 1) AS raw
                    FROM (SELECT conv_id, turn, {_REPLY} AS reply FROM conversations)))""",
)
def control_block(t):
    """Replies with a control block, with a broken one, and with none."""
    block = F.concat(F.lit(' {"controls": {"hour": '), (F.col("conv_id") % 24).cast("string"), F.lit(', "weather": "heavy"}}'))
    reply = (
        F.when(F.col("turn") % 2 == 1, F.concat("text", block))
        .when(F.col("turn") % 4 == 2, F.concat("text", F.lit(' {"controls": {oops}}')))
        .otherwise(F.col("text"))
    )
    df = t.table("conversations").select("conv_id", "turn", reply.alias("reply"))
    controls = text.control_json(F.col("reply"))
    return df.select(
        "conv_id", "turn", controls.alias("controls"),
        F.from_json(controls, text.CONTROL_SCHEMA)["hour"].cast("string").alias("hour"),
        text.without_control(F.col("reply")).alias("clean_reply"),
    )


_DAYS = "list_value(" + ", ".join(f"'{d}'" for d in dim.DAY_NAMES) + ")"


@query(
    "f11_briefing",
    f"""WITH top AS (SELECT scenario_id, list('Zone ' || zone || ' (' || borough || '): ' || printf('%.1f', round(predicted, 1)) || ' calls/hr' ORDER BY predicted DESC, zone_ord) AS p
                 FROM x_forecast GROUP BY scenario_id)
        SELECT s.scenario_id, 'Time: ' || {_DAYS}[s.dow + 1] || ' ' || CAST(CASE WHEN s.hour % 12 = 0 THEN 12 ELSE s.hour % 12 END AS VARCHAR)
          || CASE WHEN s.hour < 12 THEN 'AM' ELSE 'PM' END || ' | Weather: ' || CASE WHEN s.precipitation > 5 THEN 'heavy' WHEN s.precipitation > 0 THEN 'light' ELSE 'none' END
          || ' | Ambulances: ' || CAST(s.ambulances AS VARCHAR) || chr(10) || 'Top predicted zones: ' || array_to_string(p[1:5], ', ') || chr(10)
          || 'Coverage without staging: ' || printf('%.1f', o.pct_static) || '% within 8 min' || chr(10) || 'Coverage WITH staging: ' || printf('%.1f', o.pct_staged)
          || '% within 8 min (' || printf('%.0f', round(o.median_saved_sec, 0)) || 's median saved)' AS briefing
        FROM x_scen s JOIN top t ON t.scenario_id = s.scenario_id JOIN x_impact_overall o ON o.scenario_id = s.scenario_id""",
)
def briefing(t):
    phrase = F.struct(
        (-F.col("predicted")).alias("o"), "zone_ord",
        text.zone_phrase(F.col("zone"), F.col("borough"), F.round("predicted", 1)).alias("p"),
    )
    top = scenarios.top_k_zones(t.forecast, ["scenario_id"], 10)
    top = top.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(phrase)), lambda x: x["p"]).alias("zones"))
    overall = impact.scenario_impact(t.zone_whatif, "scenario_id")
    overall = overall.select("scenario_id", *[F.round(c, 1).alias(c) for c in ("pct_static", "pct_staged", "median_saved")])
    df = t.scenarios.join(top, "scenario_id").join(overall, "scenario_id")
    return df.select(
        "scenario_id",
        text.briefing(
            F.col("hour"), F.col("dow"), weather.weather_preset(F.col("precipitation")), F.col("ambulances"),
            F.col("zones"), F.col("pct_static"), F.col("pct_staged"), F.round("median_saved", 0),
        ).alias("briefing"),
    )


@query(
    "f12_lookup_default",
    """SELECT CAD_INCIDENT_ID, coalesce(z.svi_score, 0.5::DOUBLE) AS svi_score, coalesce(z.borough, 'UNKNOWN') AS zone_borough
       FROM x_raw LEFT JOIN x_zones z ON z.zone = INCIDENT_DISPATCH_AREA""",
)
def lookup_default(t):
    z = dim.zones(t.spark).select(F.col("zone").alias("INCIDENT_DISPATCH_AREA"), "svi_score", "borough")
    return t.raw.select(ID, "INCIDENT_DISPATCH_AREA").join(F.broadcast(z), "INCIDENT_DISPATCH_AREA", "left").select(
        ID, F.coalesce("svi_score", F.lit(0.5)).alias("svi_score"),
        F.coalesce("borough", F.lit("UNKNOWN")).alias("zone_borough"),
    )


@query(
    "f13_heat_index",
    """SELECT event_id, round(-42.379::DOUBLE + 2.04901523::DOUBLE * f + 10.14333127::DOUBLE * k - 0.22475541::DOUBLE * f * k - 0.00683783::DOUBLE * f * f
       - 0.05481717::DOUBLE * k * k + 0.00122874::DOUBLE * f * f * k + 0.00085282::DOUBLE * f * k * k - 0.00000199::DOUBLE * f * f * k * k, 4) AS heat_index
       FROM (SELECT event_id, k, 80 + value / 20 AS f FROM x_readings)""",
)
def heat_index(t):
    f = 80 + F.col("value") / 20
    return t.readings.select("event_id", F.round(weather.heat_index_f(f, F.col("k")), 4).alias("heat_index"))


# ---- generators ---------------------------------------------------------------

@query("g01_event_days", "SELECT CAST(event_date AS VARCHAR) AS event_date, zone_prefix, is_major_event FROM x_event_days_all")
def event_days(t):
    days = enrich.event_days(t.major_events, "2024-01-31")
    return days.withColumn("event_date", F.col("event_date").cast("string"))


@query(
    "g02_school_calendar",
    f"""SELECT CAST(school_date AS VARCHAR) AS school_date, {SCHOOL_FLAG.format('school_date')} AS is_school_day
        FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS school_date
              FROM (SELECT CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi FROM x_archive))""",
)
def school_calendar(t):
    days = enrich.school_days(enrich.daily_calendar(t.archive, "day"))
    return days.withColumn("school_date", F.col("school_date").cast("string"))


@query(
    "g03_bin_grid",
    """SELECT CAST(g // 7 AS INT) AS hour, CAST(g % 7 AS INT) AS dayofweek, count(CAD_INCIDENT_ID) AS n
       FROM (SELECT unnest(range(168)) AS g) LEFT JOIN x_clean c ON c.hour = g // 7 AND c.dayofweek = g % 7 AND c.split = 'test' GROUP BY g""",
)
def bin_grid(t):
    counts = t.cleaned.filter("split = 'test'").groupBy("hour", "dayofweek").agg(F.count("*").alias("n"))
    grid = scenarios.hour_bins(t.spark)
    return grid.join(counts, ["hour", "dayofweek"], "left").fillna(0, subset=["n"])


@query(
    "g04_hour_sweep",
    """SELECT h AS hour, dow, month, zone, round(coalesce(zone_baseline_avg, 5.0::DOUBLE), 4) AS predicted, n
       FROM (SELECT CAST(h AS INT) AS h, dow, month, count(*) AS n FROM (SELECT unnest(range(hour, 24)) AS h, dow, month FROM x_valid) GROUP BY ALL) s CROSS JOIN x_zones z
       LEFT JOIN x_baselines b ON b.INCIDENT_DISPATCH_AREA = z.zone AND b.hour = s.h AND b.dayofweek = s.dow""",
)
def hour_sweep(t):
    swept = scenarios.sweep_to_midnight(scenarios.valid_requests(t.requests))
    steps = swept.groupBy("hour", "dow", "month").agg(F.count("*").alias("n"))
    steps = steps.withColumns({"temperature": F.lit(15.0), "precipitation": F.lit(0.0), "windspeed": F.lit(10.0)})
    df = scenarios.baseline_forecast(scenarios.expand(steps, t.baselines, t.stats))
    return df.select("hour", "dow", "month", "zone", F.round("predicted", 4).alias("predicted"), "n")
