"""DuckDB statements of the bound inputs, as common table expressions.

``oracle(select)`` prepends every ``x_...`` expression that the select uses,
directly or through another one.
"""

from __future__ import annotations

import re

from .. import dimensions as dim
from ..operators.enrich import ENRICHMENT_DEFAULTS


def _values(rows) -> str:
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _pick(values, index) -> str:
    return "list_value(" + ", ".join(f"'{v}'" for v in values) + f")[({index}) + 1]"


CODES = "(" + ", ".join(str(c) for c in dim.SEVERE_WEATHER_CODES) + ")"
KINDS = "(" + ", ".join(f"'{k}'" for k in dim.MAJOR_EVENT_TYPES) + ")"
ZONE_LIST = "(" + ", ".join(f"'{z}'" for z in dim.ZONE_CODES) + ")"


def hav(lon1, lat1, lon2, lat2) -> str:
    return (
        f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )


def km(*p) -> str:
    return f"(12742.0::DOUBLE * asin(sqrt({hav(*p)})))"


def km2(*p) -> str:
    return f"(12742.0::DOUBLE * atan2(sqrt({hav(*p)}), sqrt(1 - {hav(*p)})))"


def drive(*p) -> str:
    return f"CAST(trunc({km(*p)} * 1.35::DOUBLE / 25 * 3600) AS INT)"


def share_within(m: str) -> str:
    """Lognormal share under 480 s with the same rational erf as the engine."""
    sigma = "sqrt(ln(1 + 0.95::DOUBLE * 0.95::DOUBLE))"
    z = f"((ln(480::DOUBLE) - (ln({m}) - {sigma} * {sigma} / 2)) / {sigma} / sqrt(2::DOUBLE))"
    t = f"(1 / (1 + 0.3275911::DOUBLE * abs({z})))"
    poly = (
        f"{t} * (0.254829592::DOUBLE + {t} * (-0.284496736::DOUBLE + {t} * (1.421413741::DOUBLE + {t} * "
        f"(-1.453152027::DOUBLE + {t} * 1.061405429::DOUBLE))))"
    )
    y = f"(1 - {poly} * exp(-(abs({z}) * abs({z}))))"
    return f"CASE WHEN {m} <= 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE * (1 + CASE WHEN {z} < 0 THEN -{y} ELSE {y} END) END"


BAND = "CASE WHEN {0} <= 0.25 THEN 'Q1' WHEN {0} <= 0.5 THEN 'Q2' WHEN {0} <= 0.75 THEN 'Q3' ELSE 'Q4' END"
TIER = "CASE WHEN {0} <= 480 THEN 'good' WHEN {0} <= 600 THEN 'fair' ELSE 'poor' END"
FACTOR = "(1.0::DOUBLE + 0.012::DOUBLE * precipitation + 0.002::DOUBLE * greatest(0.0::DOUBLE, windspeed - 15))"
COPIES = "greatest(1, CAST(round_even(demand, 0) AS INT))"
CYCLIC = (
    "sin(2 * pi() * {h} / 24) AS hour_sin, cos(2 * pi() * {h} / 24) AS hour_cos, "
    "sin(2 * pi() * {d} / 7) AS dow_sin, cos(2 * pi() * {d} / 7) AS dow_cos, "
    "sin(2 * pi() * {m} / 12) AS month_sin, cos(2 * pi() * {m} / 12) AS month_cos"
)

CTES: dict[str, str] = {}

CTES["x_zones"] = f"""
SELECT zone_ord, zone, borough, zone_name, lon::DOUBLE AS lon, lat::DOUBLE AS lat, svi::DOUBLE AS svi_score, svi_label,
       acuity::DOUBLE AS acuity_default, held::DOUBLE AS held_default, response AS response_default
FROM (VALUES {_values([(i, *z) for i, z in enumerate(dim.ZONES)])})
     AS t(zone_ord, zone, borough, zone_name, lon, lat, svi, svi_label, acuity, held, response)"""

CTES["x_boroughs"] = f"""
SELECT * FROM (VALUES {_values([(i, *b) for i, b in enumerate(dim.BOROUGHS)])})
     AS t(borough_ord, prefix, borough, feed_name, radius_deg)"""

CTES["x_readings"] = "SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events"

CTES["x_raw"] = """
SELECT CAST(event_id AS VARCHAR) AS CAD_INCIDENT_ID,
       CASE WHEN k <> 96 THEN ts END AS INCIDENT_DATETIME,
       CASE WHEN k = 10 THEN 'Z9' ELSE z.zone END AS INCIDENT_DISPATCH_AREA,
       CASE WHEN k = 7 THEN 'UNKNOWN' WHEN k = 8 THEN NULL WHEN k = 9 THEN 'QUEENS' ELSE z.borough END AS BOROUGH,
       CASE WHEN k = 99 THEN 'N/A' WHEN k = 98 THEN '7201' WHEN k = 97 THEN '0' WHEN k = 95 THEN '7200'
            WHEN k = 94 THEN '1' ELSE CAST(round(120 + 9 * value, 2) AS VARCHAR) END AS INCIDENT_RESPONSE_SECONDS_QY,
       CAST(round(120 + 9 * value, 2) * 0.62 AS VARCHAR) AS INCIDENT_TRAVEL_TM_SECONDS_QY,
       CAST(round(120 + 9 * value, 2) * 0.38 AS VARCHAR) AS DISPATCH_RESPONSE_SECONDS_QY,
       CAST(k % 8 + 1 AS VARCHAR) AS FINAL_SEVERITY_LEVEL_CODE,
       CASE WHEN event_type = 'error' THEN 'Y' ELSE 'N' END AS HELD_INDICATOR,
       CASE WHEN k < 3 THEN 'N' ELSE 'Y' END AS VALID_INCIDENT_RSPNS_TIME_INDC,
       CASE WHEN k = 3 THEN 'N' ELSE 'Y' END AS VALID_DISPATCH_RSPNS_TIME_INDC,
       CASE WHEN k = 4 THEN 'Y' ELSE 'N' END AS REOPEN_INDICATOR,
       CASE WHEN k = 5 THEN 'Y' ELSE 'N' END AS TRANSFER_INDICATOR,
       CASE WHEN k = 6 THEN 'Y' ELSE 'N' END AS STANDBY_INDICATOR
FROM x_readings JOIN x_zones z ON z.zone_ord = event_id % 31"""

# the five flags of an accepted record, in the order of the schema
_FLAGS = {
    "VALID_INCIDENT_RSPNS_TIME_INDC": "Y", "VALID_DISPATCH_RSPNS_TIME_INDC": "Y", "REOPEN_INDICATOR": "N", "TRANSFER_INDICATOR": "N",
    "STANDBY_INDICATOR": "N",
}
_SECONDS = ["INCIDENT_RESPONSE_SECONDS_QY", "INCIDENT_TRAVEL_TM_SECONDS_QY", "DISPATCH_RESPONSE_SECONDS_QY"]

# a record's borough is that of the zone's first letter, whatever the spelling of Staten Island
MATCH = "coalesce(" + " OR ".join(
    f"(left(INCIDENT_DISPATCH_AREA, 1) = '{prefix}' AND " + ("contains(BOROUGH, 'STATEN'))" if "STATEN" in name else f"BOROUGH = '{name}')")
    for prefix, name, *_ in dim.BOROUGHS
) + ", false)"

CTES["x_accepted"] = f"""
SELECT r.* FROM x_raw r SEMI JOIN x_zones z ON z.zone = r.INCIDENT_DISPATCH_AREA
WHERE {MATCH} AND ({', '.join(_FLAGS)}) = ({', '.join(f"'{v}'" for v in _FLAGS.values())})
  AND INCIDENT_DATETIME IS NOT NULL AND TRY_CAST({_SECONDS[0]} AS DOUBLE) BETWEEN 1 AND 7200"""

_CALENDAR = {"year": "year(t)", "month": "month(t)", "dayofweek": "isodow(t) - 1", "hour": "hour(t)"}
_TRUTHS = {
    "is_weekend": "dayofweek >= 5", "is_high_acuity": "FINAL_SEVERITY_LEVEL_CODE <= 2", "is_held": "HELD_INDICATOR = 'Y'",
    "is_covid_year": "year = 2020",
}
CTES["x_typed"] = f"""
SELECT CAD_INCIDENT_ID, INCIDENT_DISPATCH_AREA, BOROUGH, HELD_INDICATOR, INCIDENT_DATETIME AS t,
       CAST(FINAL_SEVERITY_LEVEL_CODE AS INT) AS FINAL_SEVERITY_LEVEL_CODE, {', '.join(f'TRY_CAST({c} AS DOUBLE) AS {c}' for c in _SECONDS)}
FROM x_accepted"""

CTES["x_dated"] = f"""
SELECT * RENAME (t AS incident_dt), {', '.join(f'CAST({e} AS INT) AS {c}' for c, e in _CALENDAR.items())},
       time_bucket(INTERVAL 1 HOUR, t) AS date_hour, CAST(t AS DATE) AS incident_date
FROM x_typed"""

# days of January 2024: 20 to learn from, 11 to test on
CTES["x_clean"] = f"""
SELECT *, {', '.join(f'CAST({e} AS INT) AS {c}' for c, e in _TRUTHS.items())},
       CASE WHEN date_trunc('month', incident_date) <> DATE '2024-01-01' THEN 'exclude' WHEN day(incident_date) <= 20 THEN 'train' ELSE 'test' END AS split
FROM x_dated"""

CTES["x_archive"] = f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_totalprice,
       CAST(o_orderdate + INTERVAL 276 MONTH AS DATE) AS day, z.zone AS INCIDENT_DISPATCH_AREA
FROM orders JOIN x_zones z ON z.zone_ord = o_custkey % 31"""

CTES["x_weather_raw"] = """
SELECT date_trunc('hour', ts) AS date_hour, max(value) * 0.2 - 10 AS temperature_2m, min(value) AS precipitation,
       CAST(max(k) - min(k) AS DOUBLE) AS windspeed_10m, max(k) AS weathercode
FROM x_readings GROUP BY 1"""

CTES["x_weather"] = f"""
SELECT *, CASE WHEN weathercode IN {CODES} THEN 1 ELSE 0 END AS is_severe_weather,
       CASE WHEN temperature_2m >= 35 THEN 1 ELSE 0 END AS is_extreme_heat,
       CASE WHEN temperature_2m >= 35 OR max(temperature_2m) OVER (ORDER BY date_hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) >= 32.2
            THEN 1 ELSE 0 END AS is_heat_emergency
FROM x_weather_raw"""

CTES["x_holidays"] = f"""
SELECT DISTINCT CAST(d AS DATE) AS holiday_date, 1 AS is_holiday
FROM (VALUES {_values([(d,) for d in dim.FEDERAL_HOLIDAYS + dim.CITY_HOLIDAYS + dim.HOLIDAYS_EXTRA_2024])}) AS t(d)"""

CTES["x_sessions"] = f"""
SELECT CAST(s AS DATE) AS session_start, CAST(e AS DATE) AS session_end FROM (VALUES {_values(dim.SCHOOL_SESSIONS)}) AS t(s, e)"""

CTES["x_closures"] = f"""
SELECT CAST(d AS DATE) AS closed FROM (VALUES {_values([(d,) for d in dim.SCHOOL_CLOSURES])}) AS t(d)"""

SCHOOL_FLAG = """CAST((isodow({0}) <= 5 AND {0} NOT IN (SELECT closed FROM x_closures)
 AND EXISTS (SELECT 1 FROM x_sessions WHERE {0} BETWEEN session_start AND session_end)) AS INT)"""

CTES["x_school"] = f"""
SELECT school_date, {SCHOOL_FLAG.format('school_date')} AS is_school_day
FROM (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS school_date
      FROM (SELECT CAST(min(incident_date) AS TIMESTAMP) AS lo, CAST(max(incident_date) AS TIMESTAMP) AS hi FROM x_clean))"""

CTES["x_permits"] = f"""
SELECT o_orderkey AS event_id, CASE WHEN o_totalprice > 490000 THEN 'TBD' ELSE CAST(day AS VARCHAR) END AS start_date_time,
       CAST(day + CAST(CASE WHEN o_custkey % 7 = 6 THEN -1 ELSE o_custkey % 4 END AS INT) AS VARCHAR) AS end_date_time,
       {_pick(["Special Event", "Parade", "Construction", "Street Fair", "Film"], "CAST(substr(o_orderpriority, 1, 1) AS INT) - 1")} AS event_type,
       {_pick(["Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island", "Citywide"], "o_custkey % 6")} AS event_borough
FROM x_archive"""

CTES["x_major"] = f"""
SELECT *, TRY_CAST(start_date_time AS DATE) AS event_start, TRY_CAST(end_date_time AS DATE) AS event_end
FROM x_permits
WHERE event_type IN {KINDS} AND TRY_CAST(start_date_time AS DATE) BETWEEN DATE '2019-01-01' AND DATE '2024-01-31'
  AND TRY_CAST(end_date_time AS DATE) IS NOT NULL AND event_borough IS NOT NULL"""

CTES["x_event_days_all"] = """
SELECT DISTINCT CAST(d AS DATE) AS event_date, prefix AS zone_prefix, 1 AS is_major_event
FROM (SELECT prefix, unnest(generate_series(CAST(event_start AS TIMESTAMP), CAST(least(event_end, DATE '2024-01-31') AS TIMESTAMP), INTERVAL 1 DAY)) AS d
      FROM x_major JOIN x_boroughs ON feed_name = event_borough WHERE event_start <= least(event_end, DATE '2024-01-31'))"""

CTES["x_event_days"] = "SELECT * FROM x_event_days_all"

CTES["x_transit_feed"] = """
SELECT strftime(l_shipdate + INTERVAL 276 MONTH, '%Y-%m-01') AS month,
       CASE WHEN l_linenumber = 7 THEN 'n/a' ELSE CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS count,
       CASE WHEN strftime(l_shipdate + INTERVAL 276 MONTH, '%Y-%m-01') < '2020-01-01' THEN l_returnflag END AS line,
       CASE WHEN strftime(l_shipdate + INTERVAL 276 MONTH, '%Y-%m-01') >= '2020-01-01' THEN l_linestatus END AS day_type
FROM lineitem"""

CTES["x_transit_sums"] = """
SELECT CAST(year(CAST(month AS DATE)) AS INT) AS year, CAST(month(CAST(month AS DATE)) AS INT) AS month_num,
       sum(coalesce(TRY_CAST(count AS DOUBLE), 0)) AS monthly_subway_incidents
FROM x_transit_feed GROUP BY 1, 2"""

CTES["x_transit"] = """
SELECT *, (monthly_subway_incidents - min(monthly_subway_incidents) OVER ())
       / (max(monthly_subway_incidents) OVER () - min(monthly_subway_incidents) OVER () + 1e-9) AS subway_disruption_idx
FROM x_transit_sums"""

# dimension -> its keys, spelled by the facts' key columns, and what it brings
_LOOKUPS = {
    "x_weather": ("date_hour", ["temperature_2m", "precipitation", "windspeed_10m", "weathercode", "is_severe_weather", "is_extreme_heat", "is_heat_emergency"]),
    "x_holidays": ("holiday_date AS day_key", ["is_holiday"]),
    "x_school": ("school_date AS day_key", ["is_school_day"]),
    "x_event_days": ("event_date AS day_key, zone_prefix AS prefix_key", ["is_major_event"]),
    "x_transit": ("12 * year + month_num AS month_key", ["subway_disruption_idx"]),
}


def _star() -> str:
    """The facts with a key column per grain, one lookup per dimension, and the defaults for what no lookup finds."""
    joins = ""
    for name, (keys, brought) in _LOOKUPS.items():
        using = ", ".join(k.split(" AS ")[-1] for k in keys.split(", "))
        joins += f"\nLEFT JOIN (SELECT {keys}, {', '.join(brought)} FROM {name}) USING ({using})"
    fills = ", ".join(f"coalesce({c}, {v}{'::DOUBLE' if isinstance(v, float) else ''}) AS {c}" for c, v in ENRICHMENT_DEFAULTS.items())
    return f"""
SELECT * EXCLUDE (day_key, prefix_key, month_key) REPLACE ({fills})
FROM (SELECT *, incident_date AS day_key, left(INCIDENT_DISPATCH_AREA, 1) AS prefix_key, 12 * year + month AS month_key FROM x_clean){joins}"""


CTES["x_star"] = _star()

CTES["x_enriched"] = """
SELECT i.*, coalesce(z.svi_score, 0.5::DOUBLE) AS svi_score
FROM x_star i LEFT JOIN x_zones z ON z.zone = i.INCIDENT_DISPATCH_AREA"""

CTES["x_clean_svi"] = """
SELECT i.*, coalesce(z.svi_score, 0.5::DOUBLE) AS svi_score
FROM x_clean i LEFT JOIN x_zones z ON z.zone = i.INCIDENT_DISPATCH_AREA"""

_BIN = "INCIDENT_DISPATCH_AREA, BOROUGH, year, month, dayofweek, hour, is_weekend, split"
_BIN_PARTS = [
    *[f"round(avg({c}), {d}) AS {c}" for c, d in {"svi_score": 4, "subway_disruption_idx": 4, "precipitation": 3, "windspeed_10m": 2, "temperature_2m": 2}.items()],
    *[f"max({c}) AS {c}" for c in ENRICHMENT_DEFAULTS if c.startswith("is_")],
    *[f"avg({c}) AS {n}" for c, n in zip(_SECONDS, ("avg_response_seconds", "avg_travel_seconds", "avg_dispatch_seconds"))],
    *[f"count(*) FILTER (WHERE {c} = 1) AS {n}" for c, n in (("is_high_acuity", "high_acuity_count"), ("is_held", "held_count"))],
    "count(*) AS incident_count", f"quantile_cont({_SECONDS[0]}, 0.5) AS median_response_seconds",
]
CTES["x_bins"] = f"""
SELECT *, {CYCLIC.format(h='hour', d='dayofweek', m='month')}
FROM (SELECT {_BIN}, {', '.join(_BIN_PARTS)} FROM x_enriched WHERE split <> 'exclude' GROUP BY ALL)"""

CTES["x_daily"] = """
SELECT INCIDENT_DISPATCH_AREA, hour, dayofweek, incident_date, count(CAD_INCIDENT_ID) AS daily_count
FROM x_clean WHERE split = 'train' GROUP BY ALL"""

CTES["x_baselines"] = """
SELECT INCIDENT_DISPATCH_AREA, hour, dayofweek, avg(daily_count) AS zone_baseline_avg FROM x_daily GROUP BY ALL"""

CTES["x_stats"] = """
SELECT INCIDENT_DISPATCH_AREA, BOROUGH, avg(svi_score) AS svi_score, avg(INCIDENT_RESPONSE_SECONDS_QY) AS avg_response_seconds,
       avg(INCIDENT_TRAVEL_TM_SECONDS_QY) AS avg_travel_seconds, avg(DISPATCH_RESPONSE_SECONDS_QY) AS avg_dispatch_seconds,
       avg(is_high_acuity) AS high_acuity_ratio, avg(is_held) AS held_ratio, count(CAD_INCIDENT_ID) AS total_incidents
FROM x_clean_svi WHERE split = 'train' GROUP BY INCIDENT_DISPATCH_AREA, BOROUGH"""

CTES["x_stations"] = """
SELECT 'ST_' || CAST(s_suppkey AS VARCHAR) AS station_id, s_name AS name, z.borough,
       'Nation ' || CAST(s_nationkey AS VARCHAR) AS address, z.lat + (s_nationkey - 12) * 0.0004::DOUBLE AS lat,
       z.lon + (s_suppkey % 7 - 3) * 0.0005::DOUBLE AS lon, z.zone AS dispatch_zone
FROM supplier JOIN x_zones z ON z.zone_ord = s_suppkey % 31"""

CTES["x_station_matrix"] = f"""
SELECT station_id AS origin, z.zone AS dest, {drive('s.lon', 's.lat', 'z.lon', 'z.lat')} AS seconds
FROM x_stations s CROSS JOIN x_zones z"""

CTES["x_zone_matrix"] = f"""
SELECT o.zone AS origin, z.zone AS dest, {drive('o.lon', 'o.lat', 'z.lon', 'z.lat')} AS seconds
FROM x_zones o CROSS JOIN x_zones z"""

CTES["x_nodes"] = """
SELECT c_custkey AS node_id, z.lon + (c_custkey % 101 - 50) * 0.0003::DOUBLE AS lon,
       z.lat + (c_custkey % 89 - 44) * 0.0003::DOUBLE AS lat
FROM customer JOIN x_zones z ON z.zone_ord = c_custkey % 31"""

CTES["x_requests"] = f"""
SELECT o_orderkey AS request_id, CAST(o_custkey % 25 AS INT) AS hour, CAST(isodow(day) - 1 AS INT) AS dow,
       CASE WHEN o_totalprice < 20000 THEN NULL ELSE CAST(month(day) AS INT) END AS month,
       CASE o_orderstatus WHEN 'F' THEN 22.04::DOUBLE WHEN 'O' THEN 10.0::DOUBLE ELSE 36.0::DOUBLE END AS temperature,
       CASE o_orderstatus WHEN 'F' THEN 0.0::DOUBLE WHEN 'O' THEN 4.0::DOUBLE ELSE 12.0::DOUBLE END AS precipitation,
       CASE o_orderstatus WHEN 'F' THEN 8.0::DOUBLE WHEN 'O' THEN 20.0::DOUBLE ELSE 40.0::DOUBLE END AS windspeed,
       CASE WHEN o_totalprice > 480000 THEN 11
            ELSE CAST({_pick(["5", "1", "3", "7", "10"], "CAST(substr(o_orderpriority, 1, 1) AS INT) - 1")} AS INT) END AS ambulances
FROM x_archive"""

CTES["x_checked"] = """
SELECT request_id, hour, dow, coalesce(month, 10) AS month, round_even(temperature, 1) AS temperature,
       round_even(precipitation, 1) AS precipitation, round_even(windspeed, 1) AS windspeed, ambulances
FROM x_requests"""

CTES["x_valid"] = """
SELECT * FROM x_checked
WHERE hour BETWEEN 0 AND 23 AND dow BETWEEN 0 AND 6 AND month BETWEEN 1 AND 12 AND ambulances BETWEEN 1 AND 10"""

CTES["x_scen"] = """
SELECT hour, dow, month, temperature, precipitation, windspeed, ambulances, count(*) AS requests,
       concat_ws('|', hour, dow, month, temperature, precipitation, windspeed, ambulances) AS scenario_id
FROM x_valid GROUP BY ALL"""

CTES["x_forecast"] = f"""
SELECT s.*, z.zone, z.zone_ord, z.borough, z.lon, z.lat, coalesce(st.svi_score, z.svi_score) AS svi_score,
       coalesce(st.high_acuity_ratio, z.acuity_default) AS high_acuity_ratio, coalesce(st.held_ratio, z.held_default) AS held_ratio,
       coalesce(b.zone_baseline_avg, 5.0::DOUBLE) AS zone_baseline_avg, greatest(coalesce(b.zone_baseline_avg, 5.0::DOUBLE), 0) AS predicted,
       CASE WHEN s.dow IN (5, 6) THEN 1 ELSE 0 END AS is_weekend, CASE WHEN precipitation > 5 THEN 1 ELSE 0 END AS is_severe_weather,
       CASE WHEN temperature >= 35 THEN 1 ELSE 0 END AS is_extreme_heat, {CYCLIC.format(h='s.hour', d='s.dow', m='s.month')}
FROM x_scen s CROSS JOIN x_zones z
LEFT JOIN x_baselines b ON b.INCIDENT_DISPATCH_AREA = z.zone AND b.hour = s.hour AND b.dayofweek = s.dow
LEFT JOIN x_stats st ON st.INCIDENT_DISPATCH_AREA = z.zone"""

CTES["x_bin_scen"] = """
SELECT DISTINCT CAST(hour AS VARCHAR) || '-' || CAST(dayofweek AS VARCHAR) AS scenario_id, hour, dayofweek AS dow, 10 AS month
FROM x_clean"""

CTES["x_bin_forecast"] = """
SELECT s.*, z.zone, z.zone_ord, z.borough, z.zone_name, z.lon, z.lat, z.svi_score, z.response_default, st.avg_response_seconds,
       coalesce(st.high_acuity_ratio, 0.23::DOUBLE) AS high_acuity_ratio, coalesce(b.zone_baseline_avg, 3.0::DOUBLE) AS predicted
FROM x_bin_scen s CROSS JOIN x_zones z
LEFT JOIN x_baselines b ON b.INCIDENT_DISPATCH_AREA = z.zone AND b.hour = s.hour AND b.dayofweek = s.dow
LEFT JOIN x_stats st ON st.INCIDENT_DISPATCH_AREA = z.zone"""

CTES["x_top_staging"] = """
SELECT hour, dow AS dayofweek, zone AS staging_zone
FROM (SELECT *, row_number() OVER (PARTITION BY hour, dow ORDER BY predicted DESC, zone_ord) AS rn FROM x_bin_forecast) WHERE rn <= 10"""

CTES["x_staged"] = """
SELECT hour, dayofweek, dest AS zone, min(seconds) AS seconds
FROM x_top_staging JOIN x_zone_matrix ON origin = staging_zone GROUP BY ALL"""

CTES["x_fixed"] = """
SELECT z.zone AS dest, coalesce(min(seconds), 9999) AS seconds
FROM x_zones z LEFT JOIN x_station_matrix m ON m.dest = z.zone GROUP BY z.zone"""

CTES["x_acute_raw"] = "SELECT * FROM x_clean_svi WHERE split = 'test' AND is_high_acuity = 1"

CTES["x_acute"] = """
SELECT a.*, CASE WHEN svi_score <= q[1] THEN 'Q1' WHEN svi_score <= q[2] THEN 'Q2' WHEN svi_score <= q[3] THEN 'Q3' ELSE 'Q4' END AS svi_quartile
FROM x_acute_raw a CROSS JOIN (SELECT quantile_cont(svi_score, [0.25, 0.5, 0.75]) AS q FROM x_acute_raw)"""

CTES["x_whatif"] = """
SELECT CAD_INCIDENT_ID, hour, dayofweek, incident_zone, borough, svi_quartile, b AS baseline_drive_sec, s AS staged_drive_sec,
       b - s AS seconds_saved, CAST(b <= 480 AS INT) AS baseline_within_8min, CAST(s <= 480 AS INT) AS staged_within_8min
FROM (SELECT a.CAD_INCIDENT_ID, a.hour, a.dayofweek, a.INCIDENT_DISPATCH_AREA AS incident_zone, a.BOROUGH AS borough, svi_quartile,
             CASE WHEN INCIDENT_RESPONSE_SECONDS_QY BETWEEN 1 AND 7200 THEN CAST(trunc(INCIDENT_RESPONSE_SECONDS_QY) AS INT)
                  ELSE coalesce(f.seconds, 9999) END AS b, coalesce(g.seconds, 9999) AS s
      FROM x_acute a LEFT JOIN x_staged g ON g.hour = a.hour AND g.dayofweek = a.dayofweek AND g.zone = a.INCIDENT_DISPATCH_AREA
      LEFT JOIN x_fixed f ON f.dest = a.INCIDENT_DISPATCH_AREA)"""

CTES["x_bin_summary"] = """
SELECT hour, dayofweek, median(seconds_saved) AS median_seconds_saved, avg(baseline_within_8min) * 100 AS pct_within_8min_static,
       avg(staged_within_8min) * 100 AS pct_within_8min_staged, count(*) AS n_incidents
FROM x_whatif GROUP BY hour, dayofweek"""

CTES["x_centred"] = """
SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY predicted_demand_coverage DESC, lat, lon) - 1 AS staging_index
FROM (SELECT scenario_id, borough, sum(w * lat) / sum(w) AS lat, sum(w * lon) / sum(w) AS lon,
             round(sum(predicted), 2) AS predicted_demand_coverage, list_sort(list(zone)) AS cluster_zones, count(*) AS zone_count
      FROM (SELECT *, greatest(predicted, 0.01::DOUBLE) AS w FROM x_forecast) GROUP BY scenario_id, borough)"""

CTES["x_drives"] = f"""
SELECT scenario_id, zone, min(t) AS best_drive
FROM (SELECT p.scenario_id, z.zone, {km2('p.lon', 'p.lat', 'z.lon', 'z.lat')} / (25.0::DOUBLE / {FACTOR}) * 3600 AS t
      FROM x_centred p JOIN x_scen s USING (scenario_id) CROSS JOIN x_zones z
      UNION ALL
      SELECT p.scenario_id, m.dest AS zone, CAST(m.seconds AS DOUBLE) AS t
      FROM x_centred p JOIN x_zones o ON {km2('p.lon', 'p.lat', 'o.lon', 'o.lat')} < 2.0 JOIN x_zone_matrix m ON m.origin = o.zone)
GROUP BY scenario_id, zone"""

CTES["x_zone_whatif"] = f"""
SELECT scenario_id, zone, zone_ord, borough, svi_score, demand, static_time, least(dispatch + greatest(best_drive, 120), static_time) AS staged_time,
       greatest(0, static_time - least(dispatch + greatest(best_drive, 120), static_time)) AS seconds_saved
FROM (SELECT f.scenario_id, f.zone, f.zone_ord, f.borough, f.svi_score, f.predicted AS demand, best_drive,
             coalesce(st.avg_dispatch_seconds, round_even(z.response_default * 0.38::DOUBLE, 0)) AS dispatch,
             coalesce(st.avg_dispatch_seconds, round_even(z.response_default * 0.38::DOUBLE, 0))
             + coalesce(st.avg_travel_seconds, z.response_default - round_even(z.response_default * 0.38::DOUBLE, 0)) * {FACTOR} AS static_time
      FROM x_forecast f JOIN x_zones z USING (zone) LEFT JOIN x_stats st ON st.INCIDENT_DISPATCH_AREA = f.zone
      LEFT JOIN x_drives d ON d.scenario_id = f.scenario_id AND d.zone = f.zone)"""


def kmeans(name: str, points: str) -> dict[str, str]:
    """Weighted K-Means of every group ``g`` of ``points`` (g, k, zone_ord, zone, w, lat, lon, predicted), round by round until no
    centre moves: farthest-first seeds, then labels and ordered sums. ``name`` has one row per centre: g, label, lat, lon, demand, zones.
    """
    d2 = "(p.lat - c.lat) * (p.lat - c.lat) + (p.lon - c.lon) * (p.lon - c.lon)"
    labelled = f"SELECT p.*, list_transform(s.centres, lambda c: {d2}) AS d, s.centres FROM {{}} s JOIN {points} p ON p.g = s.g"
    return {
        f"{name}_seeds": f"""
SELECT g, any_value(k) AS k, [arg_max({{'lat': lat, 'lon': lon}}, (w, -zone_ord))] AS centres FROM {points} GROUP BY g
UNION ALL
SELECT g, k, centres FROM (
  SELECT s.g, s.k, list_append(s.centres, arg_max({{'lat': p.lat, 'lon': p.lon}}, (p.w * list_min(list_transform(s.centres, lambda c: {d2})), -p.zone_ord))) AS centres
  FROM {name}_seeds s JOIN {points} p ON p.g = s.g WHERE len(s.centres) < s.k GROUP BY s.g, s.k, s.centres)""",
        f"{name}_rounds": f"""
SELECT g, 0 AS round, centres FROM {name}_seeds WHERE len(centres) = k
UNION ALL
SELECT g, round, centres FROM (
  SELECT g, round + 1 AS round, centres AS was,
         list_transform(range(len(centres)), lambda j: coalesce(map_from_entries(list((label, centre)))[j + 1], centres[j + 1])) AS centres
  FROM (
    SELECT g, round, centres, label,
           {{'lat': sum(w * lat ORDER BY zone_ord) / sum(w ORDER BY zone_ord), 'lon': sum(w * lon ORDER BY zone_ord) / sum(w ORDER BY zone_ord)}} AS centre
    FROM (SELECT g, round, centres, list_position(d, list_min(d)) AS label, w, lat, lon, zone_ord
          FROM (SELECT s.round, x.* FROM ({labelled.format(name + '_rounds')}) x JOIN {name}_rounds s ON s.g = x.g))
    GROUP BY g, round, centres, label)
  GROUP BY g, round, centres) WHERE centres <> was""",
        name: f"""
SELECT g, label - 1 AS label, any_value(centres)[label].lat AS lat, any_value(centres)[label].lon AS lon, round(sum(predicted ORDER BY zone_ord), 2) AS demand,
       list_sort(list(zone)) AS zones
FROM (SELECT *, list_position(d, list_min(d)) AS label FROM ({labelled.format(f"(SELECT g, arg_max(centres, round) AS centres FROM {name}_rounds GROUP BY g)")}))
GROUP BY g, label""",
    }


CTES["x_bin_points"] = """
SELECT scenario_id AS g, 10 AS k, zone_ord, zone, greatest(predicted, 0.01::DOUBLE) AS w, lat, lon, predicted FROM x_bin_forecast"""
CTES |= kmeans("x_city", "x_bin_points")

CTES["x_city_staging"] = """
SELECT p.g AS scenario_id, p.label, arg_min(z.zone, ((z.lat - p.lat) * (z.lat - p.lat) + (z.lon - p.lon) * (z.lon - p.lon), z.zone_ord)) AS staging_zone
FROM x_city p CROSS JOIN x_zones z GROUP BY ALL"""

# boroughs by demand, and one cluster after another to the highest quotient of demand and clusters held
CTES["x_ranks"] = """
SELECT scenario_id, borough, demand, n_zones, ambulances, row_number() OVER (PARTITION BY scenario_id ORDER BY demand DESC, first_ord) AS place,
       count(*) OVER (PARTITION BY scenario_id) AS n
FROM (SELECT scenario_id, borough, any_value(ambulances) AS ambulances, sum(predicted ORDER BY zone_ord) AS demand, min(zone_ord) AS first_ord, count(*) AS n_zones
      FROM x_forecast GROUP BY scenario_id, borough)"""
CTES["x_bids"] = """
SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY demand / j DESC, place, j) AS turn
FROM (SELECT *, unnest(range(1, ambulances - n + 1)) AS j FROM x_ranks WHERE ambulances > n)"""
CTES["x_held"] = """
SELECT r.scenario_id, r.borough, n_zones, CASE WHEN ambulances >= n OR place <= ambulances THEN 1 ELSE 0 END + coalesce(won, 0) AS clusters
FROM x_ranks r LEFT JOIN (SELECT scenario_id, borough, count(*) AS won FROM x_bids WHERE turn <= ambulances - n GROUP BY ALL) b
  ON b.scenario_id = r.scenario_id AND b.borough = r.borough"""
CTES["x_fair_points"] = """
SELECT f.scenario_id || '#' || f.borough AS g, least(clusters, n_zones) AS k, zone_ord, zone, greatest(predicted, 0.01::DOUBLE) AS w, lat, lon, predicted
FROM x_forecast f JOIN x_held h ON h.scenario_id = f.scenario_id AND h.borough = f.borough WHERE clusters > 0"""
CTES |= kmeans("x_fair", "x_fair_points")
CTES["x_placed"] = """
SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY predicted_demand_coverage DESC, lat, lon) - 1 AS staging_index
FROM (SELECT split_part(g, '#', 1) AS scenario_id, split_part(g, '#', 2) AS borough, label, lat, lon, demand AS predicted_demand_coverage, zones AS cluster_zones,
             len(zones) AS zone_count FROM x_fair)"""

# the what-ifs over these placements
CTES["x_city_bins"] = "SELECT hour, dow AS dayofweek, staging_zone FROM x_city_staging JOIN x_bin_scen USING (scenario_id)"
CTES["x_city_staged"] = CTES["x_staged"].replace("x_top_staging", "x_city_bins")
CTES["x_city_whatif"] = CTES["x_whatif"].replace("x_staged", "x_city_staged")
CTES["x_city_summary"] = CTES["x_bin_summary"].replace("x_whatif", "x_city_whatif")
CTES["x_fair_drives"] = CTES["x_drives"].replace("x_centred", "x_placed")
CTES["x_fair_whatif"] = CTES["x_zone_whatif"].replace("x_drives", "x_fair_drives")

CTES["x_scored"] = f"""
SELECT *, {share_within('static_time')} AS static_share, {share_within('staged_time')} AS staged_share, {COPIES} AS copies,
       {BAND.format('svi_score')} AS svi_quartile
FROM x_zone_whatif"""


def weighted_median(value: str, copies: str, keys: str, source: str) -> str:
    """Median of ``value`` with each row repeated ``copies`` times."""
    return f"SELECT {keys}, median({value}) AS m FROM (SELECT {keys}, {value}, unnest(range({copies})) FROM {source}) GROUP BY {keys}"


def _impact(scope: str, name: str, scored: str = "x_scored") -> str:
    total = "CASE WHEN sum(demand) < 0.01 THEN 1 ELSE sum(demand) END"
    return f"""
SELECT a.scenario_id, '{scope}' AS scope, a.name, round(s, 1) AS pct_static, round(g, 1) AS pct_staged, round(m, 1) AS median_saved_sec
FROM (SELECT scenario_id, {name} AS name, sum(demand * static_share) / {total} * 100 AS s, sum(demand * staged_share) / {total} * 100 AS g
      FROM {scored} GROUP BY ALL) a
JOIN ({weighted_median('seconds_saved', 'copies', 'scenario_id, name', f'(SELECT *, {name} AS name FROM {scored})')}) b
  ON a.scenario_id = b.scenario_id AND a.name = b.name"""


CTES["x_fair_scored"] = CTES["x_scored"].replace("x_zone_whatif", "x_fair_whatif")
for _prefix, _scored in (("x_impact", "x_scored"), ("x_fair_impact", "x_fair_scored")):
    CTES[f"{_prefix}_overall"] = _impact("overall", "'all'", _scored)
    CTES[f"{_prefix}_borough"] = _impact("borough", "borough", _scored)
    CTES[f"{_prefix}_band"] = _impact("svi_quartile", "svi_quartile", _scored)

CTES["x_zone_zips"] = f"""
SELECT * FROM (VALUES {_values([(dim.ZONE_CODES.index(z), z, p) for z, zips in dim.ZONE_ZIPS.items() for p in zips])})
     AS t(zone_ord, zone, zip)"""

CTES["x_zip_zone"] = """
SELECT zip, zone FROM (SELECT *, row_number() OVER (PARTITION BY zip ORDER BY zone_ord) AS rn FROM x_zone_zips) WHERE rn = 1"""

CTES["x_frame"] = """
SELECT b.*, coalesce(l.zone_baseline_avg, 1.0::DOUBLE) AS zone_baseline_avg, coalesce(s.high_acuity_ratio, 0.23::DOUBLE) AS high_acuity_ratio,
       coalesce(s.held_ratio, 0.06::DOUBLE) AS held_ratio
FROM x_bins b LEFT JOIN x_baselines l ON l.INCIDENT_DISPATCH_AREA = b.INCIDENT_DISPATCH_AREA AND l.hour = b.hour AND l.dayofweek = b.dayofweek
LEFT JOIN x_stats s ON s.INCIDENT_DISPATCH_AREA = b.INCIDENT_DISPATCH_AREA"""


def oracle(select: str) -> str:
    """The select with every expression it needs, in dependency order."""
    order: list[str] = []
    open_: set[str] = set()

    def need(text: str) -> None:
        for name in re.findall(r"\bx_[a-z_]+\b", text):
            if name in CTES and name not in order and name not in open_:
                open_.add(name)
                need(CTES[name])
                if name not in order:
                    order.append(name)

    need(select)
    select = select.strip()
    if not order:
        return select
    # inputs are shared by several parts of a select; computing each once keeps DuckDB quick
    # (a recursive one names itself and cannot be marked so)
    parts = [f"{n} AS ({CTES[n]})" if re.search(rf"\b{n}\b", CTES[n]) else f"{n} AS MATERIALIZED ({CTES[n]})" for n in order]
    head = ("WITH RECURSIVE " if any("MATERIALIZED" not in p.split("(", 1)[0] for p in parts) else "WITH ") + ",\n".join(parts)
    for opening, recursive in (("WITH RECURSIVE ", True), ("WITH ", False)):
        if select.startswith(opening):
            head = head.replace("WITH ", "WITH RECURSIVE ", 1) if recursive and not head.startswith("WITH RECURSIVE") else head
            return head + ",\n" + select[len(opening):]
    return head + "\n" + select
