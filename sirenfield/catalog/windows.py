"""Window functions (W1-W11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate as agg
from ..operators import enrich, impact, place, scenarios, travel
from . import query
from .sql import _values

KEY = "scenario_id"


@query(
    "w01_heat_emergency",
    """SELECT strftime(date_hour, '%Y-%m-%d %H:%M:%S') AS date_hour, round(temperature_2m, 4) AS temperature_2m, is_severe_weather, is_extreme_heat, is_heat_emergency FROM x_weather""",
)
def heat_emergency(t):
    return enrich.with_weather_flags(t.weather_raw).select(
        F.date_format("date_hour", "yyyy-MM-dd HH:mm:ss").alias("date_hour"),
        F.round("temperature_2m", 4).alias("temperature_2m"), "is_severe_weather", "is_extreme_heat", "is_heat_emergency",
    )


@query("w02_quantile_band", "SELECT CAD_INCIDENT_ID, svi_score, svi_quartile FROM x_acute")
def quantile_band(t):
    return t.acute.select("CAD_INCIDENT_ID", "svi_score", "svi_quartile")


@query(
    "w03_intensity",
    """SELECT scenario_id, zone, round((predicted - min(predicted) OVER w) / (max(predicted) OVER w - min(predicted) OVER w + 0.001::DOUBLE), 4) AS normalized_intensity
       FROM x_forecast WINDOW w AS (PARTITION BY scenario_id)""",
)
def intensity(t):
    df = scenarios.with_intensity(t.forecast, [KEY])
    return df.select(KEY, "zone", F.round("normalized_intensity", 4).alias("normalized_intensity"))


_RANKS = """SELECT scenario_id, borough, demand, row_number() OVER (PARTITION BY scenario_id ORDER BY demand DESC, first_ord) AS borough_rank
 FROM (SELECT scenario_id, borough, sum(predicted) AS demand, min(zone_ord) AS first_ord FROM x_forecast GROUP BY ALL)"""


@query("w04_borough_rank", f"SELECT scenario_id, borough, round(demand, 4) AS demand, borough_rank FROM ({_RANKS})")
def borough_rank(t):
    return place.borough_ranks(t.forecast, KEY).select(KEY, "borough", F.round("demand", 4).alias("demand"), "borough_rank")


@query(
    "w05_unit_allocation",
    f"""WITH ranks AS ({_RANKS}), wanted AS (SELECT r.*, s.ambulances AS units FROM ranks r JOIN x_scen s USING (scenario_id)),
        won AS (SELECT scenario_id, borough, count(*) AS extra FROM (
                  SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY demand / j DESC, borough_rank, j) AS rn
                  FROM (SELECT *, unnest(range(1, units - 5 + 1)) AS j FROM wanted WHERE units > 5)) WHERE rn <= units - 5 GROUP BY ALL)
        SELECT w.scenario_id, w.borough, CAST(CASE WHEN units >= 5 OR borough_rank <= units THEN 1 ELSE 0 END + coalesce(extra, 0) AS INT) AS clusters
        FROM wanted w LEFT JOIN won ON won.scenario_id = w.scenario_id AND won.borough = w.borough""",
)
def unit_allocation(t):
    ranks = place.borough_ranks(t.forecast, KEY)
    return place.allocate_units(ranks, t.units, KEY).select(KEY, "borough", "clusters")


@query(
    "w06_apportionment",
    """WITH p AS (SELECT c.*, s.ambulances AS total, CASE WHEN predicted_demand_coverage = 0 THEN 1 ELSE predicted_demand_coverage END AS d,
                  greatest(s.ambulances - 5, 0) AS extras FROM x_centred c JOIN x_scen s USING (scenario_id)),
       q AS (SELECT *, d / sum(d) OVER (PARTITION BY scenario_id) * extras AS raw FROM p),
       r AS (SELECT *, extras - sum(floor(raw)) OVER (PARTITION BY scenario_id) AS left_over,
                    row_number() OVER (PARTITION BY scenario_id ORDER BY raw - floor(raw) DESC, staging_index) AS by_rest,
                    row_number() OVER (PARTITION BY scenario_id ORDER BY d DESC, staging_index) AS by_demand FROM q)
       SELECT scenario_id, staging_index, CAST(CASE WHEN total < 5 THEN CAST(by_demand <= total AS INT) ELSE 1 + floor(raw) + CAST(by_rest <= left_over AS INT) END AS INT) AS units_shown FROM r""",
)
def apportionment(t):
    points = t.centred.join(t.units, KEY)
    return place.apportion_units(points, KEY, "units").select(KEY, "staging_index", "units_shown")


@query(
    "w07_zip_first_wins",
    """SELECT z.zip, z.zone, count(c_custkey) AS customers FROM x_zip_zone z LEFT JOIN customer ON CAST(10001 + c_custkey % 1700 AS VARCHAR) = z.zip GROUP BY ALL""",
)
def zip_first_wins(t):
    used = t.table("customer").groupBy((F.col("c_custkey") % 1700 + 10001).cast("string").alias("zip")).agg(
        F.count("*").alias("customers")
    )
    out = travel.zip_zone(t.spark).join(used, "zip", "left")
    return out.select("zip", "zone", F.coalesce("customers", F.lit(0).cast("long")).alias("customers"))


@query(
    "w08_capped_sample",
    """SELECT CAD_INCIDENT_ID, hour, dayofweek FROM (SELECT *, row_number() OVER (PARTITION BY hour, dayofweek ORDER BY md5(CAD_INCIDENT_ID), CAD_INCIDENT_ID) AS rn FROM x_clean) WHERE rn <= 150""",
)
def capped_sample(t):
    return impact.capped_sample(t.cleaned, ["hour", "dayofweek"], "CAD_INCIDENT_ID", 150).select(
        "CAD_INCIDENT_ID", "hour", "dayofweek"
    )


@query(
    "w08_sample_of_busy_bins",
    """SELECT CAD_INCIDENT_ID, hour, dayofweek FROM (SELECT *, row_number() OVER (PARTITION BY hour, dayofweek ORDER BY md5(CAD_INCIDENT_ID), CAD_INCIDENT_ID) AS rn,
       count(*) OVER (PARTITION BY hour, dayofweek) AS n FROM x_acute) WHERE rn <= 50 AND n >= 5""",
)
def sample_of_busy_bins(t):
    return impact.capped_sample(t.acute, ["hour", "dayofweek"], "CAD_INCIDENT_ID", 50, at_least=5).select(
        "CAD_INCIDENT_ID", "hour", "dayofweek"
    )


@query(
    "w09_top_zones_per_scenario",
    """SELECT scenario_id, zone, rank FROM (SELECT *, row_number() OVER (PARTITION BY scenario_id ORDER BY predicted DESC, zone_ord) AS rank FROM x_forecast) WHERE rank <= 5""",
)
def top_zones_per_scenario(t):
    return scenarios.top_k_zones(t.forecast, [KEY], 5).select(KEY, "zone", "rank")


@query(
    "w10_rolling_baseline",
    """SELECT INCIDENT_DISPATCH_AREA, hour, dayofweek, CAST(incident_date AS VARCHAR) AS incident_date, daily_count,
       round(avg(daily_count) OVER (PARTITION BY INCIDENT_DISPATCH_AREA, hour, dayofweek ORDER BY incident_date RANGE BETWEEN INTERVAL 28 DAY PRECEDING AND INTERVAL 1 DAY PRECEDING), 4) AS rolling_avg
       FROM (SELECT INCIDENT_DISPATCH_AREA, hour, dayofweek, incident_date, count(CAD_INCIDENT_ID) AS daily_count FROM x_clean GROUP BY ALL)""",
)
def rolling_baseline(t):
    df = agg.rolling_baseline(t.cleaned)
    return df.withColumns({"incident_date": F.col("incident_date").cast("string"), "rolling_avg": F.round("rolling_avg", 4)})


@query(
    "w11_zone_heat",
    """SELECT INCIDENT_DISPATCH_AREA, strftime(date_hour, '%Y-%m-%d %H:%M:%S') AS date_hour, round(temperature_2m, 4) AS temperature_2m, CASE WHEN temperature_2m >= 35 THEN 1 ELSE 0 END AS is_extreme_heat,
       CASE WHEN temperature_2m >= 35 OR max(temperature_2m) OVER (PARTITION BY INCIDENT_DISPATCH_AREA ORDER BY date_hour ROWS BETWEEN 24 PRECEDING AND CURRENT ROW) >= 32.2 THEN 1 ELSE 0 END AS is_heat_emergency
       FROM (SELECT INCIDENT_DISPATCH_AREA, date_hour, max(temperature_2m) AS temperature_2m FROM x_star GROUP BY ALL)""",
)
def zone_heat(t):
    facts = enrich.fill(enrich.join_weather(t.cleaned, t.weather), enrich.ENRICHMENT_DEFAULTS)
    df = enrich.zone_heat_emergency(facts)
    return df.withColumns({
        "date_hour": F.date_format("date_hour", "yyyy-MM-dd HH:mm:ss"), "temperature_2m": F.round("temperature_2m", 4),
    })
