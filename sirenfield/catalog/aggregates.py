"""Aggregations (A1-A27) and sorted reports (T1-T4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dimensions as dim
from ..operators import aggregate as agg
from ..operators import enrich, graph, impact, model, scenarios
from . import query
from .sql import COPIES, TIER, _values


def rounded(df, digits=4, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query(
    "a01_run_audit",
    """SELECT count(*) AS total, CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS train_rows,
       CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS test_rows, CAST(sum(CASE WHEN split = 'exclude' THEN 1 ELSE 0 END) AS BIGINT) AS exclude_rows,
       count(DISTINCT INCIDENT_DISPATCH_AREA) AS distinct_zones FROM x_clean""",
)
def run_audit(t):
    return agg.run_audit(t.cleaned)


@query("a02_volume_by_zone", "SELECT INCIDENT_DISPATCH_AREA, count(*) AS cnt FROM x_clean GROUP BY ALL")
def volume_by_zone(t):
    return agg.volume_by(t.cleaned, "INCIDENT_DISPATCH_AREA")


@query("a02_volume_by_borough", "SELECT BOROUGH, count(*) AS cnt FROM x_clean GROUP BY ALL")
def volume_by_borough(t):
    return agg.volume_by(t.cleaned, "BOROUGH")


_BIN_ROUND = ["avg_response_seconds", "avg_travel_seconds", "avg_dispatch_seconds", "median_response_seconds"] + [
    f"{a}_{b}" for a in ("hour", "dow", "month") for b in ("sin", "cos")
]


@query(
    "a03_zone_bins",
    "SELECT * REPLACE (" + ", ".join(f"round({c}, 6) + 0.0::DOUBLE AS {c}" for c in _BIN_ROUND) + ") FROM x_bins",
)
def zone_bins(t):
    return t.bins.withColumns({c: F.round(c, 6) + 0.0 for c in _BIN_ROUND})


@query(
    "a03_zone_date_bins",
    """SELECT INCIDENT_DISPATCH_AREA, CAST(incident_date AS VARCHAR) AS incident_date, hour, count(CAD_INCIDENT_ID) AS incident_count,
       round(median(INCIDENT_RESPONSE_SECONDS_QY), 3) AS median_response_seconds, max(is_major_event) AS is_major_event
       FROM x_enriched WHERE split IN ('train', 'test') GROUP BY ALL""",
)
def zone_date_bins(t):
    """The true per-date-hour grain, by an extra key."""
    df = agg.zone_bins(t.enriched, "incident_date")
    return df.select(
        "INCIDENT_DISPATCH_AREA", F.col("incident_date").cast("string").alias("incident_date"), "hour",
        "incident_count", F.round("median_response_seconds", 3).alias("median_response_seconds"), "is_major_event",
    )


@query(
    "a04_zone_baselines",
    "SELECT INCIDENT_DISPATCH_AREA, hour, dayofweek, round(zone_baseline_avg, 6) AS zone_baseline_avg FROM x_baselines",
)
def zone_baselines(t):
    return rounded(agg.zone_baselines(t.cleaned), 6, "zone_baseline_avg")


@query(
    "a04_dense_baselines",
    """SELECT INCIDENT_DISPATCH_AREA, hour, d.dayofweek, round(sum(daily_count) / any_value(days), 6) AS zone_baseline_avg FROM x_daily d
       JOIN (SELECT dayofweek, count(DISTINCT incident_date) AS days FROM x_clean WHERE split = 'train' GROUP BY 1) n ON n.dayofweek = d.dayofweek GROUP BY 1, 2, 3""",
)
def dense_baselines(t):
    return rounded(agg.zone_baselines(t.cleaned, dense=True), 6, "zone_baseline_avg")


_STATS = ["svi_score", "avg_response_seconds", "avg_travel_seconds", "avg_dispatch_seconds", "high_acuity_ratio", "held_ratio"]


@query("a05_zone_stats", "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in _STATS) + ") FROM x_stats")
def zone_stats(t):
    return rounded(agg.zone_stats(enrich.join_vulnerability(t.cleaned)), 4, *_STATS)


@query(
    "a06_transit_min_max",
    "SELECT year, month_num, monthly_subway_incidents, round(subway_disruption_idx, 6) AS subway_disruption_idx FROM x_transit",
)
def transit_min_max(t):
    return rounded(enrich.transit_monthly(t.transit_feed, "month", "count"), 6, "subway_disruption_idx")


_PROFILE = {
    "avg_temp_c": "temperature_2m", "avg_precip_mm": "precipitation", "avg_wind_kmh": "windspeed_10m", "pct_severe": "is_severe_weather",
    "pct_extreme_heat": "is_extreme_heat", "pct_heat_emergency": "is_heat_emergency", "pct_holiday": "is_holiday",
    "pct_school_day": "is_school_day", "pct_major_event": "is_major_event", "avg_subway_idx": "subway_disruption_idx",
}


@query(
    "a07_enrichment_profile",
    """SELECT count(*) AS total, CAST(sum(CASE WHEN temperature_2m IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_weather,
       CAST(sum(CASE WHEN svi_score IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_svi, """
    + ", ".join(f"round(avg({c}), 4) AS {a}" for a, c in _PROFILE.items())
    + ", CAST(sum(CASE WHEN subway_disruption_idx = 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS transit_defaults FROM x_enriched",
)
def enrichment_profile(t):
    return rounded(agg.enrichment_profile(t.enriched), 4, *_PROFILE)


@query(
    "a08_svi_distribution",
    "SELECT INCIDENT_DISPATCH_AREA, BOROUGH, round(avg(svi_score), 2) AS svi_score, count(*) AS incident_count FROM x_clean_svi GROUP BY ALL",
)
def svi_distribution(t):
    return agg.svi_distribution(enrich.join_vulnerability(t.cleaned))


_SHARES = ["pct_within_8min_static", "pct_within_8min_staged"]


@query("a09_bin_summary", "SELECT * REPLACE (" + ", ".join(f"round({c}, 4) AS {c}" for c in _SHARES) + ") FROM x_bin_summary")
def bin_summary(t):
    return rounded(impact.bin_summary(t.whatif), 4, *_SHARES)


@query(
    "a10_dense_bins",
    """SELECT CAST(g // 7 AS INT) AS hour, CAST(g % 7 AS INT) AS dayofweek, median_seconds_saved, round(pct_within_8min_static, 4) AS pct_within_8min_static,
       round(pct_within_8min_staged, 4) AS pct_within_8min_staged, coalesce(n_incidents, 0) AS n_incidents
       FROM (SELECT unnest(range(168)) AS g) LEFT JOIN x_bin_summary s ON s.hour = g // 7 AND s.dayofweek = g % 7""",
)
def dense_bins(t):
    return rounded(impact.dense_bins(impact.bin_summary(t.whatif)), 4, *_SHARES)


def _group_sql(keys):
    return f"""SELECT {keys}, round(avg(baseline_within_8min) * 100, 4) AS pct_within_8min_static, round(avg(staged_within_8min) * 100, 4) AS pct_within_8min_staged,
        median(seconds_saved) AS median_saved_sec, count(*) AS n_incidents FROM x_whatif GROUP BY {keys}"""


@query("a11_by_borough", _group_sql("borough"))
def by_borough(t):
    return rounded(impact.group_breakdown(t.whatif, "borough"), 4, *_SHARES)


@query("a11_by_quartile", _group_sql("svi_quartile"))
def by_quartile(t):
    return rounded(impact.group_breakdown(t.whatif, "svi_quartile"), 4, *_SHARES)


@query("a11_by_bin_borough", _group_sql("hour, dayofweek, borough"))
def by_bin_borough(t):
    return rounded(impact.group_breakdown(t.whatif, "borough", by_bin=True), 4, *_SHARES)


@query("a12_weighted_share", "SELECT scenario_id, pct_static, pct_staged FROM x_impact_overall")
def weighted_share(t):
    df = impact.scenario_impact(t.zone_whatif, "scenario_id").select("scenario_id", "pct_static", "pct_staged")
    return rounded(df, 1, "pct_static", "pct_staged")


@query("a13_weighted_median", "SELECT scenario_id, median_saved_sec FROM x_impact_overall")
def weighted_median(t):
    df = impact.scenario_impact(t.zone_whatif, "scenario_id")
    return df.select("scenario_id", F.round("median_saved", 1).alias("median_saved_sec"))


@query(
    "a14_grouped_impact",
    """SELECT * FROM x_impact_overall UNION ALL SELECT * FROM x_impact_borough UNION ALL SELECT * FROM x_impact_band
       UNION ALL SELECT scenario_id, 'svi_quartile', q, 0.0, 0.0, 0.0 FROM x_scen CROSS JOIN (SELECT unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS q)
       WHERE (scenario_id, q) NOT IN (SELECT (scenario_id, name) FROM x_impact_band)""",
)
def grouped_impact(t):
    return impact.grouped_impact(t.zone_whatif, "scenario_id")


@query(
    "a15_zone_results",
    """SELECT scenario_id, zone, round(static_time, 1) AS static_time, round(staged_time, 1) AS staged_time, round(seconds_saved, 1) AS seconds_saved FROM x_zone_whatif""",
)
def zone_results(t):
    return impact.zone_results(t.zone_whatif, "scenario_id")


@query(
    "a16_borough_breakdown",
    """SELECT b.borough AS name, coalesce(d, 0) AS avg_dispatch_seconds, coalesce(r, 0) AS avg_travel_seconds, coalesce(s, 0) AS avg_total_seconds, coalesce(h, 0) AS pct_held,
         coalesce(a, 0) AS high_acuity_ratio, zones FROM (SELECT borough, string_agg(zone, ',' ORDER BY zone) AS zones FROM x_zones GROUP BY borough) b
       LEFT JOIN (SELECT BOROUGH, round(avg(avg_dispatch_seconds), 1) AS d, round(avg(avg_travel_seconds), 1) AS r, round(avg(avg_response_seconds), 1) AS s,
                         round(avg(held_ratio) * 100, 1) AS h, round(avg(high_acuity_ratio), 3) AS a FROM x_stats GROUP BY BOROUGH) s ON s.BOROUGH = b.borough""",
)
def borough_breakdown(t):
    return agg.borough_breakdown(t.stats).withColumn("zones", F.array_join("zones", ","))


@query(
    "a17_hourly_profile",
    """SELECT z.zone AS zone, CAST(h AS INT) AS slot, round(s.avg_response_seconds, 6) AS avg_response_seconds, coalesce(round(v, 2), 0.0) AS hourly_avg
       FROM x_zones z JOIN x_stats s ON s.INCIDENT_DISPATCH_AREA = z.zone CROSS JOIN (SELECT unnest(range(24)) AS h)
       LEFT JOIN (SELECT INCIDENT_DISPATCH_AREA AS zone, hour, avg(zone_baseline_avg) AS v FROM x_baselines GROUP BY ALL) b ON b.zone = z.zone AND b.hour = h""",
)
def hourly_profile(t):
    df = agg.hourly_profile(t.stats, t.baselines)
    return df.select(
        F.col("INCIDENT_DISPATCH_AREA").alias("zone"), F.round("avg_response_seconds", 6).alias("avg_response_seconds"),
        F.posexplode("hourly_avg").alias("slot", "hourly_avg"),
    )


_TEST = "(SELECT *, incident_count - zone_baseline_avg AS gap FROM x_frame WHERE split = 'test')"


@query(
    "a18_forecast_error",
    f"""SELECT BOROUGH, round(sqrt(avg(gap * gap)), 6) AS rmse, round(avg(abs(gap)), 6) AS mae, count(*) AS n FROM {_TEST} GROUP BY BOROUGH""",
)
def forecast_error(t):
    scored = model.baseline_only(t.training.filter("split = 'test'"))
    return rounded(model.forecast_error(scored, "BOROUGH"), 6, "rmse", "mae")


@query(
    "a19_residual_profile",
    f"SELECT BOROUGH, round(avg(gap), 6) AS mean, round(stddev_samp(gap), 6) AS std FROM {_TEST} GROUP BY BOROUGH",
)
def residual_profile(t):
    scored = model.baseline_only(t.training.filter("split = 'test'"))
    return rounded(model.residual_profile(scored, "BOROUGH"), 6, "mean", "std")


@query("a20_baseline_only_error", f"SELECT round(sqrt(avg(gap * gap)), 6) AS rmse, round(avg(abs(gap)), 6) AS mae, count(*) AS n FROM {_TEST}")
def baseline_only_error(t):
    return rounded(model.forecast_error(model.baseline_only(t.training.filter("split = 'test'"))), 6, "rmse", "mae")


@query(
    "a21_column_summary",
    """SELECT count(incident_count) AS count, round(avg(incident_count), 6) AS mean, round(stddev_samp(incident_count), 6) AS std, min(incident_count) AS min,
       quantile_cont(incident_count, 0.25) AS p25, quantile_cont(incident_count, 0.5) AS p50, quantile_cont(incident_count, 0.75) AS p75, max(incident_count) AS max
       FROM x_frame WHERE split = 'train'""",
)
def column_summary(t):
    return rounded(agg.column_summary(t.training.filter("split = 'train'"), "incident_count"), 6, "mean", "std")


@query(
    "a22_response_histogram",
    f"""SELECT hour, series, CAST(CASE WHEN s < 0 THEN 0 WHEN s >= 1200 THEN 16 ELSE floor(s / 60 / 20 * 15) + 1 END AS BIGINT) AS bin, CAST(sum(c) AS BIGINT) AS n
        FROM (SELECT scenario_id, 'static' AS series, static_time AS s, {COPIES} AS c FROM x_zone_whatif
              UNION ALL SELECT scenario_id, 'staged', staged_time, {COPIES} FROM x_zone_whatif) JOIN x_scen USING (scenario_id) GROUP BY ALL""",
)
def response_histogram(t):
    """Both series by hour of the day, over all scenarios of that hour."""
    hours = t.scenarios.select("scenario_id", "hour")
    return impact.response_histogram(t.zone_whatif.join(hours, "scenario_id"), "hour")


@query(
    "a23_response_sample",
    f"""WITH x_calls AS (
          SELECT scenario_id, zone, static_time, staged_time, sum({COPIES}) OVER (PARTITION BY scenario_id ORDER BY zone) AS last,
                 {COPIES} AS c, CAST(sum({COPIES}) OVER (PARTITION BY scenario_id) AS BIGINT) AS n FROM x_zone_whatif
        ), x_edges AS (
          SELECT scenario_id, n, i, floor(n * i / 50.0::DOUBLE) AS lo, floor(n * (i + 1) / 50.0::DOUBLE) AS hi
          FROM (SELECT DISTINCT scenario_id, n FROM x_calls) CROSS JOIN (SELECT unnest(range(50)) AS i)
        ), x_picks AS (
          SELECT scenario_id, unnest(range(1, n + 1)) AS call FROM x_edges WHERE i = 0 AND n <= 50
          UNION ALL
          SELECT scenario_id, lo + CAST('0x' || substr(md5(scenario_id || '#' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT) % CAST(greatest(hi - lo, 1) AS BIGINT) + 1
          FROM x_edges WHERE n > 50
        )
        SELECT p.scenario_id, zone, CAST(call - (last - c) AS INT) AS copy, CAST(round_even(static_time, 0) AS INT) AS static_sec,
               CAST(round_even(staged_time, 0) AS INT) AS staged_sec
        FROM x_picks p JOIN x_calls z ON z.scenario_id = p.scenario_id AND call > last - c AND call <= last""",
)
def response_sample(t):
    return impact.response_sample(t.zone_whatif, "scenario_id")


@query(
    "a24_headline",
    """SELECT round(avg(pct_within_8min_static), 4) AS overall_static, round(avg(pct_within_8min_staged), 4) AS overall_staged,
       round(avg(pct_within_8min_staged) - avg(pct_within_8min_static), 4) AS gain_points, median(median_seconds_saved) AS median_saved FROM x_bin_summary""",
)
def headline(t):
    df = impact.headline(impact.dense_bins(impact.bin_summary(t.whatif)))
    return rounded(df, 4, "overall_static", "overall_staged", "gain_points")


@query(
    "a25_staging_point_effect",
    f"""SELECT scenario_id, staging_index, round(a, 2) AS avg_static, round(b, 2) AS avg_staged, round(a - b, 2) AS saved, {TIER.format('b')} AS tier
        FROM (SELECT p.scenario_id, staging_index, avg(round(static_time, 1)) AS a, avg(round(staged_time, 1)) AS b
              FROM (SELECT scenario_id, staging_index, unnest(cluster_zones) AS zone FROM x_centred) p JOIN x_zone_whatif w ON w.scenario_id = p.scenario_id AND w.zone = p.zone GROUP BY ALL)""",
)
def staging_point_effect(t):
    return rounded(
        impact.staging_point_effect(t.centred, t.zone_whatif, "scenario_id"), 2, "avg_static", "avg_staged", "saved"
    )


@query(
    "a26_reachability",
    """SELECT count(*) AS pairs, CAST(sum(CAST(seconds < 9999 AS INT)) AS BIGINT) AS reachable, CAST(sum(CAST(seconds >= 9999 AS INT)) AS BIGINT) AS unreachable,
       round(avg(CAST(seconds < 9999 AS INT)) * 100, 4) AS pct_reachable, min(CASE WHEN seconds < 9999 THEN seconds END) AS min_seconds,
       max(CASE WHEN seconds < 9999 THEN seconds END) AS max_seconds FROM (SELECT * FROM x_station_matrix UNION ALL SELECT * FROM x_zone_matrix)""",
)
def reachability(t):
    return rounded(graph.reachability(t.station_matrix.unionByName(t.zone_matrix)), 4, "pct_reachable")


_PRESETS = _values([(s[0], s[1], s[2]) for s in dim.SCENARIO_PRESETS])


@query(
    "a27_peak_ratio",
    f"""SELECT round(p, 4) AS peak_total, round(q, 4) AS quiet_total, round(p / q, 4) AS ratio
        FROM (SELECT sum(CASE WHEN scenario = 'friday_peak' THEN v END) AS p, sum(CASE WHEN scenario = 'monday_quiet' THEN v END) AS q
              FROM (SELECT s.scenario, coalesce(zone_baseline_avg, 3.0::DOUBLE) AS v FROM (VALUES {_PRESETS}) AS s(scenario, hour, dow) CROSS JOIN x_zones z
                    LEFT JOIN x_baselines b ON b.INCIDENT_DISPATCH_AREA = z.zone AND b.hour = s.hour AND b.dayofweek = s.dow))""",
)
def peak_ratio(t):
    s = dim.scenario_presets(t.spark)
    df = scenarios.expand(s, t.baselines, t.stats, baseline_default=3.0, zone_defaults=False)
    out = scenarios.peak_ratio(scenarios.baseline_forecast(df), "scenario", "friday_peak", "monday_quiet")
    return rounded(out, 4, "peak_total", "quiet_total", "ratio")


# ---- sorted reports -----------------------------------------------------------

@query(
    "t01_top_zones",
    "SELECT INCIDENT_DISPATCH_AREA, count(*) AS cnt FROM x_clean GROUP BY ALL ORDER BY cnt DESC, INCIDENT_DISPATCH_AREA LIMIT 10",
)
def top_zones(t):
    return agg.top_zones(t.cleaned)


@query(
    "t02_top_baselines",
    """SELECT INCIDENT_DISPATCH_AREA, hour, dayofweek, round(zone_baseline_avg, 2) AS zone_baseline_avg FROM x_baselines
       ORDER BY x_baselines.zone_baseline_avg DESC, INCIDENT_DISPATCH_AREA, hour, dayofweek LIMIT 5""",
)
def top_baselines(t):
    return agg.top_baselines(t.baselines)


@query(
    "t04_zones_by_response",
    """SELECT INCIDENT_DISPATCH_AREA, BOROUGH, round(avg_response_seconds, 1) AS avg_resp_sec, round(high_acuity_ratio, 3) AS high_acuity_ratio, round(held_ratio, 3) AS held_ratio FROM x_stats""",
)
def zones_by_response(t):
    return agg.zones_by_response(t.stats)
