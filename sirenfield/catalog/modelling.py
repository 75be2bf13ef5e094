"""Placement, modelling and what-if (M1-M11, T3) and data quality (Q1-Q6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dimensions as dim
from ..functions.weather import severe_by_rain
from ..operators import graph, impact, model, place, quality, scenarios, travel
from ..plans.pipeline import BASELINE_COLUMNS, STATS_COLUMNS, SUMMARY_COLUMNS
from . import query

KEY = "scenario_id"


def _model(t):
    return t.fitted


@query("m01_boosted_trees")
def boosted_trees(t):
    """Holdout error of the trained model next to the baseline-only error, by date and hour."""
    fitted = _model(t)
    test = t.training_by_date.filter("split = 'test'")
    trained = model.forecast_error(model.score(fitted, test)).withColumn("model", F.lit("boosted trees"))
    bare = model.forecast_error(model.baseline_only(test)).withColumn("model", F.lit("baseline only"))
    return trained.unionByName(bare)


@query("m02_batch_scoring")
def batch_scoring(t):
    df = scenarios.expand(t.scenarios, t.baselines, t.stats)
    return model.score(_model(t), df).select(KEY, "zone", "predicted")


@query("m03_feature_importance")
def feature_importance(t):
    return model.feature_importance(t.spark, _model(t))


@query("t03_top_features")
def top_features(t):
    return model.feature_importance(t.spark, _model(t)).limit(10)


@query(
    "m04_global_kmeans",
    """SELECT scenario_id, p.label, round(lat, 8) AS lat, round(lon, 8) AS lon, demand AS predicted_demand_coverage, array_to_string(zones, ',') AS zones, staging_zone
       FROM x_city p JOIN x_city_staging s ON s.scenario_id = p.g AND s.label = p.label""",
)
def global_kmeans(t):
    """City-wide weighted K-Means with ten points for every observed bin."""
    points = place.staging_zones(t.bin_forecast, KEY, F.lit(10))
    return points.select(
        KEY, "label", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"),
        "predicted_demand_coverage", F.array_join("cluster_zones", ",").alias("zones"), "staging_zone",
    )


@query(
    "m05_borough_fair_placement",
    """SELECT scenario_id, borough, staging_index, round(lat, 8) AS lat, round(lon, 8) AS lon, predicted_demand_coverage, array_to_string(cluster_zones, ',') AS zones, zone_count
       FROM x_placed""",
)
def borough_fair_placement(t):
    return t.placed.select(
        KEY, "borough", "staging_index", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"),
        "predicted_demand_coverage", F.array_join("cluster_zones", ",").alias("zones"), "zone_count",
    )


@query(
    "m06_weighted_centroid",
    """SELECT scenario_id, borough, round(sum(w * lat) / sum(w), 6) AS lat, round(sum(w * lon) / sum(w), 6) AS lon
       FROM (SELECT *, greatest(predicted, 0.01::DOUBLE) AS w FROM x_forecast) GROUP BY ALL""",
)
def weighted_centroid(t):
    df = place.weighted_centroid(t.forecast, KEY, "borough")
    return df.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query(
    "m07_point_summary",
    """SELECT scenario_id, staging_index, borough, predicted_demand_coverage, array_to_string(cluster_zones, ',') AS zones, CAST(zone_count AS INT) AS zone_count, 3500 AS coverage_radius_m FROM x_centred""",
)
def point_summary(t):
    return place.centroid_placement(t.forecast, KEY).select(
        KEY, "staging_index", "borough", "predicted_demand_coverage", F.array_join("cluster_zones", ",").alias("zones"),
        "zone_count", "coverage_radius_m",
    )


_EDGES = """SELECT src, dst, avg(60 + 20 * l_quantity) AS cost FROM (SELECT o_custkey % 31 AS src, l_suppkey % 31 AS dst, l_quantity
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE src <> dst GROUP BY ALL"""


@query(
    "m08_least_costs",
    f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), r(origin, node, cost, hops) AS (
          SELECT zone_ord, CAST(zone_ord AS BIGINT), 0.0::DOUBLE, 0 FROM x_zones
          UNION ALL
          SELECT origin, node, cost, hops FROM (
            SELECT r.origin, e.dst AS node, min(r.cost + e.cost) AS cost, any_value(r.hops) + 1 AS hops FROM r JOIN e ON e.src = r.node WHERE r.hops < 31 GROUP BY r.origin, e.dst))
        SELECT origin, node, round(min(cost), 4) AS cost FROM r GROUP BY origin, node""",
)
def least_costs(t):
    """Least-cost table between all zones over edges seen in orders."""
    origins = dim.zones(t.spark).select(F.col("zone_ord").alias("origin"), F.col("zone_ord").cast("long").alias("node"))
    edges = graph.movement_edges(t.trips)
    return graph.least_costs(edges, origins).withColumn("cost", F.round("cost", 4))


@query(
    "m08_road_matrix",
    f"""WITH RECURSIVE e AS MATERIALIZED ({_EDGES}), r(dest, node, cost, hops) AS (
          SELECT zone, CAST(zone_ord AS BIGINT), 0.0::DOUBLE, 0 FROM x_zones
          UNION ALL
          SELECT dest, node, cost, hops FROM (
            SELECT r.dest, e.src AS node, min(r.cost + e.cost) AS cost, any_value(r.hops) + 1 AS hops FROM r JOIN e ON e.dst = r.node WHERE r.hops < 31 GROUP BY r.dest, e.src)),
        c AS MATERIALIZED (SELECT dest, node, min(cost) AS cost FROM r GROUP BY dest, node),
        o AS (SELECT zone AS origin, CAST(zone_ord AS BIGINT) AS node FROM x_zones
              UNION ALL SELECT station_id, CAST(zone_ord AS BIGINT) FROM x_stations JOIN x_zones ON zone = dispatch_zone)
        SELECT origin, z.zone AS dest, coalesce(CAST(trunc(cost) AS INT), 9999) AS seconds
        FROM o CROSS JOIN x_zones z LEFT JOIN c ON c.node = o.node AND c.dest = z.zone""",
)
def road_matrix(t):
    """Zones and stations on the road graph of all trips; 9999 where unreachable."""
    z = dim.zones(t.spark)
    zone_nodes = z.select("zone", F.col("zone_ord").cast("long").alias("node"))
    s = t.stations.join(F.broadcast(zone_nodes), F.col("dispatch_zone") == F.col("zone"))
    station_nodes = s.select(F.col("station_id").alias("origin"), "node")
    origin_nodes = zone_nodes.select(F.col("zone").alias("origin"), "node").unionByName(station_nodes)
    origins = travel.zone_origins(t.spark).unionByName(travel.station_origins(t.stations))
    return graph.drive_matrix(graph.movement_edges(t.trips), origin_nodes, zone_nodes, origins)


@query("m09_fact_whatif", "SELECT * FROM x_whatif")
def fact_whatif(t):
    return t.fact_results(t.top_staging)


@query(
    "m09_fact_whatif_fixed",
    """SELECT CAD_INCIDENT_ID, f.seconds AS baseline_drive_sec, w.staged_drive_sec, f.seconds - w.staged_drive_sec AS seconds_saved
       FROM x_whatif w JOIN x_fixed f ON f.dest = w.incident_zone""",
)
def fact_whatif_fixed(t):
    """The other mode: before is always the nearest fixed station."""
    return t.fact_results(t.top_staging, observed=False).select("CAD_INCIDENT_ID", "baseline_drive_sec", "staged_drive_sec", "seconds_saved")


@query(
    "m09_clustered_whatif",
    """SELECT CAST(g // 7 AS INT) AS hour, CAST(g % 7 AS INT) AS dayofweek, median_seconds_saved, pct_within_8min_static, pct_within_8min_staged, coalesce(n_incidents, 0) AS n_incidents
       FROM (SELECT unnest(range(168)) AS g) LEFT JOIN x_city_summary s ON s.hour = g // 7 AND s.dayofweek = g % 7""",
)
def clustered_whatif(t):
    """Per-bin summary with K-Means staging, the full published chain."""
    return impact.dense_bins(impact.bin_summary(t.fact_results(t.clustered_staging)))


@query(
    "m10_zone_whatif",
    """SELECT scenario_id, zone, round(demand, 4) AS demand, round(static_time, 6) AS static_time, round(staged_time, 6) AS staged_time, round(seconds_saved, 6) AS seconds_saved FROM x_zone_whatif""",
)
def zone_whatif(t):
    r = {"demand": 4, "static_time": 6, "staged_time": 6, "seconds_saved": 6}
    return t.zone_results(t.centred).select(KEY, "zone", *[F.round(c, d).alias(c) for c, d in r.items()])


@query(
    "m10_fair_placement_impact",
    """SELECT * FROM x_fair_impact_overall UNION ALL SELECT * FROM x_fair_impact_borough UNION ALL SELECT * FROM x_fair_impact_band
       UNION ALL SELECT scenario_id, 'svi_quartile', q, 0.0, 0.0, 0.0 FROM x_scen CROSS JOIN (SELECT unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS q)
       WHERE (scenario_id, q) NOT IN (SELECT (scenario_id, name) FROM x_fair_impact_band)""",
)
def fair_placement_impact(t):
    """Forecast, borough-fair placement and impact in one job over all scenarios."""
    return impact.grouped_impact(t.zone_results(t.placed), KEY)


CHANGED = ("bronx event", "holiday", "blizzard", "july holiday")


@query("m11_scenario_comparison")
def scenario_comparison(t):
    """Event in the Bronx only, holiday, blizzard and a July holiday with a citywide event against plain conditions, for
    every observed (hour, weekday). No case has a school day, so that each differs only in what it names."""
    cases = t.bin_scenarios.withColumn(
        "case", F.explode(F.array(*[F.lit(c) for c in ("plain", *CHANGED)]))
    )
    storm, july = F.col("case") == "blizzard", F.col("case") == "july holiday"
    cases = cases.withColumns({
        "temperature": F.when(storm, -5.0).when(july, 28.0).otherwise(F.col("temperature")),
        "precipitation": F.when(storm, 15.0).otherwise(F.col("precipitation")),
        "windspeed": F.when(storm, 45.0).otherwise(F.col("windspeed")),
        "month": F.when(storm, 1).when(july, 7).otherwise(F.col("month")),
    })
    frame = scenarios.expand(
        cases, t.baselines, t.stats, baseline_default=3.0, zone_defaults=False,
        severe=severe_by_rain(F.col("precipitation")),
        is_major_event=(((F.col("case") == "bronx event") & (F.col("borough") == "BRONX")) | (F.col("case") == "july holiday")).cast("int"),
        is_holiday=F.col("case").isin("holiday", "july holiday").cast("int"),
        is_school_day=F.lit(0),
    )
    return model.compare_cases(model.score(_model(t), frame), "case", CHANGED, "plain", "borough")


@query("m11_quiet_monday")
def quiet_monday(t):
    """Monday at four in the morning, no school: mean and largest prediction, and whether every zone stays under five calls an hour."""
    quiet = dim.scenario_presets(t.spark).filter("scenario = 'monday_quiet'").withColumnRenamed("scenario", KEY)
    frame = scenarios.expand(quiet, t.baselines, t.stats, baseline_default=3.0, zone_defaults=False, is_school_day=F.lit(0))
    return model.score(_model(t), frame).groupBy(KEY).agg(
        F.avg("predicted").alias("mean_predicted"), F.max("predicted").alias("max_predicted"), (F.max("predicted") < 5).alias("is_quiet")
    )


# ---- model-driven chain ---------------------------------------------------------

@query("m09_model_whatif")
def model_whatif(t):
    """The published chain on the trained model: bin forecasts, K-Means staging, what-if per fact, the 168-bin summary."""
    points = place.staging_zones(t.model_bins, KEY, F.lit(10))
    bins = t.bin_scenarios.select(KEY, "hour", F.col("dow").alias("dayofweek"))
    staging = points.join(F.broadcast(bins), KEY).select("hour", "dayofweek", "staging_zone")
    return impact.dense_bins(impact.bin_summary(t.fact_results(staging)))


@query("m10_model_impact")
def model_impact(t):
    """Forecasts of the trained model, borough-fair placement and impact of every requested scenario, over tables in buckets of it."""
    rows = impact.zone_whatif(t.model_forecast, t.stats, t.model_placement, t.zone_matrix, KEY)
    return impact.grouped_impact(rows, KEY)


# ---- data quality -------------------------------------------------------------


def _required(*tables) -> str:
    """Columns that a table lacks, by the names that its first row has."""
    return " UNION ALL ".join(
        f"""SELECT '{name}: required columns' AS check_name, len(lacking) = 0 AS passed,
              CASE WHEN len(lacking) = 0 THEN 'all present' ELSE 'missing: ' || array_to_string(lacking, ', ') END AS detail, n AS rows
            FROM (SELECT list_filter({list(columns)}, lambda c: NOT list_contains(json_keys(any_value(to_json(r))), c)) AS lacking, count(*) AS n FROM {view} r)"""
        for name, view, columns in tables
    )


@query(
    "q01_required_columns",
    _required(("zone_baselines", "x_baselines", BASELINE_COLUMNS), ("zone_stats", "x_stats", STATS_COLUMNS)),
)
def required_columns(t):
    pairs = ((t.baselines, "zone_baselines", BASELINE_COLUMNS), (t.stats, "zone_stats", STATS_COLUMNS))
    return quality.report(*[
        quality.required_columns(df, name, cols).join(F.broadcast(df.agg(F.count("*").alias("rows"))), F.lit(True))
        for df, name, cols in pairs
    ])


def row_count_checks(t):
    n, v = F.count("*"), F.col("value")
    bins = impact.dense_bins(impact.bin_summary(t.whatif))
    return quality.report(
        quality.expect(t.baselines, "zone_baselines", **{"at most 5208 rows": (n, v <= 5208), "at least 31 rows": (n, v >= 31)}),
        quality.expect(t.stats, "zone_stats", **{"exactly 31 rows": (n, v == 31)}),
        quality.expect(bins, "bin_summary", **{"exactly 168 rows": (n, v == 168)}),
        quality.expect(t.whatif, "fact_whatif", **{"has rows": (n, v > 0)}),
    )


_DETAIL = "'value=' || CAST(round(CAST(v AS DOUBLE), 4) AS VARCHAR)"


_ROWS = f"""SELECT check_name, passed, {_DETAIL} AS detail FROM (
          SELECT 'zone_baselines: at most 5208 rows' AS check_name, count(*) <= 5208 AS passed, count(*) AS v FROM x_baselines
          UNION ALL SELECT 'zone_baselines: at least 31 rows', count(*) >= 31, count(*) FROM x_baselines
          UNION ALL SELECT 'zone_stats: exactly 31 rows', count(*) = 31, count(*) FROM x_stats
          UNION ALL SELECT 'bin_summary: exactly 168 rows', count(*) = 168, count(*) FROM (SELECT unnest(range(168)) AS g) LEFT JOIN x_bin_summary s ON s.hour = g // 7 AND s.dayofweek = g % 7
          UNION ALL SELECT 'fact_whatif: has rows', count(*) > 0, count(*) FROM x_whatif)"""


@query("q02_row_counts", _ROWS)
def row_counts(t):
    return row_count_checks(t)


def range_checks(t):
    v = F.col("value")
    bad = quality.violations
    none = v == 0
    ratios = {f"{c} in 0..1": (bad(F.col(c).between(0, 1)), none) for c in ("high_acuity_ratio", "held_ratio")}
    forecast = scenarios.with_intensity(t.forecast, [KEY])
    return quality.report(
        quality.expect(t.baselines, "zone_baselines", **{"baseline above 0": (bad(F.col("zone_baseline_avg") > 0), none)}),
        quality.expect(t.stats, "zone_stats", **ratios),
        quality.expect(t.zone_matrix, "drive_times", **{"times in 0..7200": (bad(F.col("seconds").between(0, 7200)), none)}),
        quality.expect(forecast, "forecast", **{"intensity in 0..1": (bad(F.col("normalized_intensity").between(0, 1)), none)}),
    )


_RANGES = f"""SELECT check_name, v = 0 AS passed, {_DETAIL} AS detail FROM (
          SELECT 'zone_baselines: baseline above 0' AS check_name, count(*) FILTER (WHERE NOT zone_baseline_avg > 0) AS v FROM x_baselines
          UNION ALL SELECT 'zone_stats: high_acuity_ratio in 0..1', count(*) FILTER (WHERE NOT high_acuity_ratio BETWEEN 0 AND 1) FROM x_stats
          UNION ALL SELECT 'zone_stats: held_ratio in 0..1', count(*) FILTER (WHERE NOT held_ratio BETWEEN 0 AND 1) FROM x_stats
          UNION ALL SELECT 'drive_times: times in 0..7200', count(*) FILTER (WHERE NOT seconds BETWEEN 0 AND 7200) FROM x_zone_matrix
          UNION ALL SELECT 'forecast: intensity in 0..1', count(*) FILTER (WHERE NOT i BETWEEN 0 AND 1) FROM (
            SELECT (predicted - min(predicted) OVER w) / (max(predicted) OVER w - min(predicted) OVER w + 0.001::DOUBLE) AS i FROM x_forecast WINDOW w AS (PARTITION BY scenario_id)))"""


@query("q03_value_ranges", _RANGES)
def value_ranges(t):
    return range_checks(t)


def share_checks(t):
    v, e = F.col("value"), t.enriched
    nulls = {f"{c} has no nulls": (quality.violations(F.col(c).isNotNull()), v == 0) for c in ("temperature_2m", "is_holiday", "is_school_day", "is_major_event")}
    shares = {
        "holiday share at least 1%": (quality.share(F.col("is_holiday") == 1), v >= 0.01),
        "school share at least 20%": (quality.share(F.col("is_school_day") == 1), v >= 0.20),
        "event share at least 1%": (quality.share(F.col("is_major_event") == 1), v >= 0.01),
        "transit defaults at most 99%": (quality.share(F.col("subway_disruption_idx") == 0.5), v <= 0.99),
    }
    return quality.expect(e, "enriched", **nulls, **shares)


_NO_NULLS = ", ".join(
    "{" + f"'rule': '{c} has no nulls', 'v': CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE), 'kind': 0, 'least': 0.0::DOUBLE" + "}"
    for c in ("temperature_2m", "is_holiday", "is_school_day", "is_major_event")
)


_SHARES = f"""SELECT check_name, passed, {_DETAIL} AS detail FROM (
          SELECT 'enriched: ' || r.rule AS check_name, r.v AS v, CASE r.kind WHEN 0 THEN r.v = 0 WHEN 1 THEN r.v >= r.least ELSE r.v <= r.least END AS passed FROM (SELECT unnest([
            {_NO_NULLS},
            {{'rule': 'holiday share at least 1%', 'v': avg(is_holiday), 'kind': 1, 'least': 0.01::DOUBLE}}, {{'rule': 'school share at least 20%', 'v': avg(is_school_day), 'kind': 1, 'least': 0.2::DOUBLE}},
            {{'rule': 'event share at least 1%', 'v': avg(is_major_event), 'kind': 1, 'least': 0.01::DOUBLE}},
            {{'rule': 'transit defaults at most 99%', 'v': avg(CAST(subway_disruption_idx = 0.5 AS INT)), 'kind': 2, 'least': 0.99::DOUBLE}}]) AS r FROM x_enriched))"""


@query("q04_null_and_share", _SHARES)
def null_and_share(t):
    return share_checks(t)


def relation_checks(t):
    v = F.col("value")
    bins = impact.bin_summary(t.whatif)
    staged, static = F.col("pct_within_8min_staged"), F.col("pct_within_8min_static")
    saved = lambda q: F.median(F.when(F.col("svi_quartile") == q, F.col("seconds_saved")))
    top5 = scenarios.top_k_zones(t.bin_forecast.filter("hour = 20 AND dow = 4"), [KEY], 5)
    rmse = model.forecast_error(model.baseline_only(t.training.filter("split = 'test'")))
    peak = scenarios.expand(dim.scenario_presets(t.spark), t.baselines, t.stats, baseline_default=3.0, zone_defaults=False)
    ratio = scenarios.peak_ratio(scenarios.baseline_forecast(peak), "scenario", "friday_peak", "monday_quiet")
    return quality.report(
        quality.expect(bins, "bin_summary", **{
            "staged no worse in over 60% of bins": (quality.share(staged >= static), v > 0.6),
            "mean gain above 0": (F.avg(staged - static), v > 0),
        }),
        quality.expect(t.whatif, "fact_whatif", **{"Q4 saves at least as much as Q1": (saved("Q4") - saved("Q1"), v >= 0)}),
        quality.expect(top5, "forecast", **{"Bronx and Brooklyn hold 3 of top 5": (F.sum(F.col("borough").isin("BRONX", "BROOKLYN").cast("int")), v >= 3)}),
        quality.expect(ratio, "forecast", **{"peak over twice quiet": (F.max("ratio"), v > 2)}),
        quality.expect(rmse, "baseline model", **{"rmse below 6": (F.max("rmse"), v <= 6.0)}),
    )


_RELATIONS = f"""WITH p AS (SELECT s.scenario, coalesce(zone_baseline_avg, 3.0::DOUBLE) AS v FROM (VALUES ('friday_peak', 20, 4), ('monday_quiet', 4, 0)) AS s(scenario, hour, dow) CROSS JOIN x_zones z
               LEFT JOIN x_baselines b ON b.INCIDENT_DISPATCH_AREA = z.zone AND b.hour = s.hour AND b.dayofweek = s.dow),
        m(check_name, v, o) AS (
          SELECT 'bin_summary: staged no worse in over 60% of bins', avg(CAST(pct_within_8min_staged >= pct_within_8min_static AS INT)), 1 FROM x_bin_summary
          UNION ALL SELECT 'bin_summary: mean gain above 0', avg(pct_within_8min_staged - pct_within_8min_static), 2 FROM x_bin_summary
          UNION ALL SELECT 'fact_whatif: Q4 saves at least as much as Q1', median(seconds_saved) FILTER (WHERE svi_quartile = 'Q4') - median(seconds_saved) FILTER (WHERE svi_quartile = 'Q1'), 3 FROM x_whatif
          UNION ALL SELECT 'forecast: Bronx and Brooklyn hold 3 of top 5', sum(CAST(borough IN ('BRONX', 'BROOKLYN') AS INT)), 4 FROM (SELECT borough FROM x_bin_forecast WHERE hour = 20 AND dow = 4 ORDER BY predicted DESC, zone_ord LIMIT 5)
          UNION ALL SELECT 'forecast: peak over twice quiet', (SELECT sum(v) FROM p WHERE scenario = 'friday_peak') / (SELECT sum(v) FROM p WHERE scenario = 'monday_quiet'), 5
          UNION ALL SELECT 'baseline model: rmse below 6', sqrt(avg(pow(incident_count - zone_baseline_avg, 2))), 6 FROM x_frame WHERE split = 'test')
        SELECT check_name, CASE o WHEN 1 THEN v > 0.6 WHEN 2 THEN v > 0 WHEN 3 THEN v >= 0 WHEN 4 THEN v >= 3 WHEN 5 THEN v > 2 ELSE v <= 6 END AS passed, {_DETAIL} AS detail FROM m"""


@query("q05_relations", _RELATIONS)
def relations(t):
    return relation_checks(t)


_KEYS = """SELECT 'zone_stats: ' || r.rule AS check_name, r.n = 0 AS passed, 'value=' || CAST(r.n AS VARCHAR) AS detail
  FROM (SELECT unnest([{'rule': 'contains all expected', 'n': lacking}, {'rule': 'equals expected', 'n': lacking + surplus}]) AS r FROM (
    SELECT (SELECT count(*) FROM (SELECT zone FROM x_zones EXCEPT SELECT INCIDENT_DISPATCH_AREA FROM x_stats)) AS lacking,
           (SELECT count(*) FROM (SELECT INCIDENT_DISPATCH_AREA FROM x_stats EXCEPT SELECT zone FROM x_zones)) AS surplus))"""
_REPORT = [_required(("zone_baselines", "x_baselines", BASELINE_COLUMNS), ("zone_stats", "x_stats", STATS_COLUMNS), ("bin_summary", "x_bin_summary", SUMMARY_COLUMNS)),
           _KEYS, _ROWS, _RANGES, _SHARES, _RELATIONS]


@query("q06_report", " UNION ALL ".join(f"SELECT check_name, passed, detail FROM ({part})" for part in _REPORT))
def full_report(t):
    """All expectations as one pass/fail table."""
    key = quality.key_sets(quality.zone_keys(t.spark, "INCIDENT_DISPATCH_AREA"), t.stats, "INCIDENT_DISPATCH_AREA", "zone_stats")
    return quality.report(
        quality.required_columns(t.baselines, "zone_baselines", BASELINE_COLUMNS),
        quality.required_columns(t.stats, "zone_stats", STATS_COLUMNS),
        quality.required_columns(impact.bin_summary(t.whatif), "bin_summary", SUMMARY_COLUMNS),
        key, row_count_checks(t), range_checks(t), share_checks(t), relation_checks(t),
    )
