"""The batch run: landed inputs to the tables that forecasts, placement and impact read."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..operators import aggregate, clean, enrich, graph, impact, model, place, quality, scenarios, travel
from ..session import bucketed
from ..sources.files import VersionedTable

KEY = "scenario_id"
ZONE = aggregate.ZONE
BASELINE_COLUMNS = (ZONE, "hour", "dayofweek", "zone_baseline_avg")
STATS_COLUMNS = (
    ZONE, "BOROUGH", "svi_score", "avg_response_seconds", "avg_travel_seconds", "avg_dispatch_seconds", "high_acuity_ratio",
    "held_ratio", "total_incidents",
)
SUMMARY_COLUMNS = (
    "hour", "dayofweek", "median_seconds_saved", "pct_within_8min_static", "pct_within_8min_staged", "n_incidents",
)
RAW_COLUMNS = ("borough", "svi_quartile", "baseline_drive_sec", "staged_drive_sec", "seconds_saved")


def _zones_complete(column: str) -> dict[str, tuple[Column, Column]]:
    known = F.col(column).isin(dim.ZONE_CODES)
    return {
        "all 31 zones present": (quality.distinct(F.when(known, F.col(column))), F.col("value") == 31),
        "no other zones": (quality.violations(known), F.col("value") == 0),
    }


class Pipeline:
    """Each step publishes a new version of its table under ``root`` and returns it.

    Readers of an older version keep it; the input of a step is never overwritten. What a step promises is measured
    while its table is written; :meth:`validate` publishes the findings.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.findings: list[DataFrame] = []

    def publish(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = (), columns: tuple[str, ...] = (), by: str | None = None, **rules) -> DataFrame:
        """Writes and checks a table; ``by`` keeps it in buckets of that key, so that later steps by it need no exchange."""
        watch = quality.Watch(name, **rules)
        if by:
            out = bucketed(watch.over(df), f"{self.root}/{name}/b-{uuid.uuid4().hex}", by)
        else:
            out = VersionedTable(self.spark, f"{self.root}/{name}").replace(watch.over(df), partition_by)
        if columns:
            self.findings.append(quality.required_columns(out, name, list(columns)))
        if rules:
            self.findings.append(watch.report())
        return out

    def ingest(self, raw: DataFrame, split: clean.Split | None = None) -> DataFrame:
        """Partitioned by split, so that train-only and test-only steps prune files."""
        v = F.col("value")
        rows = {f"has {s} rows": (aggregate.count_where(F.col("split") == s), v > 0) for s in ("train", "test")}
        return self.publish(
            "incidents_cleaned", clean.clean(raw, split), ("split",), **{"has rows": (F.count("*"), v > 0)}, **rows, **_zones_complete(ZONE)
        )

    def enrich(
        self, facts: DataFrame, weather: DataFrame, events: DataFrame, transit: DataFrame, last: str,
        extra_holidays: tuple[str, ...] = (),
    ) -> DataFrame:
        """``weather``: hourly rows; ``events``: accepted events, cut at the day ``last``; ``transit``: monthly index."""
        days = enrich.school_days(enrich.daily_calendar(facts, "incident_date"))
        hourly = enrich.with_weather_flags(weather, "location" if "location" in weather.columns else None)
        marked = enrich.event_days(events, last)
        # published, so that the joins know their sizes
        tables = [
            self.publish(name, df)
            for name, df in (
                ("weather_hourly", hourly), ("holidays", enrich.holidays(self.spark, extra_holidays)),
                ("school_days", days), ("event_days", marked), ("transit_monthly", transit),
            )
        ]
        star = enrich.star_enrich(facts, *tables)
        filled = ("temperature_2m", "is_holiday", "is_school_day", "is_major_event", "subway_disruption_idx", "svi_score")
        nulls = {f"{c} has no nulls": (quality.violations(F.col(c).isNotNull()), F.col("value") == 0) for c in filled}
        return self.publish("incidents_enriched", enrich.join_vulnerability(star), ("split",), **nulls)

    def aggregate(self, enriched: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        n, v, bad = F.count("*"), F.col("value"), quality.violations
        means = F.avg(F.when(F.col("BOROUGH") == "BRONX", F.col("avg_response_seconds")))
        return (
            self.publish("incidents_aggregated", aggregate.zone_bins(enriched), **{"has rows": (n, v > 0)}),
            self.publish(
                "zone_baselines", aggregate.zone_baselines(enriched), columns=BASELINE_COLUMNS,
                **{"at most 5208 rows": (n, v <= 5208), "at least 31 rows": (n, v >= 31), "baseline above 0": (bad(F.col("zone_baseline_avg") > 0), v == 0)},
                **_zones_complete(ZONE),
            ),
            self.publish(
                "zone_stats", aggregate.zone_stats(enriched), columns=STATS_COLUMNS,
                **{"exactly 31 rows": (n, v == 31), "Bronx mean response in 400..900": (means, v.between(400, 900))},
                **{f"{c} in 0..1": (bad(F.col(c).between(0, 1)), v == 0) for c in ("high_acuity_ratio", "held_ratio")},
                **_zones_complete(ZONE),
            ),
        )

    def train(self, enriched: DataFrame, baselines: DataFrame, stats: DataFrame, **params):
        """Fits on bins of a date's hour, the grain of the baselines; ``params`` go to :func:`model.train`."""
        by_date = aggregate.zone_bins(enriched, "incident_date")
        frame = model.leave_own_date_out(model.training_frame(by_date, baselines, stats))
        fitted = model.train(self.publish("training_by_date", frame), **params)
        fitted.write().overwrite().save(f"{self.root}/demand_model")
        return fitted

    def drive_times(self, stations: DataFrame, nodes: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
        """Zones and stations to zones: over the road graph (nodes: node_id, lon, lat; edges: src, dst, cost), if there is one,
        from the node nearest to each; otherwise by the great-circle estimate."""
        origins = travel.zone_origins(self.spark).unionByName(travel.station_origins(stations))
        if nodes is None or edges is None:
            matrix = travel.estimated_matrix(origins)
        else:
            points = origins.withColumnRenamed("origin", "point_id")
            on_road = travel.nearest_node(points, nodes).select(F.col("point_id").alias("origin"), F.col("node_id").alias("node"))
            zone_nodes = on_road.filter(F.col("origin").isin(dim.ZONE_CODES)).withColumnRenamed("origin", "zone")
            matrix = graph.drive_matrix(edges, on_road, zone_nodes, origins)
        v, s = F.col("value"), F.col("seconds")
        reachable = s < dim.UNREACHABLE_SECONDS
        neighbours = F.max(F.when((F.col("origin") == "B1") & (F.col("dest") == "B2"), s))
        return self.publish("drive_times", matrix, columns=("origin", "dest", "seconds"), **{
            "has entries": (F.count("*"), v > 0),
            "reachable times in 0..7200": (quality.violations(~reachable | s.between(0, 7200)), v == 0),
            "over half reachable": (quality.share(reachable), v > 0.5),
            "B1 to B2 in 60..7200": (neighbours, v.between(60, 7200)),
        })

    # ---- scenarios: tables in buckets of the scenario ------------------------

    def forecast(self, requested: DataFrame, baselines: DataFrame, stats: DataFrame, fitted=None, name: str = "forecast", **defaults) -> DataFrame:
        """Scenario x zone demand by the trained model, or by the bare baselines without one.

        ``requested``: one row per scenario with ``scenario_id``. ``defaults`` go to :func:`scenarios.expand`.
        """
        expanded = scenarios.expand(requested, baselines, stats, **defaults)
        scored = model.score(fitted, expanded) if fitted is not None else scenarios.baseline_forecast(expanded)
        p, v = F.col("predicted"), F.col("value")
        return self.publish(name, scored, by=KEY, **{
            "predictions at least 0": (F.min(p), v >= 0), "predictions under 100": (F.max(p), v < 100),
        })

    def place(self, forecast: DataFrame, units: str = "ambulances") -> DataFrame:
        """Borough-fair placement of each scenario's units."""
        wanted = forecast.groupBy(KEY).agg(F.max(units).alias("units"))
        v = F.col("value")
        return self.publish("placement", place.borough_placement(forecast, wanted, KEY), by=KEY, **{
            "has points": (F.count("*"), v > 0), "all settled": (quality.violations(F.col("converged")), v == 0),
        })

    def impact(self, forecast: DataFrame, stats: DataFrame, placement: DataFrame, matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Before and after of every zone of a scenario, and its overall, borough and band figures."""
        rows = impact.zone_whatif(forecast, stats, placement, matrix, KEY)
        v = F.col("value")
        zones = self.publish("zone_impact", rows, by=KEY, **{"nothing lost": (quality.violations(F.col("seconds_saved") >= 0), v == 0)})
        return zones, self.publish("impact", impact.grouped_impact(zones, KEY), **{"shares in 0..100": (
            quality.violations(F.col("pct_static").between(0, 100.0001) & F.col("pct_staged").between(0, 100.0001)), v == 0
        )})

    def whatif(self, enriched: DataFrame, forecast: DataFrame, matrix: DataFrame, stations: DataFrame, units: int = 10):
        """Per-fact what-if and the 168-bin summary. ``forecast``: one scenario per
        (hour, dow) expanded to zones, with ``scenario_id`` and ``predicted``."""
        staging = place.staging_zones(forecast, KEY, F.lit(units))
        bins = scenarios.hour_bins(self.spark).withColumn(KEY, F.concat_ws("-", "hour", "dayofweek"))
        chosen = staging.join(F.broadcast(bins), KEY).select("hour", "dayofweek", "staging_zone")
        staged = travel.nearest_staged(chosen, matrix, ["hour", "dayofweek"])
        fixed = travel.nearest_origin(matrix, travel.station_origins(stations))
        acute = impact.quantile_band(impact.acute_test_facts(enriched), "svi_score")
        v, q = F.col("value"), F.col("svi_quartile")
        raw = self.publish("whatif_raw", impact.fact_whatif(acute, staged, fixed), columns=RAW_COLUMNS, **{
            "has rows": (F.count("*"), v > 0),
            "all five boroughs": (quality.distinct(F.col("borough")), v == len(dim.BOROUGH_NAMES)),
            "no other boroughs": (quality.violations(F.col("borough").isin(dim.BOROUGH_NAMES)), v == 0),
            "all four bands": (quality.distinct(F.when(q.isin(*impact.BANDS), q)), v == 4),
        })
        staged_share, static_share = F.col("pct_within_8min_staged"), F.col("pct_within_8min_static")
        summary = self.publish("whatif_summary", impact.dense_bins(impact.bin_summary(raw)), columns=SUMMARY_COLUMNS, **{
            "exactly 168 rows": (F.count("*"), v == 168),
            "staged no worse in over 60% of bins": (quality.share(staged_share >= static_share), v > 0.6),
            "mean gain above 0": (F.avg(staged_share - static_share), v > 0),
        })
        saved = lambda band: F.max(F.when(q == band, F.col("median_saved_sec")))
        self.publish("whatif_by_band", impact.group_breakdown(raw, "svi_quartile"), **{
            "Q4 saves at least as much as Q1": (saved("Q4") - saved("Q1"), v >= 0),
        })
        self.publish("whatif_by_borough", impact.group_breakdown(raw, "borough"))
        return raw, summary

    def bin_scenarios(self, month: int = 10) -> DataFrame:
        """All 168 (hour, weekday) scenarios of plain conditions."""
        return scenarios.hour_bins(self.spark).select(
            F.concat_ws("-", "hour", "dayofweek").alias(KEY), "hour", F.col("dayofweek").alias("dow"),
            F.lit(month).alias("month"), F.lit(15.0).alias("temperature"), F.lit(0.0).alias("precipitation"),
            F.lit(10.0).alias("windspeed"),
        )

    def bin_forecast(self, baselines: DataFrame, stats: DataFrame, fitted=None, month: int = 10) -> DataFrame:
        return self.forecast(
            self.bin_scenarios(month), baselines, stats, fitted, "bin_forecast", baseline_default=3.0, zone_defaults=False
        )

    def validate(self) -> DataFrame:
        """Everything measured so far: columns, ranges, key sets and relations, as one published table."""
        return self.publish("validation", quality.report(*self.findings))
