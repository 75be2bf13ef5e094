"""Binds the driver's tables to incident-shaped inputs.

Every input below is a projection or an aggregate over a whole given table,
with plain arithmetic that DuckDB can state in the same way.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dimensions as dim
from .operators import aggregate, clean, enrich, impact, model, place, scenarios, travel
from .session import bucketed, shared_dir

FIRST_DAY, TRAIN_END, LAST_DAY = "2024-01-01", "2024-01-20", "2024-01-31"
SHIFT_MONTHS = 276  # orders and lineitem run 1995-2001; 23 years later they reach the event month


def _pick(values: list[str], index) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


_STAGED: dict[tuple[str, str, str], str | DataFrame] = {}


class Inputs:
    """Tables over one data folder.

    Tables that several later steps share (facts, baselines, statistics, zone
    results) are written once per session and folder to the shared directory,
    as the batch pipeline does; everything else stays a lazy plan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _stage(self, name: str, build) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGED:
            path = f"{shared_dir(self.spark)}/{name}"
            build().write.parquet(path)
            _STAGED[key] = path
        return self.spark.read.parquet(_STAGED[key])

    # ---- facts ---------------------------------------------------------------

    @cached_property
    def readings(self) -> DataFrame:
        """Events with the number in their payload."""
        return self.table("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))

    @cached_property
    def raw(self) -> DataFrame:
        """The landed raw table, so that filters reach a scan."""
        return self._stage("raw", self._raw)

    def _raw(self) -> DataFrame:
        """Raw dispatch records; some payload numbers stand for defective rows."""
        k = F.col("k")
        zone = _pick(dim.ZONE_CODES, F.col("event_id") % 31)
        seconds = F.round(120 + 9 * F.col("value"), 2)
        response = (
            F.when(k == 99, "N/A").when(k == 98, "7201").when(k == 97, "0").when(k == 95, "7200").when(k == 94, "1")
            .otherwise(seconds.cast("string"))
        )
        borough = F.when(k == 7, "UNKNOWN").when(k == 8, None).when(k == 9, "QUEENS").otherwise(dim.borough_of(zone))
        flag = lambda bad, yes, no: F.when(bad, yes).otherwise(no)
        return self.readings.select(
            F.col("event_id").cast("string").alias("CAD_INCIDENT_ID"),
            F.when(k != 96, F.col("ts")).alias("INCIDENT_DATETIME"),
            F.when(k == 10, "Z9").otherwise(zone).alias("INCIDENT_DISPATCH_AREA"),
            borough.alias("BOROUGH"),
            response.alias("INCIDENT_RESPONSE_SECONDS_QY"),
            (seconds * 0.62).cast("string").alias("INCIDENT_TRAVEL_TM_SECONDS_QY"),
            (seconds * 0.38).cast("string").alias("DISPATCH_RESPONSE_SECONDS_QY"),
            (k % 8 + 1).cast("string").alias("FINAL_SEVERITY_LEVEL_CODE"),
            flag(F.col("event_type") == "error", "Y", "N").alias("HELD_INDICATOR"),
            flag(k < 3, "N", "Y").alias("VALID_INCIDENT_RSPNS_TIME_INDC"),
            flag(k == 3, "N", "Y").alias("VALID_DISPATCH_RSPNS_TIME_INDC"),
            flag(k == 4, "Y", "N").alias("REOPEN_INDICATOR"),
            flag(k == 5, "Y", "N").alias("TRANSFER_INDICATOR"),
            flag(k == 6, "Y", "N").alias("STANDBY_INDICATOR"),
        )

    @cached_property
    def cleaned(self) -> DataFrame:
        return clean.clean(self.raw, clean.split_by_date(FIRST_DAY, TRAIN_END, LAST_DAY))

    @cached_property
    def facts(self) -> DataFrame:
        """Cleaned records with their zone's vulnerability, written once."""
        return self._stage("facts", lambda: enrich.join_vulnerability(self.cleaned))

    @cached_property
    def archive(self) -> DataFrame:
        """Orders as dated records of 2018-2024, for the year-based rules."""
        day = F.add_months("o_orderdate", SHIFT_MONTHS)
        return self.table("orders").select(
            "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", day.alias("day"),
            _pick(dim.ZONE_CODES, F.col("o_custkey") % 31).alias("INCIDENT_DISPATCH_AREA"),
        )

    # ---- dimensions ----------------------------------------------------------

    @cached_property
    def weather_raw(self) -> DataFrame:
        """Hourly weather from the readings of an hour."""
        return (
            self.readings.withColumn("date_hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
            .groupBy("date_hour")
            .agg(
                (F.max("value") * 0.2 - 10).alias("temperature_2m"),
                F.min("value").alias("precipitation"),
                (F.max("k") - F.min("k")).cast("double").alias("windspeed_10m"),
                F.max("k").alias("weathercode"),
            )
            .withColumn("location", F.lit("city"))
        )

    @cached_property
    def weather(self) -> DataFrame:
        return self._stage("weather", lambda: enrich.with_weather_flags(self.weather_raw))

    @cached_property
    def holidays(self) -> DataFrame:
        return enrich.holidays(self.spark, tuple(dim.HOLIDAYS_EXTRA_2024))

    @cached_property
    def school(self) -> DataFrame:
        days = enrich.daily_calendar(self.facts, "incident_date")
        return self._stage("school", lambda: enrich.school_days(days))

    @cached_property
    def permits(self) -> DataFrame:
        """Permitted events from orders, with messy headers and some bad dates."""
        day = F.col("day")
        end = F.date_add(day, F.when(F.col("o_custkey") % 7 == 6, -1).otherwise(F.col("o_custkey") % 4).cast("int"))
        start = F.when(F.col("o_totalprice") > 490000, "TBD").otherwise(day.cast("string"))
        kinds = ["Special Event", "Parade", "Construction", "Street Fair", "Film"]
        feeds = ["Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island", "Citywide"]
        return self.archive.select(
            F.col("o_orderkey").alias("Event ID"),
            start.alias("Start Date/Time"),
            end.cast("string").alias("End Date/Time"),
            _pick(kinds, F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("Event Type"),
            _pick(feeds, F.col("o_custkey") % 6).alias("Event Borough"),
        )

    @cached_property
    def major_events(self) -> DataFrame:
        from .sources.files import event_columns, normalise_headers

        feed = normalise_headers(self.permits)
        return clean.major_events(feed, **event_columns(feed), first="2019-01-01", last=LAST_DAY)

    @cached_property
    def event_days(self) -> DataFrame:
        return self._stage("event_days", lambda: enrich.event_days(self.major_events, LAST_DAY))

    @cached_property
    def transit_feed(self) -> DataFrame:
        """Two eras of monthly line counts with different columns."""
        month = F.date_format(F.add_months("l_shipdate", SHIFT_MONTHS), "yyyy-MM-01")
        count = F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.col("l_quantity").cast("int").cast("string"))
        lines = self.table("lineitem").select(month.alias("month"), count.alias("count"), "l_returnflag", "l_linestatus")
        early = lines.filter(F.col("month") < "2020-01-01").select("month", "count", F.col("l_returnflag").alias("line"))
        late = lines.filter(F.col("month") >= "2020-01-01").select(
            "month", "count", F.col("l_linestatus").alias("day_type")
        )
        return early.unionByName(late, allowMissingColumns=True)

    @cached_property
    def transit(self) -> DataFrame:
        return self._stage("transit", lambda: enrich.transit_monthly(self.transit_feed, "month", "count"))

    @cached_property
    def enriched(self) -> DataFrame:
        return self._stage(
            "enriched",
            lambda: enrich.star_enrich(
                self.facts, self.weather, self.holidays, self.school, self.event_days, self.transit
            ),
        )

    # ---- aggregates ----------------------------------------------------------

    @cached_property
    def bins(self) -> DataFrame:
        return aggregate.zone_bins(self.enriched)

    @cached_property
    def baselines(self) -> DataFrame:
        return self._stage("baselines", lambda: aggregate.zone_baselines(self.facts))

    @cached_property
    def stats(self) -> DataFrame:
        return self._stage("stats", lambda: aggregate.zone_stats(self.facts))

    @cached_property
    def training(self) -> DataFrame:
        return self._stage("training", lambda: model.training_frame(self.bins, self.baselines, self.stats))

    @cached_property
    def training_by_date(self) -> DataFrame:
        """Training frame of the grain that the baselines have, a zone's hour of a date, without a row's own date."""
        bins = aggregate.zone_bins(self.enriched, "incident_date")
        return self._stage("training_by_date", lambda: model.leave_own_date_out(model.training_frame(bins, self.baselines, self.stats)))

    @cached_property
    def fitted(self):
        """The demand model, trained and saved once per session and folder."""
        from pyspark.ml.regression import GBTRegressionModel

        key = (self.spark.sparkContext.applicationId, self.sf_dir, "model")
        if key not in _STAGED:
            path = f"{shared_dir(self.spark)}/model"
            model.train(self.training_by_date).save(path)
            _STAGED[key] = path
        return GBTRegressionModel.load(_STAGED[key])

    # ---- travel --------------------------------------------------------------

    @cached_property
    def stations(self) -> DataFrame:
        """Suppliers as stations near the centre of their zone."""
        s = self.table("supplier").withColumn("zone", _pick(dim.ZONE_CODES, F.col("s_suppkey") % 31))
        z = dim.zones(self.spark).select("zone", F.col("lon").alias("z_lon"), F.col("lat").alias("z_lat"), "borough")
        return s.join(F.broadcast(z), "zone").select(
            F.concat(F.lit("ST_"), F.col("s_suppkey").cast("string")).alias("station_id"),
            F.col("s_name").alias("name"),
            "borough",
            F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string")).alias("address"),
            (F.col("z_lat") + (F.col("s_nationkey") - 12) * 0.0004).alias("lat"),
            (F.col("z_lon") + (F.col("s_suppkey") % 7 - 3) * 0.0005).alias("lon"),
            F.col("zone").alias("dispatch_zone"),
        )

    @cached_property
    def station_matrix(self) -> DataFrame:
        return travel.estimated_matrix(travel.station_origins(self.stations))

    @cached_property
    def zone_matrix(self) -> DataFrame:
        return travel.estimated_matrix(travel.zone_origins(self.spark))

    @cached_property
    def nodes(self) -> DataFrame:
        """Customers as road nodes scattered around their zone's centre."""
        c = self.table("customer").withColumn("zone", _pick(dim.ZONE_CODES, F.col("c_custkey") % 31))
        z = dim.zones(self.spark).select("zone", F.col("lon").alias("z_lon"), F.col("lat").alias("z_lat"))
        return c.join(F.broadcast(z), "zone").select(
            F.col("c_custkey").alias("node_id"),
            (F.col("z_lon") + (F.col("c_custkey") % 101 - 50) * 0.0003).alias("lon"),
            (F.col("z_lat") + (F.col("c_custkey") % 89 - 44) * 0.0003).alias("lat"),
        )

    @cached_property
    def trips(self) -> DataFrame:
        """Zone-to-zone trips: customer zone to supplier zone of each order line."""
        o = self.table("orders").select("o_orderkey", (F.col("o_custkey") % 31).alias("src"))
        li = self.table("lineitem").select(
            "l_orderkey", (F.col("l_suppkey") % 31).alias("dst"), F.col("l_quantity"), F.col("l_discount")
        )
        joined = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select("src", "dst", (60 + 20 * F.col("l_quantity")).alias("cost"))

    # ---- scenarios -----------------------------------------------------------

    @cached_property
    def requests(self) -> DataFrame:
        """Orders as a request log; some requests are out of bounds."""
        price, cust = F.col("o_totalprice"), F.col("o_custkey")
        p = F.substring("o_orderpriority", 1, 1).cast("int")
        status = F.col("o_orderstatus")
        units = F.when(price > 480000, 11).otherwise(_pick(["5", "1", "3", "7", "10"], p - 1).cast("int"))
        by_status = lambda f, o, x: F.when(status == "F", f).when(status == "O", o).otherwise(x)
        return self.archive.select(
            F.col("o_orderkey").alias("request_id"),
            (cust % 25).cast("int").alias("hour"),
            F.weekday("day").alias("dow"),
            F.when(price < 20000, None).otherwise(F.month("day")).alias("month"),
            by_status(22.04, 10.0, 36.0).alias("temperature"),
            by_status(0.0, 4.0, 12.0).alias("precipitation"),
            by_status(8.0, 20.0, 40.0).alias("windspeed"),
            units.alias("ambulances"),
        )

    @cached_property
    def scenarios(self) -> DataFrame:
        return scenarios.distinct_scenarios(scenarios.valid_requests(self.requests))

    @cached_property
    def forecast(self) -> DataFrame:
        """Scenario x zone demand by the baseline forecast."""
        return scenarios.baseline_forecast(scenarios.expand(self.scenarios, self.baselines, self.stats))

    def _bucketed(self, name: str, build) -> DataFrame:
        """Like :meth:`_stage`, in buckets of the scenario."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STAGED:
            _STAGED[key] = bucketed(build(), f"{shared_dir(self.spark)}/{name}", "scenario_id")
        return _STAGED[key]

    @cached_property
    def model_forecast(self) -> DataFrame:
        """Scenario x zone demand by the trained model."""
        return self._bucketed("model_forecast", lambda: model.score(self.fitted, scenarios.expand(self.scenarios, self.baselines, self.stats)))

    @cached_property
    def model_placement(self) -> DataFrame:
        units = self.model_forecast.groupBy("scenario_id").agg(F.max("ambulances").alias("units"))
        return self._bucketed("model_placement", lambda: place.borough_placement(self.model_forecast, units, "scenario_id"))

    @cached_property
    def model_bins(self) -> DataFrame:
        """Bin scenarios x zones by the trained model."""
        frame = scenarios.expand(self.bin_scenarios, self.baselines, self.stats, baseline_default=3.0, zone_defaults=False)
        return self._bucketed("model_bins", lambda: model.score(self.fitted, frame))

    @cached_property
    def units(self) -> DataFrame:
        return self.scenarios.select("scenario_id", F.col("ambulances").alias("units"))

    @cached_property
    def centred(self) -> DataFrame:
        return self._stage("centred", lambda: place.centroid_placement(self.forecast, "scenario_id"))

    @cached_property
    def placed(self) -> DataFrame:
        return place.borough_placement(self.forecast, self.units, "scenario_id")

    def zone_results(self, points: DataFrame) -> DataFrame:
        return impact.zone_whatif(self.forecast, self.stats, points, self.zone_matrix, "scenario_id")

    @cached_property
    def zone_whatif(self) -> DataFrame:
        return self._stage("zone_whatif", lambda: self.zone_results(self.centred))

    # ---- what-if per fact ----------------------------------------------------

    @cached_property
    def bin_scenarios(self) -> DataFrame:
        """One scenario per (hour, weekday) that occurs among the cleaned facts."""
        return self.facts.select("hour", F.col("dayofweek").alias("dow")).distinct().select(
            F.concat_ws("-", "hour", "dow").alias("scenario_id"), "hour", "dow", F.lit(10).alias("month"),
            F.lit(15.0).alias("temperature"), F.lit(0.0).alias("precipitation"), F.lit(10.0).alias("windspeed"),
        )

    @cached_property
    def bin_forecast(self) -> DataFrame:
        return scenarios.baseline_forecast(
            scenarios.expand(self.bin_scenarios, self.baselines, self.stats, baseline_default=3.0, zone_defaults=False)
        )

    @cached_property
    def top_staging(self) -> DataFrame:
        """Ten staging zones per bin: the zones of highest demand (SQL-expressible)."""
        top = scenarios.top_k_zones(self.bin_forecast, ["hour", "dow"], 10)
        return top.select("hour", F.col("dow").alias("dayofweek"), F.col("zone").alias("staging_zone"))

    @cached_property
    def clustered_staging(self) -> DataFrame:
        """Ten staging zones per bin by city-wide weighted K-Means."""
        points = place.staging_zones(self.bin_forecast, "scenario_id", F.lit(10))
        bins = self.bin_scenarios.select("scenario_id", "hour", F.col("dow").alias("dayofweek"))
        return points.join(F.broadcast(bins), "scenario_id").select("hour", "dayofweek", "staging_zone")

    def staged_seconds(self, staging: DataFrame) -> DataFrame:
        return travel.nearest_staged(staging, self.zone_matrix, ["hour", "dayofweek"])

    @cached_property
    def fixed_seconds(self) -> DataFrame:
        return travel.nearest_origin(self.station_matrix, travel.station_origins(self.stations))

    @cached_property
    def acute(self) -> DataFrame:
        return impact.quantile_band(impact.acute_test_facts(self.facts), "svi_score")

    def fact_results(self, staging: DataFrame, observed: bool = True) -> DataFrame:
        return impact.fact_whatif(self.acute, self.staged_seconds(staging), self.fixed_seconds, observed)

    @cached_property
    def whatif(self) -> DataFrame:
        return self._stage("whatif", lambda: self.fact_results(self.top_staging))
