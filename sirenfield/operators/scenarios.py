"""Scenario tables: validation, presets, expansion to zones, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..functions.calendar import is_weekend, with_cyclical
from ..functions.weather import extreme_heat, severe_by_rain, weather_preset
from ..session import spread
from .aggregate import ZONE
from .travel import each_zone

SCENARIO_KEYS = ["hour", "dow", "month", "temperature", "precipitation", "windspeed", "ambulances"]

# Parameter bounds and defaults.
BOUNDS = {"hour": (0, 23), "dow": (0, 6), "month": (1, 12), "ambulances": (1, 10)}
DEFAULTS = {"month": 10, "temperature": 15.0, "precipitation": 0.0, "windspeed": 10.0, "ambulances": 5}


def _checked(requests: DataFrame) -> DataFrame:
    df = requests.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items()})
    df = df.withColumns({c: F.bround(F.col(c), 1) for c in ("temperature", "precipitation", "windspeed")})
    fails = [F.when(~F.coalesce(F.col(c).between(lo, hi), F.lit(False)), c) for c, (lo, hi) in BOUNDS.items()]
    return df.withColumn("rejected_for", F.concat_ws(",", *fails))


def valid_requests(requests: DataFrame) -> DataFrame:
    """Requests within bounds, defaults filled, weather rounded to one digit."""
    return _checked(requests).filter("rejected_for = ''").drop("rejected_for")


def rejected_requests(requests: DataFrame) -> DataFrame:
    """The side table of refused requests with the offending parameters."""
    return _checked(requests).filter("rejected_for <> ''")


def distinct_scenarios(requests: DataFrame) -> DataFrame:
    """Equal requests are answered once; the id is derived from the parameters."""
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in SCENARIO_KEYS])
    return (
        requests.groupBy(*SCENARIO_KEYS)
        .agg(F.count("*").alias("requests"))
        .withColumn("scenario_id", key)
    )


def with_preset(requests: DataFrame) -> DataFrame:
    """Maps a preset's rain to the weather choice and that choice's label and values."""
    w = dim.weather_presets(requests.sparkSession).select("weather", "weather_label")
    return requests.withColumn("weather", weather_preset(F.col("precipitation"))).join(F.broadcast(w), "weather")


def hour_bins(spark) -> DataFrame:
    """The 24 x 7 grid of (hour, dayofweek)."""
    return spark.range(24 * 7).select(
        F.expr("cast(id div 7 as int)").alias("hour"), F.expr("cast(id % 7 as int)").alias("dayofweek")
    )


def sweep_to_midnight(scenarios: DataFrame) -> DataFrame:
    """One scenario per hour from its own hour up to 23."""
    return scenarios.withColumn("hour", F.explode(F.sequence("hour", F.lit(23))))


def expand(
    scenarios: DataFrame,
    baselines: DataFrame,
    stats: DataFrame,
    baseline_default: float = 5.0,
    zone_defaults: bool = True,
    severe: Column | None = None,
    **overrides: Column,
) -> DataFrame:
    """Scenario x zone rows with the model's features.

    Scenario rows are few bytes but each becomes 31 scored rows, hence the
    explicit width before the fan-out. Zones come from a literal array (no join); baselines (at most 5,208 rows)
    and zone statistics (31 rows) are broadcast. ``zone_defaults`` fills
    missing ratios from the per-zone table, otherwise from the city means.
    ``overrides`` replace single features, for example an event flag that
    applies to one borough only.
    """
    b = baselines.select(F.col(ZONE).alias("zone"), "hour", F.col("dayofweek").alias("dow"), "zone_baseline_avg")
    b = b.filter(F.col("zone").isin(dim.ZONE_CODES) & F.col("hour").between(0, 23) & F.col("dow").between(0, 6))
    s = stats.filter(F.col(ZONE).isin(dim.ZONE_CODES)).select(
        F.col(ZONE).alias("zone"), F.col("svi_score").alias("s_svi"),
        F.col("high_acuity_ratio").alias("s_acuity"), F.col("held_ratio").alias("s_held"),
    )
    z = dim.zones(scenarios.sparkSession).select("zone", "acuity_default", "held_default")
    acuity, held = (F.col("acuity_default"), F.col("held_default")) if zone_defaults else (F.lit(0.23), F.lit(0.06))
    by = ["scenario_id"] if "scenario_id" in scenarios.columns else scenarios.columns
    df = (
        each_zone(spread(scenarios, *by))
        .select("*", "z.*")
        .drop("z")
        .withColumnRenamed("zone_borough", "borough")
        .join(F.broadcast(b), ["zone", "hour", "dow"], "left")
        .join(F.broadcast(s), "zone", "left")
        .join(F.broadcast(z), "zone", "left")
    )
    df = with_cyclical(df, "hour", "dow", "month")
    df = df.withColumns({
        "is_weekend": is_weekend(F.col("dow")),
        "temperature_2m": F.col("temperature"),
        "windspeed_10m": F.col("windspeed"),
        "is_severe_weather": severe if severe is not None else severe_by_rain(F.col("precipitation")),
        "svi_score": F.coalesce("s_svi", "svi_default") if zone_defaults else F.col("svi_default"),
        "zone_baseline_avg": F.coalesce("zone_baseline_avg", F.lit(baseline_default)),
        "high_acuity_ratio": F.coalesce("s_acuity", acuity),
        "held_ratio": F.coalesce("s_held", held),
        "is_holiday": F.lit(0),
        "is_major_event": F.lit(0),
        "is_school_day": F.lit(1),
        "is_heat_emergency": extreme_heat(F.col("temperature")),
        "is_extreme_heat": extreme_heat(F.col("temperature")),
        "subway_disruption_idx": F.lit(0.5),
    })
    df = df.withColumns(overrides) if overrides else df
    return df.drop("s_svi", "s_acuity", "s_held", "acuity_default", "held_default", "svi_default")


def clip_negative(predicted: Column) -> Column:
    return F.greatest(predicted, F.lit(0.0))


def baseline_forecast(expanded: DataFrame) -> DataFrame:
    """The model-free forecast: a zone's baseline is its prediction."""
    return expanded.withColumn("predicted", clip_negative(F.col("zone_baseline_avg")))


def with_intensity(forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Min-max intensity of the prediction within a scenario (31 rows each)."""
    w = Window.partitionBy(*keys)
    lo, hi = F.min("predicted").over(w), F.max("predicted").over(w)
    return forecast.withColumn("normalized_intensity", (F.col("predicted") - lo) / (hi - lo + 0.001))


def top_k_zones(forecast: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("predicted"), "zone_ord")
    return forecast.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def peak_ratio(forecast: DataFrame, label: str, peak: str, quiet: str) -> DataFrame:
    """Total demand of two labelled scenarios and their ratio (0 when quiet is 0)."""
    total = {n: F.sum(F.when(F.col(label) == v, F.col("predicted"))) for n, v in (("peak", peak), ("quiet", quiet))}
    sums = forecast.agg(total["peak"].alias("peak_total"), total["quiet"].alias("quiet_total"))
    ratio = F.when(F.col("quiet_total") > 0, F.col("peak_total") / F.col("quiet_total")).otherwise(0.0)
    return sums.withColumn("ratio", ratio)
