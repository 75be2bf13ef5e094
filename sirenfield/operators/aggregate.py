"""Demand and response aggregates over the enriched facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..functions.calendar import with_cyclical
from .quantiles import with_quantiles

ZONE = "INCIDENT_DISPATCH_AREA"
BIN_KEYS = [ZONE, "BOROUGH", "year", "month", "dayofweek", "hour", "is_weekend", "split"]


def count_where(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def run_audit(facts: DataFrame) -> DataFrame:
    """Row counts by split and the number of zones, in one pass."""
    return facts.agg(
        F.count("*").alias("total"),
        *[count_where(F.col("split") == s).alias(f"{s}_rows") for s in ("train", "test", "exclude")],
        F.countDistinct(ZONE).alias("distinct_zones"),
    )


def volume_by(facts: DataFrame, *keys: str) -> DataFrame:
    return facts.groupBy(*keys).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), *keys)


def zone_bins(facts: DataFrame, *extra_keys: str) -> DataFrame:
    """Zone aggregate over (year, month, weekday, hour), train and test rows.

    Without extra keys a bin sums all same-weekday dates of its month; pass
    ``incident_date`` for a true per-date-hour grain. The median comes from
    counts per response time; both parts end hashed by the keys and meet there.
    """
    keys = [*BIN_KEYS, *extra_keys]
    avg_rounded = {
        "temperature_2m": 2, "precipitation": 3, "windspeed_10m": 2, "subway_disruption_idx": 4, "svi_score": 4,
    }
    flags = [
        "is_severe_weather", "is_extreme_heat", "is_heat_emergency", "is_holiday", "is_school_day", "is_major_event",
    ]
    kept = facts.filter(F.col("split").isin("train", "test"))
    grouped = (
        kept.groupBy(*keys)
        .agg(
            *[F.round(F.avg(c), d).alias(c) for c, d in avg_rounded.items()],
            *[F.max(c).alias(c) for c in flags],
            F.count("CAD_INCIDENT_ID").alias("incident_count"),
            F.avg("INCIDENT_RESPONSE_SECONDS_QY").alias("avg_response_seconds"),
            F.avg("INCIDENT_TRAVEL_TM_SECONDS_QY").alias("avg_travel_seconds"),
            F.avg("DISPATCH_RESPONSE_SECONDS_QY").alias("avg_dispatch_seconds"),
            F.sum("is_high_acuity").alias("high_acuity_count"),
            F.sum("is_held").alias("held_count"),
        )
    )
    median = {"median_response_seconds": 0.5}
    return with_cyclical(with_quantiles(grouped, kept, keys, "INCIDENT_RESPONSE_SECONDS_QY", median))


def daily_counts(facts: DataFrame) -> DataFrame:
    return facts.groupBy(ZONE, "hour", "dayofweek", "incident_date").agg(
        F.count("CAD_INCIDENT_ID").alias("daily_count")
    )


def zone_baselines(facts: DataFrame, dense: bool = False) -> DataFrame:
    """Mean incidents per date for (zone, hour, weekday), training rows only.

    Dates without any incident do not count, unless ``dense`` fills them with
    zero (the mean then runs over all training dates of that weekday).
    """
    train = facts.filter(F.col("split") == "train")
    daily = daily_counts(train)
    keys = [ZONE, "hour", "dayofweek"]
    if not dense:
        return daily.groupBy(*keys).agg(F.avg("daily_count").alias("zone_baseline_avg"))
    days = train.select("incident_date", "dayofweek").distinct().groupBy("dayofweek").agg(F.count("*").alias("days"))
    totals = daily.groupBy(*keys).agg(F.sum("daily_count").alias("n"))
    return totals.join(F.broadcast(days), "dayofweek").select(
        *keys, (F.col("n") / F.col("days")).alias("zone_baseline_avg")
    )


def zone_stats(facts: DataFrame) -> DataFrame:
    """Per-zone means and ratios over the training rows."""
    return (
        facts.filter(F.col("split") == "train")
        .groupBy(ZONE, "BOROUGH")
        .agg(
            F.avg("svi_score").alias("svi_score"),
            F.avg("INCIDENT_RESPONSE_SECONDS_QY").alias("avg_response_seconds"),
            F.avg("INCIDENT_TRAVEL_TM_SECONDS_QY").alias("avg_travel_seconds"),
            F.avg("DISPATCH_RESPONSE_SECONDS_QY").alias("avg_dispatch_seconds"),
            F.avg("is_high_acuity").alias("high_acuity_ratio"),
            F.avg("is_held").alias("held_ratio"),
            F.count("CAD_INCIDENT_ID").alias("total_incidents"),
        )
    )


def rolling_baseline(facts: DataFrame, days: int = 28) -> DataFrame:
    """Mean daily count of the preceding ``days`` days per (zone, hour, weekday).

    Works on daily counts, so a window partition holds at most one row per date.
    """
    w = (
        Window.partitionBy(ZONE, "hour", "dayofweek")
        .orderBy("day_no")
        .rangeBetween(-days, -1)
    )
    return (
        daily_counts(facts)
        .withColumn("day_no", F.unix_date("incident_date"))
        .withColumn("rolling_avg", F.avg("daily_count").over(w))
        .drop("day_no")
    )


def enrichment_profile(facts: DataFrame) -> DataFrame:
    """Null counts, means and default counts of the enrichment, in one pass."""
    means = {
        "avg_temp_c": "temperature_2m", "avg_precip_mm": "precipitation", "avg_wind_kmh": "windspeed_10m",
        "pct_severe": "is_severe_weather", "pct_extreme_heat": "is_extreme_heat",
        "pct_heat_emergency": "is_heat_emergency", "pct_holiday": "is_holiday", "pct_school_day": "is_school_day",
        "pct_major_event": "is_major_event", "avg_subway_idx": "subway_disruption_idx",
    }
    return facts.agg(
        F.count("*").alias("total"),
        count_where(F.col("temperature_2m").isNull()).alias("null_weather"),
        count_where(F.col("svi_score").isNull()).alias("null_svi"),
        *[F.avg(c).alias(a) for a, c in means.items()],
        count_where(F.col("subway_disruption_idx") == 0.5).alias("transit_defaults"),
    )


def svi_distribution(facts: DataFrame) -> DataFrame:
    return facts.groupBy(ZONE, "BOROUGH").agg(
        F.round(F.avg("svi_score"), 2).alias("svi_score"), F.count("*").alias("incident_count")
    )


def borough_breakdown(stats: DataFrame) -> DataFrame:
    """Unweighted mean of zone means per borough; boroughs without data read 0."""
    spark = stats.sparkSession
    all_zones = dim.zones(spark).groupBy("borough").agg(F.array_sort(F.collect_list("zone")).alias("zones"))
    means = stats.groupBy(F.col("BOROUGH").alias("borough")).agg(
        F.round(F.avg("avg_dispatch_seconds"), 1).alias("avg_dispatch_seconds"),
        F.round(F.avg("avg_travel_seconds"), 1).alias("avg_travel_seconds"),
        F.round(F.avg("avg_response_seconds"), 1).alias("avg_total_seconds"),
        F.round(F.avg("held_ratio") * 100, 1).alias("pct_held"),
        F.round(F.avg("high_acuity_ratio"), 3).alias("high_acuity_ratio"),
    )
    figures = [c for c in means.columns if c != "borough"]
    return F.broadcast(all_zones).join(means, "borough", "left").select(
        F.col("borough").alias("name"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in figures], "zones"
    )


def hourly_profile(stats: DataFrame, baselines: DataFrame) -> DataFrame:
    """Per zone: its statistics and 24 hourly means over weekdays, 0.0 where absent."""
    by_hour = baselines.groupBy(ZONE, "hour").agg(F.round(F.avg("zone_baseline_avg"), 2).alias("v"))
    per_zone = by_hour.groupBy(ZONE).agg(F.map_from_entries(F.collect_list(F.struct("hour", "v"))).alias("by_hour"))
    slots = F.transform(
        F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.try_element_at("by_hour", h), F.lit(0.0))
    )
    empty = F.array_repeat(F.lit(0.0), 24)
    names = dim.zones(stats.sparkSession).select(F.col("zone").alias(ZONE), "zone_name")
    return (
        stats.join(F.broadcast(per_zone), ZONE, "left")
        .join(F.broadcast(names), ZONE)
        .withColumn("hourly_avg", F.when(F.col("by_hour").isNull(), empty).otherwise(slots))
        .drop("by_hour")
    )


def column_summary(df: DataFrame, column: str) -> DataFrame:
    """count, mean, sample deviation, exact quartiles and range of a count column."""
    moments = df.agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"),
    )
    return with_quantiles(moments, df, [], column, {"p25": 0.25, "p50": 0.5, "p75": 0.75})


def top_zones(facts: DataFrame, k: int = 10) -> DataFrame:
    return volume_by(facts, ZONE).limit(k)


def top_baselines(baselines: DataFrame, k: int = 5) -> DataFrame:
    order = [F.desc("zone_baseline_avg"), ZONE, "hour", "dayofweek"]
    return baselines.orderBy(*order).limit(k).withColumn("zone_baseline_avg", F.round("zone_baseline_avg", 2))


def zones_by_response(stats: DataFrame) -> DataFrame:
    return stats.select(
        ZONE, "BOROUGH", F.round("avg_response_seconds", 1).alias("avg_resp_sec"),
        F.round("high_acuity_ratio", 3).alias("high_acuity_ratio"), F.round("held_ratio", 3).alias("held_ratio"),
    ).orderBy(F.desc("avg_resp_sec"), ZONE)
