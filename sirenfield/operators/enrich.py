"""Weather, calendar, public events, transit and vulnerability onto the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import dimensions as dim
from ..functions.weather import EXTREME_HEAT_C, SUSTAINED_HEAT_C, extreme_heat, severe_by_code

# What an unmatched fact gets.
ENRICHMENT_DEFAULTS = {
    "temperature_2m": 15.0,
    "precipitation": 0.0,
    "windspeed_10m": 10.0,
    "weathercode": 0,
    "is_severe_weather": 0,
    "is_extreme_heat": 0,
    "is_heat_emergency": 0,
    "is_holiday": 0,
    "is_school_day": 0,
    "is_major_event": 0,
    "subway_disruption_idx": 0.5,
}
SVI_DEFAULT = 0.5


def heat_emergency(temperature: Column, trailing_max: Column) -> Column:
    return ((temperature >= EXTREME_HEAT_C) | (trailing_max >= SUSTAINED_HEAT_C)).cast("int")


def with_weather_flags(hourly: DataFrame, location: str | None = "location", rows: int = 24) -> DataFrame:
    """Severity and heat flags of hourly weather; the heat emergency looks back
    over the last ``rows`` rows including the current one.

    One window partition per weather location: hours of a location, never facts.
    """
    w = Window.partitionBy(*([location] if location else [])).orderBy("date_hour").rowsBetween(-(rows - 1), 0)
    return hourly.withColumns({
        "is_severe_weather": severe_by_code(F.col("weathercode")),
        "is_extreme_heat": extreme_heat(F.col("temperature_2m")),
        "is_heat_emergency": heat_emergency(F.col("temperature_2m"), F.max("temperature_2m").over(w)),
    })


def zone_heat_emergency(facts: DataFrame) -> DataFrame:
    """Per-zone variant: 25 hourly rows of the zone, the current one and 24 before.

    Facts shrink to one row per (zone, hour) first, so a zone that holds most
    of the facts still has only as many window rows as it has hours.
    """
    hours = facts.groupBy("INCIDENT_DISPATCH_AREA", "date_hour").agg(F.max("temperature_2m").alias("temperature_2m"))
    w = Window.partitionBy("INCIDENT_DISPATCH_AREA").orderBy("date_hour").rowsBetween(-24, 0)
    return hours.withColumns({
        "is_extreme_heat": extreme_heat(F.col("temperature_2m")),
        "is_heat_emergency": heat_emergency(F.col("temperature_2m"), F.max("temperature_2m").over(w)),
    })


def holidays(spark: SparkSession, extra: tuple[str, ...] = ()) -> DataFrame:
    """Union of the federal and city lists (a date in both counts once)."""
    federal = dim.date_table(spark, dim.FEDERAL_HOLIDAYS + list(extra), "holiday_date")
    city = dim.date_table(spark, dim.CITY_HOLIDAYS, "holiday_date")
    return federal.union(city).distinct().withColumn("is_holiday", F.lit(1))


def daily_calendar(dates: DataFrame, column: str) -> DataFrame:
    """Every day from the first to the last date of ``column``."""
    span = dates.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi")).alias("school_date"))


def in_session(days: DataFrame, day: str) -> DataFrame:
    """Interval join: days inside a school session (five broadcast intervals)."""
    s = dim.school_sessions(days.sparkSession)
    return days.join(
        F.broadcast(s), F.col(day).between(F.col("session_start"), F.col("session_end")), "inner"
    )


def drop_closures(days: DataFrame, day: str) -> DataFrame:
    closed = dim.date_table(days.sparkSession, dim.SCHOOL_CLOSURES, day)
    return days.join(F.broadcast(closed), day, "left_anti")


def school_days(days: DataFrame, day: str = "school_date") -> DataFrame:
    """Calendar with a 0/1 school flag: weekday, not a closure, inside a session."""
    open_days = in_session(drop_closures(days.filter(F.weekday(day) < 5), day), day)
    open_days = open_days.select(day).distinct().withColumn("is_school_day", F.lit(1))
    return days.join(open_days, day, "left").fillna(0, subset=["is_school_day"])


def event_days(events: DataFrame, cap: str) -> DataFrame:
    """Multi-day events to distinct (day, zone prefix) rows, cut at ``cap``.

    Events collapse to distinct (start, end, prefix) before the fan-out, so
    the explode works on calendar combinations and not on raw events.
    """
    prefix = dim.literal_map({b[2]: b[0] for b in dim.BOROUGHS})[F.trim("event_borough")]
    spans = (
        events.withColumn("zone_prefix", prefix)
        .filter(F.col("zone_prefix").isNotNull())
        .select("zone_prefix", "event_start", F.least("event_end", F.lit(cap).cast("date")).alias("event_end"))
        .filter(F.col("event_start") <= F.col("event_end"))
        .distinct()
    )
    return (
        spans.select("zone_prefix", F.explode(F.sequence("event_start", "event_end")).alias("event_date"))
        .dropDuplicates(["event_date", "zone_prefix"])
        .withColumn("is_major_event", F.lit(1))
    )


def transit_monthly(feed: DataFrame, month: str, count: str) -> DataFrame:
    """Incidents per month over all lines, min-max scaled over the whole period."""
    parsed = F.to_date(F.try_to_timestamp(F.col(month)))
    monthly = (
        feed.select(parsed.alias("m"), F.coalesce(F.col(count).try_cast("double"), F.lit(0.0)).alias("n"))
        .filter(F.col("m").isNotNull())
        .groupBy(F.year("m").alias("year"), F.month("m").alias("month_num"))
        .agg(F.sum("n").alias("monthly_subway_incidents"))
    )
    # the range is one row
    span = monthly.agg(F.min("monthly_subway_incidents").alias("_lo"), F.max("monthly_subway_incidents").alias("_hi"))
    return monthly.join(F.broadcast(span), F.lit(True)).withColumn(
        "subway_disruption_idx", (F.col("monthly_subway_incidents") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9)
    ).drop("_lo", "_hi")


def fill(df: DataFrame, defaults: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns})


def join_weather(facts: DataFrame, weather: DataFrame) -> DataFrame:
    """By hour, and by location where the facts have one; otherwise each hour counts once, for the first location by name."""
    cols = [c for c in ENRICHMENT_DEFAULTS if c in weather.columns]
    if "location" in weather.columns and "location" in facts.columns:
        return facts.join(weather.select("date_hour", "location", *cols), ["date_hour", "location"], "left")
    if "location" in weather.columns:
        first = F.min_by(F.struct(*cols), F.col("location")).alias("w")
        weather = weather.groupBy("date_hour").agg(first).select("date_hour", "w.*")
    return facts.join(weather.select("date_hour", *cols), "date_hour", "left")


def join_holidays(facts: DataFrame, table: DataFrame) -> DataFrame:
    on = F.to_date(facts["date_hour"]) == table["holiday_date"]
    return facts.join(table, on, "left").drop("holiday_date")


def join_school(facts: DataFrame, table: DataFrame) -> DataFrame:
    on = F.to_date(facts["date_hour"]) == table["school_date"]
    return facts.join(table, on, "left").drop("school_date")


def join_event_days(facts: DataFrame, table: DataFrame) -> DataFrame:
    on = (F.to_date(facts["date_hour"]) == table["event_date"]) & (
        F.substring(facts["INCIDENT_DISPATCH_AREA"], 1, 1) == table["zone_prefix"]
    )
    return facts.join(table, on, "left").drop("event_date", "zone_prefix")


def join_transit(facts: DataFrame, monthly: DataFrame) -> DataFrame:
    m = monthly.select(F.col("year").alias("t_year"), F.col("month_num").alias("t_month"), "subway_disruption_idx")
    on = (F.year(facts["date_hour"]) == m["t_year"]) & (F.month(facts["date_hour"]) == m["t_month"])
    return facts.join(m, on, "left").drop("t_year", "t_month")


def join_vulnerability(facts: DataFrame) -> DataFrame:
    svi = dim.zones(facts.sparkSession).select(F.col("zone").alias("INCIDENT_DISPATCH_AREA"), "svi_score")
    return fill(facts.join(F.broadcast(svi), "INCIDENT_DISPATCH_AREA", "left"), {"svi_score": SVI_DEFAULT})


def star_enrich(
    facts: DataFrame,
    weather: DataFrame,
    holiday: DataFrame,
    school: DataFrame,
    events: DataFrame,
    transit: DataFrame,
) -> DataFrame:
    """Five dimensions in one stage; the facts are neither shuffled nor sorted.

    The joins carry no hint: hand in dimensions written as tables. Spark then reads their size
    from the files, broadcasts them below its threshold and joins by shuffle above.
    """
    df = join_weather(facts, weather)
    df = join_holidays(df, holiday)
    df = join_school(df, school)
    df = join_event_days(df, events)
    df = join_transit(df, transit)
    return fill(df, ENRICHMENT_DEFAULTS)
