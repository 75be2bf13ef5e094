"""Ingest: typed projection, quality filter, calendar parts, flags and split."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dimensions import BOROUGHS, MAJOR_EVENT_TYPES, ZONE_CODES
from ..functions.calendar import is_weekend, with_calendar

RAW_SCHEMA = (
    "CAD_INCIDENT_ID string, INCIDENT_DATETIME string, INCIDENT_DISPATCH_AREA string, BOROUGH string, "
    "INCIDENT_RESPONSE_SECONDS_QY string, INCIDENT_TRAVEL_TM_SECONDS_QY string, "
    "DISPATCH_RESPONSE_SECONDS_QY string, FINAL_SEVERITY_LEVEL_CODE string, HELD_INDICATOR string, "
    "VALID_INCIDENT_RSPNS_TIME_INDC string, VALID_DISPATCH_RSPNS_TIME_INDC string, REOPEN_INDICATOR string, "
    "TRANSFER_INDICATOR string, STANDBY_INDICATOR string"
)

Split = Callable[[DataFrame], Column]


def split_by_year(train=(2019, 2022), test=2023, anomaly=2020) -> Split:
    """train / test / exclude by calendar year."""

    def rule(df: DataFrame) -> Column:
        y = F.col("year")
        return (
            F.when(y == test, "test")
            .when(y == anomaly, "exclude")
            .when(y.between(*train), "train")
            .otherwise("exclude")
        )

    return rule


def split_by_date(train_from: str, train_to: str, test_to: str) -> Split:
    """The same three labels from two consecutive date ranges."""

    def rule(df: DataFrame) -> Column:
        d = F.col("incident_date")
        return (
            F.when(d.between(F.lit(train_from).cast("date"), F.lit(train_to).cast("date")), "train")
            .when((d > F.lit(train_to).cast("date")) & (d <= F.lit(test_to).cast("date")), "test")
            .otherwise("exclude")
        )

    return rule


def response_in_range(seconds: Column) -> Column:
    return seconds.try_cast("double").between(1, 7200)


def zone_matches_borough(borough: Column, zone: Column) -> Column:
    cond = F.lit(False)
    for prefix, name, _, _ in BOROUGHS:
        named = borough.like("%STATEN%") if "STATEN" in name else borough == name
        cond = cond | (named & zone.startswith(prefix))
    return cond


def quality_filter(df: DataFrame) -> DataFrame:
    """The eleven acceptance conditions, as one conjunction that the scan can use."""
    zone, borough = F.col("INCIDENT_DISPATCH_AREA"), F.col("BOROUGH")
    return df.filter(
        (F.col("VALID_INCIDENT_RSPNS_TIME_INDC") == "Y")
        & (F.col("VALID_DISPATCH_RSPNS_TIME_INDC") == "Y")
        & (F.col("REOPEN_INDICATOR") == "N")
        & (F.col("TRANSFER_INDICATOR") == "N")
        & (F.col("STANDBY_INDICATOR") == "N")
        & response_in_range(F.col("INCIDENT_RESPONSE_SECONDS_QY"))
        & borough.isNotNull()
        & (borough != "UNKNOWN")
        & zone.isin(ZONE_CODES)
        & zone_matches_borough(borough, zone)
        & F.col("INCIDENT_DATETIME").isNotNull()
    )


def typed_projection(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("INCIDENT_DATETIME").cast("timestamp_ntz").alias("incident_dt"),
        "CAD_INCIDENT_ID",
        "INCIDENT_DISPATCH_AREA",
        "BOROUGH",
        *[
            F.col(c).try_cast("double").alias(c)
            for c in ("INCIDENT_RESPONSE_SECONDS_QY", "INCIDENT_TRAVEL_TM_SECONDS_QY", "DISPATCH_RESPONSE_SECONDS_QY")
        ],
        F.col("FINAL_SEVERITY_LEVEL_CODE").try_cast("int").alias("FINAL_SEVERITY_LEVEL_CODE"),
        "HELD_INDICATOR",
    )


def with_flags(df: DataFrame, anomaly_year: int = 2020) -> DataFrame:
    return df.withColumns({
        "is_weekend": is_weekend(F.col("dayofweek")),
        "is_high_acuity": F.coalesce(F.col("FINAL_SEVERITY_LEVEL_CODE").isin(1, 2).cast("int"), F.lit(0)),
        "is_held": F.coalesce((F.col("HELD_INDICATOR") == "Y").cast("int"), F.lit(0)),
        "is_covid_year": (F.col("year") == anomaly_year).cast("int"),
    })


def clean(raw: DataFrame, split: Split | None = None) -> DataFrame:
    """Raw dispatch records to the cleaned fact: a single narrow stage."""
    facts = with_calendar(typed_projection(quality_filter(raw)), "incident_dt")
    facts = with_flags(facts)
    return facts.withColumn("split", (split or split_by_year())(facts))


def major_events(
    feed: DataFrame, start: str, end: str, kind: str | None, borough: str, first: str, last: str
) -> DataFrame:
    """Keeps crowd-drawing events that start in the window and have dates and a borough."""
    df = feed.withColumns({
        "event_start": F.to_date(F.try_to_timestamp(F.col(start))),
        "event_end": F.to_date(F.try_to_timestamp(F.col(end))),
        "event_borough": F.col(borough),
    })
    if kind:
        df = df.filter(F.col(kind).isin(MAJOR_EVENT_TYPES))
    window = F.col("event_start").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    return df.filter(window).dropna(subset=["event_start", "event_end", "event_borough"])
