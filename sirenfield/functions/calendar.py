"""Calendar parts and cyclical encodings (Monday is day 0 throughout)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dimensions import DAY_NAMES


def hour_bucket(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def with_calendar(df: DataFrame, ts: str) -> DataFrame:
    """Adds year, month, dayofweek, hour, date_hour and incident_date."""
    t = F.col(ts)
    return df.withColumns({
        "year": F.year(t),
        "month": F.month(t),
        "dayofweek": F.weekday(t),
        "hour": F.hour(t),
        "date_hour": hour_bucket(t),
        "incident_date": F.to_date(t),
    })


def is_weekend(dow: Column) -> Column:
    return dow.isin(5, 6).cast("int")


def cyclical(x: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * x / F.lit(period)
    return F.sin(angle), F.cos(angle)


def with_cyclical(df: DataFrame, hour="hour", dow="dayofweek", month="month") -> DataFrame:
    out = {}
    for name, col, period in (("hour", hour, 24), ("dow", dow, 7), ("month", month, 12)):
        out[f"{name}_sin"], out[f"{name}_cos"] = cyclical(F.col(col), period)
    return df.withColumns(out)


def hour_label(hour: Column) -> Column:
    """12-hour clock label: 0 -> 12AM, 15 -> 3PM."""
    h12 = F.when(hour % 12 == 0, F.lit(12)).otherwise(hour % 12)
    return F.concat(h12.cast("string"), F.when(hour < 12, "AM").otherwise("PM"))


def day_name(dow: Column) -> Column:
    known = F.get(F.array(*[F.lit(d) for d in DAY_NAMES]), dow)
    return F.coalesce(known, F.concat(F.lit("day "), dow.cast("string")))
