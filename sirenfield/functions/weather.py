"""Weather flags and factors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dimensions import SEVERE_WEATHER_CODES

EXTREME_HEAT_C = 35.0
SUSTAINED_HEAT_C = 32.2


def severe_by_code(code: Column) -> Column:
    """Observed severity: membership in the WMO code list."""
    return code.isin(SEVERE_WEATHER_CODES).cast("int")


def severe_by_rain(precipitation: Column) -> Column:
    """Scenario severity: more than 5 mm/h (scenarios carry no weather code)."""
    return (precipitation > 5).cast("int")


def extreme_heat(temperature: Column) -> Column:
    return (temperature >= EXTREME_HEAT_C).cast("int")


def travel_factor(precipitation: Column, windspeed: Column) -> Column:
    """Slow-down of travel: 1.2 % per mm/h rain, 0.2 % per km/h wind above 15."""
    return 1.0 + 0.012 * precipitation + 0.002 * F.greatest(F.lit(0.0), windspeed - 15)


def weather_preset(precipitation: Column) -> Column:
    return F.when(precipitation > 5, "heavy").when(precipitation > 0, "light").otherwise("none")


def heat_index_f(t: Column, r: Column) -> Column:
    """Rothfusz regression; ``t`` in Fahrenheit, ``r`` relative humidity in percent."""
    return (
        -42.379 + 2.04901523 * t + 10.14333127 * r - 0.22475541 * t * r - 0.00683783 * t * t
        - 0.05481717 * r * r + 0.00122874 * t * t * r + 0.00085282 * t * r * r - 0.00000199 * t * t * r * r
    )
