"""Control blocks inside free text, and scenario briefings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendar import day_name, hour_label

# Fixed value: the published pattern of a control block.
CONTROL_BLOCK = r'(?i)\{"controls"\s*:\s*(\{[^}]+\})\}'
CONTROL_SCHEMA = "hour int, dow int, weather string, ambulances int"


def control_json(text: Column) -> Column:
    """The JSON object of the first control block, NULL if absent or not JSON."""
    raw = F.regexp_extract(text, CONTROL_BLOCK, 1)
    parsed = F.from_json(raw, "map<string,string>")
    return F.when((raw != "") & parsed.isNotNull() & (F.size(parsed) > 0), raw)


def without_control(text: Column) -> Column:
    """Reply text without its control blocks; left whole if the block is no JSON."""
    raw = F.regexp_extract(text, CONTROL_BLOCK, 1)
    valid = (raw != "") & F.from_json(raw, "map<string,string>").isNotNull()
    return F.trim(F.when(valid, F.regexp_replace(text, CONTROL_BLOCK, "")).otherwise(text))


def fixed(x: Column, digits: int) -> Column:
    """Number text with a set count of decimals and no thousands separators."""
    return F.format_string(f"%.{digits}f", x)


def zone_phrase(zone: Column, borough: Column, count: Column) -> Column:
    return F.concat(F.lit("Zone "), zone, F.lit(" ("), borough, F.lit("): "), fixed(count, 1), F.lit(" calls/hr"))


def briefing(hour, dow, weather, ambulances, zone_phrases, pct_static, pct_staged, saved) -> Column:
    """Four-line scenario summary; missing figures read N/A."""
    # fixed values: the wording of the four lines
    zones = F.when(F.size(zone_phrases) > 0, F.array_join(F.slice(zone_phrases, 1, 5), ", "))
    na = F.lit("N/A")
    head = F.concat(
        F.lit("Time: "), day_name(dow), F.lit(" "), hour_label(hour), F.lit(" | Weather: "), weather,
        F.lit(" | Ambulances: "), ambulances.cast("string"),
    )
    return F.concat_ws(
        "\n",
        head,
        F.concat(F.lit("Top predicted zones: "), F.coalesce(zones, F.lit("no zone data available"))),
        F.concat(F.lit("Coverage without staging: "), F.coalesce(fixed(pct_static, 1), na), F.lit("% within 8 min")),
        F.concat(
            F.lit("Coverage WITH staging: "), F.coalesce(fixed(pct_staged, 1), na), F.lit("% within 8 min ("),
            F.coalesce(fixed(saved, 0), na), F.lit("s median saved)"),
        ),
    )
