"""Fixed city dimensions and the small DataFrames built from them.

Everything here is bounded by construction (31 zones, 5 boroughs, a few
hundred calendar dates), which is what makes broadcasting these tables safe
at any fact size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. They must equal the published ones for results to agree.
# ---------------------------------------------------------------------------

# zone, borough, name, lon, lat, svi, svi label, acuity, held, response seconds
ZONES = [
    ("B1", "BRONX", "South Bronx", -73.9101, 40.8116, 0.94, "Q4", 0.29, 0.10, 641),
    ("B2", "BRONX", "West/Central Bronx", -73.9196, 40.8448, 0.89, "Q4", 0.28, 0.09, 638),
    ("B3", "BRONX", "East Bronx", -73.8784, 40.8189, 0.87, "Q4", 0.26, 0.09, 629),
    ("B4", "BRONX", "North Bronx", -73.8600, 40.8784, 0.72, "Q3", 0.24, 0.08, 598),
    ("B5", "BRONX", "Riverdale", -73.9056, 40.8651, 0.68, "Q3", 0.22, 0.08, 589),
    ("K1", "BROOKLYN", "Southern Brooklyn", -73.9857, 40.5995, 0.52, "Q2", 0.21, 0.07, 521),
    ("K2", "BROOKLYN", "Park Slope", -73.9442, 40.6501, 0.58, "Q2", 0.23, 0.07, 548),
    ("K3", "BROOKLYN", "Bushwick", -73.9075, 40.6929, 0.82, "Q4", 0.27, 0.08, 571),
    ("K4", "BROOKLYN", "East New York", -73.9015, 40.6501, 0.84, "Q4", 0.27, 0.08, 579),
    ("K5", "BROOKLYN", "Bed-Stuy", -73.9283, 40.6801, 0.79, "Q3", 0.25, 0.08, 562),
    ("K6", "BROOKLYN", "Borough Park", -73.9645, 40.6401, 0.60, "Q3", 0.22, 0.07, 534),
    ("K7", "BROOKLYN", "Williamsburg", -73.9573, 40.7201, 0.45, "Q1", 0.21, 0.07, 542),
    ("M1", "MANHATTAN", "Lower Manhattan", -74.0060, 40.7128, 0.31, "Q1", 0.20, 0.06, 489),
    ("M2", "MANHATTAN", "Midtown South", -74.0000, 40.7484, 0.18, "Q1", 0.19, 0.06, 498),
    ("M3", "MANHATTAN", "Midtown", -73.9857, 40.7580, 0.15, "Q1", 0.20, 0.07, 512),
    ("M4", "MANHATTAN", "Murray Hill", -73.9784, 40.7484, 0.20, "Q1", 0.19, 0.06, 503),
    ("M5", "MANHATTAN", "Upper East Side S", -73.9584, 40.7701, 0.12, "Q1", 0.18, 0.06, 495),
    ("M6", "MANHATTAN", "Upper East Side N", -73.9484, 40.7884, 0.14, "Q1", 0.18, 0.06, 490),
    ("M7", "MANHATTAN", "Harlem", -73.9428, 40.8048, 0.73, "Q3", 0.25, 0.08, 558),
    ("M8", "MANHATTAN", "Washington Heights S", -73.9373, 40.8284, 0.65, "Q3", 0.24, 0.07, 541),
    ("M9", "MANHATTAN", "Washington Heights N", -73.9312, 40.8484, 0.61, "Q3", 0.23, 0.07, 528),
    ("Q1", "QUEENS", "Far Rockaway", -73.7840, 40.6001, 0.71, "Q3", 0.22, 0.07, 502),
    ("Q2", "QUEENS", "Flushing", -73.8284, 40.7501, 0.44, "Q1", 0.21, 0.06, 518),
    ("Q3", "QUEENS", "Forest Hills", -73.8784, 40.7201, 0.38, "Q1", 0.20, 0.06, 509),
    ("Q4", "QUEENS", "Ridgewood", -73.9073, 40.7101, 0.55, "Q2", 0.21, 0.06, 513),
    ("Q5", "QUEENS", "Jamaica", -73.8073, 40.6901, 0.67, "Q3", 0.22, 0.07, 516),
    ("Q6", "QUEENS", "Astoria", -73.9173, 40.7701, 0.48, "Q2", 0.21, 0.06, 525),
    ("Q7", "QUEENS", "Whitestone", -73.8373, 40.7701, 0.41, "Q1", 0.19, 0.06, 499),
    ("S1", "RICHMOND / STATEN ISLAND", "North Shore SI", -74.1115, 40.6401, 0.38, "Q1", 0.19, 0.05, 468),
    ("S2", "RICHMOND / STATEN ISLAND", "Mid-Island SI", -74.1515, 40.5901, 0.32, "Q1", 0.18, 0.05, 449),
    ("S3", "RICHMOND / STATEN ISLAND", "South Shore SI", -74.1915, 40.5301, 0.28, "Q1", 0.17, 0.05, 431),
]

# zone prefix, borough, event-feed borough spelling, boundary radius in degrees
BOROUGHS = [
    ("B", "BRONX", "Bronx", 0.022),
    ("K", "BROOKLYN", "Brooklyn", 0.020),
    ("M", "MANHATTAN", "Manhattan", 0.015),
    ("Q", "QUEENS", "Queens", 0.022),
    ("S", "RICHMOND / STATEN ISLAND", "Staten Island", 0.025),
]

# fixed values: ZIP codes of the zones; one that occurs twice belongs to the first
ZONE_ZIPS = {
    "B1": ["10451", "10452", "10454", "10455", "10459", "10474"],
    "B2": ["10453", "10456", "10457", "10458", "10460"],
    "B3": ["10462", "10472", "10473"],
    "B4": ["10461", "10464", "10465", "10469", "10470", "10475"],
    "B5": ["10463", "10466", "10467", "10468", "10471"],
    "K1": ["11223", "11224", "11229", "11235"],
    "K2": ["11215", "11217", "11225", "11226", "11238"],
    "K3": ["11206", "11207", "11221", "11233", "11237"],
    "K4": ["11203", "11208", "11210", "11212", "11236", "11239"],
    "K5": ["11205", "11213", "11216", "11233", "11238"],
    "K6": ["11204", "11218", "11219", "11220", "11230", "11232"],
    "K7": ["11201", "11205", "11211", "11222", "11249"],
    "M1": ["10004", "10005", "10006", "10007", "10038", "10280"],
    "M2": ["10001", "10010", "10011", "10012", "10013", "10014"],
    "M3": ["10018", "10019", "10020", "10036"],
    "M4": ["10016", "10017", "10022", "10152", "10153", "10154"],
    "M5": ["10021", "10028", "10065", "10075"],
    "M6": ["10128", "10029"],
    "M7": ["10026", "10027", "10029", "10030", "10035", "10037"],
    "M8": ["10031", "10032", "10033"],
    "M9": ["10034", "10040", "10463"],
    "Q1": ["11691", "11692", "11693", "11694", "11697"],
    "Q2": ["11354", "11355", "11356", "11357", "11358", "11359", "11360"],
    "Q3": ["11374", "11375", "11379", "11385"],
    "Q4": ["11101", "11102", "11103", "11104", "11377", "11378"],
    "Q5": ["11412", "11413", "11418", "11419", "11420", "11421", "11423", "11432", "11433", "11434", "11435", "11436"],
    "Q6": ["11101", "11102", "11103", "11106"],
    "Q7": ["11361", "11362", "11363", "11364", "11365", "11366", "11367"],
    "S1": ["10301", "10302", "10303", "10304", "10310"],
    "S2": ["10305", "10306", "10314"],
    "S3": ["10307", "10308", "10309", "10312"],
}

# fixed values: WMO codes of severe weather
SEVERE_WEATHER_CODES = [51, 53, 55, 61, 63, 65, 71, 73, 75, 77, 80, 81, 82, 85, 86, 95, 96, 99]

# fixed values: kinds of events that count as major
MAJOR_EVENT_TYPES = [
    "Special Event", "Farmers Market", "Fair/Festival", "Festival", "Athletic Event", "Concert",
    "Parade", "Street Fair", "Block Party", "Run/Walk/Race", "Demonstration/Rally",
]

# fixed values: federal holidays as observed
FEDERAL_HOLIDAYS = [
    "2019-01-01", "2019-01-21", "2019-02-18", "2019-05-27", "2019-07-04", "2019-09-02", "2019-10-14", "2019-11-11",
    "2019-11-28", "2019-12-25",
    "2020-01-01", "2020-01-20", "2020-02-17", "2020-05-25", "2020-07-03", "2020-09-07", "2020-10-12", "2020-11-11",
    "2020-11-26", "2020-12-25",
    "2021-01-01", "2021-01-18", "2021-02-15", "2021-05-31", "2021-06-19", "2021-07-05", "2021-09-06", "2021-10-11",
    "2021-11-11", "2021-11-25", "2021-12-24",
    "2022-01-17", "2022-02-21", "2022-05-30", "2022-06-20", "2022-07-04", "2022-09-05", "2022-10-10", "2022-11-11",
    "2022-11-24", "2022-12-26",
    "2023-01-02", "2023-01-16", "2023-02-20", "2023-05-29", "2023-06-19", "2023-07-04", "2023-09-04", "2023-10-09",
    "2023-11-10", "2023-11-23", "2023-12-25",
]

# fixed values: election days, Rosh Hashanah, Yom Kippur
CITY_HOLIDAYS = [
    "2019-11-05",
    "2020-11-03",
    "2021-11-02",
    "2022-11-08",
    "2023-11-07",
    "2019-09-29", "2019-09-30",
    "2021-09-06", "2021-09-07",
    "2022-09-25", "2022-09-26",
    "2023-09-15", "2023-09-16",
    "2019-10-08", "2019-10-09",
    "2021-09-15", "2021-09-16",
    "2022-10-04", "2022-10-05",
    "2023-09-24", "2023-09-25",
]

# fixed values: first and last day of each school year
SCHOOL_SESSIONS = [
    ("2019-09-05", "2020-03-17"),
    ("2020-09-16", "2021-06-25"),
    ("2021-09-13", "2022-06-27"),
    ("2022-09-08", "2023-06-27"),
    ("2023-09-07", "2024-06-26"),
]

# fixed values: days without school within the sessions
SCHOOL_CLOSURES = [
    "2019-10-14", "2019-11-05", "2019-11-11", "2019-11-27", "2019-11-28", "2019-11-29", "2019-12-24", "2019-12-25",
    "2019-12-26", "2019-12-27", "2019-12-28", "2019-12-31",
    "2020-01-01", "2020-01-20", "2020-02-17", "2020-02-18", "2020-02-19", "2020-02-20", "2020-02-21", "2020-11-03",
    "2020-11-26", "2020-11-27", "2020-12-24", "2020-12-25", "2020-12-28", "2020-12-29", "2020-12-30", "2020-12-31",
    "2021-01-01", "2021-01-18", "2021-02-15", "2021-02-16", "2021-02-17", "2021-02-18", "2021-02-19", "2021-04-01",
    "2021-04-02", "2021-04-05", "2021-04-06", "2021-04-07", "2021-04-08", "2021-04-09", "2021-05-31", "2021-10-11",
    "2021-11-02", "2021-11-25", "2021-11-26", "2021-12-23", "2021-12-24", "2021-12-27", "2021-12-28", "2021-12-29",
    "2021-12-30", "2021-12-31",
    "2022-01-17", "2022-02-21", "2022-02-22", "2022-02-23", "2022-02-24", "2022-02-25", "2022-04-14", "2022-04-15",
    "2022-04-18", "2022-04-19", "2022-04-20", "2022-04-21", "2022-04-22", "2022-05-30", "2022-09-26", "2022-10-05",
    "2022-10-10", "2022-11-08", "2022-11-24", "2022-11-25", "2022-12-23", "2022-12-26", "2022-12-27", "2022-12-28",
    "2022-12-29", "2022-12-30",
    "2023-01-02", "2023-01-16", "2023-02-20", "2023-02-21", "2023-02-22", "2023-02-23", "2023-02-24", "2023-04-05",
    "2023-04-06", "2023-04-07", "2023-04-10", "2023-04-11", "2023-04-12", "2023-04-13", "2023-04-14", "2023-05-29",
    "2023-09-15", "2023-09-16", "2023-10-09", "2023-11-07", "2023-11-23", "2023-11-24", "2023-12-25", "2023-12-26",
    "2023-12-27", "2023-12-28", "2023-12-29",
    "2024-01-01", "2024-01-15", "2024-02-19", "2024-02-20", "2024-02-21", "2024-02-22", "2024-02-23", "2024-03-29",
    "2024-04-01", "2024-04-02", "2024-04-03", "2024-04-04", "2024-04-05", "2024-05-27",
]

# preset name, temperature, precipitation, wind speed, label
WEATHER_PRESETS = [
    ("none", 22.0, 0.0, 8.0, "Clear"),
    ("light", 10.0, 4.0, 20.0, "Light Rain"),
    ("heavy", 4.0, 12.0, 40.0, "Heavy Storm"),
]

# scenario name, hour, dow, month, temperature, precipitation, wind speed, units
SCENARIO_PRESETS = [
    ("friday_peak", 20, 4, 10, 15.0, 0.0, 10.0, 5),
    ("monday_quiet", 4, 0, 10, 15.0, 0.0, 10.0, 5),
    ("storm", 18, 2, 11, 8.0, 8.0, 30.0, 7),
]

DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

THRESHOLD_SECONDS = 480
UNREACHABLE_SECONDS = 9999
COVERAGE_RADIUS_M = 3500
EARTH_RADIUS_KM = 6371.0
CIRCUITY = 1.35
URBAN_KMH = 25.0
TRAVEL_FLOOR_SECONDS = 120
RESPONSE_CV = 0.95
BORROW_RADIUS_KM = 2.0
DISPATCH_SHARE = 0.38

FEATURES = [
    "hour_sin", "hour_cos", "dow_sin", "dow_cos", "month_sin", "month_cos", "is_weekend",
    "temperature_2m", "precipitation", "windspeed_10m", "is_severe_weather", "svi_score",
    "zone_baseline_avg", "high_acuity_ratio", "held_ratio", "is_holiday", "is_major_event",
    "is_school_day", "is_heat_emergency", "is_extreme_heat", "subway_disruption_idx",
]

# ---------------------------------------------------------------------------
# Derived lookups
# ---------------------------------------------------------------------------

ZONE_CODES = [z[0] for z in ZONES]
BOROUGH_NAMES = [b[1] for b in BOROUGHS]
HOLIDAYS_EXTRA_2024 = ["2024-01-01", "2024-01-15"]

ZONE_SCHEMA = (
    "zone_ord int, zone string, borough string, zone_name string, lon double, lat double, "
    "svi_score double, svi_label string, acuity_default double, held_default double, response_default int"
)


def local_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A literal table whose size Catalyst knows (Arrow input stays a local
    relation, so no Python task runs and joins broadcast it on statistics)."""
    names = [part.split()[0] for part in ddl.split(",")]
    columns = {n: list(col) for n, col in zip(names, zip(*rows))}
    return spark.createDataFrame(pa.table(columns), ddl)


def zones(spark: SparkSession) -> DataFrame:
    """The 31 dispatch zones, in their published order."""
    return local_table(spark, [(i, *row) for i, row in enumerate(ZONES)], ZONE_SCHEMA)


def zone_array() -> Column:
    """All zones as one literal array, so that a row can be fanned out to 31
    rows inside its own task (``explode``) instead of through a join."""
    names = ["zone_ord", "zone", "zone_borough", "lon", "lat", "svi_default"]
    return F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, (i, z[0], z[1], z[3], z[4], z[5]))])
        for i, z in enumerate(ZONES)
    ])


def boroughs(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        [(i, *b) for i, b in enumerate(BOROUGHS)],
        "borough_ord int, prefix string, borough string, feed_name string, radius_deg double",
    )


def literal_map(pairs: dict) -> Column:
    """A literal map column for in-task lookups of a handful of values."""
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def borough_of(zone: Column) -> Column:
    return literal_map({b[0]: b[1] for b in BOROUGHS})[F.substring(zone, 1, 1)]


def date_table(spark: SparkSession, dates: list[str], name: str) -> DataFrame:
    return local_table(spark, [(d,) for d in dates], "d string").select(F.to_date("d").alias(name))


def school_sessions(spark: SparkSession) -> DataFrame:
    return local_table(spark, SCHOOL_SESSIONS, "s string, e string").select(
        F.to_date("s").alias("session_start"), F.to_date("e").alias("session_end")
    )


def zone_zips(spark: SparkSession) -> DataFrame:
    """Zone to ZIP pairs with the zone's order; a ZIP may occur under several zones."""
    rows = [(ZONE_CODES.index(z), z, p) for z, zips in ZONE_ZIPS.items() for p in zips]
    return local_table(spark, rows, "zone_ord int, zone string, zip string")


def weather_presets(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        WEATHER_PRESETS,
        "weather string, temperature double, precipitation double, windspeed double, weather_label string",
    )


def scenario_presets(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        SCENARIO_PRESETS,
        "scenario string, hour int, dow int, month int, temperature double, precipitation double, "
        "windspeed double, ambulances int",
    )
