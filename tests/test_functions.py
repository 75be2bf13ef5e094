import math

from pyspark.sql import functions as F

from sirenfield import dimensions as dim
from sirenfield.functions import calendar, geo, response, text, weather


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_constants(spark):
    assert len(dim.ZONES) == 31 and len(dim.FEATURES) == 21
    assert all(-74.3 < z[3] < -73.7 and 40.4 < z[4] < 41.0 and 0 <= z[5] <= 1 for z in dim.ZONES)
    assert [b[1] for b in dim.BOROUGHS][-1] == "RICHMOND / STATEN ISLAND"
    assert all(any(z[0].startswith(b[0]) and z[1] == b[1] for b in dim.BOROUGHS) for z in dim.ZONES)
    assert dim.zones(spark).count() == 31


def test_erf_and_lognormal_share(spark):
    xs = [x / 10 for x in range(-40, 41)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", response.erf(F.col("x")).alias("e")).collect()
    assert max(abs(r["e"] - math.erf(r["x"])) for r in rows) < 1.5e-7
    sigma = math.sqrt(math.log(1 + 0.95**2))
    z = (math.log(480) - (math.log(600) - sigma**2 / 2)) / sigma
    assert abs(one(spark, response.share_within(F.lit(600.0))) - 0.5 * (1 + math.erf(z / math.sqrt(2)))) < 1e-6
    assert one(spark, response.share_within(F.lit(0.0))) == 1.0


def test_distances_agree_and_drive_time_truncates(spark):
    p = [F.lit(v) for v in (-73.9101, 40.8116, -73.9196, 40.8448)]
    a, b = one(spark, geo.great_circle_km(*p)), one(spark, geo.great_circle_km_atan2(*p))
    assert abs(a - b) < 1e-9 and 3.5 < a < 4.0
    assert one(spark, geo.drive_seconds(*p)) == int(a * 1.35 / 25 * 3600)


def test_rings_close(spark):
    ring = one(spark, geo.circle_ring(F.lit(-73.9), F.lit(40.7), F.lit(3500.0)))
    assert len(ring) == 65 and abs(ring[0]["lat"] - ring[-1]["lat"]) < 1e-9
    assert abs(ring[0]["lat"] - 40.7 - 3.5 / 111.32) < 1e-9


def test_weather_and_bands(spark):
    assert abs(one(spark, weather.travel_factor(F.lit(10.0), F.lit(25.0))) - 1.14) < 1e-12
    assert one(spark, weather.travel_factor(F.lit(0.0), F.lit(5.0))) == 1.0
    assert [one(spark, response.svi_band(F.lit(v))) for v in (0.25, 0.26, 0.75, 0.76)] == ["Q1", "Q2", "Q3", "Q4"]
    assert [one(spark, response.vulnerability_label(F.lit(v))) for v in (0.75, 0.74, 0.25, 0.2)] == [
        "Very High", "High", "Moderate", "Low"]
    assert one(spark, response.observed_or(F.lit(7200.9), F.lit(5))) == 5
    assert one(spark, response.observed_or(F.lit(99.9), F.lit(5))) == 99
    assert one(spark, response.dispatch_default(F.lit(641))) == round(641 * 0.38)


def test_labels(spark):
    assert [one(spark, calendar.hour_label(F.lit(h))) for h in (0, 11, 12, 15)] == ["12AM", "11AM", "12PM", "3PM"]
    assert one(spark, calendar.day_name(F.lit(6))) == "Sunday" and one(spark, calendar.day_name(F.lit(9))) == "day 9"


def test_control_block(spark):
    good = 'Done. {"controls": {"hour": 20, "weather": "heavy"}} Bye'
    assert one(spark, text.control_json(F.lit(good))) == '{"hour": 20, "weather": "heavy"}'
    assert one(spark, text.without_control(F.lit(good))) == "Done.  Bye"
    bad = 'x {"controls": {oops}}'
    assert one(spark, text.control_json(F.lit(bad))) is None and one(spark, text.without_control(F.lit(bad))) == bad
