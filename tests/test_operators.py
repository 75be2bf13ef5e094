import datetime as dt
import heapq
import json
import math
import random

import pytest

from pyspark.sql import functions as F

from sirenfield import dimensions as dim
from sirenfield.operators import aggregate, clean, enrich, graph, impact, model, place, quality, scenarios, travel
from sirenfield.sources import files

GOOD = dict(
    CAD_INCIDENT_ID="1", INCIDENT_DATETIME="2023-01-02 00:00:00", INCIDENT_DISPATCH_AREA="B1", BOROUGH="BRONX",
    INCIDENT_RESPONSE_SECONDS_QY="400", INCIDENT_TRAVEL_TM_SECONDS_QY="300", DISPATCH_RESPONSE_SECONDS_QY="100",
    FINAL_SEVERITY_LEVEL_CODE="2", HELD_INDICATOR="Y", VALID_INCIDENT_RSPNS_TIME_INDC="Y",
    VALID_DISPATCH_RSPNS_TIME_INDC="Y", REOPEN_INDICATOR="N", TRANSFER_INDICATOR="N", STANDBY_INDICATOR="N",
)
BREAKS = [
    ("VALID_INCIDENT_RSPNS_TIME_INDC", "N"), ("VALID_DISPATCH_RSPNS_TIME_INDC", "N"), ("REOPEN_INDICATOR", "Y"),
    ("TRANSFER_INDICATOR", "Y"), ("STANDBY_INDICATOR", "Y"), ("INCIDENT_RESPONSE_SECONDS_QY", "0"),
    ("INCIDENT_RESPONSE_SECONDS_QY", "7201"), ("INCIDENT_RESPONSE_SECONDS_QY", "n/a"), ("BOROUGH", None),
    ("BOROUGH", "UNKNOWN"), ("INCIDENT_DISPATCH_AREA", "Z9"), ("BOROUGH", "QUEENS"), ("INCIDENT_DATETIME", None),
]


def raw(spark, rows):
    return spark.createDataFrame([tuple(r[c] for c in GOOD) for r in rows], clean.RAW_SCHEMA)


def test_each_quality_condition_drops_its_row(spark):
    kept = [GOOD, {**GOOD, "CAD_INCIDENT_ID": "2", "INCIDENT_RESPONSE_SECONDS_QY": "7200"},
            {**GOOD, "CAD_INCIDENT_ID": "3", "BOROUGH": "RICHMOND / STATEN ISLAND", "INCIDENT_DISPATCH_AREA": "S2"}]
    df = clean.clean(raw(spark, kept + [{**GOOD, c: v} for c, v in BREAKS]))
    assert sorted(r["CAD_INCIDENT_ID"] for r in df.collect()) == ["1", "2", "3"]


def test_calendar_flags_and_split(spark):
    times = ["2023-01-02 00:00:00", "2022-01-02 23:59:00", "2020-05-05 10:00:00", "2018-05-05 10:00:00"]
    rows = [{**GOOD, "CAD_INCIDENT_ID": str(i), "INCIDENT_DATETIME": t} for i, t in enumerate(times)]
    out = {r["CAD_INCIDENT_ID"]: r for r in clean.clean(raw(spark, rows)).collect()}
    assert [out[str(i)]["split"] for i in range(4)] == ["test", "train", "exclude", "exclude"]
    assert [out[str(i)]["dayofweek"] for i in range(2)] == [0, 6]
    assert [out[str(i)]["is_weekend"] for i in range(2)] == [0, 1]
    assert out["2"]["is_covid_year"] == 1 and out["0"]["is_high_acuity"] == 1 and out["0"]["is_held"] == 1


def test_baselines_ignore_zero_days_unless_dense(spark):
    days = ["2022-01-03 08:00:00", "2022-01-03 08:30:00", "2022-01-10 08:00:00", "2022-01-17 09:00:00"]
    rows = [{**GOOD, "CAD_INCIDENT_ID": str(i), "INCIDENT_DATETIME": d} for i, d in enumerate(days)]
    facts = clean.clean(raw(spark, rows))
    at8 = lambda df: df.filter("hour = 8").first()["zone_baseline_avg"]
    assert at8(aggregate.zone_baselines(facts)) == 1.5
    assert at8(aggregate.zone_baselines(facts, dense=True)) == 1.0


def test_event_days_cap_and_reversed_ranges(spark):
    d = dt.date
    df = spark.createDataFrame(
        [(d(2023, 12, 30), d(2024, 1, 5), " Bronx "), (d(2023, 12, 31), d(2023, 12, 30), "Queens"),
         (d(2023, 12, 30), d(2023, 12, 30), "Bronx"), (d(2023, 12, 30), d(2023, 12, 30), "Elsewhere")],
        "event_start date, event_end date, event_borough string")
    got = sorted((r["event_date"], r["zone_prefix"]) for r in enrich.event_days(df, "2023-12-31").collect())
    assert got == [(d(2023, 12, 30), "B"), (d(2023, 12, 31), "B")]


def test_school_days(spark):
    days = spark.createDataFrame([(dt.date(2023, 9, 6),), (dt.date(2023, 9, 7),), (dt.date(2023, 9, 9),),
                                  (dt.date(2023, 10, 9),)], "school_date date")
    got = {r["school_date"].isoformat(): r["is_school_day"] for r in enrich.school_days(days).collect()}
    assert got == {"2023-09-06": 0, "2023-09-07": 1, "2023-09-09": 0, "2023-10-09": 0}


def test_unit_allocation_equals_handing_out_one_by_one(spark):
    rng = random.Random(7)
    demands, want = [], {}
    for s in range(60):
        k = rng.randint(1, 10)
        names = [f"b{i}" for i in range(5)]
        d = {n: float(rng.randint(1, 40)) for n in names}
        demands += [(str(s), n, d[n], i, 5, k) for i, n in enumerate(names)]
        ranked = sorted(names, key=lambda n: (-d[n], n))
        held = {n: int(i < k or k >= 5) for i, n in enumerate(ranked)}
        for _ in range(max(0, k - 5)):
            held[max(ranked, key=lambda n: d[n] / held[n])] += 1
        want.update({(str(s), n): held[n] for n in names})
    df = spark.createDataFrame(demands, "id string, borough string, predicted double, zone_ord int, n int, k int")
    ranks = place.borough_ranks(df, "id")
    units = df.select("id", F.col("k").alias("units")).distinct()
    got = {(r["id"], r["borough"]): r["clusters"] for r in place.allocate_units(ranks, units, "id").collect()}
    assert got == want


def _forecast(spark, seed, n_scenarios):
    rng = random.Random(seed)
    rows = [(f"s{s}", i, z[0], z[1], z[3], z[4], rng.uniform(0.1, 20)) for s in range(n_scenarios) for i, z in enumerate(dim.ZONES)]
    schema = "id string, zone_ord int, zone string, borough string, lon double, lat double, predicted double"
    return spark.createDataFrame(rows, schema), rows


def _plain_kmeans(points, k):
    """points: (ord, w, lat, lon); the same seeding and iteration in plain Python."""
    d2 = lambda p, c: (p[2] - c[0]) ** 2 + (p[3] - c[1]) ** 2
    first = max(points, key=lambda p: (p[1], -p[0]))
    centres = [(first[2], first[3])]
    while len(centres) < k:
        far = max(points, key=lambda p: (p[1] * min(d2(p, c) for c in centres), -p[0]))
        centres.append((far[2], far[3]))
    labels = None
    while True:
        new = [min(range(k), key=lambda j: (d2(p, centres[j]), j)) for p in points]
        if new == labels:
            return centres, labels
        labels = new
        for j in range(k):
            m = [p for p, lab in zip(points, labels) if lab == j]
            if m:
                w = sum(p[1] for p in m)
                centres[j] = (sum(p[1] * p[2] for p in m) / w, sum(p[1] * p[3] for p in m) / w)


def test_global_placement_equals_plain_kmeans(spark):
    df, rows = _forecast(spark, 3, 6)
    got = place.global_placement(df, "id", F.lit(5)).collect()
    for s in range(6):
        pts = [(r[1], max(r[6], 0.01), r[5], r[4]) for r in rows if r[0] == f"s{s}"]
        centres, labels = _plain_kmeans(pts, 5)
        mine = sorted((round(r["lat"], 8), round(r["lon"], 8), tuple(r["cluster_zones"])) for r in got if r["id"] == f"s{s}")
        want = sorted((round(c[0], 8), round(c[1], 8), tuple(sorted(dim.ZONE_CODES[p[0]] for p, lab in zip(pts, labels) if lab == j)))
                      for j, c in enumerate(centres))
        assert mine == want


def test_borough_placement_covers_every_zone_once(spark):
    df, _ = _forecast(spark, 5, 10)
    units = df.select("id").distinct().withColumn("units", (F.substring("id", 2, 2).cast("int") + 1))
    got = place.borough_placement(df, units, "id").collect()
    for s in range(10):
        mine = [r for r in got if r["id"] == f"s{s}"]
        zones = [z for r in mine for z in r["cluster_zones"]]
        assert len(zones) == len(set(zones)) and len(mine) == s + 1
        assert s < 4 or len(zones) == 31
        assert [r["staging_index"] for r in sorted(mine, key=lambda r: -r["predicted_demand_coverage"])] == list(range(s + 1))


def test_apportion_units(spark):
    df = spark.createDataFrame([("a", 0, 5.0, 7), ("a", 1, 3.0, 7), ("a", 2, 1.0, 7), ("b", 0, 2.0, 2), ("b", 1, 5.0, 2), ("b", 2, 1.0, 2)],
                               "id string, staging_index int, predicted_demand_coverage double, k int")
    got = {(r["id"], r["staging_index"]): r["units_shown"] for r in place.apportion_units(df, "id", "k").collect()}
    assert got == {("a", 0): 3, ("a", 1): 2, ("a", 2): 2, ("b", 0): 1, ("b", 1): 1, ("b", 2): 0}


def test_nearest_node_equals_brute_force(spark):
    rng = random.Random(1)
    crowd = [(i, -73.9 + rng.gauss(0, 0.001), 40.7 + rng.gauss(0, 0.001)) for i in range(300)]
    nodes = crowd + [(1000 + i, rng.uniform(-74.3, -73.6), rng.uniform(40.4, 41.0)) for i in range(60)] + [(5000, crowd[0][1], crowd[0][2])]
    points = [(f"p{i}", rng.uniform(-74.3, -73.6), rng.uniform(40.4, 41.0)) for i in range(80)] + [("far", -60.0, 10.0)]

    def metres(p, n):
        a = math.sin(math.radians(n[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(n[2])) * math.sin(math.radians(n[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(a))

    got = travel.nearest_node(spark.createDataFrame(points, "point_id string, lon double, lat double"),
                              spark.createDataFrame(nodes, "node_id long, lon double, lat double")).collect()
    assert len(got) == len(points)
    by_id = {r["point_id"]: r for r in got}
    for p in points:
        best = min(nodes, key=lambda n: (metres(p, n), n[0]))
        assert abs(by_id[p[0]]["metres"] - metres(p, best)) < 1e-3 and by_id[p[0]]["node_id"] == best[0]
        assert by_id[p[0]]["is_far"] == int(metres(p, best) > 500)


def test_least_costs_equal_dijkstra(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40), float(rng.randint(1, 30))) for _ in range(110)]
    got = graph.least_costs(spark.createDataFrame(edges, "src long, dst long, cost double"),
                            spark.createDataFrame([("a", 0), ("b", 7)], "origin string, node long")).collect()
    for name, start in (("a", 0), ("b", 7)):
        dist, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            for s, t, c in edges:
                if s == u and d + c < dist.get(t, math.inf):
                    dist[t] = d + c
                    heapq.heappush(heap, (d + c, t))
        assert {r["node"]: r["cost"] for r in got if r["origin"] == name} == dist


def test_drive_matrix_sentinel_and_fallback(spark):
    edges = spark.createDataFrame([(0, 1, 100.7)], "src long, dst long, cost double")
    zone_nodes = spark.createDataFrame([("B1", 0), ("B2", 1)], "zone string, node long")
    nodes = zone_nodes.select(F.col("zone").alias("origin"), "node")
    m = {(r["origin"], r["dest"]): r["seconds"]
         for r in graph.drive_matrix(edges, nodes, zone_nodes, travel.zone_origins(spark)).collect()}
    assert m["B1", "B2"] == 100 and m["B2", "B1"] == 9999 and m["B1", "B1"] == 0 and 0 < m["M1", "M2"] < 9999


def test_quartile_bands_keep_ties_together(spark):
    values = [0.1] * 5 + [0.2] * 3 + [0.5] * 4 + [0.9] * 4
    df = impact.quantile_band(spark.createDataFrame([(v,) for v in values], "svi double"), "svi")
    assert {r["svi"]: r["svi_quartile"] for r in df.collect()} == {0.1: "Q1", 0.2: "Q2", 0.5: "Q3", 0.9: "Q4"}


def test_request_bounds(spark):
    rows = [(1, 5, 2, None, 20.04, None, 1.0, None), (2, 24, 2, 1, 1.0, 0.0, 1.0, 5), (3, 1, 7, 13, 1.0, 0.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "request_id int, hour int, dow int, month int, temperature double, precipitation double, windspeed double, ambulances int")
    ok = scenarios.valid_requests(df).collect()
    assert [(r["request_id"], r["month"], r["temperature"], r["precipitation"], r["ambulances"]) for r in ok] == [(1, 10, 20.0, 0.0, 5)]
    assert {r["request_id"]: r["rejected_for"] for r in scenarios.rejected_requests(df).collect()} == {2: "hour", 3: "dow,month,ambulances"}


def test_expectations(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "r double")
    got = {r["check_name"]: r["passed"] for r in quality.expect(df, "t", **{
        "in 0..1": (quality.violations(F.col("r").between(0, 1)), F.col("value") == 0), "rows": (F.count("*"), F.col("value") == 3)}).collect()}
    assert got == {"t: in 0..1": False, "t: rows": True}
    assert not quality.required_columns(df, "t", ["r", "x"]).first()["passed"]


def test_csv_scan_drops_malformed_rows(spark, tmp_path):
    (tmp_path / "in.csv").write_text(",".join(GOOD) + "\n" + ",".join(GOOD.values()) + "\n" + ",".join(GOOD.values()) + ",extra,extra\n")
    assert files.read_incident_csv(spark, str(tmp_path / "in.csv")).count() == 1


def test_json_sources_and_versions(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"hourly": {"time": ["2023-01-01T00:00", "2023-01-01T01:00"], "temperature_2m": [1.0, 2.0],
                                                          "precipitation": [0.0, 0.1], "windspeed_10m": [5.0, 6.0], "weathercode": [0, 61]}}, indent=1))
    assert [r["weathercode"] for r in files.read_weather_payload(spark, str(tmp_path / "w.json")).collect()] == [0, 61]
    (tmp_path / "z.json").write_text(json.dumps({"B1": {"lon": 1.0, "lat": 2.0}, "B2": {"lon": 3.0, "lat": 4.0}}, indent=1))
    assert {r["zone"]: r["lat"] for r in files.read_keyed_object(spark, str(tmp_path / "z.json"), "struct<lon: double, lat: double>").collect()} == {"B1": 2.0, "B2": 4.0}
    table = files.VersionedTable(spark, str(tmp_path / "t"))
    first = table.replace(spark.range(3))
    second = table.replace(first.withColumn("x", F.col("id") * 2))
    assert first.count() == 3 and second.columns == ["id", "x"] and table.read().count() == 3
    assert files.normalised("Start Date/Time ") == "start_date_time"


def test_heat_emergency_looks_back_24_rows(spark):
    start = dt.datetime(2023, 7, 1)
    rows = [(start + dt.timedelta(hours=h), 33.0 if h == 0 else 20.0, 0, "city") for h in range(26)]
    df = spark.createDataFrame(rows, "date_hour timestamp, temperature_2m double, weathercode int, location string")
    got = [r["is_heat_emergency"] for r in enrich.with_weather_flags(df).orderBy("date_hour").collect()]
    assert got == [1] * 24 + [0, 0]


def test_csv_columns_are_found_by_name(spark, tmp_path):
    names = ["extra", *reversed(GOOD)]
    rows = [{**GOOD, "extra": "x"}, {**GOOD, "extra": "", "INCIDENT_DATETIME": "07/04/2023 11:30:00 PM"}, {**GOOD, "extra": "", "INCIDENT_DATETIME": "soon"}]
    (tmp_path / "in.csv").write_text("\n".join([",".join(names), *[",".join(r[n] for n in names) for r in rows], "a,b,c"]) + "\n")
    got = files.read_incident_csv(spark, str(tmp_path / "in.csv"))
    assert got.columns == list(GOOD) and got.count() == 3
    assert {r["BOROUGH"] for r in got.collect()} == {GOOD["BOROUGH"]}
    assert sorted(str(r["INCIDENT_DATETIME"]) for r in got.collect())[1:] == ["2023-07-04 23:30:00", "None"]
    (tmp_path / "short.csv").write_text("BOROUGH,x\nBRONX,1\n")
    with pytest.raises(ValueError, match="CAD_INCIDENT_ID"):
        files.read_incident_csv(spark, str(tmp_path / "short.csv"))


def test_version_numbers_are_claimed_once(spark, tmp_path):
    table = files.VersionedTable(spark, str(tmp_path / "t"))
    assert [table._claim(), table._claim(), table._claim()] == [1, 2, 3]
    table.replace(spark.range(2))
    log = next((tmp_path / "t" / "log").glob("*.json"))
    (tmp_path / "t" / "log").joinpath("broken.parquet.json").write_text("")
    assert table.read().count() == 2 and log.exists()


def test_weather_joins_by_location_or_counts_once(spark):
    hour = dt.datetime(2023, 7, 1, 5)
    weather = spark.createDataFrame([(hour, "b", 1.0), (hour, "a", 2.0)], "date_hour timestamp, location string, temperature_2m double")
    facts = spark.createDataFrame([(1, hour), (2, hour), (3, hour + dt.timedelta(hours=1))], "id int, date_hour timestamp")
    assert {r["id"]: r["temperature_2m"] for r in enrich.join_weather(facts, weather).collect()} == {1: 2.0, 2: 2.0, 3: None}
    placed = enrich.join_weather(facts.withColumn("location", F.lit("b")), weather)
    assert {r["id"]: r["temperature_2m"] for r in placed.collect()} == {1: 1.0, 2: 1.0, 3: None}


def test_patience_of_boosting():
    assert model.best_round([5.0, 4.0, 4.5, 3.0, 3.5, 3.6], 2) == 4
    assert model.best_round([5.0, 4.0, 4.5, 4.6, 3.0], 2) == 2
    assert model.best_round([1.0], 20) == 1


def test_cases_in_one_aggregate(spark):
    rows = [("x", "base", 1.0), ("x", "hot", 3.0), ("x", "cold", 0.5), ("y", "base", 2.0), ("y", "hot", 2.0), ("y", "cold", 2.0)]
    got = model.compare_cases(spark.createDataFrame(rows, "k string, case string, predicted double"), "case", ("hot", "cold"), "base", "k")
    assert {(r["k"], r["case"]): r["delta"] for r in got.collect()} == {("x", "hot"): 2.0, ("x", "cold"): -0.5, ("y", "hot"): 0.0, ("y", "cold"): 0.0}
