"""Gaps, fallbacks and inserts on hand-made inputs, and the sources that meet them."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from sirenfield import dimensions as dim
from sirenfield.operators import enrich, impact, model, quality, scenarios, travel
from sirenfield.sources import files
from tests.test_operators import GOOD


# ---- sources ---------------------------------------------------------------------------------------


def test_folder_of_files_with_different_headers(spark, tmp_path):
    """Two eras: other order, other columns, quoted names; every row of both is read, malformed ones are dropped and counted."""
    names = list(GOOD)
    early = [{**GOOD, "CAD_INCIDENT_ID": f"e{i}"} for i in range(5)]
    late = [{**GOOD, "CAD_INCIDENT_ID": f"l{i}", "NEW": "x", "INCIDENT_DATETIME": "07/04/2023 11:30:00 PM"} for i in range(7)]
    order = ["NEW", *reversed(names)]
    folder = tmp_path / "in put"
    folder.mkdir()
    line = lambda r, cols: ",".join(r[c] for c in cols)
    (folder / "a 2018.csv").write_text("\n".join([",".join(names), *[line(r, names) for r in early], line(GOOD, names) + ",one,more"]) + "\n")
    (folder / "b.csv").write_text("\n".join([",".join(f'"{c}"' for c in order), *[line(r, order) for r in late[:4]]]) + "\n")
    (folder / "c.csv").write_text("\n".join([",".join(order), *[line(r, order) for r in late[4:]], "x,y", "z"]) + "\n")
    got = files.read_incident_csv(spark, str(folder))
    assert got.columns == names
    rows = {r.CAD_INCIDENT_ID: r for r in got.collect()}
    assert set(rows) == {r["CAD_INCIDENT_ID"] for r in early + late} and got.count() == 12
    assert rows["e1"].BOROUGH == rows["l6"].BOROUGH == GOOD["BOROUGH"]
    assert str(rows["l2"].INCIDENT_DATETIME) == "2023-07-04 23:30:00" and str(rows["e2"].INCIDENT_DATETIME) == "2023-01-02 00:00:00"
    assert [len(v) for v in sorted(files.file_headers(spark, str(folder)).values(), key=len)] == [1, 2]
    counts = {r.file.rpartition("/")[2]: (r.rows, r.malformed) for r in files.malformed_rows(spark, str(folder)).collect()}
    assert counts == {"a%202018.csv": (6, 1), "b.csv": (4, 0), "c.csv": (5, 2)}
    (folder / "d.csv").write_text("BOROUGH,NEW\nBRONX,1\n")
    with pytest.raises(ValueError, match="d.csv: CAD_INCIDENT_ID"):
        files.read_incident_csv(spark, str(folder))


def test_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "zones")
    schema = "zone string, borough string, n long"
    first = [(z[0], z[1], 0) for z in dim.ZONES]
    files.upsert_partitions(spark, path, spark.createDataFrame(first, schema), "zone", "borough")

    def names():
        return {p.parent.name: p.name for p in (tmp_path / "zones").glob("*/*.parquet")}

    before = {p for p in (tmp_path / "zones").glob("*/*.parquet")}
    # an update, an insert, a zone that moves to another borough
    changes = [("B1", "BRONX", 7), ("B9", "BRONX", 1), ("S3", "QUEENS", 5)]
    files.upsert_partitions(spark, path, spark.createDataFrame(changes, schema), "zone", "borough")
    after = {p for p in (tmp_path / "zones").glob("*/*.parquet")}
    kept = {p.parent.name for p in before & after}
    assert kept == {"borough=BROOKLYN", "borough=MANHATTAN"}
    want = {z: (b, n) for z, b, n in first} | {z: (b, n) for z, b, n in changes}
    got = {r.zone: (r.borough, r.n) for r in spark.read.parquet(path).collect()}
    assert got == want and spark.read.parquet(path).count() == 32
    # a borough that loses its last zones disappears
    moved = [("S1", "QUEENS", 1), ("S2", "QUEENS", 1)]
    files.upsert_partitions(spark, path, spark.createDataFrame(moved, schema), "zone", "borough")
    got = {r.zone: r.borough for r in spark.read.parquet(path).collect()}
    assert len(got) == spark.read.parquet(path).count() == 32 and got["S1"] == got["S2"] == "QUEENS"
    assert not any("STATEN" in b for b in got.values())


# ---- gaps and fallbacks ----------------------------------------------------------------------------


def test_hours_without_weather_get_the_defaults(spark):
    hour = dt.datetime(2023, 7, 1, 5)
    facts = spark.createDataFrame([(1, hour, "B1"), (2, hour + dt.timedelta(hours=1), "B1")], "id int, date_hour timestamp_ntz, INCIDENT_DISPATCH_AREA string")
    weather = spark.createDataFrame([(hour, 30.0, 2.0, 5.0, 61, 1, 0, 0)], "date_hour timestamp_ntz, temperature_2m double, precipitation double, windspeed_10m double, weathercode int, is_severe_weather int, is_extreme_heat int, is_heat_emergency int")
    none = lambda ddl: spark.createDataFrame([], ddl)
    got = {r.id: r for r in enrich.star_enrich(
        facts, weather, none("holiday_date date, is_holiday int"), none("school_date date, is_school_day int"),
        none("event_date date, zone_prefix string, is_major_event int"), none("year int, month_num int, subway_disruption_idx double"),
    ).collect()}
    assert (got[1].temperature_2m, got[1].weathercode, got[1].is_holiday) == (30.0, 61, 0)
    assert {c: got[2][c] for c in enrich.ENRICHMENT_DEFAULTS} == enrich.ENRICHMENT_DEFAULTS


def test_zones_without_score_weigh_nothing(spark):
    scores = spark.createDataFrame([("B1", 4.0), ("Z9", 1.0)], "zone string, n double")
    got = {r.zone: r.weight for r in travel.centroid_weights(scores, "n").collect()}
    assert len(got) == 31 and got["B1"] == 4.0 and sum(got.values()) == 4.0


def test_facts_of_wanted_bins(spark):
    facts = spark.createDataFrame([(1, 3, 2), (2, 3, 2), (3, 4, 2)], "id int, hour int, dayofweek int")
    bins = spark.createDataFrame([(3, 2), (3, 2), (30, 2)], "hour int, dayofweek int")
    assert sorted(r.id for r in impact.bin_facts(facts, bins).collect()) == [1, 2]


def test_missing_keys_of_several_columns(spark):
    expected = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, h int")
    found = spark.createDataFrame([("a", 1), ("a", 1), ("c", 1)], "k string, h int")
    assert sorted(tuple(r) for r in quality.missing_keys(expected, found, "k", "h").collect()) == [("a", 2), ("b", 1)]


def test_zone_without_result_takes_the_boroughs_saving(spark):
    zones = spark.createDataFrame([("s", "B1", "BRONX", 600.0), ("s", "B2", "BRONX", 100.0), ("s", "K1", "BROOKLYN", 500.0)], "id string, zone string, borough string, avg_response_seconds double")
    own = spark.createDataFrame([("s", "K1", 450.0, 300.0)], "id string, zone string, static_time double, staged_time double")
    saving = spark.createDataFrame([("s", "BRONX", 130.0)], "id string, borough string, median_saved_sec double")
    got = {r.zone: (r.before, r.after, r.tier) for r in impact.zone_before_after(zones, own, saving, "id").collect()}
    assert got == {"B1": (600.0, 470.0, "good"), "B2": (100.0, 0.0, "good"), "K1": (450.0, 300.0, "good")}


# ---- the demand model ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def by_date(spark):
    """Ten weeks of zone hours by date: a rate per zone and hour, more on event days, and chance; the last two weeks are the test."""
    draw = random.Random(12)

    def poisson(rate):
        n, p, limit = 0, 1.0, math.exp(-rate)
        while (p := p * draw.random()) > limit:
            n += 1
        return n

    rows = []
    for zone, borough in (("B1", "BRONX"), ("K2", "BROOKLYN"), ("Q3", "QUEENS")):
        level = {"B1": 6.0, "K2": 3.0, "Q3": 1.5}[zone]
        for day in range(70):
            event = int(day % 9 == 4)
            for hour in range(0, 24, 2):
                n = poisson(level * (1 + 0.6 * math.sin(2 * math.pi * hour / 24)) * (1 + 1.2 * event))
                if n:
                    rows.append((zone, borough, day, day % 7, hour, n, event, "train" if day < 56 else "test"))
    df = spark.createDataFrame(rows, "INCIDENT_DISPATCH_AREA string, BOROUGH string, day int, dayofweek int, hour int, incident_count long, is_major_event int, split string")
    base = df.filter("split = 'train'").groupBy("INCIDENT_DISPATCH_AREA", "hour", "dayofweek").agg(F.avg("incident_count").alias("zone_baseline_avg"))
    stats = df.groupBy("INCIDENT_DISPATCH_AREA").agg(F.lit(0.2).alias("high_acuity_ratio"), F.lit(0.1).alias("held_ratio"))
    angle = lambda c, n: 2 * math.pi * F.col(c) / n
    bins = df.withColumns({
        "hour_sin": F.sin(angle("hour", 24)), "hour_cos": F.cos(angle("hour", 24)), "dow_sin": F.sin(angle("dayofweek", 7)), "dow_cos": F.cos(angle("dayofweek", 7)),
        "month_sin": F.lit(0.0), "month_cos": F.lit(1.0), "is_weekend": (F.col("dayofweek") > 4).cast("int"),
        **{c: F.lit(0.0) for c in ("temperature_2m", "precipitation", "windspeed_10m", "svi_score", "subway_disruption_idx")},
        **{c: F.lit(0) for c in ("is_severe_weather", "is_holiday", "is_school_day", "is_heat_emergency", "is_extreme_heat")},
    })
    return model.training_frame(bins, base, stats), bins


def test_leave_own_date_out(spark, by_date):
    frame, bins = by_date
    rows = [r for r in bins.collect() if r.split == "train"]
    for r in model.leave_own_date_out(frame).sample(0.1, 3).collect():
        key = lambda x: (x.INCIDENT_DISPATCH_AREA, x.hour, x.dayofweek)
        others = [x.incident_count for x in rows if key(x) == key(r) and (r.split == "test" or x.day != r.day)]
        assert r.zone_baseline_avg == pytest.approx(sum(others) / len(others) if others else 1.0)


def test_trees_beat_the_baseline(by_date, tmp_path):
    """One fit; a prefix of its trees; less error on the test rows than the bare baseline; the event matters."""
    frame, _ = by_date
    fitted = model.train(model.leave_own_date_out(frame), trees=60, depth=4, step=0.1)
    test = frame.filter("split = 'test'")
    trees, bare = (model.forecast_error(x).first() for x in (model.score(fitted, test), model.baseline_only(test)))
    assert trees.rmse < 0.93 * bare.rmse and trees.mae < bare.mae
    assert fitted.getNumTrees < 60
    spark = frame.sparkSession
    ranked = [r.feature for r in model.feature_importance(spark, fitted).collect()]
    assert set(ranked[:5]) >= {"zone_baseline_avg", "is_major_event"}
    from pyspark.ml.regression import GBTRegressionModel

    fitted.save(str(tmp_path / "m"))
    again = GBTRegressionModel.load(str(tmp_path / "m"))
    assert again.getNumTrees == fitted.getNumTrees
    assert model.forecast_error(model.score(again, test)).first().rmse == pytest.approx(trees.rmse)


def test_first_trees_are_a_prefix(by_date):
    from pyspark.ml.regression import GBTRegressor

    frame, _ = by_date
    data = model._assembled(frame).select("features", F.col("incident_count").cast("double").alias("label"))
    full = GBTRegressor(maxIter=6, maxDepth=3, seed=1).fit(data)
    part = model.first_trees(full, 3)
    assert part.getNumTrees == 3 and part.treeWeights == full.treeWeights[:3] and model.first_trees(full, 9) is full
    for r in data.limit(20).collect():
        assert part.predict(r.features) == pytest.approx(sum(w * t.predict(r.features) for w, t in zip(full.treeWeights[:3], full.trees[:3])))


def test_no_more_trees_are_grown_than_settle_it(by_date, monkeypatch):
    """A short run that settles ends the growing, and its trees are those of the whole run; without test rows all grow."""
    frame, _ = by_date
    frame, asked = model.leave_own_date_out(frame), []

    class Watched(model.GBTRegressor):
        def fit(self, data):
            asked.append(self.getMaxIter())
            return super().fit(data)

    monkeypatch.setattr(model, "GBTRegressor", Watched)
    options = dict(trees=30, depth=3, step=0.5, patience=3)
    fitted = model.train(frame, **options)
    assert max(asked) < 30 and fitted.getNumTrees + 3 <= max(asked)
    monkeypatch.setattr(model, "run_lengths", lambda trees, patience: [trees])
    whole = model.train(frame, **options)
    assert asked[-1] == 30 and whole.treeWeights == fitted.treeWeights
    assert [t.toDebugString.split("\n", 1)[1] for t in whole.trees] == [t.toDebugString.split("\n", 1)[1] for t in fitted.trees]
    assert model.train(frame.filter("split = 'train'"), **{**options, "trees": 5}).getNumTrees == 5


def test_run_lengths():
    assert model.run_lengths(300, 20) == [33, 100, 300]
    assert model.run_lengths(20, 20) == [20] and model.run_lengths(1, 0) == [1]


def test_quiet_monday_is_one_scenario(spark):
    quiet = dim.scenario_presets(spark).filter("scenario = 'monday_quiet'").withColumnRenamed("scenario", "scenario_id")
    base = spark.createDataFrame([("B1", 4, 0, 1.5)], "INCIDENT_DISPATCH_AREA string, hour int, dayofweek int, zone_baseline_avg double")
    stats = spark.createDataFrame([], "INCIDENT_DISPATCH_AREA string, svi_score double, high_acuity_ratio double, held_ratio double")
    frame = scenarios.expand(quiet, base, stats, baseline_default=3.0, zone_defaults=False, is_school_day=F.lit(0)).collect()
    assert len(frame) == 31 and {(r.hour, r.dow, r.is_school_day, r.is_major_event, r.is_holiday) for r in frame} == {(4, 0, 0, 0, 0)}
    assert {r.zone: r.zone_baseline_avg for r in frame}["B1"] == 1.5
