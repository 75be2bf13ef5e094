import contextlib
import io
import math

import pytest
from pyspark.sql import functions as F

from sirenfield import dimensions as dim
from sirenfield.binding import FIRST_DAY, LAST_DAY, TRAIN_END, Inputs
from sirenfield.operators import clean, graph, impact, model, place, scenarios
from sirenfield.plans.pipeline import KEY, Pipeline

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue().split("\n\n\n")[0]


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """The whole batch run: ingest, enrichment, training, road matrix, forecasts by the model, placement, impact, validation."""
    t = Inputs(spark, SF)
    run = Pipeline(spark, str(tmp_path_factory.mktemp("run")))
    out = {"inputs": t, "run": run, "facts": run.ingest(t.raw, clean.split_by_date(FIRST_DAY, TRAIN_END, LAST_DAY))}
    out["enriched"] = run.enrich(out["facts"], t.weather_raw, t.major_events, t.transit, LAST_DAY)
    out["bins"], baselines, stats = run.aggregate(out["enriched"])
    out["stats"], out["baselines"] = stats, baselines
    out["model"] = run.train(out["enriched"], baselines, stats, trees=6)
    zones = dim.zones(spark)
    nodes = zones.select(F.col("zone_ord").cast("long").alias("node_id"), "lon", "lat")
    out["matrix"] = run.drive_times(t.stations, nodes, graph.movement_edges(t.trips))
    out["bin_forecast"] = run.bin_forecast(baselines, stats, out["model"])
    out["raw"], out["summary"] = run.whatif(out["enriched"], out["bin_forecast"], out["matrix"], t.stations)
    out["forecast"] = run.forecast(t.scenarios, baselines, stats, out["model"])
    out["placement"] = run.place(out["forecast"])
    out["zones"], out["impact"] = run.impact(out["forecast"], stats, out["placement"], out["matrix"])
    out["report"] = run.validate()
    return out


def test_batch_run(run):
    t = run["inputs"]
    assert run["enriched"].count() == run["facts"].count() == t.facts.count()
    assert run["bins"].agg({"incident_count": "sum"}).first()[0] == run["facts"].count()
    assert run["raw"].count() == t.acute.count() and run["summary"].count() == 168
    n = t.scenarios.count()
    assert run["forecast"].count() == run["zones"].count() == 31 * n
    assert run["impact"].filter("scope = 'overall'").count() == n


def test_the_model_drives_the_chain(run):
    """Predictions of the tables are the model's, and what follows is computed from them."""
    t, spark = run["inputs"], run["run"].spark
    again = model.score(run["model"], scenarios.expand(t.scenarios, run["baselines"], run["stats"]))
    both = again.select(KEY, "zone", F.col("predicted").alias("p")).join(run["forecast"].select(KEY, "zone", "predicted"), [KEY, "zone"])
    assert both.count() == run["forecast"].count() and both.filter("abs(p - predicted) > 1e-9").count() == 0
    assert run["forecast"].filter("abs(predicted - zone_baseline_avg) > 1e-6").count() > 0
    demand = run["zones"].groupBy(KEY).agg(F.sum("demand").alias("d")).join(run["forecast"].groupBy(KEY).agg(F.sum("predicted").alias("p")), KEY)
    assert demand.filter("abs(d - p) > 1e-6").count() == 0
    covered = run["placement"].groupBy(KEY).agg(F.sum("predicted_demand_coverage").alias("c"), F.count("*").alias("points"))
    wanted = t.scenarios.select(KEY, "ambulances").join(covered, KEY)
    assert wanted.count() == t.scenarios.count() and wanted.filter("points > ambulances").count() == 0
    assert spark.read.parquet(f"{run['run'].root}/demand_model/data").count() > 0


def test_road_times_come_from_the_graph(run):
    """Zones stand on their own nodes; stations take the zone node nearest to them."""
    t = run["inputs"]
    zones = {r.zone: r.zone_ord for r in dim.zones(t.spark).collect()}
    costs = {(r.target, r.node): r.cost for r in graph.least_costs_into(
        graph.movement_edges(t.trips), dim.zones(t.spark).select(F.col("zone").alias("target"), F.col("zone_ord").cast("long").alias("node"))).collect()}
    for r in run["matrix"].collect():
        if r.origin in zones:
            want = costs.get((r.dest, zones[r.origin]))
            assert r.seconds == (9999 if want is None else int(want))


def test_later_steps_need_no_exchange_by_scenario(spark, run):
    forecast, placement = run["forecast"], run["placement"]

    def exchanges(df) -> list[str]:
        return [line for line in plan(df).splitlines() if "Exchange" in line and "Broadcast" not in line]

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables too large to broadcast
    try:
        rows = impact.zone_whatif(forecast, run["stats"], placement, run["matrix"], KEY)
        # the 31 x 31 legs are grouped by zone before their hinted broadcast
        assert len(exchanges(impact.grouped_impact(rows, KEY))) == 1
        for df in (impact.scenario_impact(run["zones"], KEY), impact.response_sample(run["zones"], KEY)):
            assert exchanges(df) == []
        wanted = forecast.groupBy(KEY).agg(F.max("ambulances").alias("units"))
        assert exchanges(place.allocate_units(place.borough_ranks(forecast, KEY), wanted, KEY)) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_report_is_measured_while_writing(run):
    rows = {r.check_name: (r.passed, r.detail) for r in run["report"].collect()}
    assert len(rows) == run["report"].count() >= 45
    failed = {k: v for k, v in rows.items() if not v[0]}
    # invented data: a sparse graph of trips, and response times, savings and the equity relation as they come
    assert set(failed) <= {
        "zone_stats: Bronx mean response in 400..900", "whatif_by_band: Q4 saves at least as much as Q1", "drive_times: over half reachable",
        "whatif_summary: mean gain above 0", "whatif_summary: staged no worse in over 60% of bins",
    }, failed
    reached = run["matrix"].agg(F.avg((F.col("seconds") < 9999).cast("int"))).first()[0]
    assert rows["drive_times: over half reachable"] == (reached > 0.5, f"value={round(reached, 4)}")
    n = run["facts"].count()
    assert rows["incidents_cleaned: has rows"] == (True, f"value={float(n)}")
    assert rows["incidents_cleaned: has train rows"][1] == f"value={float(run['facts'].filter("split = 'train'").count())}"
    assert rows["zone_stats: required columns"] == (True, "all present")
    bronx = run["stats"].filter("BOROUGH = 'BRONX'").agg(F.avg("avg_response_seconds")).first()[0]
    assert math.isclose(float(rows["zone_stats: Bronx mean response in 400..900"][1][6:]), bronx, abs_tol=1e-3)


def test_broken_tables_show_in_the_report(spark, tmp_path):
    run = Pipeline(spark, str(tmp_path))
    bad = spark.createDataFrame([("B1", "BRONX", 1.5)], "INCIDENT_DISPATCH_AREA string, BOROUGH string, high_acuity_ratio double")
    from sirenfield.operators import quality

    run.publish("zone_stats", bad, columns=("INCIDENT_DISPATCH_AREA", "held_ratio"), **{
        "ratio in 0..1": (quality.violations(F.col("high_acuity_ratio").between(0, 1)), F.col("value") == 0),
        "three zones": (quality.distinct(F.col("INCIDENT_DISPATCH_AREA")), F.col("value") == 3),
    })
    got = {r.check_name: (r.passed, r.detail) for r in run.validate().collect()}
    assert got == {
        "zone_stats: required columns": (False, "missing: held_ratio"),
        "zone_stats: ratio in 0..1": (False, "value=1.0"), "zone_stats: three zones": (False, "value=1.0"),
    }
