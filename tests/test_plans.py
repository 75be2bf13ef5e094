"""The plans that decide whether a job holds at scale."""

import contextlib
import io

from sirenfield.binding import Inputs
from sirenfield.operators import clean, enrich, impact

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_quality_filter_reaches_the_scan_and_needs_no_shuffle(spark):
    text = plan(clean.clean(Inputs(spark, SF).raw).select("CAD_INCIDENT_ID", "hour"))
    assert "EqualTo(REOPEN_INDICATOR,N)" in text and "Exchange" not in text


def test_star_enrichment_does_not_move_the_facts(spark):
    t = Inputs(spark, SF)
    text = plan(enrich.star_enrich(t.facts, t.weather, t.holidays, t.school, t.event_days, t.transit))
    assert text.count("BroadcastHashJoin") >= 5 and "SortMergeJoin" not in text 


def test_fact_whatif_broadcasts_both_lookups(spark):
    t = Inputs(spark, SF)
    staged = spark.createDataFrame([(0, 0, "B1", 100)], "hour int, dayofweek int, zone string, seconds int")
    fixed = spark.createDataFrame([("B1", 100)], "dest string, seconds int")
    text = plan(impact.fact_whatif(t.acute, staged, fixed))
    assert "SortMergeJoin" not in text and "Cartesian" not in text


def test_capped_sample_limits_before_the_shuffle(spark):
    text = plan(impact.capped_sample(Inputs(spark, SF).facts, ["hour", "dayofweek"], "CAD_INCIDENT_ID", 150))
    assert "WindowGroupLimit" in text
