"""Operators whose method decides how they hold at scale: quantiles, least costs, nearest nodes, placement, impact, samples."""

import contextlib
import heapq
import io
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sirenfield import dimensions as dim
from sirenfield.operators import aggregate, graph, impact, place, quantiles, travel
from sirenfield.session import work_tables
from tests.test_operators import _forecast, _plain_kmeans


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


# ---- quantiles -------------------------------------------------------------------------------------


def test_quantiles_equal_linear_interpolation(spark):
    draw = random.Random(3)
    groups = {None: [5.0], "a": [draw.randint(0, 6) / 2 for _ in range(101)], "b": [draw.random() for _ in range(40)], "c": [None, None], "d": [1.0, 2.0]}
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p90": 0.9, "p100": 1.0}
    got = {r.k: r for r in quantiles.quantiles(df, ["k"], "v", points).collect()}
    assert set(got) == {None, "a", "b", "d"}
    for k, r in got.items():
        assert [r[n] for n in points] == pytest.approx([np.quantile(groups[k], p) for p in points.values()], rel=1e-12)
    whole = quantiles.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [np.median([v for _, v in rows if v is not None])]
    assert quantiles.quantiles(df.limit(0), [], "v", {"m": 0.5}).count() == quantiles.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0
    both = quantiles.with_quantiles(df.groupBy("k").agg(F.count("*").alias("n")), df, ["k"], "v", {"m": 0.5})
    assert {r.k: (r.n, r.m) for r in both.collect()}[None] == (1, 5.0) and both.filter("k = 'c'").first().m is None


def test_no_median_buffers_raw_facts(spark):
    facts = spark.createDataFrame([], "hour int, dayofweek int, borough string, svi_quartile string, seconds_saved int, baseline_within_8min int, staged_within_8min int, svi double")
    texts = [plan(impact.bin_summary(facts)), plan(impact.group_breakdown(facts, "borough", by_bin=True)), plan(impact.quantile_band(facts, "svi", "q")), plan(aggregate.column_summary(facts, "svi"))]
    for text in texts:
        assert "median(" not in text and "percentile(" not in text and "ObjectHashAggregate" not in text


# ---- least costs -----------------------------------------------------------------------------------


def dijkstra(edges, start):
    out = defaultdict(list)
    for s, t, c in edges:
        out[s].append((t, c))
    dist, heap = {start: 0.0}, [(0.0, start)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > dist[u]:
            continue
        for t, c in out[u]:
            if d + c < dist.get(t, math.inf):
                dist[t] = d + c
                heapq.heappush(heap, (d + c, t))
    return dist


def test_least_costs_into_targets(spark, monkeypatch):
    """A long chain with shortcuts, zero costs and an island; settled parts are merged on the way."""
    monkeypatch.setattr(graph, "PARTS", 3)
    draw = random.Random(4)
    edges = [(i, i + 1, float(draw.randint(0, 9))) for i in range(30)] + [(draw.randrange(31), draw.randrange(31), float(draw.randint(0, 200))) for _ in range(60)]
    edges += [(100, 101, 1.0), (5, 6, 500.0)]
    df = spark.createDataFrame(edges, "src long, dst long, cost double")
    targets = spark.createDataFrame([("x", 30), ("x", 30), ("y", 3), ("z", 101), ("w", 999)], "target string, node long")
    got = defaultdict(dict)
    rows = graph.least_costs_into(df, targets).collect()
    for r in rows:
        got[r.target][r.node] = r.cost
    back = [(t, s, c) for s, t, c in edges]
    assert got == {t: dijkstra(back, n) for t, n in (("x", 30), ("y", 3), ("z", 101), ("w", 999))}
    assert len(rows) == len({(r.target, r.node) for r in rows})
    assert graph.least_costs(df, targets.limit(0).withColumnRenamed("target", "origin")).count() == 0


def test_labels_are_rewritten_few_times(spark, monkeypatch):
    """Rows written over all rounds of a chain stay near the number of labels, not labels times rounds."""
    n, written = 40, []

    @contextlib.contextmanager
    def counting(session):
        with work_tables(session) as write:
            def count(df, **kw):
                out = write(df, **kw)
                written.append((out.count(), "fresh" in out.columns))
                return out
            yield count

    monkeypatch.setattr(graph, "work_tables", counting)
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n)], "src long, dst long, cost double")
    got = graph.least_costs(edges, spark.createDataFrame([("a", 0)], "origin string, node long"))
    assert got.count() == n + 1
    assert sum(k for k, is_open in written if is_open) <= 3 * (n + 1)


def test_drive_matrix_joins_origins_last(spark):
    edges = spark.createDataFrame([(0, 1, 100.7), (1, 2, 50.0), (7, 1, 9.0)], "src long, dst long, cost double")
    zone_nodes = spark.createDataFrame([("B1", 1), ("B2", 2), ("B2", 7)], "zone string, node long")
    nodes = spark.createDataFrame([("s", 0), ("s", 0), ("t", 2), ("u", 55)], "origin string, node long")
    origins = spark.createDataFrame([("s", -73.9, 40.7), ("t", -73.9, 40.7), ("u", -73.9, 40.7), ("v", -73.9, 40.7)], "origin string, lon double, lat double")
    m = {(r.origin, r.dest): r.seconds for r in graph.drive_matrix(edges, nodes, zone_nodes, origins).collect()}
    assert len(m) == 4 * 31
    assert (m["s", "B1"], m["s", "B2"], m["t", "B1"], m["t", "B2"], m["u", "B1"]) == (100, 150, 9999, 0, 9999)
    assert 0 < m["v", "B1"] < 9999


# ---- nearest node ----------------------------------------------------------------------------------


def metres(p, n):
    a = math.sin(math.radians(n[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(n[2])) * math.sin(math.radians(n[1] - p[1]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(a))


def test_nearest_node_with_most_nodes_in_one_place(spark):
    """90 % of the nodes within some hundred metres, others around the globe, points far off, on the poles and the date line."""
    draw = random.Random(6)
    nodes = [(i, -73.9 + draw.gauss(0, 0.002), 40.7 + draw.gauss(0, 0.002)) for i in range(9_000)]
    nodes += [(20_000 + i, draw.uniform(-180, 180), draw.uniform(-90, 90)) for i in range(1_000)]
    nodes += [(50_000, nodes[5][1], nodes[5][2]), (60_000, 180.0, 10.0), (60_001, -179.999, 10.0)]
    points = [(f"c{i}", -73.9 + draw.gauss(0, 0.002), 40.7 + draw.gauss(0, 0.002)) for i in range(150)]
    points += [(f"g{i}", draw.uniform(-180, 180), draw.uniform(-90, 90)) for i in range(100)]
    points += [("north", 0.0, 90.0), ("south", 12.0, -90.0), ("line", 179.9995, 10.0), ("five", nodes[5][1], nodes[5][2])]
    p = spark.createDataFrame(points, "point_id string, lon double, lat double").repartition(3)
    n = spark.createDataFrame(nodes, "node_id long, lon double, lat double").repartition(7)
    got = {r.point_id: r for r in travel.nearest_node(p, n).collect()}
    assert len(got) == len(points)
    for q in points:
        best = min((metres(q, x), x[0]) for x in nodes)
        assert abs(got[q[0]].metres - best[0]) < 1e-3
        assert got[q[0]].node_id == best[1]
    places = n.groupBy("lon", "lat").agg(F.min("node_id").alias("node_id")).select("node_id", F.col("lon").alias("n_lon"), F.col("lat").alias("n_lat"))
    with work_tables(spark) as write:
        leaves, levels = travel.box_tree(places, write)
        assert leaves.groupBy("box").count().agg(F.max("count")).first()[0] <= travel.LEAF_NODES and levels[0].count() == 1
        opened = {r.point_id: r["count"] for r in travel.candidate_leaves(p, levels, leaves, write).groupBy("point_id").count().collect()}
    # brute force compares 10,002 nodes a point
    assert np.mean(list(opened.values())) <= 3 and max(opened.values()) <= 12


def test_nearest_node_edges(spark):
    empty = spark.createDataFrame([], "node_id long, lon double, lat double")
    one = spark.createDataFrame([(4, 1.0, 2.0), (3, 1.0, 2.0)], "node_id long, lon double, lat double")
    points = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.01), ("n", None, 2.0)], "point_id string, lon double, lat double")
    assert travel.nearest_node(points, empty).count() == 0
    got = {r.point_id: (r.node_id, r.is_far) for r in travel.nearest_node(points, one).collect()}
    assert got == {"a": (3, 0), "b": (3, 1)}


# ---- placement -------------------------------------------------------------------------------------


def test_placement_goes_on_until_it_settles(spark):
    """Passes of a single round give what one long run gives; a pass limit shows in the result."""
    df, rows = _forecast(spark, 11, 8)
    got = place.global_placement(df, "id", F.lit(6), rounds=1).collect()
    assert all(r.converged for r in got)
    for s in range(8):
        pts = [(r[1], max(r[6], 0.01), r[5], r[4]) for r in rows if r[0] == f"s{s}"]
        centres, _ = _plain_kmeans(pts, 6)
        assert sorted((round(r.lat, 8), round(r.lon, 8)) for r in got if r.id == f"s{s}") == sorted((round(a, 8), round(b, 8)) for a, b in centres)
    grouped = df.groupBy("id").agg(place.zone_points().alias("points")).withColumn("k", F.lit(6))
    stopped = place.settle(grouped, ["id"], rounds=1, passes=2)
    assert stopped.count() == 8 and stopped.filter("not state.settled").count() > 0


# ---- impact ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def zone_rows(spark):
    draw = random.Random(9)
    rows = []
    for s in range(12):
        for i, z in enumerate(dim.ZONES[: 31 if s else 4]):
            static = draw.uniform(200, 1500)
            rows.append((f"s{s}", z[0], i, z[1], draw.choice([0.1, 0.3, 0.9] if s < 6 else [0.1]), draw.choice([0.0, 0.4, 3.0, 90.0]), static, static * draw.uniform(0.3, 1), 0.0))
    rows = [(*r[:-1], r[6] - r[7]) for r in rows]
    return spark.createDataFrame(rows, "id string, zone string, zone_ord int, borough string, svi_score double, demand double, static_time double, staged_time double, seconds_saved double"), rows


def test_impact_in_one_pass(spark, zone_rows):
    df, rows = zone_rows
    out = impact.grouped_impact(df, "id")
    got = {(r.id, r.scope, r.name): (r.pct_static, r.pct_staged, r.median_saved_sec) for r in out.collect()}
    shares = {(r.id, r.zone): (r.a, r.b, r.c, r.q) for r in df.select(
        "id", "zone", impact.rs.share_within(F.col("static_time")).alias("a"), impact.rs.share_within(F.col("staged_time")).alias("b"),
        impact.rs.repeat_weight(F.col("demand")).alias("c"), impact.rs.svi_band(F.col("svi_score")).alias("q")).collect()}
    groups = defaultdict(list)
    for r in rows:
        for scope, name in (("overall", "all"), ("borough", r[3]), ("svi_quartile", shares[r[0], r[1]][3])):
            groups[r[0], scope, name].append(r)
    for s in {r[0] for r in rows}:
        for q in impact.BANDS:
            groups.setdefault((s, "svi_quartile", q), [])
    assert set(got) == set(groups)
    for key, members in groups.items():
        if not members:
            assert got[key] == (0.0, 0.0, 0.0)
            continue
        w = [r[5] for r in members]
        total = sum(w) if sum(w) >= 0.01 else 1.0
        want = [100 * sum(x * shares[r[0], r[1]][i] for x, r in zip(w, members)) / total for i in (0, 1)]
        want.append(np.median(np.repeat([r[8] for r in members], [shares[r[0], r[1]][2] for r in members])))
        assert got[key] == pytest.approx(want, abs=0.0501)
    text = plan(impact.grouped_impact(df, "id"))
    tree = text.split("\n\n\n")[0]
    assert tree.count("Exchange") == 1 and tree.count("Scan") == 1 and "Union" not in tree and "Join" not in tree


def test_sample_picks_from_running_weights(spark, zone_rows):
    df, rows = zone_rows
    got = impact.response_sample(df, "id", 50).collect()
    again = impact.response_sample(df.repartition(7), "id", 50).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    calls = defaultdict(list)
    for r in sorted(rows):
        n = max(1, round(r[5]))
        calls[r[0]] += [(r[1], round(r[6]), round(r[7]), i + 1) for i in range(n)]
    for s, all_calls in calls.items():
        mine = [(r.zone, r.static_sec, r.staged_sec, r.copy) for r in got if r.id == s]
        assert len(mine) == len(set(mine)) == min(50, len(all_calls)) and set(mine) <= set(all_calls)
        places = sorted(all_calls.index(m) for m in mine)
        if len(all_calls) > 50:  # one of each stretch
            assert all(i * len(all_calls) // 50 <= p < (i + 1) * len(all_calls) // 50 for i, p in enumerate(places))
