"""Spans of clusters, ingest that stops, metric series, gate reports and route tables."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F
from test_plans import graph  # noqa: F401

from pathweave.functions import geo
from pathweave.operators import gates, register, report, spatial


def test_spans_equal_all_pairs(spark):
    rng = random.Random(1)
    rows = [(k, {"lon": -111.9 + rng.gauss(0, 0.01), "lat": 33.4 + rng.gauss(0, 0.01)}) for k, n in ((1, 1), (2, 2), (3, 3), (4, 400), (5, 2500)) for _ in range(n)]
    rows += [(6, rows[0][1])] * 4 + [(7, {"lon": -111.9 + i * 1e-4, "lat": 33.4}) for i in range(30)]
    d = spark.createDataFrame(rows, f"c long, position {geo.POINT}").repartition(5)
    pairs = d.alias("a").join(d.alias("b"), F.col("a.c") == F.col("b.c")).groupBy(F.col("a.c").alias("c")).agg(F.max(geo.haversine(F.col("a.position"), F.col("b.position"))).alias("m"))
    want = {r.c: r.m for r in pairs.collect()}
    got = {r.c: r.span for r in spatial.spans(d, "c").collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-6) for k, v in want.items())


@pytest.mark.parametrize("n", (0, 1, 2, 10, 3001))
def test_quantiles_are_those_of_all_values(spark, n):
    rng = random.Random(n)
    values = [rng.choice((rng.random(), 0.5, 2.0)) for _ in range(n)]
    shares = (0.0, 0.1, 0.5, 0.9, 0.999, 1.0)
    d = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
    want = d.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0] or [None] * len(shares)
    assert report.quantiles(d, "v", shares) == [w if w is None else pytest.approx(w, abs=1e-12) for w in want]


def test_an_ingest_stops_on_faults(spark):
    ring = [{"lon": float(x), "lat": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 0))]
    kind = f"ordinal int, geometry_type string, code string, ring array<{geo.POINT}>"
    good = spark.createDataFrame([(0, "Polygon", "A1", ring)], kind)
    bounds = ((-2.0, 2.0), (-2.0, 2.0))
    assert register.checked_shapes(good, *bounds).count() == 1
    bad = good.unionByName(spark.createDataFrame([(1, "Point", "b", ring[:2])], kind))
    with pytest.raises(register.ShapeFaults, match="4 faults: shape 1: code is not a building code; shape 1: geometry is Point"):
        register.checked_shapes(bad, *bounds)
    with pytest.raises(register.ShapeFaults, match="no shapes"):
        register.checked_shapes(good.limit(0), *bounds)


def test_metrics_are_series_over_builds(spark):
    builds = spark.createDataFrame([(f"h{i}", dt.datetime(2026, 8, i)) for i in (1, 2, 3)], "build_hash string, generated_utc timestamp")
    series = None
    for h, value, passed in (("h2", 1.4, False), ("h1", 1.2, True), ("h3", 1.1, True)):
        judged = spark.createDataFrame([(value, "R2", passed)], "value double, gate string, passed boolean")
        one = report.build_metrics(h, {"detour_p90": judged, "nodes": spark.range(3).agg(F.count("*").alias("value"))})
        series = one if series is None else series.unionByName(one)
    got = {(r.metric, r.build_hash): (r.before, r.passed, r.lost) for r in report.metric_changes(series, builds).collect()}
    assert got[("detour_p90", "h1")] == (None, True, False) and got[("detour_p90", "h2")] == (1.2, False, True) and got[("detour_p90", "h3")] == (1.4, True, False)
    assert got[("nodes", "h2")] == (3.0, None, False)


def test_a_gate_with_very_many_violations_shows_three(spark):
    many = spark.range(200_000).select(F.format_string("n%06d", "id").alias("entity"), F.lit("off").alias("measurement"))
    none = many.limit(0)
    got = {r.gate: r for r in gates.report({"A": many, "B": none, "C": many.limit(2)}, ("D",)).collect()}
    assert got["A"].violations == 200_000 and got["A"].sample == ["n000000: off", "n000001: off", "n000002: off"]
    assert (got["B"].status, got["B"].violations, got["B"].sample, got["D"].status) == ("PASS", 0, [], "SKIP") and len(got["C"].sample) == 2


def test_routes_are_searched_once(spark, graph, tmp_path, monkeypatch):  # noqa: F811
    path, noon = str(tmp_path / "routes"), dt.datetime(2026, 7, 1, 19, tzinfo=dt.timezone.utc)
    asked = spark.createDataFrame([(1, "bldg:HALL", "bldg:LAB"), (2, "bldg:LAB", "bldg:HALL"), (3, "bldg:HALL", "bldg:LAB"), (4, "bldg:HALL", "bldg:NONE")], "request int, from_id string, to_id string")
    first = {r.request: r for r in graph.kept_routes(path, asked, depart=noon).collect()}
    assert [first[k].kept for k in (1, 2, 3, 4)] == [False] * 4 and first[1].route == first[3].route and first[4].reason == "unknown_building"
    plain = {r.request: r for r in graph.routes(asked, depart=noon).collect()}
    assert all(first[k].route == plain[k].route and first[k].ok == plain[k].ok for k in plain)
    solved = []
    search = type(graph).routes
    monkeypatch.setattr(type(graph), "routes", lambda self, *a, **k: (solved.append(1), search(self, *a, **k))[1])
    assert all(r.kept for r in graph.kept_routes(path, asked, depart=noon).collect()) and not solved
    assert not any(r.kept for r in graph.kept_routes(path, asked, depart=noon + dt.timedelta(hours=1)).collect()) and solved
    closed = spark.createDataFrame([("edge:yyyyyyyy",)], "edge_id string")
    shut = {r.request: r for r in graph.kept_routes(path, asked, depart=noon, closed=closed).collect()}
    assert not shut[1].kept and shut[1].reason == "blocked_by_closure"


@pytest.mark.parametrize("ends", list(itertools.product((False, True), repeat=2)))
def test_golden_routes(spark, ends):
    """An expected route is missed if its nodes differ, or its length by more than 2 m."""
    from pathweave.operators import overlays

    other, far = ends
    found = spark.createDataFrame([(1, ["a", "b"], 10.0), (2, ["a", "c"], 20.0)], "request int, node_ids array<string>, length_m double")
    expected = spark.createDataFrame([(1, ["a", "x" if other else "b"], 12.5 if far else 11.9), (3, ["q"], 1.0)], "request int, node_ids array<string>, length_m double")
    assert sorted(r.request for r in overlays.golden(found, expected).collect()) == ([1, 3] if other or far else [3])
