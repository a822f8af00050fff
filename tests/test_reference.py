"""Geometry, routes, gates, ingest, build stages and streams on small hand-made inputs."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pathweave import schema
from pathweave.functions import cost, geo
from pathweave.operators import build, gates, overlays, register, report, route, shortest, spatial, ways
from pathweave.operators.components import connected_components
from pathweave.sources import readers, writers
from pathweave.streaming import changes

LON, LAT = -111.93, 33.42


def P(x, y):
    """A point so many metres east and north of the origin."""
    return {"lon": LON + x / 111195.08 / math.cos(math.radians(LAT)), "lat": LAT + y / 111195.08}


def line(*xy):
    return [P(*p) for p in xy]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(p):
    return geo.point(p["lon"], p["lat"])


def lits(ps):
    return F.array(*[lit(p) for p in ps])


def test_known_geometry(spark):
    assert abs(one(spark, geo.haversine(geo.point(0.0, 0.0), geo.point(0.0, 1.0))) - 111195.08) < 0.1
    assert one(spark, geo.length(lits([P(0, 0)]))) == 0
    assert abs(one(spark, geo.length(lits(line((0, 0), (30, 40))))) - 50) < 0.01
    assert abs(one(spark, geo.bearing(lit(P(0, 0)), lit(P(0, -5)))) - 180) < 1e-6
    assert abs(one(spark, geo.bearing(lit(P(0, 0)), lit(P(5, 0)))) - 90) < 0.01
    assert one(spark, geo.compass(F.lit(337.6))) == "north" and one(spark, geo.compass(F.lit(200.0))) == "south"
    assert one(spark, geo.angle_between(F.lit(350.0), F.lit(10.0))) == 20
    hit = one(spark, geo.project(lit(P(3, 4)), lit(P(0, 0)), lit(P(10, 0))))
    assert abs(hit.t - 0.3) < 1e-4 and abs(hit.dist_m - 4) < 0.01
    same = one(spark, geo.project(lit(P(3, 4)), lit(P(0, 0)), lit(P(0, 0))))
    assert same.t == 0 and abs(same.dist_m - 5) < 0.01
    ring = lits(line((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)))
    assert one(spark, geo.inside(lit(P(5, 5)), ring)) and not one(spark, geo.inside(lit(P(15, 5)), ring))
    assert one(spark, geo.intersection(lit(P(0, 0)), lit(P(2, 2)), lit(P(0, 2)), lit(P(2, 0)))).t == pytest.approx(0.5, abs=1e-3)
    assert one(spark, geo.intersection(lit(P(0, 0)), lit(P(2, 0)), lit(P(0, 1)), lit(P(2, 1)))) is None
    assert one(spark, geo.intersection(lit(P(0, 0)), lit(P(2, 2)), lit(P(5, 0)), lit(P(5, 9)))) is None
    at = one(spark, geo.along(lits(line((0, 0), (10, 0), (10, 10))), 15.0))
    assert abs(at.lat - P(10, 5)["lat"]) < 1e-9
    end = one(spark, geo.along(lits(line((0, 0), (10, 0))), 99.0))
    assert end.lon == P(10, 0)["lon"]
    assert abs(one(spark, geo.square_metres(ring)) - 100) < 0.1
    assert abs(one(spark, geo.square_metres(geo.square_around(lit(P(0, 0)), F.lit(400.0)))) - 400) < 0.5
    assert abs(one(spark, geo.length_inside(lits(line((-5, 5), (15, 5))), ring)) - 10) < 0.01
    assert one(spark, geo.from_wkt_point(F.lit("POINT(-1.5 2)"))).lat == 2 and one(spark, geo.from_wkt_point(F.lit("x"))) is None
    assert [one(spark, geo.half_up(F.lit(v))) for v in (2.5, -2.5, 0.49)] == [3, -2, 0]


def test_costs(spark):
    heat = lambda t: one(spark, cost.heat_factor(F.lit(t).cast("timestamp")))
    assert heat("2026-07-01 21:00:00") == 1.0 and heat("2026-07-01 10:00:00") == 0.0
    assert heat("2026-04-01 17:30:00") == pytest.approx(0.25) and heat("2026-12-01 21:00:00") == 0.0
    assert one(spark, cost.surface_factor(F.lit("sand"))) == 0.7 and one(spark, cost.surface_factor(F.lit("?"))) == 0.95
    assert one(spark, cost.step_penalty(F.lit(True), F.lit(10))) == 9 and one(spark, cost.step_penalty(F.lit(True), F.lit(None).cast("int"))) == 12
    assert one(spark, cost.passable(F.lit(False), F.lit(None).cast("boolean"))) and not one(spark, cost.passable(F.lit(True), F.lit(True)))


EDGES = [  # id, u, v, type, name, line, surface, stairs, steps, accessible, shade
    ("e1", "a", "b", "path", "Palm", line((0, 0), (100, 0)), "paved", False, None, True, 0.2),
    ("e2", "b", "c", "crossing", None, line((100, 0), (110, 0)), "asphalt", False, None, None, 0.0),
    ("e3", "c", "d", "path", None, line((110, 0), (110, 100)), "gravel", False, None, True, 0.5),
    ("e4", "d", "door", "link", None, line((110, 100), (112, 100)), "paved", False, None, None, 0.5),
    ("e5", "a", "s", "path", "Mall", line((0, 0), (0, 50)), "paved", False, None, True, 0.1),
    ("e6", "s", "gym", "steps", None, line((0, 50), (0, 60)), "paved", True, 18, False, 0.1),
]


@pytest.fixture(scope="module")
def campus(spark):
    ddl = f"id string, u string, v string, type string, name string, geometry array<{geo.POINT}>, surface string, stairs boolean, stepCount int, accessible boolean, shadeIndex double"
    e = spark.createDataFrame(EDGES, ddl).withColumn("lengthM", F.round(geo.length(F.col("geometry")), 2)).withColumn("fromNodeId", F.col("u")).withColumn("toNodeId", F.col("v"))
    b = spark.createDataFrame([("A", "Alpha", True, ["a"]), ("D", "Delta", True, ["door"]), ("G", "Gym", True, ["gym"]), ("X", "Out", False, ["a"]), ("N", "None", True, []), ("I", "Island", True, ["island"]), ("AA", "Same door", True, ["a"])], "id string, displayName string, in_area boolean, doors array<string>")
    n = spark.createDataFrame([("door", "north"), ("a", None), ("gym", None)], "id string, entranceName string")
    x = spark.createDataFrame([("c",)], "id string")
    return e, b, n, x


def ask(spark, b, pairs):
    r = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(pairs)], "request int, from_id string, to_id string")
    return route.request_status(r, b)


def test_routes_and_failures(spark, campus):
    e, b, n, x = campus
    pairs = [("A", "D"), ("A", "zz"), ("A", "A"), ("A", "X"), ("A", "N"), ("A", "I"), ("A", "G"), ("A", "AA"), ("zz", "zz")]
    asked = ask(spark, b, pairs)
    solved = route.solve(asked, e, x, cost.DEFAULT_PROFILE)
    got = {r.request: r for r in route.routes(solved, e, n, b, "walk-default", 12, "hash").collect()}
    assert [got[i].reason for i in range(9)] == [None, "unknown_building", "same_building", "out_of_service_area", "no_entrance", "disconnected", None, None, "unknown_building"]
    assert got[5].detail == "A -> I" and got[1].route is None
    r = got[0].route
    assert r.nodeIds == ["a", "b", "c", "d", "door"] and r.edgeIds == ["e1", "e2", "e3", "e4"]
    assert r.id == "route:a>door@walk-default:12" and got[1].detail == "zz" and got[3].detail == "X" and abs(r.lengthM - 212) < 0.1
    assert [g.instruction for g in r.legs] == ["Walk along Palm", "Cross the street", "Head north for 100 m", "Arrive at Delta (north entrance)"]
    assert abs(sum(g.distanceM for g in r.legs) - r.lengthM) < 0.05 and all(0 <= g.bearing < 360 for g in r.legs)
    want = 100 / 1.35 + 10 / 1.35 + 20 + 100 / 1.35 / 0.9 + 2 / 1.35
    assert abs(r.estimatedSec - want) < 1
    assert abs(r.shadedFraction - (100 * 0.2 + 100 * 0.5 + 2 * 0.5) / 212) < 1e-3
    assert got[6].route.legs[-1].instruction == "Take the stairs"
    assert got[7].ok and got[7].route.lengthM == 0 and got[7].route.legs == [] and got[7].route.shadedFraction == 0
    strict = {r.request: r.reason for r in route.solve(asked, e, x, cost.ACCESSIBLE_PROFILE).collect()}
    assert strict[6] == "no_accessible_route" and strict[5] == "disconnected" and strict[0] is None


def test_plans_agree(spark, campus):
    e, _, _, x = campus
    rng = random.Random(3)
    arcs = route.priced_arcs(e, x, cost.DEFAULT_PROFILE)
    lattice = [(i, i + 1, rng.uniform(1, 9), i) for i in range(120) if i % 11] + [(i, i + 11, rng.uniform(1, 9), 1000 + i) for i in range(110)]
    big = shortest.both_ways(spark.createDataFrame(lattice, "u long, v long, cost double, edge long"))
    asked = spark.createDataFrame([(k, [rng.randrange(121), rng.randrange(121)], [rng.randrange(121)]) for k in range(30)] + [(99, [5], [9999])], "request int, origins array<long>, targets array<long>")
    a = {r.request: r for r in shortest.cheapest(big, asked).collect()}
    b = {r.request: r.cost for r in shortest.cheapest(big, asked, most=10).collect()}
    price = {(u, v): c for u, v, c, _ in lattice} | {(v, u): c for u, v, c, _ in lattice}
    for k, r in a.items():
        assert (r.cost is None) == (b[k] is None) == (k == 99)
        if r.cost is not None:
            assert abs(r.cost - b[k]) < 1e-6
            assert abs(sum(price[p] for p in zip(r.node_ids, r.node_ids[1:], strict=False)) - r.cost) < 1e-9
    there = shortest.cheapest(arcs, spark.createDataFrame([(1, ["a"], ["c"]), (2, ["c"], ["a"])], "request int, origins array<string>, targets array<string>")).collect()
    costs = {r.request: r.cost for r in there}
    assert abs(costs[1] - costs[2] - 20) < 1e-6  # the penalty is due on entering
    ways_ = shortest.alternatives(big, asked.limit(2)).collect()
    assert all(r.cost >= a[r.request].cost - 1e-9 for r in ways_) and {r.alternative for r in ways_} >= {0}


def document(spark, tmp_path, edit=lambda d: None):
    ids = {"a": "node:aaaaaaaa", "b": "node:bbbbbbbb", "c": "node:cccccccc"}
    at = {"a": (0, 0), "b": (60, 0), "c": (60, 80)}
    pos = lambda k: [P(*at[k])["lon"], P(*at[k])["lat"]]
    edge = lambda i, u, v, m: {"kind": "edge", "id": f"edge:{i * 8}", "type": "path", "fromNodeId": ids[u], "toNodeId": ids[v], "geometry": [pos(u), pos(v)], "lengthM": m, "name": None, "surface": "paved", "stairs": False, "stepCount": None, "covered": False, "indoor": False, "accessible": True, "shadeIndex": 0.15, "shadeSource": "default", "synthetic": False, "osmWayId": None}
    d = {
        "manifest": {"generatedUtc": "x", "builderGitRev": "y", "inputs": {}, "graphHash": "z", "counts": {"nodes": 3}},
        "buildings": [{"kind": "building", "id": "bldg:HALL", "code": "HALL", "officialName": "HALL", "displayName": "Hall", "category": "academic", "centroid": pos("a"), "footprintId": None, "footprintSource": "none", "entranceIds": [ids["a"]], "gsf": None, "address": None, "imageUrl": None, "inServiceArea": True, "routable": True, "unroutableReason": None}],
        "nodes": [{"kind": "node", "id": ids[k], "type": "entrance" if k == "a" else "walkway", "position": pos(k), **({"buildingId": "bldg:HALL", "provisional": False} if k == "a" else {})} for k in at],
        "edges": [edge("x", "a", "b", 60.0), edge("y", "b", "c", 80.0)],
    }
    edit(d)
    (tmp_path / "graph.json").write_text(json.dumps(d, indent=1))
    return readers.graph_document(spark, str(tmp_path / "graph.json"))


BREAKS = {
    "S1": lambda d: d["buildings"][0].update(category="castle"),
    "S2": lambda d: d["edges"][1].update(toNodeId="node:zzzzzzzz"),
    "S3": lambda d: d["buildings"][0].update(entranceIds=["node:bbbbbbbb"]),
    "S4": lambda d: d["nodes"].append(dict(d["nodes"][0])),
    "S5": lambda d: d["edges"][0]["geometry"][0].__setitem__(0, d["edges"][0]["geometry"][0][0] + 0.00006),
    "S8": lambda d: d["edges"].pop(),
    "G2": lambda d: d["nodes"][2].update(position=[0, 0]),
    "G4": lambda d: d["edges"][1].update(lengthM=92.5),
    "G7": lambda d: d["nodes"].append({"kind": "node", "id": "node:dddddddd", "type": "walkway", "position": d["nodes"][2]["position"]}),
}


def test_gates_pass_and_each_break_turns_its_gate_red(spark, tmp_path):
    status = lambda doc: {r.gate: r for r in gates.report(gates.document_gates(doc), ("S6", "S7")).collect()}
    good = status(document(spark, tmp_path))
    assert {g: r.status for g, r in good.items()} == {**{g: "PASS" for g in ("S1", "S2", "S3", "S4", "S5", "S8", "G2", "G4", "G7")}, "S6": "SKIP", "S7": "SKIP"}
    for gate, edit in BREAKS.items():
        made = gates.document_gates(document(spark, tmp_path, edit))[gate].collect()
        assert made, gate
        if gate == "G4":
            assert made[0].measurement.startswith("delta 12.5")


def test_more_gates(spark):
    docs = spark.createDataFrame([("f.json", '{"a": ["node:abcdefgh", {"edge:aaaaaaaa": "edge:bbbbbbbb"}], "t": "node:short"}')], "name string, body string")
    ids = spark.createDataFrame([("node:abcdefgh",)], "id string")
    assert [(r.entity, r.measurement) for r in gates.json_references(docs, ids).collect()] == [("f.json", "edge:bbbbbbbb")]
    counts = spark.createDataFrame([("x", 8, 6, 2), ("y", 8, 6, 1), ("z", None, 1, 1)], "source string, fetched int, kept int, rejected int")
    assert {r.entity for r in gates.reconciliation(counts).collect()} == {"y", "z"}
    assert gates.reconciliation(counts.limit(0)).count() == 1
    tables = readers.tables(spark)
    assert len(tables) == 14 and gates.reference_violations(tables).count() == 0
    tables["closure_edge"] = spark.createDataFrame([("c", "e")], schema.TABLES["closure_edge"])
    assert gates.reference_violations(tables).count() == 2
    twice = spark.createDataFrame([("h", "m", 1.0, None, None)] * 2, schema.TABLES["build_metric"])
    assert gates.key_violations(twice, "build_metric").count() == 1
    wrong = spark.createDataFrame([("h", "a", "b", 1.0, 1.0, 1.0, 1, "disconnected")], schema.TABLES["route_sample"])
    assert [r.measurement for r in gates.check_constraints(wrong, "route_sample").collect()] == ["outcome"]
    nodes = spark.createDataFrame([(i,) for i in range(6)], "id long")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (4, 5, 1.0)], "u long, v long, m double")
    assert {r.entity for r in gates.one_component(nodes, edges).collect()} == {"3", "4"}
    allowed = spark.createDataFrame([(4, "why"), (5, "why"), (3, " ")], "id long, reason string")
    assert {r.entity for r in gates.one_component(nodes, edges, allowed).collect()} == {"3"}


def test_register(spark, tmp_path):
    point = lambda code, name, x, y, gsf, t: {"attributes": {"BLDG_CODE": code, "BLDG_NAME": name, "BLDG_GSF": gsf, "EditDate": t}, "geometry": None if x is None else {"x": x, "y": y}}
    far, near = P(400, 0), P(60, 0)
    body = {"features": [point("S", "STADIUM", LON, LAT, 10, 5), point("S", "ANNEX", far["lon"], far["lat"], 90, 1), point("M", "MU", LON, LAT, 5, 3), point("M", "MU WING", near["lon"], near["lat"], 50, 2), point("Z", "ZERO", 0, 0, 1, 9), point("Q", "NOWHERE", None, None, 1, None)]}
    (tmp_path / "p.json").write_text(json.dumps(body, indent=1))
    p = readers.register_points(spark, str(tmp_path / "p.json"))
    kept, rejected = writers.split_rejects(p.withColumn("reject_reason", register.point_reason(F.col("x"), F.col("y"))))
    assert {r.BLDG_CODE: r.reject_reason for r in rejected.collect()} == {"Z": register.NULL_ISLAND, "Q": register.NO_GEOMETRY}
    r = register.records(kept.select(F.col("ordinal").alias("id"), F.col("BLDG_CODE").alias("code"), F.col("BLDG_GSF").alias("gsf"), geo.point(F.col("x"), F.col("y")).alias("position")))
    got = {x.id: (x.record_id, x.resolution, x.is_primary, x.member_count) for x in r.collect()}
    assert got == {0: ("bldg:S#2", "separate", True, 1), 1: ("bldg:S", "separate", True, 1), 2: ("bldg:M", "wings", False, 2), 3: ("bldg:M", "wings", True, 2)}
    assert r.filter("id = 2").first().max_span_m == pytest.approx(60, abs=0.2)
    f = {x.field: x for x in register.freshness(kept, ["EditDate", "ExtractDateTime"]).collect()}
    assert f["EditDate"].n == 4 and f["EditDate"].p50.microsecond == 3000 and f["ExtractDateTime"].n == 0 and f["ExtractDateTime"].p50 is None
    b = spark.createDataFrame([("A", 0), ("B", 60_000), ("C", 5)], "code string, gsf long")
    f1, f2 = spark.createDataFrame([("A",), ("D",)], "code string"), spark.createDataFrame([("C",), ("A",)], "code string")
    c = register.coverage(b, f1).first()
    assert (c.records, c.with_footprint, c.coverage_pct, c.without_over_50k) == (3, 1, 33.3, 1)
    assert [sorted(r.code for r in d.collect()) for d in register.gained(b, f1, f2)] == [["C"], ["D"], ["B"]]
    merged = register.merge_by_priority([f1.withColumn("s", F.lit(1)), f2.withColumn("s", F.lit(2))])
    assert {(r.code, r.s) for r in merged.collect()} == {("A", 1), ("D", 1), ("C", 2)}
    shapes = spark.createDataFrame([(0, "Polygon", "A1", line((0, 0), (9, 0), (9, 9), (0, 0))), (1, "Point", "a", line((0, 0), (9, 0))), (2, "Polygon", "B", [{"lon": 0.0, "lat": 0.0}] * 4)], f"ordinal int, geometry_type string, code string, ring array<{geo.POINT}>")
    faults = register.shape_errors(shapes, schema.LON_BOUNDS, schema.LAT_BOUNDS).groupBy("ordinal").count().collect()
    assert {r.ordinal: r["count"] for r in faults} == {1: 4, 2: 1}
    names = spark.createDataFrame([(True, "SOLAR SHADE"), (True, "Solarium"), (False, "X"), (True, None)], "s boolean, n string").select(register.shape_reason(F.col("s"), F.col("n")).alias("r"))
    assert [r.r for r in names.collect()] == [register.NOT_ENCLOSED, None, register.NOT_IN_SET, None]


def test_ways(spark, tmp_path):
    g = lambda *xy: [{"lat": P(*p)["lat"], "lon": P(*p)["lon"]} for p in xy]
    el = [
        {"type": "way", "id": 1, "geometry": g((0, 0), (9, 0)), "tags": {"highway": "steps", "step_count": "4", "x": "y"}},
        {"type": "way", "id": 2, "geometry": g((0, 0), (9, 0)), "tags": {"highway": "service", "foot": "no"}},
        {"type": "way", "id": 3, "geometry": g((0, 0), (9, 0)), "tags": {"highway": "service"}},
        {"type": "way", "id": 4, "geometry": g((0, 0), (9, 0)), "tags": {"highway": "residential", "foot": "yes", "sidewalk": "both"}},
        {"type": "way", "id": 5, "geometry": g((0, 0), (9, 0), (9, 9), (0, 0)), "tags": {"highway": "pedestrian", "area": "yes"}},
        {"type": "way", "id": 6, "geometry": g((0, 0), (9, 0)), "tags": {"area:highway": "footway"}},
        {"type": "way", "id": 7, "geometry": g((0, 0)), "tags": {"highway": "path"}},
        {"type": "way", "id": 8, "geometry": g((0, 0), (9, 0)), "tags": {"highway": "tertiary", "foot": "yes"}},
        {"type": "node", "id": 9, "lat": LAT, "lon": LON, "tags": {"highway": "crossing", "crossing": "marked"}},
        {"type": "node", "id": 10, "lat": LAT, "lon": LON, "tags": {"barrier": "fence"}},
        {"type": "node", "id": 11, "lat": LAT, "lon": LON, "tags": {"entrance": "main"}},
        {"type": "node", "id": 12, "lat": LAT, "lon": LON},
    ]
    (tmp_path / "o.json").write_text(json.dumps({"elements": el}, indent=1))
    f = {r.osm_id: r for r in ways.features(readers.overpass(spark, str(tmp_path / "o.json"))).collect()}
    assert sorted(f) == [1, 3, 5, 6, 8, 9, 11]
    assert f[5].geometry_type == "Polygon" and f[6].geometry_type == "LineString" and f[9].crossing == "marked"
    assert f[1].tags == {"highway": "steps", "step_count": "4"}
    m = ways.centreline_metres(ways.features(readers.overpass(spark, str(tmp_path / "o.json")))).first().metres
    assert m == pytest.approx(36, abs=0.3)
    with pytest.raises(NotImplementedError):
        readers.extract_file(spark, "x.pbf")
    assert "(33.0,-112.0,34.0,-111.0)" in readers.overpass_query(-112.0, 33.0, -111.0, 34.0)


def lines_of(spark, rows):
    return spark.createDataFrame([(i, l, layer, bridge, name) for i, l, layer, bridge, name in rows], f"way long, line array<{geo.POINT}>, layer string, bridged boolean, name string")


def test_building_the_graph(spark):
    rows = [
        (1, line((0, 0), (100, 0)), None, False, "x"),
        (2, line((50, -50), (50, 50)), None, False, "x"),
        (3, line((20, -45), (20, 45)), "1", True, "b"),  # passes over
        (4, line((100.8, 0), (100, 80)), None, False, "x"),  # ends close to 1
        (5, line((0, 0), (0, 40)), None, False, "x"),  # shares a vertex
        (6, line((50, 50), (52, 54)), None, False, "x"),  # a stub
    ]
    split = build.node_lines(lines_of(spark, rows))
    assert {r.way: r["count"] for r in split.groupBy("way").count().collect()} == {1: 2, 2: 2, 3: 1, 4: 1, 5: 1, 6: 1}
    total = split.agg(F.sum(geo.length(F.col("line")))).first()[0]
    assert total == pytest.approx(100 + 100 + 90 + 80 + 40 + math.hypot(2, 4), abs=0.3)
    snapped = build.snap(split).withColumn("id", F.xxhash64("way", "part")).withColumn("m", geo.length(F.col("line"))).cache()
    degree = sorted(r.degree for r in build.degrees_of(snapped).collect())
    assert degree.count(4) == 1 and degree.count(2) == 3
    kept = build.drop_stubs(snapped, snapped.select(F.col("u").alias("node")).limit(0))
    assert kept.count() == snapped.count() - 1
    big, others = build.largest_component(kept.select("id", "u", "v", "m", "line", "name"))
    assert others.count() == 1 and others.first().warn is False and others.first().nodes == 2
    merged = build.collapse_chains(big, big.select(F.col("u").alias("node")).limit(0), ["name"])
    ends = merged.agg(F.count("*"), F.sum(geo.length(F.col("line")))).first()
    assert ends[0] == 4 and ends[1] == pytest.approx(big.agg(F.sum("m")).first()[0], abs=0.01)
    withids = build.with_ids(merged.select("u", "v", "line", "name"))
    out = withids.collect()
    assert all(r.from_node_id < r.to_node_id and len(r.id) > 12 for r in out)
    again = build.with_ids(merged.select("u", "v", "line", "name").repartition(3)).collect()
    assert sorted(r.id for r in out) == sorted(r.id for r in again)
    assert withids.filter(F.col("id").rlike(schema.ID_PATTERNS["edge"])).count() == len(out)


def test_build_details(spark):
    e = spark.createDataFrame([(1, "a", "b", line((0, 0), (50, 0)), 2), (2, "b", "a", line((50, 0.4), (0, 0.4)), 1), (3, "a", "b", line((0, 0), (25, 9), (50, 0)), 1)], f"id long, u string, v string, line array<{geo.POINT}>, tags int")
    assert sorted(r.id for r in build.drop_duplicates(e).collect()) == [1, 3]
    ring = line((10, 10), (30, 10), (30, 30), (10, 30), (10, 10))
    b = spark.createDataFrame([("near", ring), ("mapped", line((100, 2), (120, 2), (120, 20), (100, 20), (100, 2))), ("far", line((0, 100), (9, 100), (9, 109), (0, 109), (0, 100))), ("lost", line((0, 900), (9, 900), (9, 909), (0, 909), (0, 900)))], f"id string, ring array<{geo.POINT}>")
    edges = spark.createDataFrame([(1, line((-50, 0), (200, 0)), "paved", 0.15)], f"id long, line array<{geo.POINT}>, surface string, shadeIndex double")
    doors = build.doors(b, spark.createDataFrame([(P(110, 2),)], f"p {geo.POINT}"), edges).cache()
    kinds = {}
    for r in doors.collect():
        kinds.setdefault(r.building_id, []).append((r.provisional, r.weak, r.reason))
    assert kinds["mapped"] == [(False, False, None)] and kinds["near"] == [(True, False, None)] * 3
    assert kinds["far"] == [(True, True, None)] and kinds["lost"] == [(None, None, "no_walkway_within_120m")]
    parts, links = build.link_doors(doors.filter("building_id in ('mapped', 'near')"), edges)
    assert parts.agg(F.sum(geo.length(F.col("line")))).first()[0] == pytest.approx(250, abs=0.1)
    assert parts.count() >= 3 and links.filter("building_id = 'mapped'").count() == 1
    foot = spark.createDataFrame([(7, ring)], f"footprint_id long, ring array<{geo.POINT}>")
    through = spark.createDataFrame([(1, line((0, 15), (40, 15))), (2, line((0, 15), (20, 20))), (3, line((0, 0), (40, 0)))], f"id long, line array<{geo.POINT}>")
    assert sorted(r.edge_id for r in spatial.piercing(through, foot).collect()) == [1, 2]
    led, left = build.around_footprints(through, foot)
    assert [r.id for r in left.collect()] == [2]
    assert spatial.piercing(led.filter("id = 1"), foot).count() == 0
    assert led.filter("id = 1").select(geo.length(F.col("line"))).first()[0] == pytest.approx(50, abs=2)
    s = spark.createDataFrame([(1, line((0, 5), (9, 5)), True), (2, line((31, 12), (31, 28)), None), (3, line((300, 300), (310, 300)), None), (4, line((0, 200), (9, 200)), False)], f"id long, line array<{geo.POINT}>, covered boolean").withColumns({"tunnel": F.lit(None).cast("boolean"), "indoor": F.lit(False)})
    trees = spark.createDataFrame([(1, line((300, 303), (310, 303)))], f"id long, line array<{geo.POINT}>")
    assert {r.id: r.shadeSource for r in build.shade(s, trees, foot).collect()} == {1: "covered", 2: "adjacency", 3: "treerow", 4: "default"}
    area = spark.createDataFrame([(line((-10, -10), (60, -10), (60, 60), (-10, 60), (-10, -10)),)], f"ring array<{geo.POINT}>")
    w = spark.createDataFrame([(1, line((0, 0), (5, 5))), (2, line((-50, 0), (100, 0))), (3, line((200, 200), (210, 200)))], f"way long, line array<{geo.POINT}>")
    inside, outside = build.clip(w, area)
    assert sorted(r.way for r in inside.collect()) == [1, 2] and [r.way for r in outside.collect()] == [3]
    pl = spark.createDataFrame([(5, ring)], f"way long, line array<{geo.POINT}>")
    reach = spark.createDataFrame([(1, line((0, 0), (10, 10))), (2, line((50, 10), (30, 10))), (3, line((30, 30), (60, 60)))], f"way long, line array<{geo.POINT}>")
    assert build.plaza_lines(pl, reach).count() == 3 and build.plaza_lines(pl.limit(0), reach).count() == 0


def test_components_and_nearest_against_plain(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long"), "u", "v").collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root}
    pts = [(i, P(rng.uniform(0, 500), rng.uniform(0, 500))) for i in range(80)]
    segs = [(i, [P(x := rng.uniform(0, 500), y := rng.uniform(0, 500)), P(x + rng.uniform(-60, 60), y + rng.uniform(-60, 60))]) for i in range(60)]
    p, e = spark.createDataFrame(pts, f"point_id long, p {geo.POINT}"), spark.createDataFrame(segs, f"id long, line array<{geo.POINT}>")
    near = {r.point_id: (r.edge_id, r.dist_m) for r in spatial.nearest_edge(p, e, 60.0, radii=(10.0,)).collect()}
    plain = {}
    for r in p.crossJoin(e).withColumn("d", geo.distance_to_line(F.col("p"), F.col("line"))).filter("d <= 60").collect():
        plain[r.point_id] = min(plain.get(r.point_id, (9e9, 0)), (r.d, r.id))
    assert {k: (e_, d) for k, (d, e_) in plain.items()} == near


def test_overlays_and_reports(spark, tmp_path):
    refs = spark.createDataFrame([("o1", "f", "node:aaaaaaaa", None), ("o2", "f", "gone", "osm:way/1"), ("o3", "f", f"geo:{LON},{LAT},r=5", None), ("o4", "f", "gone", f"geo:{LON},{LAT},r=50"), ("o5", "f", "gone", None)], "overlay_id string, file string, ref_primary string, ref_fallback string")
    known = spark.createDataFrame([("node:aaaaaaaa", "node:aaaaaaaa"), ("osm:way/1", "edge:bbbbbbbb")], "ref string, id string")
    places = spark.createDataFrame([("node:cccccccc", P(1, 1)), ("node:dddddddd", P(20, 0))], f"id string, p {geo.POINT}")
    got = overlays.resolve(refs, known, places)
    assert {r.overlay_id: (r.resolution, r.resolved_to) for r in got.collect()} == {"o1": ("exact", "node:aaaaaaaa"), "o2": ("exact", "edge:bbbbbbbb"), "o3": ("spatial", "node:cccccccc"), "o4": ("ambiguous", None), "o5": ("failed", None)}
    entries = spark.createDataFrame([("f", "o1", "node:aaaaaaaa"), ("f", "o3", "geo")], "file string, overlay_id string, ref string")
    assert {r.overlay_id: (r.ref, r.repinned) for r in overlays.repin(entries, got).collect()} == {"o1": ("node:aaaaaaaa", False), "o3": ("node:cccccccc", True)}
    ent = spark.createDataFrame([("e1", "B", P(0, 0), True), ("e2", "B", P(1, 0), True), ("e3", "B", P(2, 0), True)], f"id string, buildingId string, position {geo.POINT}, provisional boolean")
    act = spark.createDataFrame([("delete", "e1", None, None), ("promote", "e2", None, None), ("move", "e3", None, P(9, 9)), ("add", "e4", "B", P(5, 5))], f"action string, id string, buildingId string, position {geo.POINT}")
    after = {r.id: r for r in overlays.apply_entrances(ent, act).collect()}
    assert sorted(after) == ["e2", "e3", "e4"] and after["e2"].provisional is False and after["e3"].position.lon == P(9, 9)["lon"]
    assert one(spark, overlays.normalised(F.lit("  Café-Hall, É "))) == "cafehall e"
    trace = spark.createDataFrame([("r", i, P(10 * i, 20 if i == 2 else 0)) for i in range(5)], f"route string, seq int, p {geo.POINT}")
    t = overlays.trace_deviation(trace, spark.createDataFrame([("r", line((0, 0), (40, 0)))], f"route string, line array<{geo.POINT}>")).first()
    assert t.max_m == pytest.approx(20, abs=0.1) and t.correct
    pairs = report.sampled_pairs(spark, [(f"b{i}", P(i * 40, 0)["lon"], P(0, i * 7)["lat"]) for i in range(12)], n=20)
    assert pairs.count() == 20 and pairs.filter("straight_m < 50").count() == 0
    assert pairs.collect() == report.sampled_pairs(spark, [(f"b{i}", P(i * 40, 0)["lon"], P(0, i * 7)["lat"]) for i in range(12)], n=20).collect()
    q = {r.gate: r for r in report.quality(report.detours(spark.createDataFrame([(120.0, 100.0), (200.0, 100.0), (None, 80.0)], "graph_m double, straight_m double"))).collect()}
    assert q["R1"].value == 1.6 and q["R3"].value == 2.0 and q["R4"].value == 1.0 and not q["R1"].ok and q["R3"].ok
    assert report.ratchet(1.3, 1.2401) == 1.25
    n, e = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("e", "a", "b", 1.0)], "id string, u string, v string, m double")
    h = report.graph_hash(n, e).first().graph_hash
    assert h == report.graph_hash(n.repartition(3).orderBy(F.desc("id")), e).first().graph_hash != report.graph_hash(n, e.withColumn("m", F.lit(1.1))).first().graph_hash
    assert report.same_build({"n": n, "e": e}, {"n": n.orderBy("id"), "e": e.withColumn("u", F.lit("z"))}) == ["e"]
    m = spark.createDataFrame([("a", 1), ("b", 2)], "file string, n int")
    assert {(r.file, r.n) for r in writers.upsert_manifest(m, spark.createDataFrame([("b", 9)], "file string, n int")).collect()} == {("a", 1), ("b", 9)}
    assert writers.replace_section("x\n<!-- m:begin -->\nold\n<!-- m:end -->\ny\n", "m", "new") == "x\n<!-- m:begin -->\nnew\n<!-- m:end -->\ny\n"
    with pytest.raises(writers.WriteRefused):
        writers.replace_partition(m, str(tmp_path / "t"), "file")
    writers.replace_partition(m, str(tmp_path / "t"), "file", allow_write=True)
    writers.replace_partition(m.filter("file = 'b'").withColumn("n", F.lit(7)), str(tmp_path / "t"), "file", allow_write=True)
    assert {(r.file, r.n) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {("a", 1), ("b", 7)}
    (tmp_path / "junk.json").write_text('junk )]}\n{"features": [{"geometry": {"type": "Polygon", "coordinates": [[[1.0, 2.0]]]}, "properties": {"code": "A"}}]}')
    f = readers.features_after_prefix(spark, str(tmp_path / "junk.json"), "code string", "array<array<array<double>>>").first()
    assert f.code == "A" and f.coordinates == [[[1.0, 2.0]]]
    feature = m.select(writers.as_feature("Point", F.array(F.lit(1.0), F.lit(2.0)), ["file", "n"]).alias("f")).first().f
    assert json.loads(feature) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}, "properties": {"file": "a", "n": 1}}


def test_streams(spark, tmp_path):
    folder, state, check = tmp_path / "in", str(tmp_path / "state"), str(tmp_path / "check")
    folder.mkdir()
    told = []

    def run():
        changes.upsert_stream(changes.changes(spark, str(folder)), state, check, lambda n, b: told.append(b.count())).awaitTermination(60)

    put = lambda name, rows: (folder / name).write_text("\n".join(json.dumps(dict(zip(("id", "kind", "seq", "deleted", "body"), r, strict=True))) for r in rows))
    put("1.json", [("a", "node", 1, False, "x"), ("a", "node", 2, False, "y"), ("b", "node", 1, False, "z")])
    run()
    assert told == [3] and {r.id: r.body for r in changes.current(spark, state).collect()} == {"a": "y", "b": "z"}
    run()
    assert told == [3]  # nothing new, no notice
    put("2.json", [("b", "node", 2, True, None), ("a", "node", 1, False, "late")])
    run()
    assert told == [3, 2] and {r.id: r.body for r in changes.current(spark, state).collect()} == {"a": "y"}
    for n in range(3, 7):  # a part keeps two versions; others are left alone
        put(f"{n}.json", [("b", "node", n, False, str(n))])
        run()
    versions = changes._versions(spark, state)
    assert sorted(map(len, versions.values())) == [2, 2] and {r.id: r.body for r in changes.current(spark, state).collect()} == {"a": "y", "b": "6"}
    c = spark.createDataFrame([("c1", "h", ["e1", "e9"]), ("c2", "old", ["e2"])], "closure_id string, graph_hash string, edge_ids array<string>").withColumns({"from_utc": F.current_timestamp(), "to_utc": F.lit(None).cast("timestamp")})
    c.write.parquet(str(tmp_path / "c"))
    stream = spark.readStream.schema(c.schema).parquet(str(tmp_path / "c"))
    joined = changes.closures_with_edges(stream, spark.createDataFrame([("e1",), ("e2",)], "id string"), "h")
    joined.writeStream.format("memory").queryName("closed").trigger(availableNow=True).start().awaitTermination(60)
    assert {(r.closure_id, r.edge_id, r.stale) for r in spark.table("closed").collect()} == {("c1", "e1", False), ("c2", "e2", True)}


def test_closures_lapse_without_a_row(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda s: f"2026-08-27T14:{s // 60:02}:{s % 60:02}Z"
    batches = [[("e1", "c1", False, 0), ("e2", "c2", True, 10)], [("e1", "c1", False, 50)], [("e3", "c3", False, 75)], [("e3", "c3", False, 130)], [("e3", "c3", False, 131)]]
    try:
        for n, rows in enumerate(batches):
            (folder / f"{n}.json").write_text("\n".join(json.dumps({"edge_id": e, "closure_id": c, "stale": s, "seen": at(t)}) for e, c, s, t in rows))
            stream = spark.readStream.schema("edge_id string, closure_id string, stale boolean, seen timestamp").json(str(folder))
            out = changes.closures_in_force(stream)
            out.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.schema("edge_id string, closure_id string, closed boolean, stale boolean").json(str(tmp_path / "out")).collect())
    # c1 was confirmed at 50 s and holds until 110; c2 lapses at 70; c3 is still in force
    assert got == [("e1", "c1", False, False), ("e1", "c1", True, False), ("e2", "c2", False, True), ("e2", "c2", True, True), ("e3", "c3", True, False)]
