"""The graph object and the whole build on a small town."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from test_reference import BREAKS, P, document, line

from pathweave import schema
from pathweave.functions import cost, geo
from pathweave.operators import gates, spatial
from pathweave.operators.components import connected_components
from pathweave.plans import build_graph
from pathweave.plans.graph import Graph, batch


@pytest.fixture
def graph(spark, tmp_path):
    document(spark, tmp_path, lambda d: (d["buildings"].append({**d["buildings"][0], "id": "bldg:LAB", "code": "LAB", "displayName": "Lab", "entranceIds": ["node:cccccccc"]}), d["nodes"][2].update(type="entrance", buildingId="bldg:LAB", provisional=False)))
    return Graph.load(spark, str(tmp_path / "graph.json"))


def test_graph(spark, graph):
    assert graph.require("nodes", "node:bbbbbbbb").type == "walkway" and graph.get("edges", "edge:none") is None
    with pytest.raises(KeyError):
        graph.require("edges", "edge:none")
    degree = {r.node: r["count"] for r in graph.adjacency().groupBy("node").count().collect()}
    assert degree == {"node:aaaaaaaa": 1, "node:bbbbbbbb": 2, "node:cccccccc": 1}
    near = graph.nearest_edge(spark.createDataFrame([(1, P(30, 4)), (2, P(900, 900))], f"point_id int, p {geo.POINT}")).collect()
    assert [(r.point_id, r.edge_id) for r in near] == [(1, "edge:xxxxxxxx")] and near[0].dist_m == pytest.approx(4, abs=0.05)
    noon = dt.datetime(2026, 7, 1, 19, tzinfo=dt.timezone.utc)
    r = batch(graph, [("bldg:HALL", "bldg:LAB")], depart=noon).first()
    assert r.ok and r.route.lengthM == 140 and r.route.id.endswith("@walk-default:12") and r.route.graphHash == graph.graph_hash()
    shaded = ("shade", 1.35, False, False, 1.0, 20.0)
    slower = batch(graph, [("bldg:HALL", "bldg:LAB")], depart=noon, profile=shaded).first()
    assert slower.route.estimatedSec > r.route.estimatedSec and slower.route.lengthM == r.route.lengthM and slower.route.nodeIds == r.route.nodeIds
    closed = spark.createDataFrame([("edge:yyyyyyyy",)], "edge_id string")
    assert batch(graph, [("bldg:HALL", "bldg:LAB")], depart=noon, closed=closed).first().reason == "blocked_by_closure"
    cut = graph.delete("edges", spark.createDataFrame([("edge:yyyyyyyy",)], "id string"))
    assert batch(cut, [("bldg:HALL", "bldg:LAB")], depart=noon).first().reason == "disconnected" and cut.graph_hash() != graph.graph_hash()
    assert not graph.unverified(batch(graph, [("bldg:HALL", "bldg:LAB")], depart=noon)).first().unverified
    longer = graph.put("edges", graph.edges.filter("id = 'edge:xxxxxxxx'").withColumn("lengthM", F.lit(75.0)))
    assert longer.edges.count() == 2 and {r.gate for r in longer.validate().filter("status = 'FAIL'").collect()} == {"G4"}
    assert gates.unreachable(cut.buildings, cut.edges, "bldg:HALL").collect()[0].entity == "bldg:LAB"
    assert gates.without_entrance(graph.buildings.withColumn("entranceIds", F.array().cast("array<string>"))).count() == 2
    roads = spark.createDataFrame([(1, line((30, -20), (30, 20)))], f"id long, line array<{geo.POINT}>")
    spots = spark.createDataFrame([("x", P(30, 1))], f"id string, position {geo.POINT}")
    assert gates.roads_without_crossing(graph.edges, roads, spots.limit(0)).count() == 1 and gates.roads_without_crossing(graph.edges, roads, spots).count() == 0
    assert set(BREAKS) >= {"S1", "G7"} and cost.ACCESSIBLE_PROFILE[3] and json.dumps(schema.KEYS)


def town(spark):
    rows = [(i, line((0, 40 * i), (200, 40 * i)), None, False, "path", f"row{i}", "paved", False) for i in range(5)]
    rows += [(10 + i, line((50 * i, 0), (50 * i, 160)), None, False, "path", f"col{i}", "concrete", False) for i in range(5)]
    rows += [(29, line((240, 40), (300, 40)), None, False, "path", "side", "paved", False)]
    rows += [(30, line((200.9, 160), (260, 160)), None, False, "path", "east", "gravel", False), (31, line((900, 900), (960, 900)), None, False, "path", "away", "paved", False), (32, line((5000, 0), (5100, 0)), None, False, "path", "out", "paved", False)]
    rows += [(40, line((200, 0), (240, 0), (240, 40), (200, 40), (200, 0)), None, False, "plaza", "square", "paved", True)]
    pts = f"array<{geo.POINT}>"
    ways = spark.createDataFrame(rows, f"way long, line {pts}, layer string, bridged boolean, type string, name string, surface string, plaza boolean")
    buildings = spark.createDataFrame([("bldg:A", line((110, 50), (130, 50), (130, 70), (110, 70), (110, 50))), ("bldg:B", line((255, 170), (275, 170), (275, 190), (255, 190), (255, 170)))], f"id string, ring {pts}")
    entrances = spark.createDataFrame([(P(120, 50),)], f"p {geo.POINT}")
    area = spark.createDataFrame([(line((-100, -100), (1500, -100), (1500, 1500), (-100, 1500), (-100, -100)),)], f"ring {pts}")
    trees = spark.createDataFrame([(1, line((0, 163), (200, 163)))], f"id long, line {pts}")
    return build_graph.State(ways, buildings, entrances, area, trees)


def test_build(spark):
    s = build_graph.run(town(spark))
    assert s.log == [n for n, _ in build_graph.STAGES] and s.rejected.count() == 1 and s.dropped.count() == 1
    e, n = s.edges.cache(), build_graph.nodes(s).cache()
    assert e.filter("type = 'link'").count() >= 2 and e.filter("type = 'plaza'").count() >= 1
    assert e.filter("shadeSource = 'treerow'").count() >= 4
    comps = connected_components(e, "from_node_id", "to_node_id").select("component").distinct().count()
    assert comps == 1
    doc = e.select("id", F.col("from_node_id").alias("fromNodeId"), F.col("to_node_id").alias("toNodeId"), F.col("line").alias("geometry"), F.col("m").alias("lengthM"))
    assert gates.dangling(doc, n).count() == 0 and gates.length_agrees(doc).count() == 0
    assert gates.unique_ids(e.select(F.lit("edge").alias("kind"), "id")).count() == 0
    assert spatial.piercing(e.filter("type <> 'link'").select("id", "line"), s.buildings.select(F.col("id").alias("footprint_id"), "ring")).count() == 0
    with pytest.raises(ValueError, match="no stage"):
        build_graph.run(town(spark), only="roof")
    assert build_graph.run(town(spark), only="load").log == ["load"]


def test_build_keeps_barriers_and_crossings(spark):
    """Stubs stay that end at a barrier; chains are cut at crossings, whose nodes get their type."""
    s = town(spark)
    more = [(50, line((100, 160), (100, 165)), None, False, "path", "gate", "paved", False), (51, line((150, 160), (150, 165)), None, False, "path", "noise", "paved", False), (53, line((260, 160), (320, 160)), None, False, "path", "east", "gravel", False)]
    s.ways = s.ways.unionByName(spark.createDataFrame(more, s.ways.schema))
    s.barriers = spark.createDataFrame([(P(100, 165),)], f"p {geo.POINT}")
    s.crossings = spark.createDataFrame([(P(260, 160),)], f"p {geo.POINT}")
    s = build_graph.run(s)
    n = build_graph.nodes(s).cache()
    near = lambda x, y: n.filter(geo.haversine(F.col("position"), geo.point(P(x, y)["lon"], P(x, y)["lat"])) < 1)
    assert near(100, 165).count() == 1 and near(150, 165).count() == 0
    assert near(260, 160).first().type == "crossing" and n.filter("type = 'crossing'").count() == 1
