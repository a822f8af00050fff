"""Documents written and read back, faults of documents, services, export layers, overlay files."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from pathweave.functions import cost, geo
from pathweave.operators import gates, overlays, report, route, spatial
from pathweave.sources import readers, writers


@pytest.fixture
def service():
    """A layer of 25 features that gives 10 a page and never says how many there are, and an echo of posts."""

    class Handler(BaseHTTPRequestHandler):
        def _say(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            if q["where"] == "wrong":
                return self._say({"error": {"code": 400, "message": "no such field"}})
            at = int(q["resultOffset"])
            rows = [{"attributes": {"n": i}} for i in range(at, min(25, at + int(q["resultRecordCount"]), at + 10))]
            self._say({"features": rows, "exceededTransferLimit": at + 10 < 25})

        def do_POST(self):
            sent = parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode())["data"][0]
            self._say({"elements": [{"type": "node", "id": 7, "lat": 33.4, "lon": -111.9, "tags": {"said": sent}}, {"type": "node", "id": 8, "lat": 1.0, "lon": 2.0}]})

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query"
    server.shutdown()


def test_pages_are_followed(spark, service):
    spark.dataSource.register(readers.PagedFeatures)
    load = lambda **o: sorted(json.loads(r.feature)["attributes"]["n"] for r in spark.read.format("paged_features").options(url=service, pageSize=10, **o).load().collect())
    assert load() == list(range(25))
    assert load(count=25) == list(range(25))
    assert load(count=11) == list(range(25))  # too low a count loses nothing
    with pytest.raises(Exception, match="no such field"):
        load(where="wrong")


def test_posted_queries(spark, service):
    found = {r.id: r for r in readers.answered_elements(readers.posted(spark, service, "node;out;")).collect()}
    assert found[7].tags == {"said": "node;out;"} and found[8].tags == {} and found[8].lat == 1.0
    asked = readers.overpass_query(-112.0, 33.0, -111.0, 34.0)
    assert asked.count("(33.0,-112.0,34.0,-111.0)") == 8 and '["sidewalk"]' not in asked and '[!"sidewalk"]' in asked


POINT = "struct<lon:double,lat:double>"


def document(spark):
    at = lambda x: (x, 33.42)
    b = spark.createDataFrame([("building", "bldg:A", "A", at(-111.93), ["node:aaaaaaaa"], True)], f"kind string, id string, displayName string, centroid {POINT}, entranceIds array<string>, routable boolean")
    n = spark.createDataFrame([("node", "node:aaaaaaaa", "entrance", at(-111.93), "bldg:A", False), ("node", "node:bbbbbbbb", "walkway", at(-111.931), None, None)], f"kind string, id string, type string, position {POINT}, buildingId string, provisional boolean")
    e = spark.createDataFrame([("edge", "edge:cccccccc", "node:aaaaaaaa", "node:bbbbbbbb", [at(-111.93), at(-111.931)], 92.8)], f"kind string, id string, fromNodeId string, toNodeId string, geometry array<{POINT}>, lengthM double")
    return b, n, e


def test_documents_are_read_back(spark, tmp_path):
    b, n, e = document(spark)
    m = spark.createDataFrame([("2026-01-01T00:00:00Z", "abc")], "generatedUtc string, graphHash string")
    path = str(tmp_path / "graph")
    with pytest.raises(writers.WriteRefused):
        writers.emit_document(b, n, e, path)
    writers.emit_document(b, n, e, path, manifest=m, allow_write=True)
    doc = readers.graph_document(spark, path, lines=True)
    assert doc["manifest"].first().graphHash == "abc" and doc["manifest"].count() == 1
    for name, df in (("buildings", b), ("nodes", n), ("edges", e)):
        assert doc[name].select(*df.columns).orderBy("id").collect() == df.orderBy("id").collect()
    assert readers.document_faults(spark, path, lines=True).count() == 0
    first = sorted(p.read_text() for p in (tmp_path / "graph").glob("part-*"))
    writers.emit_document(b, n, e, str(tmp_path / "again"), manifest=m, allow_write=True)
    assert sorted(p.read_text() for p in (tmp_path / "again").glob("part-*")) == first


def test_faults_of_documents(spark, tmp_path):
    doc = {
        "buildings": [{"kind": "building", "id": "bldg:A", "routable": "perhaps", "colour": "red"}],
        "nodes": [{"kind": "node", "id": "node:aaaaaaaa", "type": "entrance", "position": [-111.93, 33.42], "buildingId": "bldg:A"}, {"kind": "node", "id": "node:bbbbbbbb", "type": "crossing", "position": [-111.93, 33.42]}],
        "edges": [{"kind": "edge", "id": "edge:cccccccc", "lengthM": "long", "geometry": [[-111.93, 33.42]]}],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    found = {tuple(r) for r in readers.document_faults(spark, str(tmp_path / "g.json")).collect()}
    assert found == {("manifest", "document", "missing"), ("buildings", "bldg:A", "unexpected property colour"), ("buildings", "bldg:A", "routable is of another type"), ("edges", "edge:cccccccc", "lengthM is of another type")}
    errors = {tuple(r) for r in gates.schema_errors(readers.graph_document(spark, str(tmp_path / "g.json"))).collect()}
    assert ("node:aaaaaaaa", "an entrance has no provisional") in errors and ("node:aaaaaaaa", "an entrance has no buildingId") not in errors
    assert ("node:bbbbbbbb", "a crossing has no signalized") in errors


def test_export_layers(spark):
    t = readers.tables(spark)
    put = lambda name, **values: spark.createDataFrame([tuple(values.get(f.name) for f in t[name].schema)], t[name].schema)
    here, ring = (-111.93, 33.42), [(-111.931, 33.419), (-111.929, 33.419), (-111.929, 33.421), (-111.931, 33.421), (-111.931, 33.419)]
    assert tuple(writers.extent(t["edge"]).first()) == writers.DEFAULT_BOX
    t["node"] = put("node", node_id="n1", type="entrance", building_id="b1", provisional=True, geom=here).union(put("node", node_id="n2", type="walkway", geom=(-111.93, 33.4225)))
    t["entrance"] = put("entrance", node_id="n1", building_id="b1", ordinal=0, snap_m=3.5, side="main")
    t["building"] = put("building", building_id="b1", code="B", display_name="Bee", footprint_id=5, gsf=10, centroid=here)
    t["footprint"] = put("footprint", footprint_id=5, code="B", geom=ring).union(put("footprint", footprint_id=6, code="", geom=ring))
    t["edge"] = put("edge", edge_id="e1", type="path", geom=[here, (-111.93, 33.4225)])
    dropped = spark.createDataFrame([(9, 3, 120.5, here)], f"component long, nodes long, metres double, centre {POINT}")
    out = {name: {r.key: json.loads(r.feature) for r in df.collect()} for name, df in writers.layers(t, dropped).items()}
    assert list(out) == ["edges", "nodes", "footprints", "buildings", "dropped"]
    assert out["nodes"]["n1"]["properties"] == {"node_id": "n1", "type": "entrance", "building_id": "b1", "provisional": True, "entrance_ordinal": 0, "snap_m": 3.5, "side": "main"}
    assert out["nodes"]["n2"]["properties"] == {"node_id": "n2", "type": "walkway"}
    assert out["footprints"]["5"]["properties"]["display_name"] == "Bee" and out["footprints"]["6"]["properties"] == {"footprint_id": 6}
    assert out["footprints"]["5"]["geometry"]["coordinates"][0][0] == [-111.931, 33.419]
    assert out["edges"]["e1"]["geometry"] == {"type": "LineString", "coordinates": [[-111.93, 33.42], [-111.93, 33.4225]]}
    assert tuple(writers.extent(t["edge"]).first()) == (-111.93, 33.42, -111.93, 33.4225)
    d = gates.entrance_distances(t["node"], t["building"], t["footprint"]).collect()
    assert [(r.id, r.building_id, r.gsf, r.snap_m) for r in d] == [("n1", "b1", 10, 0.0)]


def test_overlay_files(spark):
    body = json.dumps({"entries": [{"id": "a", "ref": {"primary": "node:old", "fallback": "geo:1,2,r=8"}}, {"id": "b", "ref": "geo:1,2,r=8"}, {"id": "c", "ref": "osm:way/1", "note": 'say "x"'}, {"id": "d"}, 7], "more": {"z": [1, "é"], "a": None}})
    texts = spark.createDataFrame([("x.json", body), ("y.json", "{}")], "file string, body string")
    rows = [("x.json", i, "spatial", to) for i, to in (("a", "node:aaaaaaaa"), ("b", "edge:bbbbbbbb"), ("c", "node:cccccccc"), ("d", "node:dddddddd"), ("z", "node:eeeeeeee"))]
    rows += [("x.json", "c", "exact", "node:ffffffff"), ("gone.json", "q", "spatial", "node:aaaaaaaa"), ("y.json", "q", "spatial", "bldg:A")]
    out = {r.file: r for r in overlays.repin_files(texts, spark.createDataFrame(rows, "file string, overlay_id string, resolution string, resolved_to string")).collect()}
    refs = {e["id"]: e.get("ref") for e in json.loads(out["x.json"].body)["entries"][:4]}
    assert refs == {"a": {"primary": "node:aaaaaaaa", "fallback": "geo:1,2,r=8"}, "b": {"primary": "edge:bbbbbbbb", "fallback": None}, "c": "node:cccccccc", "d": None}
    assert [r.overlay_id for r in out["x.json"].repinned] == ["a", "b", "c"] and [r.overlay_id for r in out["x.json"].skipped] == ["d", "z"]
    assert not out["y.json"].changed and out["y.json"].body == "{}" and out["y.json"].skipped[0].what == "bldg:A is no content id"
    assert json.loads(out["x.json"].body)["more"] == {"z": [1, "é"], "a": None} and out["x.json"].changed
    assert out["gone.json"].body is None and out["gone.json"].skipped[0].what == "file not found"


def test_boxes_of_all_sizes_meet_once(spark):
    rng = random.Random(4)

    def boxes(n, sizes):
        out = []
        for i in range(n):
            w, h, x, y = rng.choice(sizes) * rng.random(), rng.choice(sizes) * rng.random(), rng.uniform(-3, 3), rng.uniform(-2, 2)
            out.append((i, (x, y, x + w, y + h)))
        return out

    box = "struct<min_lon:double,min_lat:double,max_lon:double,max_lat:double>"
    for left_sizes, right_sizes, margin in (((0.0, 1e-4, 0.3, 5.0), (1e-3, 0.05, 8.0), 0.0), ((0.0,), (0.0, 2.0), 0.02), ((1.0,), (0.0,), 0.0), ((0.5,), (0.5,), 0.0)):
        a, b = boxes(120, left_sizes), boxes(150, right_sizes)
        got = spatial.box_join(spark.createDataFrame(a, f"i long, l {box}"), spark.createDataFrame(b, f"j long, r {box}"), F.col("l"), F.col("r"), margin).select("i", "j").collect()
        got = [tuple(r) for r in got]
        near = lambda p, q, m=margin: p[0] - m <= q[2] and q[0] <= p[2] + m and p[1] - m <= q[3] and q[1] <= p[3] + m
        sure = {(i, j) for i, p in a for j, q in b if near(p, q)}
        assert len(got) == len(set(got)) and sure <= set(got)
        # in longitude a margin is wider, as degrees are shorter there
        assert set(got) <= {(i, j) for i, p in a for j, q in b if near(p, q, margin * 1.1)}
    nothing = spark.createDataFrame([], f"j long, r {box}")
    assert spatial.box_join(spark.createDataFrame(a, f"i long, l {box}"), nothing, F.col("l"), F.col("r")).count() == 0


def test_cells_do_not_grow_with_the_radius(spark):
    refs = spark.createDataFrame([(str(r), f"geo:-111.93,33.42,r={r}") for r in (30, 300_000)], "overlay_id string, ref_primary string").withColumn("ref_fallback", F.lit(None).cast("string"))
    box = refs.select(spatial.around(geo.point(F.lit(-111.93), F.lit(33.42)), F.regexp_extract("ref_primary", "r=([0-9]+)", 1).cast("double")).alias("b"))
    own = F.array(F.struct(spatial.level_of(F.col("b")).alias("level"), F.lit(0).alias("owner")))
    assert max(r["n"] for r in box.select(F.size(spatial._cells(F.col("b"), own)).alias("n")).collect()) <= 4


def test_radii_count_whole(spark):
    refs = spark.createDataFrame([("near", "geo:-111.93,33.42,r=150"), ("small", "geo:-111.93,33.42,r=100"), ("north", "geo:20.0,75.0,r=150")], "overlay_id string, ref_primary string").withColumn("ref_fallback", F.lit(None).cast("string"))
    places = spark.createDataFrame([("a", (-111.9287, 33.42)), ("n", (20.0045, 75.0))], f"id string, p {POINT}")
    known = spark.createDataFrame([], "ref string, id string")
    got = {r.overlay_id: (r.resolution, r.resolved_to) for r in overlays.resolve(refs, known, places).collect()}
    assert got == {"near": ("spatial", "a"), "small": ("failed", None), "north": ("spatial", "n")}


def test_heat_follows_utc_in_any_session(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
        at = spark.sql("SELECT explode(array(timestamp '2026-07-01 22:00:00Z', timestamp '2026-07-01 05:00:00Z', timestamp '2026-04-01 06:59:00Z')) AS t")
        assert [r.h for r in at.select(cost.heat_factor(F.col("t")).alias("h")).collect()] == [1.0, 0.0, 0.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_failures_name_the_building(spark):
    b = spark.createDataFrame([("a", True, [1]), ("b", True, []), ("c", False, [2])], "id string, in_area boolean, doors array<long>")
    asked = spark.createDataFrame([(1, "a", "x"), (2, "x", "a"), (3, "a", "b"), (4, "b", "a"), (5, "c", "b"), (6, "a", "c"), (7, "a", "a")], "request int, from_id string, to_id string")
    got = {r.request: (r.reason, r.about) for r in route.request_status(asked, b).collect()}
    assert got == {1: ("unknown_building", "x"), 2: ("unknown_building", "x"), 3: ("no_entrance", "b"), 4: ("no_entrance", "b"), 5: ("out_of_service_area", "c"), 6: ("out_of_service_area", "c"), 7: ("same_building", None)}


def test_seeded_pairs_are_in_order(spark):
    places = [(f"b{i}", -111.93 + i * 0.001, 33.42) for i in range(12)]
    rows = report.sampled_pairs(spark, places, n=30).collect()
    assert len(rows) == 30 and all(r.from_bldg < r.to_bldg for r in rows)
