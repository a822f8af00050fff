"""Quality gates: each gives its violations as ``entity, measurement``; none means it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pathweave import schema
from pathweave.functions import geo
from pathweave.operators.components import connected_components
from pathweave.operators.spatial import box_join, close_pairs, crossings, degrees_for, nearest_edge, piercing, point_box

MOST_ERRORS = 100


def _out(df: DataFrame, entity: Column | str, measurement: Column | str) -> DataFrame:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_col(entity).cast("string").alias("entity"), as_col(measurement).cast("string").alias("measurement"))


def _endpoints(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.explode(F.array(F.struct(F.lit("from").alias("end"), F.col("fromNodeId").alias("node")), F.struct(F.lit("to").alias("end"), F.col("toNodeId").alias("node")))).alias("x")).select("id", "x.*")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Ends that name no node."""
    return _out(_endpoints(edges).join(nodes.select(F.col("id").alias("node")), "node", "left_anti"), "id", F.concat("end", F.lit(" "), F.coalesce("node", F.lit("null"))))


def entrance_references(buildings: DataFrame, nodes: DataFrame) -> DataFrame:
    """S3: doors of buildings that don't exist or are no entrances."""
    refs = buildings.select("id", F.explode("entranceIds").alias("node"))
    d = refs.join(nodes.select(F.col("id").alias("node"), "type"), "node", "left")
    return _out(d.filter(F.col("type").isNull() | (F.col("type") != "entrance")), "id", F.concat("node", F.lit(" is "), F.coalesce("type", F.lit("missing"))))


def unique_ids(ids: DataFrame) -> DataFrame:
    """``ids(kind, id)`` that occur twice in a kind, or in two kinds."""
    g = ids.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("kind").alias("kinds")).filter("n > 1")
    return _out(g, "id", F.when(F.col("kinds") > 1, F.concat("kinds", F.lit(" kinds"))).otherwise(F.concat("n", F.lit(" times"))))


def endpoint_geometry(edges: DataFrame, nodes: DataFrame, metres: float = 0.1) -> DataFrame:
    """Lines of fewer than two positions, or whose ends are off their nodes."""
    n = nodes.select(F.col("id").alias("node"), "position")
    short = _out(edges.filter(F.size("geometry") < 2), "id", F.lit("fewer than 2 positions"))
    ends = _endpoints(edges.filter(F.size("geometry") >= 2)).join(edges.select("id", "geometry"), "id").join(n, "node")
    off = ends.withColumn("m", geo.haversine(F.when(F.col("end") == "from", F.col("geometry")[0]).otherwise(F.element_at("geometry", -1)), F.col("position")))
    return short.unionByName(_out(off.filter(F.col("m") > metres), "id", F.concat("end", F.lit(" off by "), F.format_number("m", 2), F.lit(" m"))))


def string_values(doc: Column) -> Column:
    """All string values of a JSON text, at any depth: quoted strings that no colon follows."""
    pattern = F.lit(r'"((?:[^"\\]|\\.)*+)"(\s*:)?')
    named = F.zip_with(F.regexp_extract_all(doc, pattern, F.lit(1)), F.regexp_extract_all(doc, pattern, F.lit(2)), lambda text, colon: F.when(colon == "", text))
    return F.array_compact(named)


def json_references(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs(name, body)``: string values anywhere in the JSON that look like node or edge ids and are none."""
    refs = docs.select("name", F.explode(string_values(F.col("body"))).alias("id")).filter(F.col("id").rlike(r"^(node|edge):[a-z2-7]{8,16}$"))
    return _out(refs.join(ids.select("id"), "id", "left_anti"), "name", "id")


def reconciliation(counts: DataFrame) -> DataFrame:
    """``counts(source, fetched, kept, rejected)`` that don't add up; no row at all is a violation too."""
    wrong = counts.filter(F.col("fetched").isNull() | F.col("kept").isNull() | F.col("rejected").isNull() | (F.col("fetched") != F.col("kept") + F.col("rejected")))
    bad = _out(wrong, "source", F.concat_ws(" ", F.coalesce(F.col("fetched").cast("string"), F.lit("null")), F.lit("<>"), F.coalesce(F.col("kept").cast("string"), F.lit("null")), F.lit("+"), F.coalesce(F.col("rejected").cast("string"), F.lit("null"))))
    none = counts.agg(F.count("*").alias("n")).filter("n = 0")
    return bad.unionByName(_out(none, F.lit("manifest"), F.lit("no counts")))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``component, nodes, metres`` of every component, single nodes too. ``nodes(id)``, ``edges(u, v, m)``."""
    found = connected_components(edges, "u", "v")
    placed = nodes.select(F.col("id").alias("node")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = placed.groupBy("component").agg(F.count("*").alias("nodes"))
    metres = edges.select(F.col("u").alias("node"), "m").join(placed, "node").groupBy("component").agg(F.sum("m").alias("metres"))
    return sizes.join(metres, "component", "left").withColumn("metres", F.coalesce("metres", F.lit(0.0)))


def one_component(nodes: DataFrame, edges: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """Components besides the largest, unless all their nodes are in ``allowed(id, reason)`` with a reason."""
    found = connected_components(edges, "u", "v")
    placed = nodes.select(F.col("id").alias("node")).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if allowed is None:
        placed = placed.withColumn("ok", F.lit(False))
    else:
        listed = allowed.filter(F.coalesce(F.trim("reason"), F.lit("")) != "").select(F.col("id").alias("node")).distinct().withColumn("ok", F.lit(True))
        placed = placed.join(listed, "node", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    g = placed.groupBy("component").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"))
    top = g.agg(F.max(F.struct("n", "component")).alias("top")).select("top.component")
    return _out(g.filter(~F.col("ok")).join(F.broadcast(top), "component", "left_anti"), "component", F.concat("n", F.lit(" nodes")))


def bounds(points: DataFrame, lon: tuple[float, float] = schema.LON_BOUNDS, lat: tuple[float, float] = schema.LAT_BOUNDS) -> DataFrame:
    """``points(id, p)`` at (0, 0) or out of bounds."""
    p = F.col("p")
    zero = (p["lon"] == 0) & (p["lat"] == 0)
    bad = points.filter(zero | ~(p["lon"].between(*lon) & p["lat"].between(*lat)) | p.isNull())
    return _out(bad, "id", F.when(zero, "(0, 0)").otherwise("out of bounds"))


def length_agrees(edges: DataFrame, metres: float = 0.5) -> DataFrame:
    """Stated lengths that differ from the line's."""
    d = edges.withColumn("delta", F.abs(F.col("lengthM") - geo.length(F.col("geometry"))))
    return _out(d.filter(F.col("delta") > metres), "id", F.concat(F.lit("delta "), F.format_number("delta", 2), F.lit(" m")))


def near_duplicates(nodes: DataFrame, metres: float = 0.5) -> DataFrame:
    """Nodes closer than ``metres`` to another."""
    return _out(close_pairs(nodes, metres).filter(F.col("dist_m") < metres), F.concat("a", F.lit(" "), "b"), F.round("dist_m", 3))


def footprint_piercing(edges: DataFrame, footprints: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """More than 2 m inside a footprint, neither indoor nor tunnel nor allowed; stand-in footprints don't count."""
    e = edges.filter(~F.coalesce("indoor", F.lit(False)) & ~F.coalesce("tunnel", F.lit(False))).select("id", F.col("geometry").alias("line"))
    if allowed is not None:
        e = e.join(allowed.select("id"), "id", "left_anti")
    found = piercing(e, footprints.filter(F.coalesce("source", F.lit("")) != "proxy"))
    return _out(found, "edge_id", F.concat(F.round("inside_m", 2), F.lit(" m in "), "footprint_id"))


def in_service_area(points: DataFrame, area: DataFrame) -> DataFrame:
    """G1: ``points(id, p)`` outside all rings of ``area(ring)``; a point meets the rings whose box it is in."""
    met = box_join(points.select("id", "p"), area.select("ring"), point_box(F.col("p")), geo.bounds(F.col("ring")))
    inside = met.filter(geo.inside(F.col("p"), F.col("ring"))).select("id").distinct()
    return _out(points.join(inside, "id", "left_anti"), "id", F.lit("outside"))


def long_straight(edges: DataFrame, metres: float = 400.0) -> DataFrame:
    """G5 (a warning): segments longer than ``metres`` without a vertex."""
    d = edges.withColumn("m", F.array_max(geo.pairs(F.col("geometry"), geo.haversine)))
    return _out(d.filter(F.col("m") > metres), "id", F.concat(F.round("m", 1), F.lit(" m")))


def entrance_distances(nodes: DataFrame, buildings: DataFrame, footprints: DataFrame) -> DataFrame:
    """``id, building_id, gsf, provisional, snap_m`` of entrances, from the nodes, their buildings and the buildings'
    footprints, as the authoring tables have them: how far a door is from the footprint, 0 on it or inside."""
    n = nodes.filter("type = 'entrance'").select(F.col("node_id").alias("id"), "building_id", "provisional", F.col("geom").alias("p"))
    b = buildings.select("building_id", "footprint_id", "gsf")
    d = n.join(b, "building_id").join(footprints.select("footprint_id", F.col("geom").alias("ring")), "footprint_id")
    away = F.when(geo.inside(F.col("p"), F.col("ring")), 0.0).otherwise(geo.distance_to_line(F.col("p"), F.col("ring")))
    return d.select("id", "building_id", "gsf", "provisional", away.alias("snap_m"))


def far_entrances(entrances: DataFrame, fail: float = 40.0, warn: float = 25.0) -> DataFrame:
    """``entrances(id, snap_m)`` far from the network."""
    return _out(entrances.filter(F.col("snap_m") > warn), "id", F.concat(F.when(F.col("snap_m") > fail, "FAIL ").otherwise("WARN "), F.round("snap_m", 2)))


def coverage_figures(buildings: DataFrame, edges: DataFrame) -> DataFrame:
    """``metric, value, ok``."""
    share = buildings.filter("inServiceArea").agg(F.avg(F.col("routable").cast("int")).alias("value")).select(F.lit("C1").alias("metric"), "value", (F.col("value") >= 0.95).alias("ok"))
    length = edges.filter("type <> 'link'").agg(F.coalesce(F.sum("lengthM"), F.lit(0.0)).alias("value")).select(F.lit("C5").alias("metric"), "value", (F.col("value") >= 25_000).alias("ok"))
    return share.unionByName(length)


def far_buildings(buildings: DataFrame, edges: DataFrame, metres: float = 50.0) -> DataFrame:
    """Buildings without an edge within ``metres`` of their centre."""
    near = nearest_edge(buildings.select(F.col("id").alias("point_id"), F.col("centroid").alias("p")), edges.select("id", F.col("geometry").alias("line")), metres)
    return _out(buildings.join(near.select(F.col("point_id").alias("id")), "id", "left_anti"), "id", F.lit(f"no edge within {metres:g} m"))


def roads_without_crossing(edges: DataFrame, roads: DataFrame, crossing_nodes: DataFrame, metres: float = 3.0) -> DataFrame:
    """Places where an edge(id, geometry) crosses a road(id, line) and no crossing(id, position) is near."""
    seg = lambda d, line, kind: d.select(F.concat(F.lit(kind), F.col("id").cast("string")).alias("of"), F.posexplode(geo.pairs(F.col(line), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "s")).select(F.concat_ws("/", "of", F.col("k").cast("string")).alias("id"), "of", "s.a", "s.b")
    met = crossings(seg(edges, "geometry", "e:").unionByName(seg(roads, "line", "r:")))
    met = met.filter(F.col("left_id").startswith("e:") & F.col("right_id").startswith("r:")).select(F.concat_ws(" x ", "left_id", "right_id").alias("place"), "point")
    near = box_join(met, crossing_nodes.select(F.col("position").alias("cp")), point_box(F.col("point")), point_box(F.col("cp")), degrees_for(metres))
    covered = near.filter(geo.haversine(F.col("point"), F.col("cp")) <= metres).select("place").distinct()
    return _out(met.join(covered, "place", "left_anti"), "place", F.to_json("point"))


def without_entrance(buildings: DataFrame) -> DataFrame:
    """Buildings in the service area that have no door and no reason for it."""
    return _out(buildings.filter("inServiceArea").filter((F.size(F.coalesce("entranceIds", F.array().cast("array<string>"))) == 0) & F.col("unroutableReason").isNull()), "id", F.lit("no entrance"))


def unreachable(buildings: DataFrame, edges: DataFrame, main: str) -> DataFrame:
    """C4: routable buildings none of whose doors is in the component of the main building's."""
    comp = connected_components(edges.select(F.col("fromNodeId").alias("u"), F.col("toNodeId").alias("v")), "u", "v")
    doors = buildings.filter("routable").select("id", F.explode("entranceIds").alias("node")).join(comp, "node")
    home = doors.filter(F.col("id") == main).select("component").distinct()
    ok = doors.join(home, "component", "left_semi").select("id").distinct()
    return _out(buildings.filter("routable").join(ok, "id", "left_anti"), "id", F.lit(f"not reachable from {main}"))


def check_constraints(table: DataFrame, name: str) -> DataFrame:
    """Rows of an authoring table that break a CHECK: ``entity`` is the key, ``measurement`` the constraint."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in schema.KEYS[name][0]])
    broken = [F.when(~F.expr(condition), F.lit(label)) for label, condition in schema.CHECKS.get(name, {}).items()]
    if not broken:
        return _out(table.limit(0), key, F.lit(""))
    return _out(table.withColumn("broken", F.explode(F.array_compact(F.array(*broken)))), key, "broken")


def key_violations(table: DataFrame, name: str) -> DataFrame:
    out = None
    for key in schema.KEYS[name]:
        full = table.filter(" and ".join(f"{c} is not null" for c in key))
        one = _out(full.groupBy(*key).count().filter("count > 1"), F.concat_ws("/", *[F.col(c).cast("string") for c in key]), F.lit(f"repeats in ({', '.join(key)})"))
        out = one if out is None else out.unionByName(one)
    return out


def reference_violations(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for table, column, there, target in schema.REFERENCES:
        one = tables[table].filter(F.col(column).isNotNull()).join(tables[there].select(F.col(target).alias(column)), column, "left_anti")
        one = _out(one, column, F.lit(f"{table}.{column} is not in {there}"))
        out = one if out is None else out.unionByName(one)
    return out


def schema_errors(doc: dict[str, DataFrame]) -> DataFrame:
    """What the document schema forbids, as conditions per kind: required fields, patterns,
    enumerations and ranges. At most the first 100 errors by entity are reported."""
    required = lambda *cols: {f"{c} is missing": F.col(c).isNull() for c in cols}
    pattern = lambda c, p, label: {f"{c} is no {label} id": ~F.col(c).rlike(p)}
    one_of = lambda c, values: {f"{c} isn't one of the values": ~F.col(c).isin(*values)}
    pos = lambda c: {f"{c} is out of bounds": ~(F.col(c)["lon"].between(*schema.LON_BOUNDS) & F.col(c)["lat"].between(*schema.LAT_BOUNDS))}
    rules = {
        "buildings": required("id", "code", "officialName", "displayName", "category", "centroid", "footprintSource", "entranceIds", "inServiceArea", "routable") | pattern("id", schema.ID_PATTERNS["building"], "building") | one_of("category", schema.CATEGORIES) | one_of("footprintSource", schema.FOOTPRINT_SOURCES) | pos("centroid") | {"gsf is negative": F.col("gsf") < 0},
        "nodes": required("id", "type", "position") | pattern("id", schema.ID_PATTERNS["node"], "node") | one_of("type", schema.NODE_TYPES) | one_of("crossingKind", schema.CROSSING_KINDS) | pos("position")
        | {f"an entrance has no {c}": (F.col("type") == "entrance") & F.col(c).isNull() for c in ("buildingId", "provisional")} | {"a crossing has no signalized": (F.col("type") == "crossing") & F.col("signalized").isNull()},
        "edges": required("id", "type", "fromNodeId", "toNodeId", "geometry", "lengthM", "surface", "shadeIndex", "shadeSource") | pattern("id", schema.ID_PATTERNS["edge"], "edge") | one_of("type", schema.EDGE_TYPES) | one_of("surface", schema.SURFACES) | one_of("shadeSource", schema.SHADE_SOURCES) | {"shadeIndex is out of range": ~F.col("shadeIndex").between(0, 1), "lengthM isn't positive": F.col("lengthM") <= 0, "geometry has fewer than 2 positions": F.size("geometry") < 2},
    }
    out = None
    for kind, found in rules.items():
        errors = F.array_compact(F.array(*[F.when(condition, F.lit(label)) for label, condition in found.items()]))
        one = _out(doc[kind].withColumn("error", F.explode(errors)), F.coalesce("id", F.lit(kind)), "error")
        out = one if out is None else out.unionByName(one)
    return out.orderBy("entity", "measurement").limit(MOST_ERRORS)


def document_gates(doc: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The gates that a graph document is held against, in the order of the report."""
    b, n, e = doc["buildings"], doc["nodes"], doc["edges"]
    uv = e.select(F.col("fromNodeId").alias("u"), F.col("toNodeId").alias("v"), F.col("lengthM").alias("m"))
    ids = b.select(F.lit("building").alias("kind"), "id").unionByName(n.select(F.lit("node").alias("kind"), "id")).unionByName(e.select(F.lit("edge").alias("kind"), "id"))
    places = n.select("id", F.col("position").alias("p")).unionByName(e.select("id", F.explode("geometry").alias("p")))
    return {
        "S1": schema_errors(doc), "S2": dangling(e, n), "S3": entrance_references(b, n), "S4": unique_ids(ids), "S5": endpoint_geometry(e, n),
        "S8": one_component(n, uv), "G2": bounds(places), "G4": length_agrees(e), "G7": near_duplicates(n),
    }


#: Entities that a report shows of each gate.
SHOWN = 3


def report(gates: dict[str, DataFrame], skipped: tuple[str, ...] = ()) -> DataFrame:
    """``gate, status, violations, sample`` of all gates in one query; the sample is of three entities."""
    order = list(gates) + list(skipped)
    every = None
    for name, df in gates.items():
        one = df.select(F.lit(name).alias("gate"), "entity", "measurement")
        every = one if every is None else every.unionByName(one)
    spark = every.sparkSession
    names = spark.createDataFrame([(i, g, g in skipped) for i, g in enumerate(order)], "place int, gate string, skipped boolean")
    every = every.select("gate", F.concat_ws(": ", "entity", "measurement").alias("text")).groupBy("gate", "text").agg(F.count("*").alias("n"))
    # a row number up to three is cut before the shuffle, so a gate's violations meet in no task
    first = every.withColumn("r", F.row_number().over(W.partitionBy("gate").orderBy("text"))).filter(F.col("r") <= SHOWN)
    first = first.groupBy("gate").agg(F.array_sort(F.collect_list("text")).alias("sample"))
    g = every.groupBy("gate").agg(F.sum("n").alias("violations")).join(first, "gate")
    d = F.broadcast(names).join(g, "gate", "left")
    status = F.when(F.col("skipped"), "SKIP").when(F.coalesce("violations", F.lit(0)) > 0, "FAIL").otherwise("PASS")
    return d.select("place", "gate", status.alias("status"), F.coalesce("violations", F.lit(0)).cast("long").alias("violations"), F.coalesce("sample", F.array().cast("array<string>")).alias("sample")).orderBy("place")
