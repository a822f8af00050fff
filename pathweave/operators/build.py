"""Building the graph from kept ways: splitting, snapping, cleaning, ids, doors, shade.

Every stage takes and gives DataFrames; a line is an array of points.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pathweave.functions import geo
from pathweave.operators.components import connected_components
from pathweave.operators.spatial import box_join, close_pairs, convex, crossings, degrees_for, nearest_edge, point_box
from pathweave.operators.ways import same_grade
from pathweave.session import cut_lineage, write_and_reread

SNAP_M, STUB_M, DUPLICATE_M = 1.5, 8.0, 1.0
DOOR_M, PROJECT_M, WEAK_M = 3.0, 60.0, 120.0
ID_CELL_M = 0.5


def clip(ways: DataFrame, ring: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ways that have a vertex in the service area or cross its border, and the rest with a reason.

    A way meets the rings of ``ring(ring)`` whose boxes touch its own.
    """
    d = write_and_reread(ways.withColumn("__way", F.monotonically_increasing_id()), "clip")  # the numbers hold from here on
    met = box_join(d.select("__way", "line"), ring.select("ring"), geo.bounds(F.col("line")), geo.bounds(F.col("ring")))
    cross = lambda a, b: F.exists(geo.pairs(F.col("ring"), lambda c, e: geo.intersection(a, b, c, e).isNotNull()), lambda x: x)
    inside = F.exists("line", lambda p: geo.inside(p, F.col("ring"))) | F.exists(geo.pairs(F.col("line"), cross), lambda x: x)
    kept = met.filter(inside).select("__way").distinct()
    out = d.join(kept, "__way", "left_anti").withColumn("reject_reason", F.lit("outside the service area"))
    return d.join(kept, "__way", "left_semi").drop("__way"), out.drop("__way")


def segments(ways: DataFrame) -> DataFrame:
    """``way, seq, a, b`` and the other columns of ``ways(way, line, ...)``."""
    rest = [c for c in ways.columns if c != "line"]
    cut = ways.select(*rest, F.posexplode(geo.pairs(F.col("line"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("seq", "s"))
    return cut.select(*rest, "seq", "s.a", "s.b")


def node_lines(ways: DataFrame) -> DataFrame:
    """Ways split where they share a vertex and where they cross at the same grade -> ``way, part, line``
    and the other columns. ``ways(way, line, layer, bridged, ...)``."""
    rest = [c for c in ways.columns if c not in ("way", "line")]
    seg = cut_lineage(segments(ways.select("way", "line", "layer", "bridged")).withColumn("id", F.xxhash64("way", "seq")))
    met = crossings(seg)
    side = lambda s: seg.select(F.col("id").alias(f"{s}_id"), F.col("way").alias(f"{s}_way"), F.col("seq").alias(f"{s}_seq"), F.col("layer").alias(f"{s}_layer"), F.col("bridged").alias(f"{s}_bridged"))
    met = met.join(side("left"), "left_id").join(side("right"), "right_id")
    met = met.filter(same_grade(F.col("left_layer"), F.col("right_layer"), F.col("left_bridged"), F.col("right_bridged")) & (F.col("left_way") != F.col("right_way")))
    cuts = met.select(F.col("left_way").alias("way"), F.col("left_seq").alias("seq"), "t", "point").unionByName(met.select(F.col("right_way").alias("way"), F.col("right_seq").alias("seq"), F.col("u").alias("t"), "point"))
    cuts = cuts.groupBy("way", "seq").agg(F.array_sort(F.collect_set(F.struct("t", "point"))).alias("cuts"))
    vertex = segments(ways.select("way", "line")).select("way", F.explode(F.array("a", "b")).alias("p")).distinct()
    shared = vertex.groupBy("p").agg(F.count("*").alias("ways")).filter("ways > 1").select("p", F.lit(True).alias("shared"))
    # every segment with its cut points; a new part begins at a shared vertex or a cut
    s = segments(ways.select("way", "line")).join(cuts, ["way", "seq"], "left")
    pts = F.filter(F.coalesce("cuts", F.array().cast(f"array<struct<t:double,point:{geo.POINT}>>")), lambda c: (c["t"] > 1e-9) & (c["t"] < 1 - 1e-9))
    ends = F.concat(F.array(F.struct(F.lit(0.0).alias("t"), F.col("a").alias("point"))), pts, F.array(F.struct(F.lit(1.0).alias("t"), F.col("b").alias("point"))))
    pieces = s.select("way", "seq", F.posexplode(geo.pairs(ends, lambda x, y: F.struct(x["point"].alias("a"), y["point"].alias("b"), (x["t"] > 0).alias("cut")))).alias("k", "x")).select("way", "seq", "k", "x.*")
    pieces = pieces.join(shared.withColumnRenamed("p", "a"), "a", "left")
    touch = cuts.select("way", F.explode("cuts").alias("c")).select("way", F.col("c.point").alias("a")).distinct().withColumn("touch", F.lit(True))
    pieces = pieces.join(touch, ["way", "a"], "left")
    order = W.partitionBy("way").orderBy("seq", "k")
    starts = (F.col("cut") | F.coalesce("shared", F.lit(False)) | F.coalesce("touch", F.lit(False))).cast("int")
    pieces = pieces.withColumn("part", F.sum(starts).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "k", "a", "b")))
    lines = pieces.groupBy("way", "part").agg(ordered.alias("o")).select("way", "part", F.concat(F.array(F.col("o")[0]["a"]), F.transform("o", lambda x: x["b"])).alias("line"))
    return lines.join(ways.select("way", *rest), "way")


def snap(lines: DataFrame, metres: float = SNAP_M) -> DataFrame:
    """Line ends within ``metres`` of each other, one to the next, moved to their mean; lines that
    shrink to a point go. Adds ``u`` and ``v``, the ends as points."""
    ends = lines.select(F.explode(F.array(F.col("line")[0], F.element_at("line", -1))).alias("position")).distinct().withColumn("id", F.xxhash64("position.lon", "position.lat"))
    ends = cut_lineage(ends)
    groups = connected_components(close_pairs(ends, metres), "a", "b")
    placed = ends.join(groups.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mean = placed.groupBy("component").agg(geo.point(F.round(F.avg("position.lon"), 7), F.round(F.avg("position.lat"), 7)).alias("at"))
    moved = placed.join(mean, "component").select("position", "at")
    d = lines.withColumns({"__u": F.col("line")[0], "__v": F.element_at("line", -1)})
    d = d.join(moved.select(F.col("position").alias("__u"), F.col("at").alias("u")), "__u").join(moved.select(F.col("position").alias("__v"), F.col("at").alias("v")), "__v")
    inner = F.slice("line", F.lit(2), F.greatest(F.size("line") - 2, F.lit(0)))
    d = d.withColumn("line", F.concat(F.array("u"), inner, F.array("v"))).drop("__u", "__v")
    return d.filter((F.col("u") != F.col("v")) | (F.size("line") > 3))


def plaza_lines(plazas: DataFrame, lines: DataFrame, most: int = 8) -> DataFrame:
    """Straight synthetic lines between the places where ways end on a plaza's border, at most ``most``
    of them (the first by place), for ``plazas(way, line)``."""
    ends = lines.select(F.explode(F.array(F.col("line")[0], F.element_at("line", -1))).alias("p")).distinct()
    near = box_join(plazas.select("way", F.col("line").alias("ring")), ends, geo.bounds(F.col("ring")), point_box(F.col("p")), degrees_for(1.0))
    near = near.filter(geo.distance_to_line(F.col("p"), F.col("ring")) <= 1.0)
    ranked = near.withColumn("r", F.row_number().over(W.partitionBy("way").orderBy("p"))).filter(F.col("r") <= most)
    a, b = ranked.select("way", F.col("p").alias("a"), F.col("r").alias("i")), ranked.select("way", F.col("p").alias("b"), F.col("r").alias("j"))
    return a.join(b, "way").filter("i < j").select("way", F.array("a", "b").alias("line"), F.lit(True).alias("synthetic"))


def degrees_of(edges: DataFrame) -> DataFrame:
    """``node, degree`` over edges(u, v)."""
    return edges.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def near_points(lines: DataFrame, points: DataFrame, metres: float = DOOR_M) -> DataFrame:
    """``node``: the ends ``u, v`` of lines that are within ``metres`` of one of ``points(p)``."""
    ends = lines.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    met = box_join(ends, points.select(F.col("p").alias("kp")), point_box(F.col("node")), point_box(F.col("kp")), degrees_for(metres))
    return met.filter(geo.haversine(F.col("node"), F.col("kp")) <= metres).select("node").distinct()


def drop_stubs(edges: DataFrame, keep: DataFrame, metres: float = STUB_M) -> DataFrame:
    """Edges(id, u, v, m) without those shorter than ``metres`` with a free end that isn't in ``keep(node)``."""
    free = degrees_of(edges).filter("degree = 1").join(keep.select("node"), "node", "left_anti").select("node")
    stub = edges.filter(F.col("m") < metres).select("id", F.explode(F.array("u", "v")).alias("node")).join(free, "node", "left_semi").select("id").distinct()
    return edges.join(stub, "id", "left_anti")


def ranked_arcs(arcs: DataFrame, inner: DataFrame) -> DataFrame:
    """``id, dir, rank, end_id, end_dir`` of ``arcs(id, dir, a, b)``: which arc ends the chain that an arc goes on in
    through ``inner(node)`` nodes, and how many arcs it is from there, itself included.

    Every inner node has one arc leaving it that isn't the arriving one turned back. Lists are ranked by
    doubling: a round joins each arc's jump with the jump at its end, so a chain of a million arcs takes 20
    rounds, whatever the tasks' memory. A ring, in which no jump ever ends, is cut at its smallest node.
    """
    leaving = arcs.join(inner, F.col("a") == F.col("node")).select("node", F.col("id").alias("next_id"), F.col("dir").alias("next_dir"))
    first = arcs.join(leaving, (F.col("b") == F.col("node")) & (F.col("id") != F.col("next_id")), "left")
    state = write_and_reread(first.select("id", "dir", "next_id", "next_dir", F.lit(1).cast("long").alias("rank"), F.col("id").alias("end_id"), F.col("dir").alias("end_dir"), F.col("b").alias("low")), "chains")
    most, rounds = state.count(), 0
    while True:
        open_ = state.filter("next_id is not null")
        if open_.isEmpty():
            return state.select("id", "dir", "rank", "end_id", "end_dir")
        if 1 << rounds > most:
            whole = state.filter("next_id is null").select("id", "dir", "rank", "end_id", "end_dir")
            cut = inner.join(open_.select(F.col("low").alias("node")).distinct(), "node", "left_anti")
            return whole.unionByName(ranked_arcs(write_and_reread(arcs.join(open_.select("id", "dir"), ["id", "dir"]), "chains"), write_and_reread(cut, "chains")))
        end = state.select(F.col("id").alias("next_id"), F.col("dir").alias("next_dir"), *[F.col(c).alias(f"{c}_2") for c in ("next_id", "next_dir", "rank", "end_id", "end_dir", "low")])
        far = open_.join(end, ["next_id", "next_dir"])
        far = far.select("id", "dir", F.col("next_id_2").alias("next_id"), F.col("next_dir_2").alias("next_dir"), (F.col("rank") + F.col("rank_2")).alias("rank"), F.col("end_id_2").alias("end_id"), F.col("end_dir_2").alias("end_dir"), F.least("low", "low_2").alias("low"))
        state = write_and_reread(state.filter("next_id is null").unionByName(far), "chains")
        rounds += 1


#: Edges of a chain whose points are put together first, before the chain's.
CHAIN_PART = 1024


def collapse_chains(edges: DataFrame, keep: DataFrame, attributes: list[str]) -> DataFrame:
    """Edges joined through nodes of degree 2 whose two edges agree in ``attributes`` and that aren't in ``keep``.

    ``edges(id, u, v, line, ...)`` -> ``id`` (the smallest of the chain), ``u, v, line`` and attributes. A chain runs
    from its smaller end; a ring from the node that other edges or ``keep`` hold, or its smallest, along the
    smaller of the two edges there. The order comes from ranked lists; no task holds a chain but for the
    line that it becomes.
    """
    ends = edges.select("id", F.explode(F.array("u", "v")).alias("node"), F.to_json(F.struct(*attributes)).alias("attr"))
    inner = ends.groupBy("node").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_distinct("attr").alias("attrs"), F.collect_set("id").alias("both")).filter("n = 2 and ids = 2 and attrs = 1")
    inner = cut_lineage(inner.join(keep.select("node"), "node", "left_anti").select("node", "both"))
    touched = inner.select(F.explode("both").alias("id")).distinct()
    single = edges.join(touched, "id", "left_anti").select("id", "u", "v", "line", *attributes)
    chained = cut_lineage(edges.join(touched, "id").select("id", "u", "v"))
    way = lambda d, a, b: chained.select("id", F.lit(d).alias("dir"), F.col(a).alias("a"), F.col(b).alias("b"))
    arcs = way(0, "u", "v").unionByName(way(1, "v", "u"))
    placed = cut_lineage(ranked_arcs(arcs, inner.select("node")).join(arcs, ["id", "dir"]))
    # either way through a chain is known by its last arc; one of the two is kept
    ways = placed.groupBy("end_id", "end_dir").agg(F.min("id").alias("chain"), F.max("rank").alias("size"), F.max_by(F.struct("a", "id"), "rank").alias("start"), F.min_by("b", "rank").alias("end"))
    chosen = ways.groupBy("chain").agg(F.min(F.struct("start", "end_id", "end_dir", "size", "end")).alias("w")).select("chain", "w.*")
    steps = placed.join(chosen, ["end_id", "end_dir"]).select("chain", "id", "dir", (F.col("size") - F.col("rank")).alias("at"))
    points = F.when(F.col("dir") == 0, F.col("line")).otherwise(F.reverse("line"))
    points = F.when(F.col("at") == 0, points).otherwise(F.slice(points, 2, F.greatest(F.size("line") - 1, F.lit(0))))
    pieces = steps.join(edges.select("id", "line"), "id").select("chain", F.floor(F.col("at") / CHAIN_PART).alias("part"), F.struct("at", points.alias("points")).alias("x"))
    flat = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(c)), lambda x: x["points"]))
    parts = pieces.groupBy("chain", "part").agg(flat("x").alias("points"))
    lines = parts.groupBy("chain").agg(flat(F.struct("part", "points")).alias("line"))
    long = lines.join(chosen.select("chain", F.col("start.a").alias("u"), F.col("end").alias("v")), "chain").join(edges.select(F.col("id").alias("chain"), *attributes), "chain")
    return single.unionByName(long.select(F.col("chain").alias("id"), "u", "v", "line", *attributes))


def drop_duplicates(edges: DataFrame, metres: float = DUPLICATE_M, rank: str = "tags") -> DataFrame:
    """Edges(id, u, v, line, rank) without those that run within ``metres`` of another of the same ends
    that has more tags, or as many and the smaller id."""
    ends = lambda s: edges.select(F.least("u", "v").alias("x"), F.greatest("u", "v").alias("y"), F.col("id").alias(f"{s}_id"), F.col("line").alias(f"{s}_line"), F.col(rank).alias(f"{s}_rank"))
    pair = ends("a").join(ends("b"), ["x", "y"]).filter("a_id <> b_id and (b_rank > a_rank or (b_rank = a_rank and b_id < a_id))")
    apart = F.greatest(F.array_max(F.transform("a_line", lambda p: geo.distance_to_line(p, F.col("b_line")))), F.array_max(F.transform("b_line", lambda p: geo.distance_to_line(p, F.col("a_line")))))
    return edges.join(pair.filter(apart <= metres).select(F.col("a_id").alias("id")).distinct(), "id", "left_anti")


def largest_component(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges(id, u, v, m, line) of the component with most nodes, and ``component, nodes, metres, centre, warn`` of the others."""
    number = edges.select(F.explode(F.array("u", "v")).alias("p")).distinct().withColumn("n", F.xxhash64(F.to_json(F.struct("p"))))
    e = edges.join(number.select(F.col("p").alias("u"), F.col("n").alias("nu")), "u").join(number.select(F.col("p").alias("v"), F.col("n").alias("nv")), "v")
    e = cut_lineage(e)
    comp = connected_components(e, "nu", "nv")
    size = comp.groupBy("component").agg(F.count("*").alias("nodes"))
    top = size.agg(F.max(F.struct("nodes", F.negative("component").alias("c"))).alias("t")).select(F.negative("t.c").alias("top"))
    placed = e.join(comp.withColumnRenamed("node", "nu"), "nu").crossJoin(F.broadcast(top))
    own = geo.bounds(F.col("line"))
    box = F.struct(*[f(own[c]).alias(c) for f, c in ((F.min, "min_lon"), (F.min, "min_lat"), (F.max, "max_lon"), (F.max, "max_lat"))])
    others = placed.filter("component <> top").groupBy("component").agg(F.sum("m").alias("metres"), box.alias("box")).join(size, "component")
    others = others.select("component", "nodes", "metres", geo.point((F.col("box.min_lon") + F.col("box.max_lon")) / 2, (F.col("box.min_lat") + F.col("box.max_lat")) / 2).alias("centre"), (F.col("metres") > 100).alias("warn"))
    return placed.filter("component = top").drop("component", "top", "nu", "nv"), others


def _short_hash(text: Column) -> Column:
    """Base 32 of a 6-byte BLAKE2 digest: Spark has neither, so it is computed on Arrow batches."""

    @F.pandas_udf("string")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: None if s is None else base64.b32encode(hashlib.blake2b(s.encode(), digest_size=6).digest()).decode().lower().rstrip("="))

    return digest(text)


def node_id(p: Column) -> Column:
    """``node:`` and a hash of the half-metre cell of the point."""
    step = ID_CELL_M / geo.DEGREE_M
    text = F.concat_ws(",", F.floor(p["lon"] / step + 0.5).cast("long").cast("string"), F.floor(p["lat"] / step + 0.5).cast("long").cast("string"))
    return F.concat(F.lit("node:"), _short_hash(text))


def edge_id(u: Column, v: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("edge:"), _short_hash(F.concat_ws("|", F.least(u, v), F.greatest(u, v), ordinal.cast("string"))))


def with_ids(edges: DataFrame) -> DataFrame:
    """Edges(u, v, line, ...) by content: ends as node ids in order, parallel edges numbered by length."""
    d = edges.withColumns({"ui": node_id(F.col("u")), "vi": node_id(F.col("v"))}).filter("ui <> vi")
    flip = F.col("ui") > F.col("vi")
    d = d.withColumn("line", F.when(flip, F.reverse("line")).otherwise(F.col("line"))).withColumns({"from_node_id": F.least("ui", "vi"), "to_node_id": F.greatest("ui", "vi")}).drop("ui", "vi", "u", "v", "id")
    d = d.withColumn("m", geo.length(F.col("line")))
    d = d.withColumn("ord", F.row_number().over(W.partitionBy("from_node_id", "to_node_id").orderBy("m", F.to_json("line"))) - 1)
    return d.withColumn("id", edge_id(F.col("from_node_id"), F.col("to_node_id"), F.col("ord")))


def doors(buildings: DataFrame, entrance_points: DataFrame, edges: DataFrame) -> DataFrame:
    """``building_id, position, provisional, weak, reason`` for ``buildings(id, ring)``: mapped entrances in or
    within 3 m of the footprint; else the middles of up to three sides that have an edge within 60 m;
    else of the side nearest to an edge within 120 m, weak; else a reason."""
    b = buildings.select("id", "ring")
    met = box_join(b, entrance_points.select(F.col("p").alias("ep")), geo.bounds(F.col("ring")), point_box(F.col("ep")), degrees_for(DOOR_M))
    mapped = met.filter(geo.inside(F.col("ep"), F.col("ring")) | (geo.distance_to_line(F.col("ep"), F.col("ring")) <= DOOR_M)).select("id", F.col("ep").alias("position")).distinct()
    rest = cut_lineage(b.join(mapped.select("id").distinct(), "id", "left_anti"))
    sides = rest.select("id", F.posexplode(geo.pairs(F.col("ring"), lambda p, q: geo.point((p["lon"] + q["lon"]) / 2, (p["lat"] + q["lat"]) / 2))).alias("side", "p")).withColumn("point_id", F.xxhash64("id", "side"))
    near = nearest_edge(sides.select("point_id", "p"), edges.select("id", "line"), WEAK_M, radii=(PROJECT_M,))
    near = near.join(sides, "point_id").select("id", "side", "p", "dist_m")
    near = near.withColumn("position", F.col("p"))
    good = near.filter(F.col("dist_m") <= PROJECT_M).withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("dist_m", "side"))).filter("r <= 3")
    weak = near.join(good.select("id").distinct(), "id", "left_anti").withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("dist_m", "side"))).filter("r = 1")
    row = lambda d, provisional, weak_, reason=None: d.select(F.col("id").alias("building_id"), "position", F.lit(provisional).alias("provisional"), F.lit(weak_).alias("weak"), F.lit(reason).cast("string").alias("reason"))
    none = rest.join(near.select("id").distinct(), "id", "left_anti").withColumn("position", F.lit(None).cast(geo.POINT))
    return row(mapped, False, False).unionByName(row(good, True, False)).unionByName(row(weak, True, True)).unionByName(row(none, None, None, "no_walkway_within_120m"))


def door_ordinals(doors_: DataFrame) -> DataFrame:
    """Doors numbered per building from 0, the preferred one first: mapped before provisional, strong before
    weak, then by side (``main`` first, if there is that column) and place."""
    side = [F.when(F.col("side") == "main", 0).otherwise(1), F.col("side")] if "side" in doors_.columns else []
    order = W.partitionBy("building_id").orderBy(F.col("provisional").asc_nulls_last(), F.col("weak").asc_nulls_last(), *side, "position.lon", "position.lat")
    return doors_.filter("position is not null").withColumn("ordinal", F.row_number().over(order) - 1)


def link_doors(doors_: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges(id, line, ...) cut where doors(building_id, position) project onto them, and the links
    ``building_id, line, edge_id, surface, shadeIndex`` from each door to its edge."""
    d = doors_.filter("position is not null").withColumn("point_id", F.xxhash64("building_id", "position.lon", "position.lat"))
    near = nearest_edge(d.select("point_id", F.col("position").alias("p")), edges.select("id", "line"), WEAK_M).join(d, "point_id")
    e = edges.select(F.col("id").alias("edge_id"), "line", *[c for c in ("surface", "shadeIndex") if c in edges.columns])
    hit = near.join(e, "edge_id")
    best = F.array_min(F.zip_with(geo.pairs(F.col("line"), lambda a, b: F.struct(geo.project(F.col("position"), a, b).alias("x"))), F.sequence(F.lit(0), F.size("line") - 2), lambda s, i: F.struct(s["x"]["dist_m"].alias("d"), i.alias("seq"), s["x"]["t"].alias("t"), s["x"]["point"].alias("at"))))
    hit = hit.withColumn("best", best)
    links = hit.filter("best.d > 0").select("building_id", F.array("position", "best.at").alias("line"), "edge_id", *[c for c in ("surface", "shadeIndex") if c in edges.columns])
    cuts = hit.groupBy("edge_id").agg(F.array_sort(F.collect_set(F.struct("best.seq", "best.t", "best.at"))).alias("cuts"))
    cut = edges.join(cuts.withColumnRenamed("edge_id", "id"), "id", "left")
    vertices = F.transform(F.col("line"), lambda p, i: F.struct(i.cast("int").alias("seq"), F.lit(0.0).alias("t"), p.alias("at"), F.lit(False).alias("cut")))
    inside = F.filter(F.coalesce("cuts", F.array().cast(f"array<struct<seq:int,t:double,at:{geo.POINT}>>")), lambda c: ~((c["seq"] == 0) & (c["t"] <= 1e-9)) & ~((c["seq"] == F.size("line") - 2) & (c["t"] >= 1 - 1e-9)))
    all_ = F.array_sort(F.concat(vertices, F.transform(inside, lambda c: F.struct(c["seq"].alias("seq"), c["t"].alias("t"), c["at"].alias("at"), F.lit(True).alias("cut")))))
    rest = [c for c in edges.columns if c not in ("line",)]
    marks = F.concat(F.array(F.lit(0)), F.filter(F.transform("all", lambda x, i: F.when(x["cut"], i)), lambda x: x.isNotNull()), F.array(F.size("all") - 1))
    parts = cut.withColumn("all", all_).withColumn("marks", marks).select(*rest, F.posexplode(geo.pairs(F.col("marks"), lambda a, b: F.transform(F.slice(F.col("all"), a + 1, b - a + 1), lambda x: x["at"]))).alias("piece", "line"))
    return parts, links


def shade(edges: DataFrame, tree_rows: DataFrame, footprints: DataFrame) -> DataFrame:
    """Edges(id, line, covered, tunnel, indoor) with ``shadeIndex, shadeSource``: covered 1.0, within 6 m of a
    tree row 0.7, within 8 m to the south or east of a footprint 0.5, else 0.15."""
    mid = edges.select("id", geo.along(F.col("line"), geo.length(F.col("line")) / 2).alias("p"))
    trees = nearest_edge(mid.select(F.col("id").alias("point_id"), "p"), tree_rows.select("id", "line"), 6.0).select(F.col("point_id").alias("id"), F.lit(True).alias("tree"))
    by = box_join(mid, footprints.select("footprint_id", "ring"), point_box(F.col("p")), geo.bounds(F.col("ring")), degrees_for(8.0))
    centre = geo.vertex_mean(F.col("ring"), 9)
    by = by.filter((geo.distance_to_line(F.col("p"), F.col("ring")) <= 8.0) & ((F.col("p")["lat"] < centre["lat"]) | (F.col("p")["lon"] > centre["lon"]))).select("id").distinct().withColumn("near", F.lit(True))
    d = edges.join(trees, "id", "left").join(by, "id", "left")
    no = F.lit(False)
    covered = F.coalesce("covered", no) | F.coalesce("tunnel", no) | F.coalesce("indoor", no)
    kind = lambda index, source: F.struct(F.lit(index).alias("i"), F.lit(source).alias("s"))
    found = F.when(covered, kind(1.0, "covered")).when(F.col("tree"), kind(0.7, "treerow")).when(F.col("near"), kind(0.5, "adjacency")).otherwise(kind(0.15, "default"))
    return d.withColumn("f", found).withColumns({"shadeIndex": F.col("f.i"), "shadeSource": F.col("f.s")}).drop("f", "tree", "near")


#: How far outside a border a way is led, and how often a way is led around another footprint.
OUTSIDE_M, LED_TIMES = 0.3, 12


def spread(d: DataFrame, key: str) -> DataFrame:
    """``d`` by ``key`` in as many tasks as are asked for: rows are small beside the work on them, and by their size Spark
    would leave them to a few."""
    return d.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def blocks_of(footprints: DataFrame, apart_m: float = 2 * OUTSIDE_M) -> DataFrame:
    """``footprint_id, block, ring``: footprints that leave no room to pass between them are a block, whose ring is their
    convex hull; one by itself has its own ring."""
    f = footprints.select("footprint_id", "ring")
    f = write_and_reread(f.withColumn("n", F.monotonically_increasing_id()), "blocks")  # the numbers hold from here on
    left, right = f.select(F.col("n").alias("a"), F.col("ring").alias("ra")), f.select(F.col("n").alias("b"), F.col("ring").alias("rb"))
    near = box_join(left, right, geo.bounds(F.col("ra")), geo.bounds(F.col("rb")), degrees_for(apart_m)).filter("a < b")
    close = lambda r, s: F.exists(r, lambda p: geo.inside(p, s) | (geo.distance_to_line(p, s) <= apart_m))
    cross = F.exists(geo.pairs(F.col("ra"), lambda p, q: F.exists(geo.pairs(F.col("rb"), lambda x, y: geo.intersection(p, q, x, y, geo.once).isNotNull()), lambda z: z)), lambda z: z)
    # exploded before it is filtered, as a filter alone would be worked out within the join
    touch = F.explode(F.array(close(F.col("ra"), F.col("rb")) | close(F.col("rb"), F.col("ra")) | cross))
    near = near.select("a", "b", touch.alias("touch")).filter("touch")
    placed = f.join(connected_components(near, "a", "b").withColumnRenamed("node", "n"), "n", "left").withColumn("block", F.coalesce("component", "n"))
    placed = cut_lineage(placed.select("footprint_id", "n", "block", "ring"))
    many = placed.groupBy("block").count().filter("count > 1").select("block")
    corners = placed.join(many, "block").select("block", F.explode("ring").alias("p")).select("block", "p.lon", "p.lat").distinct()
    corners = spread(corners, "block").groupBy("block").agg(F.collect_list("lon").alias("lon"), F.collect_list("lat").alias("lat"))

    def around(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rings = [convex(zip(x.tolist(), y.tolist(), strict=True)) for x, y in zip(batch["lon"], batch["lat"], strict=True)]
            yield pd.DataFrame({"block": batch["block"], "ring": [[{"lon": x, "lat": y} for x, y in ring] for ring in rings]})

    hulls = corners.mapInPandas(around, f"block long, ring array<{geo.POINT}>")
    single = placed.join(many, "block", "left_anti").select("footprint_id", "block", "ring")
    return single.unionByName(placed.select("footprint_id", "block").join(hulls, "block").select("footprint_id", "block", "ring"))


def _led(met: DataFrame) -> DataFrame:
    """``id, new_line`` of ``met(edge_id, line, ring)``: the shorter way around a ring, a bit outside, for lines whose ends lie outside."""
    bad_end = geo.inside(F.col("line")[0], F.col("ring")) | geo.inside(F.element_at("line", -1), F.col("ring"))
    fix = met.filter(~bad_end).withColumn("ring", geo.widened(F.col("ring"), OUTSIDE_M))
    ring_n = F.size("ring") - 1
    place = lambda p: F.array_min(F.zip_with(geo.pairs(F.col("ring"), lambda a, b: geo.project(p, a, b, geo.once)["dist_m"]), F.sequence(F.lit(0), ring_n - 1), lambda m, i: F.struct(m.alias("d"), i.alias("k"))))["k"]
    parts = F.zip_with(geo.pairs(F.col("line"), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.sequence(F.lit(0), F.size("line") - 2), lambda s, i: F.struct(s["a"].alias("a"), s["b"].alias("b"), i.alias("seq")))
    hits = F.flatten(F.transform(parts, lambda s: F.transform(geo.meetings(s["a"], s["b"], F.col("ring")), lambda x: F.struct(s["seq"].alias("seq"), x["t"].alias("t"), x["point"].alias("p")))))
    # exploded before they are filtered, as a filter alone would be worked out below, from hits of its own
    fix = fix.select("edge_id", "line", "ring", F.explode(F.array(F.array_sort(hits))).alias("hits")).filter(F.size("hits") >= 2)
    fix = fix.withColumns({"h0": F.col("hits")[0], "h1": F.element_at("hits", -1)})
    fix = fix.select("edge_id", "line", "ring", "h0", "h1", F.explode(F.array(F.struct(place(F.col("h0.p")).alias("k0"), place(F.col("h1.p")).alias("k1")))).alias("k"))
    fix = fix.select("edge_id", "line", "ring", "h0", "h1", "k.k0", "k.k1")
    steps = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    on = F.transform(steps(F.pmod(F.col("k1") - F.col("k0") + ring_n, ring_n).cast("int")), lambda s: F.col("ring")[((F.col("k0") + s) % ring_n).cast("int")])
    back = F.transform(steps(F.pmod(F.col("k0") - F.col("k1") + ring_n, ring_n).cast("int")), lambda s: F.col("ring")[F.pmod(F.col("k0") - s + 1, ring_n).cast("int")])
    head = F.slice("line", F.lit(1), F.col("h0.seq") + 1)
    tail = F.slice("line", F.col("h1.seq") + 2, F.size("line"))
    way = lambda mid: F.concat(head, F.array("h0.p"), mid, F.array("h1.p"), tail)
    both = fix.select(F.col("edge_id").alias("id"), F.explode(F.array(F.struct(way(on).alias("x"), way(back).alias("y")))).alias("w")).select("id", "w.x", "w.y")
    return both.select("id", F.when(geo.length(F.col("x")) <= geo.length(F.col("y")), F.col("x")).otherwise(F.col("y")).alias("new_line"))


def around_footprints(edges: DataFrame, footprints: DataFrame, least_m: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Edges(id, line) that run more than ``least_m`` through footprints led along their borders, 0.3 m
    outside and the shorter way. Footprints without room between them are passed as one block; blocks that an edge
    runs through are passed one after the other. Those whose end lies inside, or that no such way clears, stay as they were and are
    returned as ``id, reason`` for the allow-list."""
    rings = write_and_reread(blocks_of(footprints), "footprint-blocks")
    own = footprints.select("footprint_id", F.col("ring").alias("own"))

    def pierced(lines: DataFrame) -> DataFrame:
        met = box_join(lines.select(F.col("id").alias("edge_id"), "line"), own, geo.bounds(F.col("line")), geo.bounds(F.col("own")))
        # exploded before it is filtered, as a filter alone would be worked out within the join
        inside = F.explode(F.array(geo.length_inside(F.col("line"), F.col("own"))))
        return met.select("edge_id", "line", "footprint_id", inside.alias("m")).filter(F.col("m") > least_m)

    # a line that wasn't led a last time keeps what it runs through, so a round has to look at the led ones only
    lines = edges.select("id", "line").filter("id is not null")
    cleared = stuck = None
    for times in range(LED_TIMES + 1):
        met = spread(pierced(lines).join(rings, "footprint_id"), "edge_id").groupBy("edge_id").agg(F.first("line").alias("line"), F.min_by("ring", "block").alias("ring"))
        met = write_and_reread(met, "led-met")
        found = met.select(F.col("edge_id").alias("id"))
        if times:
            clear = lines.select("id", F.col("line").alias("new_line")).join(found, "id", "left_anti")
            cleared = clear if cleared is None else cleared.unionByName(clear)
        led = write_and_reread(_led(met) if times < LED_TIMES else _led(met.limit(0)), "led-ways")
        left = found.join(led, "id", "left_anti")
        stuck = left if stuck is None else stuck.unionByName(left)
        if led.isEmpty():
            break
        lines = led.withColumnRenamed("new_line", "line")
    stuck = cut_lineage(stuck)
    out = edges
    if cleared is not None:
        out = edges.join(write_and_reread(cleared, "led"), "id", "left").withColumn("line", F.coalesce("new_line", "line")).drop("new_line")
    return out, stuck.withColumn("reason", F.lit("runs into the footprint"))
