"""Shapes around sets of points: concave hulls from grid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions import geo
from pathweave.operators.build import CHAIN_PART, ranked_arcs
from pathweave.session import cut_lineage, write_and_reread

#: The size of the cells, and so of the bays that a hull follows.
ALPHA_M = 60.0
#: Sides of a cell as steps from its lower left corner, the cell on their left: from, to, the neighbour beyond, direction.
SIDES = (((0, 0), (1, 0), (0, -1), 0), ((1, 0), (1, 1), (1, 0), 1), ((1, 1), (0, 1), (0, 1), 2), ((0, 1), (0, 0), (-1, 0), 3))


def occupied(points: DataFrame, metres: float = ALPHA_M) -> DataFrame:
    """``source, cx, cy, lon_step, lat_step``: the cells of ``points(source, p)``. Cells are as wide as high in
    the middle of the degree of latitude in which a source's lowest point lies."""
    high = metres / geo.DEGREE_M
    low = points.groupBy("source").agg(F.floor(F.min(F.col("p")["lat"])).alias("degree"))
    d = points.join(low, "source").withColumns({"lat_step": F.lit(high), "lon_step": F.lit(high) / F.cos(F.radians(F.col("degree") + 0.5))})
    c = geo.cell(F.col("p"), F.col("lon_step"), F.col("lat_step"))
    return d.select("source", c["cx"].alias("cx"), c["cy"].alias("cy"), "lon_step", "lat_step").distinct()


def borders(cells: DataFrame) -> DataFrame:
    """``source, ax, ay, bx, by, way``: the sides of cells beyond which there is none, each with its cell on the left."""
    step = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip((*a, *b, *beyond, way), ("ax", "ay", "bx", "by", "nx", "ny", "way"), strict=True)]) for a, b, beyond, way in SIDES])
    d = cells.select("source", "cx", "cy", F.explode(step).alias("s"))
    d = d.select("source", *[(F.col("cx") + F.col(f"s.{n}x")).alias(f"{n}x") for n in "abn"], *[(F.col("cy") + F.col(f"s.{n}y")).alias(f"{n}y") for n in "abn"], "s.way")
    taken = cells.select("source", F.col("cx").alias("nx"), F.col("cy").alias("ny"))
    return d.join(taken, ["source", "nx", "ny"], "left_anti").select("source", "ax", "ay", "bx", "by", "way")


def concave_hulls(points: DataFrame, metres: float = ALPHA_M) -> DataFrame:
    """``source, ring, outer, area_m2`` of ``points(source, p)``: the rings around the cells that hold points, the outer ones
    counter-clockwise, and those of holes clockwise with a negative area. Cells that only touch at a corner are apart.

    Sides are put in order as rings by list ranking, so no task holds a border but for the ring that it becomes.
    """
    cells = write_and_reread(occupied(points, metres), "hull-cells")
    sides = write_and_reread(borders(cells).withColumn("id", F.monotonically_increasing_id()), "hull-sides")  # the numbers hold from here on
    # where two cells touch at a corner two sides leave it: one arrived at goes on with a turn to the left
    twice = sides.groupBy("source", F.col("ax").alias("x"), F.col("ay").alias("y")).count().filter("count > 1").select("source", "x", "y", F.lit(True).alias("twice"))
    at = lambda x, y, way: F.to_json(F.struct("source", F.col(x).alias("x"), F.col(y).alias("y"), way.alias("w")))
    d = sides.join(twice.withColumnsRenamed({"x": "ax", "y": "ay", "twice": "ta"}), ["source", "ax", "ay"], "left").join(twice.withColumnsRenamed({"x": "bx", "y": "by", "twice": "tb"}), ["source", "bx", "by"], "left")
    d = write_and_reread(d.withColumns({"a": at("ax", "ay", F.when(F.col("ta"), F.col("way"))), "b": at("bx", "by", F.when(F.col("tb"), (F.col("way") + 1) % 4))}), "hull-arcs")
    arcs = d.select("id", F.lit(0).alias("dir"), "a", "b")
    ranked = cut_lineage(ranked_arcs(arcs, arcs.select(F.col("a").alias("node")).distinct()).join(d.select("id", "source", "ax", "ay", "bx", "by"), "id"))
    turn = F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")
    parts = ranked.groupBy("source", F.col("end_id").alias("ring"), F.floor(F.col("rank") / CHAIN_PART).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("rank")).alias("at"), "ax", "ay"))).alias("corners"), F.sum(turn).alias("twice_area")
    )
    rings = parts.groupBy("source", "ring").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("part")).alias("at"), "corners"))), lambda x: x["corners"])).alias("c"), F.sum("twice_area").alias("twice_area"))
    # corners where the border goes straight on are left out
    n = F.size("c")
    near = lambda i, by: F.element_at("c", (F.pmod(i + by, n) + 1).cast("int"))
    bend = F.filter("c", lambda x, i: (near(i, -1)["ax"] != near(i, 1)["ax"]) & (near(i, -1)["ay"] != near(i, 1)["ay"]))
    steps = cells.groupBy("source").agg(F.first("lon_step").alias("lon_step"), F.first("lat_step").alias("lat_step"))
    line = F.transform("bends", lambda x: geo.point(x["ax"] * F.col("lon_step"), x["ay"] * F.col("lat_step")))
    out = rings.withColumn("bends", bend).join(steps, "source").withColumn("line", line)
    return out.select("source", F.concat("line", F.slice("line", 1, 1)).alias("ring"), (F.col("twice_area") > 0).alias("outer"), (F.col("twice_area") / 2 * metres * metres).alias("area_m2"))
