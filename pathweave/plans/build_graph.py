"""The build from kept ways to a routable graph, stage after stage, each written where it can be inspected."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.functions import geo
from pathweave.operators import build, report
from pathweave.session import write_and_reread

POINTS = f"array<{geo.POINT}>"


@dataclass
class State:
    """What the stages pass on. ``ways(way, line, layer, bridged, type, name, surface, plaza)``,
    ``buildings(id, ring)``, ``entrances(p)``, ``area(ring)``, ``trees(id, line)``, and if there are
    any ``barriers(p)`` and ``crossings(p, signalized)``."""

    ways: DataFrame
    buildings: DataFrame
    entrances: DataFrame
    area: DataFrame
    trees: DataFrame
    barriers: DataFrame | None = None
    crossings: DataFrame | None = None
    lines: DataFrame | None = None
    edges: DataFrame | None = None
    doors: DataFrame | None = None
    rejected: DataFrame | None = None
    dropped: DataFrame | None = None
    allowed: DataFrame | None = None
    links: DataFrame | None = None
    log: list[str] = field(default_factory=list)


ATTRIBUTES = ["type", "name", "surface"]


def load(s: State) -> None:
    s.ways, s.rejected = build.clip(s.ways, s.area)


def node(s: State) -> None:
    s.lines = build.node_lines(s.ways.filter("not plaza").drop("plaza"))


def cluster(s: State) -> None:
    s.lines = build.snap(s.lines)


def plaza(s: State) -> None:
    """Lines across plazas, between the ends of ways on their borders."""
    across = build.plaza_lines(s.ways.filter("plaza"), s.lines).withColumns({"part": F.lit(-1), "u": F.col("line")[0], "v": F.element_at("line", -1), "type": F.lit("plaza"), "layer": F.lit(None).cast("string"), "bridged": F.lit(False), "name": F.lit(None).cast("string"), "surface": F.lit("paved")})
    s.lines = s.lines.withColumn("synthetic", F.lit(False)).unionByName(across, allowMissingColumns=True)


def cleanup(s: State) -> None:
    e = s.lines.withColumn("id", F.xxhash64(F.to_json("line"), "way", "part")).withColumn("m", geo.length(F.col("line")))
    # stubs stay that end at an entrance or barrier; chains end at entrances and crossings
    near = lambda points: e.select(F.col("u").alias("node")).limit(0) if points is None else build.near_points(e, points)
    doors = write_and_reread(near(s.entrances), "build-kept")
    e = build.drop_stubs(e.select("id", "u", "v", "m", "line", "synthetic", *ATTRIBUTES), doors.union(near(s.barriers)).distinct())
    apart = write_and_reread(doors.union(near(s.crossings)).distinct(), "build-apart")
    e = write_and_reread(build.drop_duplicates(e.withColumn("tags", F.size(F.array_compact(F.array("name", "surface"))))).drop("tags"), "build-unique")
    e, s.dropped = build.largest_component(e)
    s.edges = build.collapse_chains(e, apart, [*ATTRIBUTES, "synthetic"])


def clip_footprints(s: State) -> None:
    s.edges, s.allowed = build.around_footprints(s.edges, s.buildings.select(F.col("id").alias("footprint_id"), "ring"))


def entrances(s: State) -> None:
    s.doors = write_and_reread(build.doors(s.buildings, s.entrances, s.edges), "build-doors")
    cut, links = build.link_doors(s.doors, s.edges)
    links = links.select(F.col("line")[0].alias("u"), F.element_at("line", -1).alias("v"), "line", F.lit("link").alias("type"), F.lit(None).cast("string").alias("name"), "surface", F.lit(False).alias("synthetic"))
    cut = cut.withColumns({"u": F.col("line")[0], "v": F.element_at("line", -1)})
    s.edges = cut.select("u", "v", "line", "type", "name", "surface", "synthetic").unionByName(links)


def identity(s: State) -> None:
    s.edges = build.with_ids(s.edges)


def shade(s: State) -> None:
    e = s.edges.withColumns({c: F.lit(False) for c in ("covered", "tunnel", "indoor")})
    s.edges = build.shade(e, s.trees, s.buildings.select(F.col("id").alias("footprint_id"), "ring"))


#: Doors are linked before ids are given, so that ids are of the edges as they end up.
STAGES: list[tuple[str, Callable[[State], None]]] = [
    ("load", load), ("node", node), ("cluster", cluster), ("plaza", plaza), ("cleanup", cleanup), ("footprints", clip_footprints), ("entrances", entrances), ("identity", identity), ("shade", shade),
]


def run(state: State, *, only: str | None = None, begin: str | None = None) -> State:
    """Run all stages, one, or those from one on; what a stage has made is written and read back."""
    names = [n for n, _ in STAGES]
    for wanted in (only, begin):
        if wanted is not None and wanted not in names:
            raise ValueError(f"no stage {wanted}; there are {', '.join(names)}")
    started = begin is None
    for name, stage in STAGES:
        started = started or name == begin
        if (only is not None and name != only) or not started:
            continue
        stage(state)
        for part in ("ways", "lines", "edges"):
            df = getattr(state, part)
            if df is not None and part in {"load": ("ways",), "node": ("lines",), "cluster": ("lines",), "plaza": ("lines",)}.get(name, ("edges",)):
                setattr(state, part, write_and_reread(df, f"build-{name}"))
        state.log.append(name)
    return state


def nodes(state: State) -> DataFrame:
    """``id, position, type`` of the built edges' ends; doors are entrances, ends at a mapped crossing crossings."""
    ends = state.edges.select(F.explode(F.array(F.struct(F.col("from_node_id").alias("id"), F.col("line")[0].alias("position")), F.struct(F.col("to_node_id").alias("id"), F.element_at("line", -1).alias("position")))).alias("x")).select("x.*")
    doors = state.doors.filter("position is not null").select(build.node_id(F.col("position")).alias("id"), F.lit(True).alias("door")).distinct()
    each = ends.groupBy("id").agg(F.min("position").alias("position"))
    each = each.join(doors, "id", "left").withColumn("at", F.lit(False))
    if state.crossings is not None:
        ends = each.select(F.col("position").alias("u"), F.col("position").alias("v"))
        met = build.near_points(ends, state.crossings).select(F.col("node").alias("position"), F.lit(True).alias("met"))
        each = each.join(met, "position", "left").withColumn("at", F.coalesce("met", F.lit(False)))
    kind = F.when(F.col("door"), "entrance").when(F.col("at"), "crossing").otherwise("walkway")
    return each.select("id", "position", kind.alias("type"))


def deterministic(make: Callable[[], State]) -> list[str]:
    """Build twice; the tables in which the builds differ, none if all is well."""
    a, b = run(make()), run(make())
    return report.same_build({"edges": a.edges, "doors": a.doors}, {"edges": b.edges, "doors": b.doors})
