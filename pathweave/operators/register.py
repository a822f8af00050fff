"""Building registers: rejects, duplicates of a code, freshness, footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pathweave.functions import geo
from pathweave.operators.components import connected_components
from pathweave.operators.spatial import close_pairs, spans
from pathweave.session import cut_lineage

WING_M = 150.0
NULL_ISLAND, NO_GEOMETRY = "null-island coordinates (0, 0)", "missing point geometry"
NOT_IN_SET, NOT_ENCLOSED = "code not in the building set", "open-air canopy or infrastructure"


def point_reason(x: Column, y: Column) -> Column:
    return F.when((x == 0) & (y == 0), NULL_ISLAND).when(x.isNull() | y.isNull(), NO_GEOMETRY)


def shape_reason(in_set: Column, name: Column) -> Column:
    return F.when(~F.coalesce(in_set, F.lit(False)), NOT_IN_SET).when(F.coalesce(name, F.lit("")).rlike(r"(?i)\b(SOLAR|CANOPY|INFRASTRUCTURE)\b"), NOT_ENCLOSED)


def shapes_of_buildings(shapes: DataFrame, codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``shapes(code, name, ...)`` of buildings, by ``codes(code)`` of the register, and the others with their ``reject_reason``."""
    known = codes.filter("code is not null").select("code").distinct()
    inside = shapes.join(known, "code", "left_semi").withColumn("reject_reason", shape_reason(F.lit(True), F.col("name")))
    outside = shapes.join(known, "code", "left_anti").withColumn("reject_reason", F.lit(NOT_IN_SET))
    return inside.filter("reject_reason is null").drop("reject_reason"), inside.filter("reject_reason is not null").unionByName(outside)


def with_entrance(nodes: DataFrame, entrances: DataFrame) -> DataFrame:
    """``nodes(node_id, ...)`` with what ``entrances(node_id, ...)`` says about those that are doors."""
    return nodes.join(entrances.drop("building_id"), "node_id", "left")


def with_building(footprints: DataFrame, buildings: DataFrame) -> DataFrame:
    """``footprints(footprint_id, ...)`` with the building that stands on each, if any."""
    b = buildings.filter("footprint_id is not null").select("footprint_id", "building_id", "display_name", "category", "routable", "footprint_src", "unroutable_why")
    return footprints.join(b, "footprint_id", "left")


def clusters(points: DataFrame, metres: float = WING_M, *, key: str | None = "code") -> DataFrame:
    """``points(id, position[, key])`` with ``cluster``: the smallest id of those linked, one to the
    next, by at most ``metres``, within the same ``key`` if there is one."""
    links = close_pairs(points, metres, same=key)
    found = connected_components(links, "a", "b")
    return points.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("component", "id")).drop("component")


def records(points: DataFrame, metres: float = WING_M) -> DataFrame:
    """``points(id, code, gsf, position)`` of kept register rows -> the same with ``record_id, ordinal,
    is_primary, cluster`` and the cluster's ``member_count, primary_gsf, summed_gsf, max_span_m, resolution``.

    Clusters of a code are numbered by total size; the first is ``bldg:CODE``, the next
    ``bldg:CODE#2``. Ties go to the row that comes first. The largest member is the primary.
    """
    d = clusters(points.withColumn("gsf0", F.coalesce(F.col("gsf").cast("double"), F.lit(0.0))), metres)
    per = d.groupBy("code", "cluster").agg(F.count("*").alias("member_count"), F.sum("gsf0").alias("summed_gsf"), F.max("gsf0").alias("primary_gsf"))
    per = per.withColumn("ordinal", F.row_number().over(W.partitionBy("code").orderBy(F.desc("summed_gsf"), "cluster")) - 1)
    count = F.count("*").over(W.partitionBy("code"))
    members = F.sum("member_count").over(W.partitionBy("code"))
    per = per.withColumn("resolution", F.when(members == 1, "single").when(count > 1, "separate").otherwise("wings"))
    per = per.withColumn("record_id", F.concat(F.lit("bldg:"), "code", F.when(F.col("ordinal") > 0, F.concat(F.lit("#"), (F.col("ordinal") + 1).cast("string"))).otherwise("")))
    per = per.join(spans(d, "cluster"), "cluster", "left").withColumn("max_span_m", F.round(F.coalesce("span", F.lit(0.0)), 1)).drop("span", "code")
    first = F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("gsf0"), "id")) == 1
    return d.join(per, "cluster").withColumn("is_primary", first).drop("gsf0")


def freshness(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``field, min, max, p50, n`` of millisecond columns; p50 is the upper median, not interpolated.

    Values are counted and dealt by ranges; the median is looked for in the one range that holds it.
    """
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("v")) for c in columns])).alias("x")).select("x.*").filter("v is not null")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = long.groupBy("field", "v").agg(F.count("*").alias("c")).repartitionByRange(parts, "field", "v")
    counted = cut_lineage(counted.withColumn("part", F.spark_partition_id()))
    ranges = counted.groupBy("field", "part").agg(F.sum("c").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))  # a row per range
    before = F.sum("c").over(W.partitionBy("field").orderBy("part")) - F.col("c")
    ranges = ranges.select("field", "part", "lo", "hi", "c", before.alias("before"), F.sum("c").over(W.partitionBy("field")).alias("n"))
    middle = F.floor(F.col("n") / 2)
    holds = ranges.filter((F.col("before") <= middle) & (middle < F.col("before") + F.col("c"))).select("field", "part", (middle - F.col("before")).alias("left"))
    up_to = F.sum("c").over(W.partitionBy("field").orderBy("v"))
    mid = counted.join(F.broadcast(holds), ["field", "part"]).withColumn("up_to", up_to).filter("up_to > left").groupBy("field").agg(F.min("v").alias("mid"))
    found = ranges.groupBy("field").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n").alias("n")).join(mid, "field")
    fields = rows.sparkSession.createDataFrame([(c,) for c in columns], "field string")
    d = fields.join(found, "field", "left")
    return d.select("field", *[F.timestamp_millis(c).alias(a) for c, a in (("lo", "min"), ("hi", "max"), ("mid", "p50"))], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def reconcile(features: DataFrame) -> DataFrame:
    """``features(source, kept)`` -> the sources whose rows don't add up to kept and rejected ones."""
    g = features.groupBy("source").agg(F.count("*").alias("total"), F.sum(F.col("kept").cast("long")).alias("kept"), F.sum((~F.col("kept")).cast("long")).alias("rejected"))
    return g.filter(F.col("total") != F.coalesce("kept", F.lit(0)) + F.coalesce("rejected", F.lit(0)))


def coverage(buildings: DataFrame, footprints: DataFrame) -> DataFrame:
    """One row over ``buildings(code, gsf)`` and ``footprints(code)``."""
    codes = footprints.filter("code is not null").select("code").distinct().withColumn("has", F.lit(True))
    d = buildings.join(codes, "code", "left").withColumn("has", F.coalesce("has", F.lit(False))).withColumn("gsf", F.coalesce(F.col("gsf").cast("long"), F.lit(0)))
    with_ = F.count_if(F.col("has"))
    return d.agg(
        F.count("*").alias("records"), with_.alias("with_footprint"), F.count_if(~F.col("has")).alias("without_footprint"),
        F.when(F.count("*") > 0, F.round(100 * with_ / F.count("*"), 1)).otherwise(0.0).alias("coverage_pct"),
        F.count_distinct("code").alias("distinct_codes"), F.count_distinct(F.when(F.col("has"), F.col("code"))).alias("distinct_covered"),
        F.count_if(~F.col("has") & (F.col("gsf") == 0)).alias("without_zero_gsf"), F.count_if(~F.col("has") & (F.col("gsf") >= 50_000)).alias("without_over_50k"),
    )


def gained(buildings: DataFrame, first: DataFrame, second: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes of buildings that only the second source has, codes of the first that the second lacks, and what neither covers."""
    code = lambda d: d.filter("code is not null").select("code")
    return code(buildings).intersect(code(second)).subtract(code(first)), code(first).subtract(code(second)), code(buildings).subtract(code(first).union(code(second)))


def merge_by_priority(sources: list[DataFrame], key: str = "code") -> DataFrame:
    """The rows of the first source that has the key; a source's own rows of a key all stay."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("priority", F.lit(i))
        every = s if every is None else every.unionByName(s, allowMissingColumns=True)
    best = F.min("priority").over(W.partitionBy(key))
    return every.withColumn("best", best).filter("priority = best").drop("best")


def shape_errors(shapes: DataFrame, lon: tuple[float, float], lat: tuple[float, float]) -> DataFrame:
    """``shapes(ordinal, geometry_type, code, ring)`` -> a row per fault; any of them should stop the ingest."""
    bad = F.filter("ring", lambda p: ~(p["lon"].between(*lon) & p["lat"].between(*lat)))
    faults = F.array_compact(
        F.array(
            F.when(~F.col("geometry_type").isin("Polygon", "MultiPolygon") | F.col("geometry_type").isNull(), F.concat(F.lit("geometry is "), F.coalesce("geometry_type", F.lit("missing")))),
            F.when(~F.coalesce(F.col("code").rlike("^[A-Z0-9]+$"), F.lit(False)), "code is not a building code"),
            F.when(F.size("ring") < 4, "ring has fewer than 4 positions"),
            F.when((F.size("ring") >= 1) & (F.get("ring", F.lit(0)) != F.element_at("ring", -1)), "ring is not closed"),
            F.when(F.size(bad) > 0, F.concat(F.lit("vertex out of bounds: "), F.to_json(F.get(bad, F.lit(0))))),
        )
    )
    return shapes.select("ordinal", F.explode(faults).alias("fault"))


class ShapeFaults(ValueError):
    """An ingest was stopped."""


def checked_shapes(shapes: DataFrame, lon: tuple[float, float], lat: tuple[float, float], shown: int = 20) -> DataFrame:
    """``shapes`` if they have no fault and there are any; else the ingest stops with the number of faults and the first ``shown``."""
    if shapes.isEmpty():
        raise ShapeFaults("no shapes")
    faults = cut_lineage(shape_errors(shapes, lon, lat))
    n = faults.count()
    if n:
        first = [f"shape {r['ordinal']}: {r['fault']}" for r in faults.orderBy("ordinal", "fault").limit(shown).collect()]
        raise ShapeFaults(f"{n} faults: " + "; ".join(first))
    return shapes
