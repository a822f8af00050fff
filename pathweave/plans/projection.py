"""A walking graph drawn from star-schema tables, so that every operator runs at any scale.

Customers are nodes of a lattice 40 wide, suppliers are buildings with doors on it, parts are
footprints. All of it is integer arithmetic on keys that are dense from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import geo

WIDTH, STEP, LON0, LAT0 = 40, 0.00012, -111.95, 33.40
SURFACES = {"AUTOMOBILE": "paved", "BUILDING": "concrete", "FURNITURE": "gravel", "HOUSEHOLD": "grass"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def place(id_: Column) -> Column:
    return geo.point(F.lit(LON0) + (id_ % WIDTH) * F.lit(STEP), F.lit(LAT0) + F.floor(id_ / WIDTH) * F.lit(STEP))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), place(F.col("c_custkey")).alias("position"), F.when(F.col("c_custkey") % 17 == 3, "crossing").otherwise("walkway").alias("type"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, u, v, type, name, lengthM, surface, stairs, stepCount, accessible, shadeIndex, geometry``."""
    c = table(spark, sf_dir, "customer")
    n = c.select(F.col("c_custkey").alias("v"))
    surface = F.lit("unknown")
    for segment, s in SURFACES.items():
        surface = F.when(F.col("c_mktsegment") == segment, s).otherwise(surface)
    u = F.col("c_custkey")
    east = F.when(u % WIDTH < WIDTH - 1, F.struct((u + 1).alias("v"), F.lit(0).alias("k")))
    north = F.struct((u + WIDTH).alias("v"), F.lit(1).alias("k"))
    d = c.select(
        u.alias("u"), surface.alias("surface"), (F.col("c_acctbal") < 0).alias("stairs"), F.col("c_mktsegment").alias("name"),
        F.when(F.col("c_nationkey") % 3 == 0, True).when(F.col("c_nationkey") % 3 == 1, False).alias("accessible"),
        ((u * 7) % 100 / 100.0).alias("shadeIndex"), F.explode(F.array_compact(F.array(east, north))).alias("x"),
    )
    # both ends exist: the node table has no more columns than its key here
    d = d.select("*", F.col("x.v").alias("v"), (F.col("u") * 2 + F.col("x.k")).alias("id")).drop("x").join(n, "v", "left_semi")
    line = F.array(place(F.col("u")), place(F.col("v")))
    d = d.withColumn("geometry", line).withColumn("lengthM", F.floor(geo.length(F.col("geometry")) * 100) / 100)
    kind = F.when(F.col("stairs"), "steps").when((F.col("u") % 17 == 3) & (F.col("id") % 2 == 0), "crossing").otherwise("path")
    return d.select("id", "u", "v", kind.alias("type"), "name", "lengthM", "surface", "stairs", F.lit(None).cast("int").alias("stepCount"), "accessible", "shadeIndex", "geometry")


def crossing_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).filter("type = 'crossing'").select("id")


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, in_area, doors, gsf, centroid``. The counts of nodes joins as one row."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    s = table(spark, sf_dir, "supplier").crossJoin(F.broadcast(n))
    k = F.col("s_suppkey")
    two = F.array((k * 15) % F.col("n"), (k * 15 + 7) % F.col("n"))
    doors = F.when(k % 23 == 0, F.array().cast("array<bigint>")).when(k % 31 == 0, F.array(F.col("n") + k)).otherwise(two)
    return s.select(k.alias("id"), (k % 29 != 0).alias("in_area"), doors.alias("doors"), F.floor("s_acctbal").cast("long").alias("gsf"), place((k * 15) % F.col("n")).alias("centroid"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``request, from_id, to_id``: ordered pairs of suppliers, thinned to about a hundred for each, and one unknown building."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    n = s.agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(1), F.floor(F.col("n") / 100))
    f = s.crossJoin(F.broadcast(n)).withColumn("k", k.cast("long"))
    # the partners of a supplier are every k-th, so they are numbered rather than joined
    first = F.pmod(-(F.col("s_suppkey") * 101), F.col("k"))
    to = F.explode(F.when(first < F.col("n"), F.sequence(first, F.col("n") - 1, F.col("k"))))
    d = f.select(F.col("s_suppkey").alias("from_id"), "n", to.alias("to_id"))
    extra = n.select(F.lit(1).cast("long").alias("from_id"), "n", (F.col("n") + 1).alias("to_id"))
    return d.unionByName(extra).select((F.col("from_id") * (F.col("n") + 2) + F.col("to_id")).alias("request"), "from_id", "to_id")


def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``footprint_id, ring, code, type, size``: a box around the middle of a lattice cell."""
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("n"))
    p = table(spark, sf_dir, "part").crossJoin(F.broadcast(n))
    at = place((F.col("p_partkey") * 7) % F.col("n"))
    half = F.lit(0.00002) + F.col("p_size") * F.lit(0.000002)
    lon, lat = at["lon"] + F.lit(0.00003), at["lat"] + F.lit(0.00004)
    corner = lambda i, j: geo.point(lon + i * half, lat + j * half)
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))
    return p.select(F.col("p_partkey").alias("footprint_id"), ring.alias("ring"), F.concat(F.lit("S"), (F.col("p_partkey") % 50).cast("string")).alias("code"), F.col("p_type").alias("type"), F.col("p_size").alias("size"))
