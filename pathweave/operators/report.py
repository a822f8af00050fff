"""Route-quality reports, digests and series of builds."""

from __future__ import annotations

import random
from collections.abc import Sequence
from math import ceil, floor, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pathweave.functions import geo
from pathweave.session import cut_lineage

SEED, PAIRS, LEAST_M = 20260827, 500, 50.0


def sampled_pairs(spark: SparkSession, places: list[tuple[str, float, float]], n: int = PAIRS, seed: int = SEED, least_m: float = LEAST_M) -> DataFrame:
    """``from_bldg, to_bldg, straight_m``: pairs drawn by a seeded generator, so that they are the same
    everywhere, the smaller id first. ``places`` are the ids and centres of the routable buildings, a list that a driver holds."""
    from math import asin, cos, radians, sin, sqrt

    def metres(a: tuple, b: tuple) -> float:
        p, q, d = radians(a[2]), radians(b[2]), radians(b[1] - a[1])
        h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(d / 2) ** 2
        return 2 * geo.EARTH_M * asin(min(1.0, sqrt(h)))

    rng, ordered = random.Random(seed), sorted(places)
    seen, out, tries = set(), [], 0
    while len(out) < n and tries < 200 * n and len(ordered) > 1:
        tries += 1
        a, b = rng.sample(ordered, 2)
        key = tuple(sorted((a[0], b[0])))
        if key in seen or (m := metres(a, b)) < least_m:
            continue
        seen.add(key)
        out.append((*key, m))
    return spark.createDataFrame(out, "from_bldg string, to_bldg string, straight_m double")


def detours(samples: DataFrame) -> DataFrame:
    """``samples(..., graph_m, straight_m)`` with ``detour_ratio`` and ``failure``."""
    return samples.withColumn("detour_ratio", F.try_divide("graph_m", "straight_m")).withColumn("failure", F.when(F.col("graph_m").isNull(), "disconnected"))


def quantiles(rows: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """The interpolated quantiles of a column, as one has them of all its values in order; None if there are none.

    Values are counted and dealt by ranges, and the two neighbours of each rank are looked for in the range that
    holds them, so no task sees more than a range of different values.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null").groupBy("v").agg(F.count("*").alias("c"))
    counted = cut_lineage(counted.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()))
    ranges = counted.groupBy("part").agg(F.sum("c").alias("c"))  # a row per range
    ranges = ranges.withColumn("before", F.sum("c").over(W.orderBy("part")) - F.col("c"))
    n = counted.agg(F.sum("c")).first()[0]
    if not n:
        return [None] * len(shares)
    places = [q * (n - 1) for q in shares]
    ranks = sorted({r for h in places for r in (floor(h), ceil(h))})
    wanted = ranges.withColumn("rank", F.explode(F.array(*[F.lit(r).cast("long") for r in ranks])))
    wanted = wanted.filter("before <= rank and rank < before + c").select("part", "rank", (F.col("rank") - F.col("before")).alias("left"))
    up_to = F.sum("c").over(W.partitionBy("rank").orderBy("v"))
    found = counted.join(F.broadcast(wanted), "part").withColumn("up_to", up_to).filter("up_to > left").groupBy("rank").agg(F.min("v").alias("v"))
    value = {r["rank"]: r["v"] for r in found.collect()}
    return [value[floor(h)] + (value[ceil(h)] - value[floor(h)]) * (h - floor(h)) for h in places]


def quality(samples: DataFrame) -> DataFrame:
    """``gate, value, most, ok`` over the ratios of ``detours``; percentiles are interpolated."""
    samples = cut_lineage(samples.select("detour_ratio", "failure"))
    r1, r2 = quantiles(samples, "detour_ratio", (0.5, 0.9))
    one = samples.agg(F.coalesce(F.lit(r1), F.lit(0.0)).alias("R1"), F.coalesce(F.lit(r2), F.lit(0.0)).alias("R2"), F.coalesce(F.max("detour_ratio"), F.lit(0.0)).alias("R3"), F.count_if(F.col("failure").isNotNull()).cast("double").alias("R4"))
    limits = {"R1": 1.30, "R2": 1.45, "R3": 3.00, "R4": 0.0}
    rows = F.array(*[F.struct(F.lit(g).alias("gate"), F.round(g, 3).alias("value"), F.lit(most).alias("most")) for g, most in limits.items()])
    return one.select(F.explode(rows).alias("x")).select("x.*", (F.col("x.value") <= F.col("x.most")).alias("ok"))


def ratchet(limit: float, value: float) -> float:
    """A threshold tightened to a passing value, rounded up to hundredths."""
    from math import ceil

    return min(limit, ceil(round(value * 100, 9)) / 100)


def build_metrics(build_hash: str, values: dict[str, DataFrame]) -> DataFrame:
    """``build_hash, metric, value, gate, passed`` of one build: a row for each metric of ``values``, tables with
    ``value`` and, where a gate judges the metric, ``gate, passed``. A row per build and metric is a point of its series."""
    out = None
    for name, d in values.items():
        have = {c: F.col(c) for c in d.columns}
        one = d.select(F.lit(build_hash).alias("build_hash"), F.lit(name).alias("metric"), F.col("value").cast("double").alias("value"), have.get("gate", F.lit(None)).cast("string").alias("gate"), have.get("passed", F.lit(None)).cast("boolean").alias("passed"))
        out = one if out is None else out.unionByName(one)
    return out


def metric_changes(series: DataFrame, builds: DataFrame) -> DataFrame:
    """``metric, build_hash, value, before, change, passed, lost`` of ``series`` by the order of ``builds(build_hash, generated_utc)``:
    each value beside that of the build before, and whether a gate that had passed fails now."""
    w = W.partitionBy("metric").orderBy("generated_utc", "build_hash")
    d = series.join(builds.select("build_hash", "generated_utc"), "build_hash")
    d = d.withColumns({"before": F.lag("value").over(w), "had": F.lag("passed").over(w)})
    return d.select("metric", "build_hash", "generated_utc", "value", "before", (F.col("value") - F.col("before")).alias("change"), "passed", (F.coalesce("had", F.lit(False)) & ~F.coalesce("passed", F.lit(True))).alias("lost"))


def graph_hash(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """SHA-256 over the ordered node ids and ``id|from|to|length`` of the ordered edges. The digests of
    ranges are taken first, so no task holds the whole graph as text; it is not the digest of the whole
    listing in one go. Ranges get smaller as the graph grows, so that one has some 50 000 lines at most."""
    parts = max(2, ceil(log(max(nodes.count() + edges.count(), 1) / 50_000, 16)))
    n = nodes.select(F.lit(0).alias("part"), F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("line"))
    e = edges.select(F.lit(1).alias("part"), F.col("id").cast("string").alias("k"), F.concat_ws("|", F.col("id").cast("string"), F.col("u").cast("string"), F.col("v").cast("string"), F.format_string("%.3f", "m")).alias("line"))
    lines = n.unionByName(e).withColumn("range", F.substring(F.sha2("k", 256), 1, parts))
    each = lines.groupBy("part", "range").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n"), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "range", "h"))), lambda x: F.concat_ws(":", x["part"].cast("string"), x["range"], x["h"])), ""), 256).alias("graph_hash"))


def table_digest(df: DataFrame) -> DataFrame:
    """``rows, digest`` of a table whatever its order: equal tables agree, and every column counts."""
    h = F.xxhash64(*[F.coalesce(F.to_json(F.struct(c)), F.lit("")) for c in df.columns])
    return df.select(h.alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def same_build(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> list[str]:
    """The tables in which two builds differ."""
    return [t for t in first if tuple(table_digest(first[t]).first()) != tuple(table_digest(second[t]).first())]


def manifest_counts(buildings: DataFrame, nodes: DataFrame, edges: DataFrame, components: int) -> DataFrame:
    b = buildings.agg(F.count("*").alias("buildings"), F.count_if(F.col("routable")).alias("routableBuildings"))
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("type") == "entrance").alias("entrances"), F.count_if(F.coalesce("provisional", F.lit(False))).alias("provisionalEntrances"), F.count_if(F.col("type") == "crossing").alias("crossings"))
    e = edges.agg(F.count("*").alias("edges"), F.round(F.coalesce(F.sum("lengthM"), F.lit(0.0)), 2).alias("totalLengthM"))
    return b.crossJoin(n).crossJoin(e).withColumn("components", F.lit(components))


def entrance_queue(buildings: DataFrame, entrances: DataFrame) -> DataFrame:
    """Buildings whose doors are all provisional or missing, with their ``place``, the largest first."""
    sure = entrances.filter(~F.coalesce("provisional", F.lit(True))).select(F.col("buildingId").alias("id")).distinct()
    return numbered(buildings.join(sure, "id", "left_anti"), "place", F.desc_nulls_last("gsf"), F.asc("id"))


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """``rows`` numbered from 1 in a total order: dealt by ranges, numbered in each, and moved on by the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    d = cut_lineage(d.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = d.groupBy("__part").agg(F.count("*").alias("n"))  # a row per range
    before = sizes.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))
    return d.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__part", "__at", "__before")


def latest_by_key(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the last row; deleted ones (``deleted`` is true) are left out."""
    last = changes.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), order).alias("row"))
    return last.select(*keys, "row.*").filter("not coalesce(deleted, false)").drop("deleted").select(*[c for c in changes.columns if c != "deleted"])
