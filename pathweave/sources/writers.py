"""Writers: feature collections, manifests, reject logs, tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions import geo
from pathweave.operators import register


class WriteRefused(RuntimeError):
    """A write was asked for without ``allow_write``."""


def _guard(allow_write: bool, path: str) -> None:
    if not allow_write:
        raise WriteRefused(f"{path} would be written; pass allow_write=True")


def as_feature(geometry_type: str, coordinates: Column, properties: Sequence[str], drop_empty: bool = True) -> Column:
    """A feature as JSON; null properties, and empty strings if asked for, are left out."""
    value = lambda c: F.when(F.col(c).cast("string") != "", F.col(c)) if drop_empty else F.col(c)
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit(geometry_type).alias("type"), coordinates.alias("coordinates")).alias("geometry"), F.struct(*[value(c).alias(c) for c in properties]).alias("properties")))


def coordinates(line: Column, digits: int = 6) -> Column:
    return F.transform(line, lambda p: F.array(F.round(p["lon"], digits), F.round(p["lat"], digits)))


def write_features(df: DataFrame, feature: Column, order: Sequence[str], path: str, *, allow_write: bool = False) -> None:
    """One feature a line, sorted by ``order`` across all files, so equal input gives equal text."""
    _guard(allow_write, path)
    df.orderBy(*order).select(feature.alias("value")).write.mode("overwrite").text(path)


def upsert_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """``manifest`` with the rows of ``entries`` in place of those for the same file."""
    return manifest.join(entries.select("file"), "file", "left_anti").unionByName(entries, allowMissingColumns=True)


def split_rejects(classified: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """Kept rows, and rejected ones with their reason; every row is in one of the two."""
    return classified.filter(F.col(reason).isNull()).drop(reason), classified.filter(F.col(reason).isNotNull())


def replace_partition(df: DataFrame, path: str, key: str, *, allow_write: bool = False) -> None:
    """Replace the partitions of ``key`` that ``df`` has and leave the others as they are."""
    _guard(allow_write, path)
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def file_digests(df_binary_files: DataFrame) -> DataFrame:
    """``path, sha256, bytes`` of what ``spark.read.format("binaryFile")`` has read."""
    return df_binary_files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def replace_section(text: str, marker: str, body: str) -> str:
    """``text`` with what stands between a marker's begin and end replaced, or added at the end."""
    begin, end = f"<!-- {marker}:begin -->", f"<!-- {marker}:end -->"
    block = f"{begin}\n{body.rstrip()}\n{end}"
    if begin in text and end in text:
        head, _, rest = text.partition(begin)
        return head + block + rest.partition(end)[2]
    return (text.rstrip() + "\n\n" if text.strip() else "") + block + "\n"


def emit_document(buildings: DataFrame, nodes: DataFrame, edges: DataFrame, path: str, *, manifest: DataFrame | None = None, allow_write: bool = False) -> None:
    """The graph as lines, each a part of the document with one entity, sorted by kind and id: written
    side by side, unlike one document, equal for equal input, and read by ``graph_document(lines=True)``."""
    _guard(allow_write, path)
    every = None
    for order, (name, df) in enumerate((("manifest", manifest), ("buildings", buildings), ("nodes", nodes), ("edges", edges))):
        if df is None:
            continue
        place = {"centroid": lambda c: _place(F.col(c)), "position": lambda c: _place(F.col(c)), "geometry": lambda c: F.transform(c, _place)}
        entity = F.struct(*[(place[c](c) if c in place else F.col(c)).alias(c) for c in df.columns])
        line = F.to_json(F.struct((entity if name == "manifest" else F.array(entity)).alias(name)))
        key = F.col("id") if "id" in df.columns else F.lit("")
        one = df.select(F.lit(order).alias("kind"), key.alias("key"), line.alias("value"))
        every = one if every is None else every.unionByName(one)
    every.orderBy("kind", "key", "value").select("value").write.mode("overwrite").text(path)


def _place(p: Column) -> Column:
    return F.when(p.isNotNull(), F.array(p["lon"], p["lat"]))


#: Where nothing is known of a graph's extent: west, south, east, north.
DEFAULT_BOX = (-111.9365, 33.4155, -111.928, 33.4248)


def extent(edges: DataFrame, line: str = "geom") -> DataFrame:
    """One row ``min_lon, min_lat, max_lon, max_lat`` around all lines, the default box without any."""
    own = geo.bounds(F.col(line))
    ends = ((F.min, "min_lon"), (F.min, "min_lat"), (F.max, "max_lon"), (F.max, "max_lat"))
    return edges.agg(*[F.coalesce(f(own[c]), F.lit(d)).alias(c) for (f, c), d in zip(ends, DEFAULT_BOX, strict=True)])


def layers(tables: dict[str, DataFrame], dropped: DataFrame) -> dict[str, DataFrame]:
    """The five layers of an export, ``key, feature`` each: edges, nodes with what is known of doors,
    footprints with the building on each, buildings, and the centres of dropped components."""
    line, at = lambda c: coordinates(F.col(c), 7), lambda c: F.array(F.round(F.col(c)["lon"], 7), F.round(F.col(c)["lat"], 7))
    nodes = register.with_entrance(tables["node"], tables["entrance"].withColumnRenamed("ordinal", "entrance_ordinal"))
    footprints = register.with_building(tables["footprint"], tables["building"])
    # The properties of each layer.
    parts = {
        "edges": (tables["edge"], "edge_id", "LineString", line("geom"), "edge_id type name length_m surface stairs step_count covered tunnel bridge layer accessible shade_index shade_source synthetic osm_way_id"),
        "nodes": (nodes, "node_id", "Point", at("geom"), "node_id type osm_node_id building_id provisional weak signalized cross_kind entrance_ordinal snap_m side"),
        "footprints": (footprints, "footprint_id", "Polygon", F.array(line("geom")), "footprint_id code area_m2 building_id display_name category routable footprint_src unroutable_why"),
        "buildings": (tables["building"], "building_id", "Point", at("centroid"), "building_id code display_name category routable unroutable_why gsf footprint_src in_service_area"),
        "dropped": (dropped, "component", "Point", at("centre"), "component nodes metres"),
    }
    out = {}
    for name, (df, key, shape, where, wanted) in parts.items():
        out[name] = df.select(F.col(key).cast("string").alias("key"), as_feature(shape, where, [c for c in wanted.split() if c in df.columns]).alias("feature"))
    return out


def field_layer(buildings: DataFrame, queue: DataFrame, labels: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Buildings with their place in the entrance queue and its label, and the count per status."""
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]) if labels else F.create_map()
    d = buildings.join(queue, "id", "left").withColumn("status", F.coalesce("status", F.lit("none")))
    d = d.withColumn("label", F.coalesce(F.try_element_at(label, F.col("status")), F.col("status")))
    return d, d.groupBy("status").count()
