"""Map elements: which ways and nodes are kept, and what they become."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathweave.functions import geo

# Tag names and values of the map's data model.
PEDESTRIAN = ("footway", "path", "steps", "pedestrian", "corridor", "living_street")
EDGE_TAGS = ("surface", "smoothness", "incline", "covered", "tunnel", "bridge", "layer", "indoor", "width", "wheelchair", "access", "foot", "lit", "handrail", "step_count")
BARRIERS = ("gate", "bollard", "kerb")


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def plaza(tags: Column) -> Column:
    return F.coalesce((tag(tags, "area:highway") == "footway") | ((tag(tags, "highway") == "pedestrian") & (tag(tags, "area") == "yes")), F.lit(False))


def keep_way(tags: Column) -> Column:
    highway, foot = F.coalesce(tag(tags, "highway"), F.lit("")), F.coalesce(tag(tags, "foot"), F.lit(""))
    return (
        F.when(highway.isin(*PEDESTRIAN), True)
        .when((highway == "service") & (foot != "no"), True)
        .when(highway.isin("residential", "tertiary"), ~F.map_contains_key(tags, "sidewalk") & (foot == "yes"))
        .otherwise(plaza(tags))
    )


def keep_node(tags: Column) -> Column:
    return F.coalesce(tag(tags, "highway").isin("crossing", "elevator"), F.lit(False)) | F.map_contains_key(tags, "entrance") | F.coalesce(tag(tags, "barrier").isin(*BARRIERS), F.lit(False))


def features(elements: DataFrame) -> DataFrame:
    """``kind, osm_id, geometry_type, line, plaza, highway, name, crossing, tags`` of what is kept."""
    line = F.transform(F.coalesce("geometry", F.array().cast("array<struct<lat:double,lon:double>>")), lambda p: geo.point(F.round(p["lon"], 6), F.round(p["lat"], 6)))
    way = (F.col("type") == "way") & keep_way(F.col("tags")) & (F.size("line") >= 2)
    node = (F.col("type") == "node") & keep_node(F.col("tags"))
    d = elements.withColumn("line", line).filter(way | node)
    is_way = F.col("type") == "way"
    area = is_way & plaza(F.col("tags")) & (F.size("line") >= 4) & (F.get("line", F.lit(0)) == F.element_at("line", -1))
    at = F.array(geo.point(F.round("lon", 6), F.round("lat", 6)))
    return d.select(
        F.col("type").alias("kind"), F.col("id").alias("osm_id"), F.when(~is_way, "Point").when(area, "Polygon").otherwise("LineString").alias("geometry_type"),
        F.when(is_way, F.col("line")).otherwise(at).alias("line"), F.coalesce(area, F.lit(False)).alias("plaza"),
        tag(F.col("tags"), "highway").alias("highway"), tag(F.col("tags"), "name").alias("name"), tag(F.col("tags"), "crossing").alias("crossing"),
        F.map_filter("tags", lambda k, _: k.isin(*EDGE_TAGS, "entrance", "barrier", "highway")).alias("tags"),
    )


def centreline_metres(ways: DataFrame) -> DataFrame:
    """Total length of lines, without areas."""
    return ways.filter("geometry_type = 'LineString'").agg(F.coalesce(F.sum(geo.length(F.col("line"))), F.lit(0.0)).alias("metres"))


def same_grade(layer_a: Column, layer_b: Column, bridged_a: Column, bridged_b: Column) -> Column:
    """Whether two ways that cross in plan also meet."""
    zero = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    return (zero(layer_a) == zero(layer_b)) & ~F.coalesce(bridged_a, F.lit(False)) & ~F.coalesce(bridged_b, F.lit(False))
