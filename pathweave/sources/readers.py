"""Readers of graph documents, map extracts, building registers and feature collections."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from pathweave import schema
from pathweave.functions import geo


def graph_document(spark: SparkSession, path: str, *, lines: bool = False) -> dict[str, DataFrame]:
    """``manifest``, ``buildings``, ``nodes`` and ``edges`` of graph files, geometries as points.

    A file is one document, or with ``lines`` a part of one on each line, as ``emit_document`` writes them.
    """
    doc = spark.read.schema(schema.GRAPH).option("multiLine", not lines).json(path)
    each = lambda name: doc.select(F.explode(name).alias("x")).select("x.*")
    pos = lambda c: F.when(F.col(c).isNotNull(), geo.point(F.col(c)[0], F.col(c)[1]))
    return {
        "manifest": doc.filter("manifest is not null").select("manifest.*"),
        "buildings": each("buildings").withColumn("centroid", pos("centroid")),
        "nodes": each("nodes").withColumn("position", pos("position")),
        "edges": each("edges").withColumn("geometry", geo.points(F.col("geometry"))),
    }


def document_faults(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """``kind, entity, fault`` of graph files by their text: parts that are missing, properties that the
    format doesn't have, and values that aren't of their property's type (text that holds a number
    passes as a number does as text)."""
    kinds = {"buildings": schema.BUILDING, "nodes": schema.NODE, "edges": schema.EDGE}
    raw = ", ".join(f"{k} array<string>" for k in kinds)
    doc = spark.read.schema(f"manifest string, {raw}").option("multiLine", not lines).json(path)
    held = doc.agg(*[F.count(c).alias(c) for c in ("manifest", *kinds)])
    missing = F.array_compact(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in ("manifest", *kinds)]))
    out = held.select(F.explode(missing).alias("kind")).select("kind", F.lit("document").alias("entity"), F.lit("missing").alias("fault"))
    parts = [(k, ddl, doc.select(F.explode(k).alias("text"))) for k, ddl in kinds.items()]
    parts.append(("manifest", schema.MANIFEST, doc.filter("manifest is not null").select(F.col("manifest").alias("text"))))
    for kind, ddl, entities in parts:
        names = spark.createDataFrame([], f"x {ddl}").schema["x"].dataType.names
        d = entities.withColumns({"x": F.from_json("text", ddl), "keys": F.json_object_keys("text")})
        extra = F.transform(F.array_except("keys", F.array(*map(F.lit, names))), lambda k: F.concat(F.lit("unexpected property "), k))
        wrong = F.array_compact(F.array(*[F.when(F.get_json_object("text", f"$.{n}").isNotNull() & F.col(f"x.{n}").isNull(), F.lit(f"{n} is of another type")) for n in names]))
        entity = F.coalesce(F.get_json_object("text", "$.id"), F.lit(kind))
        out = out.unionByName(d.select(F.lit(kind).alias("kind"), entity.alias("entity"), F.explode(F.concat(F.coalesce(extra, F.array().cast("array<string>")), wrong)).alias("fault")))
    return out


def overpass(spark: SparkSession, path: str) -> DataFrame:
    """The elements of a map extract: ``type, id, lat, lon, geometry, tags``."""
    doc = spark.read.schema(schema.OVERPASS).option("multiLine", True).json(path)
    return doc.select(F.explode("elements").alias("x")).select("x.*").withColumn("tags", F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))


def extract_file(spark: SparkSession, path: str) -> DataFrame:
    """Binary extracts aren't supported, as the format asks for a parser of its own."""
    if path.endswith(".pbf"):
        raise NotImplementedError("binary map extracts (.pbf) aren't supported; pass the JSON form")
    return overpass(spark, path)


def overpass_query(min_lon: float, min_lat: float, max_lon: float, max_lat: float) -> str:
    """The request for all ways and nodes that the filters keep; the box is south, west, north, east."""
    box = f"({min_lat},{min_lon},{max_lat},{max_lon})"
    # The conditions of the filters in the service's language.
    wanted = [
        'way["highway"~"^(footway|path|steps|pedestrian|corridor|living_street)$"]', 'way["highway"="service"]["foot"!="no"]', 'way["highway"~"^(residential|tertiary)$"]["foot"="yes"][!"sidewalk"]',
        'way["area:highway"="footway"]', 'way["highway"="pedestrian"]["area"="yes"]', 'node["highway"~"^(crossing|elevator)$"]', 'node["entrance"]', 'node["barrier"~"^(gate|bollard|kerb)$"]',
    ]
    return "[out:json][timeout:180];\n(\n" + "".join(f"  {w}{box};\n" for w in wanted) + ");\nout geom;\n"


def posted(spark: SparkSession, url: str, query: str, *, timeout: int = 200) -> DataFrame:
    """``answer``: what a service says to a query that is posted to it, asked for by a task. An answer that
    isn't JSON fails the task."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q in batch["query"]:
                request = Request(url, data=urlencode({"data": q}).encode(), headers={"User-Agent": "pathweave"})
                with urlopen(request, timeout=timeout) as answer:
                    text = answer.read().decode()
                json.loads(text)
                yield pd.DataFrame({"answer": [text]})

    return spark.createDataFrame([(query,)], "query string").coalesce(1).mapInPandas(ask, "answer string")


def answered_elements(answers: DataFrame) -> DataFrame:
    """The elements of ``posted`` map queries, as ``overpass`` gives them."""
    doc = answers.select(F.from_json("answer", f"struct<{schema.OVERPASS.replace(' ', ':', 1)}>").alias("d"))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return doc.select(F.explode("d.elements").alias("x")).select("x.*").withColumn("tags", F.coalesce("tags", nothing))


def register_points(spark: SparkSession, path: str) -> DataFrame:
    """Building records of a register's point layer, with ``x, y`` and their place in the file."""
    doc = spark.read.schema(schema.REGISTER_POINTS).option("multiLine", True).json(path)
    return doc.select(F.posexplode("features").alias("ordinal", "f")).select("ordinal", "f.attributes.*", F.col("f.geometry.x").alias("x"), F.col("f.geometry.y").alias("y"))


def register_shapes(spark: SparkSession, path: str) -> DataFrame:
    """Footprints of a register's polygon layer: attributes, ``part`` and ``ring``, a row for each ring of a shape."""
    doc = spark.read.schema(schema.REGISTER_SHAPES).option("multiLine", True).json(path)
    f = doc.select(F.posexplode("features").alias("ordinal", "f"))
    return f.select("ordinal", "f.attributes.*", F.posexplode_outer("f.geometry.rings").alias("part", "__ring")).withColumn("ring", geo.points(F.col("__ring"))).drop("__ring")


def features(spark: SparkSession, path: str, properties: str, coordinates: str = "array<double>") -> DataFrame:
    """A feature collection: ``ordinal, geometry_type, coordinates`` and the ``properties`` (a DDL list)."""
    shape = f"features array<struct<geometry:struct<type:string,coordinates:{coordinates}>,properties:struct<{properties}>>>"
    doc = spark.read.schema(shape).option("multiLine", True).json(path)
    f = doc.select(F.posexplode("features").alias("ordinal", "f"))
    return f.select("ordinal", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def features_after_prefix(spark: SparkSession, path: str, properties: str, coordinates: str) -> DataFrame:
    """The same of files with anything before the first brace."""
    shape = f"struct<features:array<struct<geometry:struct<type:string,coordinates:{coordinates}>,properties:struct<{properties.replace(' ', ':').replace(',:', ',')}>>>>"
    text = spark.read.option("wholetext", True).text(path)
    doc = text.select(F.from_json(F.regexp_replace("value", r"(?s)\A[^{]*", ""), shape).alias("d"))
    f = doc.select(F.posexplode("d.features").alias("ordinal", "f"))
    return f.select("ordinal", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), "f.properties.*")


def service_area(spark: SparkSession, path: str) -> DataFrame:
    """``ring, box``: the outer rings of a polygon collection's features and their bounds."""
    f = features(spark, path, "name:string", "array<array<array<double>>>")
    return f.select(geo.points(F.col("coordinates")[0]).alias("ring")).withColumn("box", geo.bounds(F.col("ring")))


def tables(spark: SparkSession, folder: str | None = None) -> dict[str, DataFrame]:
    """All authoring tables from Parquet below ``folder``; empty ones with the right columns without it."""
    if folder is None:
        return {name: spark.createDataFrame([], ddl) for name, ddl in schema.TABLES.items()}
    return {name: spark.read.schema(ddl).parquet(f"{folder}/{name}") for name, ddl in schema.TABLES.items()}


def register_views(tables_: dict[str, DataFrame]) -> None:
    for name, df in tables_.items():
        df.createOrReplaceTempView(name)


class _Page(InputPartition):
    def __init__(self, offset: int, last: bool = False):
        self.offset, self.last = offset, last


class PagedFeatures(DataSource):
    """Features of a REST layer: ``spark.read.format("paged_features")``.

    Options: ``url`` of the layer's query, ``where``, ``pageSize``, and ``count``, the number of
    features to expect, by which the pages are asked for side by side. The last page, or the only one
    where no count is given, is followed by others as long as they are full or the answer says that
    it was cut off. An error in an answer fails the task with the service's words.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_features"

    def schema(self) -> str:
        return "offset int, feature string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(self.options)


class _PagedReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.where = options["url"], options.get("where", "1=1")
        self.size, self.count = int(options.get("pageSize", 1000)), int(options.get("count", 1))

    def partitions(self):
        pages = [_Page(o) for o in range(0, max(self.count, 1), self.size)]
        pages[-1].last = True
        return pages

    def read(self, partition):
        offset, more = partition.offset, True
        while more:
            asked = {"where": self.where, "outFields": "*", "outSR": 4326, "f": "json", "resultOffset": offset, "resultRecordCount": self.size}
            with urlopen(f"{self.url}?{urlencode(asked)}", timeout=120) as answer:
                body = json.load(answer)
            if "error" in body:
                raise RuntimeError(f"the service answered with an error: {body['error']}")
            found = body.get("features", [])
            for f in found:
                yield offset, json.dumps(f)
            more = partition.last and bool(found) and (bool(body.get("exceededTransferLimit")) or len(found) == self.size)
            offset += self.size


def epoch_millis(c: Column) -> Column:
    return F.timestamp_millis(c)
