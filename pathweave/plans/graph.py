"""A walking graph as one object: look-ups, changes, and batch queries over DataFrames."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathweave.functions import cost
from pathweave.operators import cells, gates, report, route, spatial
from pathweave.operators.kept import answered
from pathweave.operators.shortest import both_ways
from pathweave.session import cut_lineage, write_and_reread
from pathweave.sources import readers

KINDS = ("buildings", "nodes", "edges")


class Graph:
    """Buildings, nodes and edges with the columns of the graph document. Changes give a new graph."""

    def __init__(self, buildings: DataFrame, nodes: DataFrame, edges: DataFrame):
        self.buildings, self.nodes, self.edges = buildings, nodes, edges

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        doc = readers.graph_document(spark, path)
        return cls(doc["buildings"], doc["nodes"], doc["edges"])

    def all(self, kind: str) -> DataFrame:
        return getattr(self, kind)

    def get(self, kind: str, id_: str):
        """The entity with that id, or None."""
        return self.all(kind).filter(F.col("id") == id_).first()

    def require(self, kind: str, id_: str):
        found = self.get(kind, id_)
        if found is None:
            raise KeyError(id_)
        return found

    def put(self, kind: str, rows: DataFrame) -> Graph:
        """With ``rows`` added, in place of those with the same ids."""
        merged = self.all(kind).join(rows.select("id"), "id", "left_anti").unionByName(rows)
        return Graph(**{k: merged if k == kind else self.all(k) for k in KINDS})

    def delete(self, kind: str, ids: DataFrame) -> Graph:
        left = self.all(kind).join(ids.select("id"), "id", "left_anti")
        return Graph(**{k: left if k == kind else self.all(k) for k in KINDS})

    def adjacency(self) -> DataFrame:
        """``node, edge_id, other, length_m``, in both directions; edges without both their nodes are left out."""
        ids = self.nodes.select("id")
        e = self.edges.select("id", F.col("fromNodeId").alias("u"), F.col("toNodeId").alias("v"), "lengthM")
        e = e.join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(ids.select(F.col("id").alias("v")), "v", "left_semi")
        return both_ways(e).select(F.col("u").alias("node"), F.col("id").alias("edge_id"), F.col("v").alias("other"), F.col("lengthM").alias("length_m"))

    def nearest_edge(self, points: DataFrame, metres: float = 125.0) -> DataFrame:
        return spatial.nearest_edge(points, self.edges.select("id", F.col("geometry").alias("line")), metres, radii=(25.0,))

    def graph_hash(self) -> str:
        e = self.edges.select("id", F.col("fromNodeId").alias("u"), F.col("toNodeId").alias("v"), F.col("lengthM").alias("m"))
        return report.graph_hash(self.nodes.select("id"), e).first()["graph_hash"]

    def validate(self) -> DataFrame:
        return gates.report(gates.document_gates({"buildings": self.buildings, "nodes": self.nodes, "edges": self.edges}), ("S6", "S7"))

    def routes(self, requests: DataFrame, profile: tuple = cost.DEFAULT_PROFILE, depart: dt.datetime | None = None, closed: DataFrame | None = None) -> DataFrame:
        """Routes of ``requests(request, from_id, to_id)``; ``closed(edge_id)`` are edges that can't be used
        then. A request that only the closures leave without a way fails with ``blocked_by_closure``."""
        spark = requests.sparkSession
        depart = depart or dt.datetime.now(dt.timezone.utc)
        heat = spark.range(1).select(cost.heat_factor(F.lit(depart.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")).cast("double").alias("h")).first()["h"] if profile[4] else 0.0
        buildings = self.buildings.select("id", F.col("inServiceArea").alias("in_area"), F.col("entranceIds").alias("doors"))
        asked = cut_lineage(route.request_status(requests, buildings))
        ids = self.nodes.select("id")
        e = self.edges.withColumns({"u": F.col("fromNodeId"), "v": F.col("toNodeId")})
        e = e.join(ids.select(F.col("id").alias("u")), "u", "left_semi").join(ids.select(F.col("id").alias("v")), "v", "left_semi")
        columns = ["id", "u", "v", "lengthM", "surface", "stairs", "stepCount", "accessible", "shadeIndex"]
        usable = e if closed is None else e.join(closed.select(F.col("edge_id").alias("id")), "id", "left_anti")
        crossings = self.nodes.filter("type = 'crossing'").select("id")
        solved = cut_lineage(route.solve(asked, usable.select(*columns), crossings, profile, heat, cells=lambda: cells.by_place(self.nodes)))
        if closed is not None:
            solved = route.blocked_by_closure(solved, e.select(*columns), crossings, profile)
        hour = (depart - dt.timedelta(hours=7)).hour
        return route.routes(solved, self.edges, self.nodes, self.buildings, profile[0], hour, self.graph_hash())

    def kept_routes(self, path: str, requests: DataFrame, profile: tuple = cost.DEFAULT_PROFILE, depart: dt.datetime | None = None, closed: DataFrame | None = None) -> DataFrame:
        """``routes`` with ``kept``: what the table under ``path`` has for the pair, profile and local hour isn't searched
        again. Another graph, or other closed edges, empty the table."""
        depart = depart or dt.datetime.now(dt.timezone.utc)
        shut = "" if closed is None else report.table_digest(closed.select("edge_id").distinct()).first()["digest"]
        hour, name = (depart - dt.timedelta(hours=7)).hour, profile[0]
        asked = requests.select("request", "from_id", "to_id").withColumns({"profile": F.lit(name), "hour": F.lit(hour)})
        keys = ("from_id", "to_id", "profile", "hour")

        def solve(questions: DataFrame) -> DataFrame:
            numbered = write_and_reread(questions.withColumn("request", F.monotonically_increasing_id()), "kept-numbers")
            return numbered.join(self.routes(numbered.select("request", "from_id", "to_id"), profile, depart, closed), "request").drop("request")

        return answered(path, f"{self.graph_hash()}/{shut}", asked, keys, solve).drop("profile", "hour", "from_id", "to_id")

    def unverified(self, routes: DataFrame) -> DataFrame:
        """``request, unverified``: whether a route uses an edge of unknown accessibility."""
        used = routes.filter("ok").select("request", F.explode("route.edgeIds").alias("id"))
        return used.join(self.edges.select("id", "accessible"), "id").groupBy("request").agg(F.bool_or(F.col("accessible").isNull()).alias("unverified"))


def batch(graph: Graph, pairs: Sequence[tuple[str, str]], **options) -> DataFrame:
    """Routes of a short list of pairs, such as a day's schedule."""
    spark = graph.edges.sparkSession
    return graph.routes(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "request int, from_id string, to_id string"), **options)
