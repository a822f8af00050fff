"""Queries whose figures must hold on tables larger than the driver's smallest ones."""

import random

from pyspark.sql import functions as F

from pathweave.operators import components, spatial
from pathweave.plans.queries import QUERIES


def put(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_parallel_edges_between_far_places(spark, tmp_path):
    rng = random.Random(1)
    rows = [(s, w, float(q)) for s, w in ((59_987, 3), (59_999, 2), (30_001, 38), (359_960, 39), (359_999, 0), (77, 78), (80, 0)) for q in range(1, 51)]
    rng.shuffle(rows)
    d = put(spark, tmp_path, lineitem=(rows, "l_suppkey long, l_partkey long, l_quantity double"))
    found = QUERIES["parallel_edge_ord"](spark, d).collect()
    assert len(found) == len(rows) and all(r.ord == r.q - 1 for r in found)


def test_shapes_beyond_the_first_rows_stay_in_bounds(spark, tmp_path):
    d = put(spark, tmp_path, customer=([(i,) for i in range(90_000)], "c_custkey long"), part=([(i, "bolt", 1 + i % 50) for i in range(0, 90_000, 1000)], "p_partkey long, p_type string, p_size int"))
    found = {r.fault: r.ordinals for r in QUERIES["shape_faults"](spark, d).collect()}
    assert found["vertex out of bounds"] == sum(i for i in range(0, 90_000, 1000) if i % 13 and i % 17 and i % 19 == 0)


def test_component_rounds_keep_estimated_sizes(spark, monkeypatch):
    monkeypatch.setattr(components, "BROADCAST_ROWS", 0)
    found = components.connected_components(spark.range(600).selectExpr("id as src", "id + 1 as dst"))
    assert int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())).bit_length() < 64
    assert found.count() == 601 and found.filter("component <> 0").isEmpty()


def test_joins_by_place_never_broadcast_by_estimate(spark):
    lines = spark.range(50).selectExpr("id as left_id", "named_struct('lon', id / 1e4, 'lat', 0D) as p")
    other = lines.selectExpr("left_id as right_id", "p as q")
    met = spatial.box_join(lines, other, spatial.point_box(F.col("p")), spatial.point_box(F.col("q")))
    assert met.count() == 50 and "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
