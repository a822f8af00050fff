"""Lines led around footprints: what a round looks at, and geometry within lambdas."""

import random

from pyspark.sql import functions as F

from pathweave.functions import geo
from pathweave.operators import build, spatial


def _line(*points):
    return [{"lon": x * 1e-5, "lat": y * 1e-5} for x, y in points]


def test_a_round_looks_at_the_lines_led_in_the_one_before(spark, monkeypatch):
    box = lambda x: _line((x, 0), (x + 10, 0), (x + 10, 10), (x, 10), (x, 0))
    houses = spark.createDataFrame([(1, box(0)), (2, box(10)), (3, box(60))], f"footprint_id long, ring array<{geo.POINT}>")
    edges = spark.createDataFrame(
        [(1, _line((-20, 5), (100, 5))), (2, _line((5, 5), (100, 5))), (3, _line((-20, 50), (100, 50))), (4, _line((30, 4), (100, 4))), (None, _line((-20, 5), (100, 5)))], f"id long, line array<{geo.POINT}>"
    )
    met = []

    def counted(left, right, *boxes, **options):
        if "edge_id" in left.columns:
            met.append(left.count())
        return spatial.box_join(left, right, *boxes, **options)

    monkeypatch.setattr(build, "box_join", counted)
    led, left = build.around_footprints(edges, houses)
    # 1 is led around the two houses and then around the one apart, 4 around that only
    assert met == [4, 2, 1]
    assert [(r.id, r.reason) for r in left.collect()] == [(2, "runs into the footprint")]
    points = {r.id: r.n for r in led.select("id", F.size("line").alias("n")).collect()}
    assert points[2] == points[3] == points[None] == 2 and points[1] > points[4] > 2
    assert [r.edge_id for r in spatial.piercing(led.filter("id is not null"), houses).select("edge_id").distinct().collect()] == [2]


def test_lambdas_work_their_terms_out_once(spark):
    rng = random.Random(3)
    ring = lambda: (lambda p: [*p, p[0]])([(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(5)])
    rows = [(i, _line(*[(rng.uniform(-9, 18), rng.uniform(-9, 18)) for _ in range(3)]), _line(*ring())) for i in range(60)]
    d = spark.createDataFrame(rows, f"id long, line array<{geo.POINT}>, ring array<{geo.POINT}>")
    inside = geo.length_inside(F.col("line"), F.col("ring"))
    found = {r.id: r.m for r in d.select("id", inside.alias("m")).collect()}
    for i, line, corners in rows:
        plain = 0.0
        for a, b in zip(line, line[1:], strict=False):
            n = 4000
            mids = [((k + 0.5) / n * (b["lon"] - a["lon"]) + a["lon"], (k + 0.5) / n * (b["lat"] - a["lat"]) + a["lat"]) for k in range(n)]
            hit = 0
            for x, y in mids:
                odd = False
                for c, e in zip(corners, corners[1:], strict=False):
                    if (c["lat"] > y) != (e["lat"] > y) and x < (e["lon"] - c["lon"]) * (y - c["lat"]) / (e["lat"] - c["lat"]) + c["lon"]:
                        odd = not odd
                hit += odd
            plain += hit / n * geo.DEGREE_M * ((a["lon"] - b["lon"]) ** 2 + (a["lat"] - b["lat"]) ** 2) ** 0.5
        assert abs(found[i] - plain) < 0.02, i
    # uses of the ring in the plan: its sides are met once and each piece's middle is tested once
    text = d.select(inside.alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("ring#") < 20


def test_cells_are_compiled(spark):
    d = spark.createDataFrame([(1, _line((0, 0), (30, 5))), (2, _line((20, -3), (400, 900)))], f"a long, la array<{geo.POINT}>")
    met = spatial.box_join(d, d.select(F.col("a").alias("b"), F.col("la").alias("lb")), geo.bounds(F.col("la")), geo.bounds(F.col("lb")), 1e-6)
    assert sorted((r.a, r.b) for r in met.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert "lambda" not in met._jdf.queryExecution().optimizedPlan().toString()
