"""Concave hulls of known sets."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from pathweave.functions import geo
from pathweave.operators import shapes

STEP = 60.0 / geo.DEGREE_M


def grid(cells, source=1):
    """A point in the middle of each cell, near the equator so that cells are square."""
    from math import cos, radians

    wide = STEP / cos(radians(0.5))
    return [(source, {"lon": (x + 0.5) * wide, "lat": (y + 0.5) * STEP}) for x, y in cells]


def hulls(spark, rows):
    d = spark.createDataFrame(rows, f"source long, p {geo.POINT}")
    found = defaultdict(list)
    for r in shapes.concave_hulls(d).collect():
        found[r.source].append((r.outer, round(r.area_m2 / 3600, 6), len(r.ring) - 1, r.ring[0] == r.ring[-1]))
    return {k: sorted(v) for k, v in found.items()}


def test_known_shapes(spark):
    square = [(x, y) for x in range(4) for y in range(3)]
    rows = grid(square) + grid([*square, (0, 0)], 1)
    rows += grid([c for c in [(x, y) for x in range(5) for y in range(5)] if c not in ((2, 2), (3, 3))], 2)  # two holes that touch at a corner
    rows += grid([(0, 0), (1, 1), (5, 5)], 3)  # two cells that touch at a corner, one apart
    rows += grid([(0, 0), (1, 0), (2, 0), (0, 1), (2, 1)], 4)  # a bay
    got = hulls(spark, rows)
    assert got[1] == [(True, 12.0, 4, True)]
    assert got[2] == [(False, -2.0, 8, True), (True, 25.0, 4, True)] or got[2] == [(False, -1.0, 4, True), (False, -1.0, 4, True), (True, 25.0, 4, True)]
    assert got[3] == [(True, 1.0, 4, True)] * 3
    assert got[4] == [(True, 5.0, 8, True)]


def test_areas_of_random_sets(spark):
    rng = random.Random(2)
    cells = {s: {(rng.randrange(14), rng.randrange(14)) for _ in range(90)} for s in range(4)}
    got = hulls(spark, [r for s, c in cells.items() for r in grid(c, s)])
    for s, c in cells.items():
        assert round(sum(x[1] for x in got[s]), 6) == len(c) and all(x[3] for x in got[s])


def test_no_points(spark):
    assert hulls(spark, []) == {}


def test_rings_are_simple_borders(spark):
    d = spark.createDataFrame(grid([(0, 0), (1, 0), (1, 1)]), f"source long, p {geo.POINT}")
    (r,) = shapes.concave_hulls(d).select("ring", geo.square_metres(F.col("ring")).alias("m2")).collect()
    assert len(r.ring) == 7 and abs(r.m2 / 3600 - 3) < 0.01
