"""Connected components of an edge list, by alternating star operations.

Each round joins every node's larger neighbours to the smallest id around it, then its smaller
ones; the edges end as stars around the smallest id of each component. A round costs shuffles
of the edges only; the number of rounds grows with the logarithm of the size of components.
Every round is written as a table, so plans and their estimated sizes stay short and a lost executor costs no earlier round.

A star's centre has as many edges as its component has nodes. Its smallest neighbour comes from
partial minima; it meets the edges again by broadcast while the counted edges bound the nodes, and
else by a join of two plain shuffles, whose skewed partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.session import write_and_reread

#: Up to this number of nodes (16 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Edges to a file of a round's table, and the least number of files: a round of few edges leaves few files.
FILE_ROWS, LEAST_FILES = 50_000, 16


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``node, component`` (the smallest id of its component) of every node with an edge to another.

    Nulls and self-loops are left out.
    """
    e = edges.select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b")).filter((F.col("a") > F.col("b")) & F.col(src).isNotNull() & F.col(dst).isNotNull())
    e = write_and_reread(e.distinct(), "components")
    known = _signature(e)
    for _ in range(max_rounds):
        # edges have two nodes at most
        met = F.broadcast if 2 * known[0] <= BROADCAST_ROWS else lambda d: write_and_reread(d, "components-least").hint("merge")
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        smallest = met(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))
        large = both.filter("v > u").join(smallest, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        lowest = met(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(lowest, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # a round never has more edges than the one before
        e = write_and_reread(small.union(lowest.select("a", F.col("m").alias("b"))).distinct().coalesce(max(LEAST_FILES, -(-known[0] // FILE_ROWS))), "components")
        now = _signature(e)
        if now == known:
            break
        known = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
