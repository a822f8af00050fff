"""Small helpers on tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.session import counted_side as counted_side


def deal_buckets(rows: DataFrame, sizes: DataFrame, chunk: int, most: int, weight: int | None = None) -> DataFrame:
    """``rows(key, id, ...)`` with ``i, j, side``, dealt and sorted by (key, i, j): the members of each
    bucket, so that every two of them are together in one group.

    ``sizes(key, count)`` has the buckets' sizes. One of more than ``chunk`` members is cut into
    chunks of about that size, and each pair of chunks is a group of its own, whose members have
    side 0 or 1; a chunk with itself and a small bucket have side 0 alone. With ``weight``, so are those of
    more than that by their column ``weight``, the sum over their members.
    """
    chunks = F.ceil(F.col("count") / chunk)
    if weight is not None:
        chunks = F.least("count", F.greatest(chunks, F.ceil(F.col("weight") / weight)))
    crowded, n = counted_side(sizes.select("key", chunks.cast("int").alias("chunks")).filter("chunks > 1"), most)
    if n:
        own = F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int")
        d = rows.join(crowded, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", own)
        d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        d = d.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "side": (F.col("own") > F.col("other")).cast("int")})
    else:
        d = rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)})
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return d.select("key", "i", "j", "side", *[c for c in rows.columns if c != "key"]).repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def dealt_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[Sequence]]:
    """The groups of what ``deal_buckets`` has dealt, as lists of column values; those of one row are left out."""
    held: list[list] = []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        places = list(zip(*columns[:3], strict=True))
        edges = [0, *[k for k in range(1, len(places)) if places[k] != places[k - 1]], len(places)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            own = [c[a:b] for c in columns]
            if held and tuple(c[0] for c in held[:3]) == places[a]:
                held = [x + y for x, y in zip(held, own, strict=True)]
                continue
            if held and len(held[0]) > 1:
                yield held
            held = own
    if held and len(held[0]) > 1:
        yield held


def each_group(work: Callable[[list[Sequence]], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on every group of the dealt buckets, for ``mapInArrow``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in dealt_groups(batches):
            out = work(group)
            if out is not None:
                yield out

    return run
