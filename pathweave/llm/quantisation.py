"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned on a bounded sample (``SAMPLE`` vectors): unit vectors are
turned to their principal axes, then rotated so that their signs lose as little as possible
(alternating between signs and the best orthogonal rotation). The vectors are not centred, as
the angle of a pair must be that of its cosine. The signs are binary
codes; several rotations from different starts give a code of any length. The code is cut
into substrings, a hash table each: every pair whose codes differ in fewer bits than there are
tables meets in at least one. The tables' number follows from the substrings' length, which
grows with the logarithm of the number of vectors, and the chance ``miss`` with which a pair
right at the threshold may be overlooked; closer pairs meet more surely.

Every pair that meets is reranked by the cosine of the original vectors, in double precision.
Equal vectors are one class that counts with its size. A bucket is reranked block by block and
gives sums per vector and a spanning forest of its links, never its pairs; a pair that meets
in several tables counts in the first. A bucket of more than ``CHUNK`` classes is dealt out to
a task per pair of chunks.

Cases: a vector that is null, zero, or holds null or non-finite components links with nothing,
nor does one without an id; vectors link with those of their own length only, each length being
searched by itself; rows with equal vectors link with each other; rows that share an id are
vectors of their own, so an id may have several rows in the result; an empty table gives an
empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.tables import deal_buckets, each_group
from pathweave.llm.vectors import dtype_of, lengths, split_usable
from pathweave.operators.components import connected_components
from pathweave.session import cut_lineage, write_and_reread

SAMPLE = 8192
CHUNK = 1024
#: Up to this number of crowded buckets (16 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors divided by a power of two near their largest component each, so that no square overflows
    or vanishes; that changes no digit of a cosine."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1]) if v.size else v


def units(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def learn_rotation(x: np.ndarray, seed: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Origin and projection whose signs are the code of a unit vector, from a sample of unit vectors.

    The origin is zero: from the mean, a pair would be seen under a wider angle than its own.
    """
    mean = np.zeros(x.shape[1])
    centred = x - mean
    _, axes = np.linalg.eigh(centred.T @ centred)
    turned = centred @ axes
    rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((x.shape[1], x.shape[1])))
    for _ in range(rounds):
        signs = np.where(turned @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(turned.T @ signs)
        rotation = u @ w
    return mean, axes @ rotation


def layout(n: int, threshold: float, miss: float) -> tuple[int, int]:
    """Bits of a substring and number of tables for ``n`` vectors."""
    bits = min(30, max(6, math.ceil(math.log2(max(n, 2))) - 4))
    differ = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    meet = (1 - differ) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet))) if meet < 1 else 1


def substrings(x: np.ndarray, models: list[tuple[np.ndarray, np.ndarray]], bits: int, tables: int) -> np.ndarray:
    """The substrings of the codes of unit vectors: a row of ``tables`` integers each."""
    code = np.concatenate([(x - mean) @ rotation >= 0 for mean, rotation in models], axis=1)[:, : bits * tables]
    return code.reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _roots(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest index in each one's component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[p], root[q])
        np.minimum.at(root, p, low)
        np.minimum.at(root, q, low)
        root = root[root]
        if (root == before).all():
            return root


def rerank(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, subs: np.ndarray, side: np.ndarray, table: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one block: the vectors with links, the weight they link to, and a smaller vector they hang together with.

    ``side`` is 0 and 1 for the two chunks, all 0 for a chunk with itself.
    """
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    alone = len(b) == 0
    if alone:
        b = a
    near = x[a] @ x[b].T >= threshold
    if alone:
        near = np.triu(near, 1)
    i, j = np.nonzero(near)
    p, q = a[i], b[j]
    for t in range(table):  # counted in an earlier table
        other = subs[p, t] != subs[q, t]
        p, q = p[other], q[other]
    links = np.bincount(p, weight[q], len(ids)) + np.bincount(q, weight[p], len(ids))
    root = _roots(len(ids), p, q)
    some = np.flatnonzero(links)
    return ids[some], links[some].astype(np.int64), ids[root[some]]


def found_links(classes: DataFrame, dims: int, n: int, threshold: float, miss: float, seed: int) -> DataFrame:
    """``id, links, root`` of ``n`` classes ``(id, weight, v)`` of one length, block by block: the number of
    vectors of other classes that a class was linked with, and a class that it hangs together with."""
    bits, tables = layout(n, threshold, miss)
    stored = dtype_of(classes)
    sample = units(np.array([r["v"] for r in classes.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()], dtype=np.float64))
    models = [learn_rotation(sample, seed + k) for k in range(math.ceil(bits * tables / dims))]
    packed = "<u2" if bits <= 16 else "<u4"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(stored)
                subs = substrings(units(x.astype(np.float64)), models, bits, tables)
                keys = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * tables, pa.array((subs | (np.arange(tables) << 32)).ravel()))
                rest = [pa.array([r.tobytes() for r in z], type=pa.binary()) for z in (x, subs.astype(packed))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *rest, keys], names=["id", "weight", "x", "subs", "keys"])

    coded = classes.select("id", "weight", "v").mapInArrow(code, "id long, weight long, x binary, subs binary, keys array<long>")
    coded = write_and_reread(coded, "vector-codes")
    placed = coded.select(F.explode("keys").alias("key"), "id", "weight", "x", "subs")
    sizes = coded.select(F.explode("keys").alias("key")).groupBy("key").count()

    def work(group: list) -> pa.RecordBatch | None:
        key, _, _, side, ids, weight, x, subs = group
        x = units(np.frombuffer(b"".join(x), dtype=stored).reshape(len(ids), -1).astype(np.float64))
        subs = np.frombuffer(b"".join(subs), dtype=packed).reshape(len(ids), -1)
        found = rerank(np.array(ids), np.array(weight), x, subs, np.array(side), key[0] >> 32, threshold)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["id", "links", "root"]) if len(found[0]) else None

    return deal_buckets(placed, sizes, CHUNK, BROADCAST_ROWS).mapInArrow(each_group(work), "id long, links long, root long")


def links(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, miss: float = 1e-4, seed: int = 17) -> DataFrame:
    """``id, n_links, component_id`` of every row."""
    good, bad = split_usable(rows, id_col, vector_col)
    alone = bad.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    classes = good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight")).withColumn("id", F.monotonically_increasing_id())
    classes = write_and_reread(classes, "vector-classes")  # the numbers hold from here on
    found = None
    for dims, n in lengths(classes):
        if n > 1:
            more = found_links(classes.filter(F.size("v") == dims), dims, n, threshold, miss, seed)
            found = more if found is None else found.union(more)
    per_class = classes.select("v", "id", "rep", "weight")
    if found is None:
        per_class = per_class.select("v", (F.col("weight") - 1).alias("n_links"), F.col("rep").alias("component_id"))
    else:
        found = cut_lineage(found)
        sums = found.groupBy("id").agg(F.sum("links").alias("links"))
        components = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), "a", "b")
        placed = components.select(F.col("node").alias("id"), "component").join(classes.select("id", "rep"), "id")
        smallest = placed.groupBy("component").agg(F.min("rep").alias("least"))
        least = placed.join(smallest, "component").select("id", "least")
        per_class = (
            per_class.join(sums, "id", "left")
            .join(least, "id", "left")
            .select("v", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
        )
    per_class = per_class.withColumnRenamed("v", "cv")
    return good.join(per_class, F.col("v") == F.col("cv")).select("id", "n_links", "component_id").unionByName(alone)
