"""Approximate nearest neighbours by navigable small-world graphs, one per shard.

Vectors are dealt into shards by a hash; a shard has an eighth of them, between ``SMALLEST`` and
``LARGEST`` (or what ``CELLS`` numbers hold). Each shard builds its
graph (Malkov and Yashunin 2018) and stores it in one row as flat arrays: ids, vectors, levels
and neighbours, layer after layer, padded with -1. Queries are packed in blocks; a task takes
one block and one shard, walks the graph and rescores what it finds by the cosine of the
original vectors in double precision. The shards' results are merged per query.

Equal vectors are one node with its few smallest ids, as many as a result can show.

Cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do
those without an id; a vector's candidates are those of its own length, each length being
searched by itself; ties go to the smaller id; with fewer candidates than ``k`` all are returned;
rows with equal id and vector are one; rows that share an id with different vectors are candidates
each, and queries each with ranks of its own; none of an id's rows is a candidate of that id; an
empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pathweave.llm.quantisation import scaled, units
from pathweave.llm.vectors import lengths, split_usable
from pathweave.session import cut_lineage, write_and_reread

SMALLEST, LARGEST, CELLS = 2048, 16_384, 16_000_000
BLOCK = 8192
LINKS = 10  # a node's neighbours on upper layers; twice as many on the lowest
BUILD_WIDTH, SEARCH_WIDTH = 48, 192
#: In larger shards a search is as wide as a share of the nodes, so that as many of the nearest are found.
WIDTH_SHARE = 24
#: Queries that walk a graph in step, and nodes that each opens in a step.
TOGETHER, OPENED = 128, 16
INDEX = "shard int, ids array<long>, least array<long>, vectors array<double>, levels array<int>, neighbours array<int>, entry int"


class Graph:
    """A graph over the rows of ``x`` (unit vectors), to build or to search."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, neighbours: np.ndarray | None = None, entry: int = -1):
        self.x, self.levels, self.entry = x.astype(np.float32), levels, entry
        self.order = [np.flatnonzero(levels >= layer) for layer in range(int(levels.max(initial=-1)) + 1)]
        self.row = [np.full(len(x), -1, np.int32) for _ in self.order]
        for row, nodes in zip(self.row, self.order, strict=True):
            row[nodes] = np.arange(len(nodes))
        widths = [2 * LINKS if layer == 0 else LINKS for layer in range(len(self.order))]
        self.tables, at = [], 0
        for nodes, width in zip(self.order, widths, strict=True):
            size = len(nodes) * width
            table = np.full(size, -1, np.int32) if neighbours is None else neighbours[at : at + size]
            self.tables.append(table.reshape(len(nodes), width))
            at += size
        self.seen, self.stamp = np.zeros(len(x), np.int64), 0

    def flat(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in self.tables]) if self.tables else np.zeros(0, np.int32)

    def around(self, node: int, layer: int) -> np.ndarray:
        near = self.tables[layer][self.row[layer][node]]
        return near[near >= 0]

    def walk(self, q: np.ndarray, start: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The ``width`` nearest nodes found from ``start``, nearest first."""
        self.stamp += 1
        seen, stamp, x = self.seen, self.stamp, self.x
        for _, s in start:
            seen[s] = stamp
        open_ = list(start)
        heapq.heapify(open_)
        best = [(-d, s) for d, s in start]
        heapq.heapify(best)
        while open_:
            d, node = heapq.heappop(open_)
            if d > -best[0][0] and len(best) >= width:
                break
            near = self.around(node, layer)
            near = near[seen[near] != stamp]
            if not len(near):
                continue
            seen[near] = stamp
            for dn, n in zip((1.0 - x[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (-dn, n))
                    heapq.heappush(open_, (dn, n))
                elif dn < -best[0][0]:
                    heapq.heapreplace(best, (-dn, n))
                    heapq.heappush(open_, (dn, n))
        return sorted((-d, n) for d, n in best)

    def spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of nodes, nearest first, those nearer to the new one than to any kept before; filled up by the nearest others."""
        nodes = np.array([n for _, n in found])
        between = 1.0 - self.x[nodes] @ self.x[nodes].T
        kept, others, least = [], [], np.full(len(nodes), np.inf, np.float32)  # the distance to the nearest kept one
        for i, (d, _) in enumerate(found):
            if len(kept) < most and least[i] > d:
                kept.append(i)
                np.minimum(least, between[i], out=least)
            else:
                others.append(i)
        return nodes[kept + others[: most - len(kept)]].tolist()

    def insert(self, node: int, top: int) -> None:
        q = self.x[node]
        level = int(self.levels[node])
        at = [(float(1.0 - self.x[self.entry] @ q), self.entry)]
        for layer in range(top, level, -1):
            at = self.walk(q, at[:1], 1, layer)
        for layer in range(min(top, level), -1, -1):
            at = self.walk(q, at, BUILD_WIDTH, layer)
            chosen = self.spread(at, LINKS)
            table, row = self.tables[layer], self.row[layer]
            table[row[node], : len(chosen)] = chosen
            for n in chosen:
                own = table[row[n]]
                free = np.flatnonzero(own < 0)
                if len(free):
                    own[free[0]] = node
                    continue
                around = np.append(own, node)
                d = 1.0 - self.x[around] @ self.x[n]
                order = np.argsort(d, kind="stable")
                own[:] = self.spread(list(zip(d[order].tolist(), around[order].tolist(), strict=True)), len(own))

    def search_all(self, points: np.ndarray, width: int) -> np.ndarray:
        """``search`` for many points in step: a row of the nodes found for each, nearest first, filled up with -1.

        Each step opens the ``OPENED`` nearest unopened nodes of every point whose nearest ``width`` have any, so the
        walk ends as ``walk`` does, when no node that may lead nearer is left."""
        n = len(points)
        if self.entry < 0:
            return np.full((n, width), -1, dtype=np.int64)
        lists = self.tables[0]
        entries = np.full(n, self.entry)
        for layer in range(len(self.tables) - 1, 0, -1):
            entries = np.array([self.walk(q, [(float(1.0 - self.x[e] @ q), int(e))], 1, layer)[0][1] for q, e in zip(points, entries, strict=True)])
        out = np.full((n, width), -1, dtype=np.int64)
        for s in range(0, n, TOGETHER):
            q, some = points[s : s + TOGETHER], entries[s : s + TOGETHER]
            rows = np.arange(len(q))
            nodes, far, shut = np.full((len(q), width), -1), np.full((len(q), width), np.inf, np.float32), np.ones((len(q), width), dtype=bool)
            seen = np.zeros((len(q), len(self.x) + 1), dtype=bool)  # the last column is for places without a node
            nodes[:, 0], far[:, 0], shut[:, 0] = some, 1.0 - (self.x[some] * q).sum(axis=1), False
            seen[rows, some] = seen[:, -1] = True
            while len(rows):
                # rows are in order of distance, so the first unopened ones are the nearest
                at = np.argsort(shut, axis=1, kind="stable")[:, :OPENED]
                live = ~np.take_along_axis(shut, at, axis=1)
                going = live.any(axis=1)
                if not going.all():
                    done = ~going
                    out[s + rows[done]] = nodes[done]
                    rows, q, nodes, far, shut, seen, at, live = (v[going] for v in (rows, q, nodes, far, shut, seen, at, live))
                    if not len(rows):
                        break
                near = np.where(live[:, :, None], lists[np.take_along_axis(nodes, at, axis=1)], -1).reshape(len(rows), -1)
                np.put_along_axis(shut, at, True, axis=1)
                near.sort(axis=1)
                near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
                lane = np.arange(len(rows))[:, None]
                near[seen[lane, near]] = -1
                seen[lane, near] = True
                i, j = np.nonzero(near >= 0)
                d = np.full(near.shape, np.inf, np.float32)
                d[i, j] = 1.0 - np.einsum("nd,nd->n", self.x[near[i, j]], q[i])
                nodes, far, shut = np.concatenate([nodes, near], axis=1), np.concatenate([far, d], axis=1), np.concatenate([shut, near < 0], axis=1)
                order = np.argsort(far, axis=1, kind="stable")[:, :width]
                nodes, far, shut = (np.take_along_axis(v, order, axis=1) for v in (nodes, far, shut))
        return out

    def search(self, q: np.ndarray, width: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [(float(1.0 - self.x[self.entry] @ q), self.entry)]
        for layer in range(len(self.tables) - 1, 0, -1):
            at = self.walk(q, at[:1], 1, layer)
        return self.walk(q, at, width, 0)


def build(x: np.ndarray, seed: int) -> Graph:
    n = len(x)
    draw = np.random.default_rng(seed).random(n)
    levels = np.minimum(np.floor(-np.log(1 - draw) / math.log(LINKS)).astype(np.int32), 8)
    g = Graph(x, levels)
    top = -1
    for node in range(n):
        if g.entry < 0:
            g.entry, top = node, int(levels[node])
            continue
        g.insert(node, top)
        if levels[node] > top:
            g.entry, top = node, int(levels[node])
    return g


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    a, b = scaled(a), scaled(b)
    return float((a * b).sum() / (math.sqrt((a * a).sum()) * math.sqrt((b * b).sum())))


def _candidates(p: np.ndarray, v: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Of nodes those that may be among the ``most`` nearest, by a cosine in double precision that is no farther than 1e-9 from ``cosine``."""
    if len(nodes) <= most:
        return nodes
    close = units(v[nodes]) @ units(p[None])[0]
    return nodes[close >= np.partition(close, -most)[-most] - 1e-9]


def shards_for(n: int, dims: int) -> int:
    """The number of shards of ``n`` vectors."""
    most = max(SMALLEST, min(LARGEST, CELLS // dims))
    return max(1, math.ceil(n / min(most, max(SMALLEST, n // 8))))


def _tasks(n_shards: int) -> int:
    """Partitions that leave most shards one of their own. Shards are far smaller than the work on them, so by their size Spark would put several into a task."""
    return 4 * n_shards


def index(classes: DataFrame, n_shards: int, seed: int = 23) -> DataFrame:
    """A row per shard of ``classes(rep, members, v)``."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["least", "rep"])
        v = np.stack(rows["v"].to_list()).astype(np.float64)
        g = build(units(v), seed)
        return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "ids": [rows["rep"].to_numpy()], "least": [rows["least"].to_numpy()], "vectors": [v.ravel()], "levels": [g.levels], "neighbours": [g.flat()], "entry": [g.entry]})

    shard = F.pmod(F.xxhash64(F.col("members")[0], "v", F.lit(seed)), F.lit(n_shards)).cast("int")
    dealt = classes.select(shard.alias("shard"), "rep", F.col("members")[0].alias("least"), "v").repartition(_tasks(n_shards), "shard")
    return write_and_reread(dealt.groupBy("shard").applyInPandas(run, INDEX), "hnsw-index")


def search(indexed: DataFrame, queries: DataFrame, n_shards: int, n_queries: int, found_per_shard: int) -> DataFrame:
    """``query, rep, score`` of the nearest in every shard for ``queries(query, v)``."""
    blocks = max(1, math.ceil(n_queries / BLOCK))
    packed = queries.groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")).agg(F.collect_list("query").alias("queries"), F.flatten(F.collect_list("v")).alias("points"))
    pairs = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1)))).repartition(_tasks(n_shards), "shard")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids, least = np.asarray(row.ids), np.asarray(row.least)
                v = np.asarray(row.vectors).reshape(len(ids), -1)
                g = Graph(units(v), np.asarray(row.levels), np.asarray(row.neighbours), int(row.entry))
                points = np.asarray(row.points, dtype=np.float64).reshape(len(row.queries), -1)
                out = []
                met = g.search_all(units(points).astype(np.float32), max(SEARCH_WIDTH, len(ids) // WIDTH_SHARE, found_per_shard))
                for query, p, nodes in zip(row.queries, points, met, strict=True):
                    near = [(-cosine(p, v[n]), least[n], ids[n]) for n in _candidates(p, v, nodes[nodes >= 0], found_per_shard)]
                    out += [(query, n, -d) for d, _, n in sorted(near)[:found_per_shard]]
                yield pd.DataFrame(out, columns=["query", "rep", "score"])

    return pairs.join(indexed, "shard").mapInPandas(run, "query long, rep long, score double")


def nearest(rows: DataFrame, is_query: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` nearest other rows of every row for which ``is_query`` (over ``id``) holds."""
    good, _ = split_usable(rows, id_col, vector_col)
    first = W.partitionBy("v").orderBy("id")
    few = good.withColumn("place", F.dense_rank().over(first)).filter(F.col("place") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("members")).withColumn("rep", F.monotonically_increasing_id())
    classes = write_and_reread(classes.select("v", "members", "rep"), "vector-classes")  # the numbers hold from here on
    asked = good.filter(is_query).select("id", "v").join(classes.select(F.col("v").alias("cv"), "rep"), F.col("v") == F.col("cv"))
    asked = cut_lineage(asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query"), "v").dropDuplicates(["query_id", "query"]))
    points = cut_lineage(asked.dropDuplicates(["query"]).select("query", "v"))
    # nodes that hold no other id than the query's are passed over; there is one, unless ids repeat
    own = classes.filter(F.size("members") == 1).groupBy(F.col("members")[0].alias("id")).count().agg(F.max("count").alias("most")).first()["most"]
    wanted = k + (own or 1)
    found = None
    for dims, n in lengths(classes):
        here = points.filter(F.size("v") == dims)
        n_queries = here.count()
        if n_queries:
            n_shards = shards_for(n, dims)
            more = search(index(classes.filter(F.size("v") == dims), n_shards), here, n_shards, n_queries, wanted)
            found = more if found is None else found.union(more)
    if found is None:
        return asked.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("id"), F.lit(0.0).alias("score")).filter(F.lit(False))
    merged = W.partitionBy("query").orderBy(F.desc("score"), "least")
    near = found.join(classes.select("rep", "members", F.col("members")[0].alias("least")), "rep")
    top = near.withColumn("place", F.row_number().over(merged)).filter(F.col("place") <= wanted)
    each = top.select("query", "score", F.explode("members").alias("id"))
    ranked = W.partitionBy("query_id", "query").orderBy(F.desc("score"), "id")
    pairs = asked.select("query_id", "query").join(each, "query").filter("id <> query_id").withColumn("rank", F.row_number().over(ranked))
    return pairs.filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
