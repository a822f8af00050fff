"""Ranked lexical search over shards of documents with variable block-max WAND.

``index`` cuts the documents into shards of bounded size, a row each, with flat posting arrays
of every term (or of the terms that are asked for, so that postings nobody reads are never
made). ``search`` takes the corpus counts from that table and works shard by shard:

* a dynamic program cuts each posting list into blocks of varying length, so that what the
  blocks' maxima overstate, plus a price for each block, is least (Mallia et al. 2017);
* the document ranges between the ends of all blocks of a query's lists are bounded by the sum
  of the maxima of the blocks there. Ranges are taken by falling bound; postings of a range
  are read only while its bound reaches the k-th best score so far, so no result is lost;
* the shards' best are merged.

A term is a maximal run of characters that are neither ASCII marks nor ASCII blanks; only A-Z
are lower-cased. ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` in doubles, the rest is in 64-bit
integers: ``m = 10 + (90 * n * N) div L`` and a document's score is the sum of
``w * ((10^9 * tf) div (1000 * tf + 8 * m))`` over the query's different terms.

Queries are sent to all shards in blocks of at most ``QUERY_TERMS`` terms together (one with more
is a block of its own), each block a pass over the index.

Cases: null and empty texts, or those without a term, are no documents and no queries that find
anything; texts of any length are read whole; equal scores go by ascending id, nulls last; rows
that repeat an id are documents of their own, and repeated queries get results each; empty
tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pathweave.session import write_and_reread

SHARD_DOCS, SHARD_POSTINGS = 16_384, 2_000_000
QUERY_TERMS = 500_000
MEAN_BLOCK = 40  # the length of block whose mean error prices a block
CELLS, REACH = 512, 48  # places where a list can be cut; cells that a block has at most

_KEPT = [c for c in range(256) if chr(c).isalnum() or c >= 0x80]
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in set(_KEPT) else 0x20 for c in range(256))

INDEX = "ids array<long>, lengths binary, terms array<binary>, df array<int>, docs binary, tf binary, n_docs long, n_terms long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


class Shard:
    """A shard that is filled document by document."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.numbers: dict[bytes, int] = {}
        self.term, self.tf, self.sizes = [], [], []
        self.postings = 0

    def add(self, doc_id: int | None, length: int, counts: list[tuple[bytes, int]]) -> None:
        number = self.numbers
        self.ids.append(doc_id)
        self.lengths.append(length)
        self.term.append(np.array([number.setdefault(t, len(number)) for t, _ in counts], dtype=np.int32))
        self.tf.append(np.array([c for _, c in counts], dtype=np.int32))
        self.sizes.append(len(counts))
        self.postings += len(counts)

    def row(self) -> pa.RecordBatch:
        """The shard with its documents by ascending id, lists by term."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        names = sorted(self.numbers)
        rank = np.empty(len(names), np.int32)
        rank[[self.numbers[t] for t in names]] = np.arange(len(names), dtype=np.int32)
        join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int32)
        term, tf, doc = rank[join(self.term)], join(self.tf), np.repeat(place, self.sizes)
        by = np.lexsort((doc, term))
        lengths = np.array(self.lengths, dtype=np.int64)[order]
        df = np.bincount(term, minlength=len(names)).astype(np.int32)
        columns = [[[self.ids[i] for i in order]], [lengths.tobytes()], [names], [df.tolist()], [doc[by].tobytes()], [tf[by].tobytes()], [len(order)], [int(lengths.sum())]]
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in INDEX.split(", ")])


def index(docs: DataFrame, *, asked: frozenset[bytes] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per shard; with ``asked``, postings of these terms only (lengths count all terms)."""
    shared = docs.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, shard = shared.value, Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = terms_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                found = list(counts.items()) if wanted is None else [(t, counts[t]) for t in counts.keys() & wanted]
                shard.add(doc_id.as_py(), len(words), found)
                if len(shard.ids) >= SHARD_DOCS or shard.postings >= SHARD_POSTINGS:
                    yield shard.row()
                    shard = Shard()
        if shard.ids:
            yield shard.row()

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, INDEX)


def blocks(lists: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Where the blocks of each list of scores end (exclusive): of all ways to cut between cells, the
    one with the least sum of block length times block maximum plus the list's price per block."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(lists)
    order = sorted((i for i in range(len(lists)) if len(lists[i])), key=lambda i: len(lists[i]))
    for a in range(0, len(order), 256):
        some = order[a : a + 256]
        cut = [_cells(lists[i]) for i in some]
        wide = max(len(ends) for ends, _ in cut)
        size, high = np.zeros((len(some), wide)), np.zeros((len(some), wide))
        for r, (ends, top) in enumerate(cut):
            size[r, : len(ends)], high[r, : len(ends)] = np.diff(ends, prepend=0), top
        price = np.array([_price(lists[i]) for i in some])
        best = np.zeros((len(some), wide + 1))
        back = np.zeros((len(some), wide + 1), np.int64)
        count, top = np.zeros((len(some), REACH)), np.zeros((len(some), REACH))
        for k in range(wide):  # column j: the block of the last j + 1 cells
            count[:, 1:] = count[:, :-1] + size[:, k, None]
            top[:, 1:] = np.maximum(top[:, :-1], high[:, k, None])
            count[:, 0], top[:, 0] = size[:, k], high[:, k]
            reach = min(REACH, k + 1)
            cost = best[:, k - np.arange(reach)] + count[:, :reach] * top[:, :reach]
            at = cost.argmin(1)
            best[:, k + 1] = cost[np.arange(len(some)), at] + price
            back[:, k + 1] = at + 1
        for r, i in enumerate(some):
            ends, k, taken = cut[r][0], len(cut[r][0]), []
            while k:
                taken.append(ends[k - 1])
                k -= back[r, k]
            out[i] = np.array(taken[::-1], dtype=np.int64)
    return out


def _cells(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends of a list's cells and their maxima; up to ``CELLS`` postings each is a cell."""
    grain = -(-len(scores) // CELLS)
    starts = np.arange(0, len(scores), grain)
    return np.append(starts[1:], len(scores)), np.maximum.reduceat(scores, starts)


def _price(scores: np.ndarray) -> float:
    """What a block costs: the mean error of blocks of ``MEAN_BLOCK`` postings."""
    starts = np.arange(0, len(scores), MEAN_BLOCK)
    lengths = np.diff(np.append(starts, len(scores)))
    return float((np.maximum.reduceat(scores, starts) * lengths - np.add.reduceat(scores, starts)).mean()) + 1.0


class Lists:
    """The posting lists of a shard, each with its scores and blocks."""

    def __init__(self, docs: list[np.ndarray], scores: list[np.ndarray], n_docs: int):
        self.docs, self.scores, self.n_docs = docs, scores, n_docs
        self.first, self.stop, self.most = [], [], []
        for d, s, ends in zip(docs, scores, blocks(scores), strict=True):
            starts = np.append(0, ends[:-1]) if len(ends) else ends
            self.first.append(d[starts])
            self.stop.append(d[ends - 1] + 1)
            self.most.append(np.maximum.reduceat(s, starts) if len(ends) else s[:0])
        self.read = 0  # postings read so far

    def ranges(self, chosen: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First document, end and bound of the ranges between block ends where ``chosen`` lists have blocks."""
        at = np.concatenate([x for i in chosen for x in (self.first[i], self.stop[i])])
        step = np.concatenate([x for i in chosen for x in (self.most[i], -self.most[i])])
        by = np.argsort(at, kind="stable")
        at, bound = at[by], np.cumsum(step[by])
        last = np.flatnonzero(np.append(at[1:] != at[:-1], False))  # the last change at a place has the sum
        edges = np.append(at[last], at[-1])
        bound = bound[last]
        live = bound > 0
        return edges[:-1][live], edges[1:][live], bound[live]

    def best(self, chosen: Sequence[int], k: int) -> list[tuple[int, int]]:
        """``(document, score)`` of the ``k`` best by score, then by document."""
        if not chosen:
            return []
        begin, end, bound = self.ranges(chosen)
        by = np.argsort(-bound, kind="stable")
        begin, end, bound = begin[by], end[by], bound[by]
        total, least, at, step = np.zeros(self.n_docs, np.int64), 1, 0, 4 * k
        reached = np.cumsum(end - begin)
        while at < len(bound) and bound[at] >= least:
            # the next ranges by bound, of about ``step`` documents together
            upto = int(np.searchsorted(reached, (reached[at - 1] if at else 0) + step)) + 1
            upto = min(upto, at + int(np.searchsorted(-bound[at:], -least, side="right")))
            order = np.argsort(begin[at:upto])
            a, b = begin[at:upto][order], end[at:upto][order]
            for i in chosen:
                d = self.docs[i]
                lo, hi = np.searchsorted(d, a), np.searchsorted(d, b)
                n = hi - lo
                here = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                total[d[here]] += self.scores[i][here]
                self.read += len(here)
            if self.n_docs > k:
                least = max(1, int(np.partition(total, -k)[-k]))
            at, step = upto, 4 * step
        top = np.flatnonzero(total >= least)
        top = top[np.lexsort((top, -total[top]))][:k]
        return list(zip(top.tolist(), total[top].tolist(), strict=True))


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def search(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text: str = "text", k: int = 10) -> DataFrame:
    """``query_id, rank, id, score``: the ``k`` best documents of each row of ``queries``."""
    asked = queries.select(F.col(query_col).cast("long").alias("q"), F.col(query_text).alias("t"))
    size = asked.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    passes = max(1, math.ceil(size / 2 / QUERY_TERMS))  # a term and what follows it have two bytes or more
    part = F.pmod(F.xxhash64("q", "t"), F.lit(passes))
    found, before = None, 0
    for p in range(passes):
        rows = [(r["q"], sorted(set(terms_of(r["t"])))) for r in asked.filter(part == p).collect()]
        more = _search_block(docs, rows, before, id_col, text_col, k)
        before += len(rows)
        found = more if found is None else found.unionByName(more)
    ranked = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "score")


def _search_block(docs: DataFrame, rows: list[tuple[int | None, list[bytes]]], before: int, id_col: str, text_col: str, k: int) -> DataFrame:
    """``query, query_id, id, score``: the ``k`` best of each shard, for the queries numbered from ``before``."""
    spark = docs.sparkSession
    wanted = frozenset(t for _, terms in rows for t in terms)
    shards = write_and_reread(index(docs, asked=wanted, id_col=id_col, text_col=text_col), "search-index")
    n, total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    counted = shards.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("t")).agg(F.sum("x.df").alias("df"))
    weights = {bytes(r["t"]): weight(n, r["df"]) for r in counted.collect()}  # of terms of this block of queries only
    shared = spark.sparkContext.broadcast(([[t for t in terms if t in weights] for _, terms in rows], weights))
    ids = [q for q, _ in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weights = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, lengths, terms, df, at, tf = (batch.column(c)[row] for c in range(6))
                bounds = np.cumsum(df.values.to_numpy(zero_copy_only=False).astype(np.int64))[:-1]
                names = terms.values.to_pylist()
                n_terms = np.frombuffer(lengths.as_buffer(), dtype=np.int64)
                m = 10 + (90 * n_terms * n) // total
                at, tf = np.frombuffer(at.as_buffer(), dtype=np.int32), np.frombuffer(tf.as_buffer(), dtype=np.int32).astype(np.int64)
                share = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
                lists = Lists(np.split(at, bounds), [s * weights[t] for s, t in zip(np.split(share, bounds), names, strict=True)], len(n_terms)) if names else None
                number = {t: i for i, t in enumerate(names)}
                out = []
                for q, own in enumerate(queries):
                    chosen = [number[t] for t in own if t in number]
                    out += [(q, d, s) for d, s in lists.best(chosen, k)] if chosen else []
                if out:
                    q, d, s = zip(*out, strict=True)
                    named = doc_ids.values.take(pa.array(d, type=pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array([before + x for x in q], type=pa.int64()), pa.array([ids[x] for x in q], type=pa.int64()), named, pa.array(s, type=pa.int64())], names=["query", "query_id", "id", "score"])

    one_each = shards.select("ids", "lengths", "terms", "df", "docs", "tf")
    return one_each.mapInArrow(run, "query long, query_id long, id long, score long")
