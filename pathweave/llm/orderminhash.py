"""Near-duplicates by Order MinHash, verified by banded alignment.

A text is its lower-case words. Its k-mers (``K`` words, labelled by how many times they have
occurred before) are ranked by each of ``SKETCHES`` hash functions; the ``ELL`` smallest, in
the order in which they stand in the text, make that function's sketch. Two texts share a
sketch the more likely the closer they are in edit distance, as order counts. Texts that share
a sketch are candidates, and the words of both are aligned in a band as wide as the distance
that ``similarity`` (1 - distance / longer length) leaves.

Texts with the same words are one class, found by a digest. Classes are looked up by their
sketches. Each bucket's members are first compared with one of them, then with another, which
joins groups of near copies, however large, by as many comparisons as they have members. Only
pairs of a bucket that are still in different components are left then. They are sorted out by
their lengths and by ``BINS`` counts of hashed words, whose difference is at most the edit
distance, and the others are aligned inside the bucket's task, the nearest first, until its
members have come together or all their pairs have been looked at. So no link between components
is lost, and no pairs are written out.

Sketches are of two-word k-mers, as edits that lie apart leave no longer ones: a text of words all
different with every fifth one changed keeps 0.43 of the labelled k-mers of both, and two texts that have a share J
meet with probability ``1 - (1 - J^3)^48``, which is 0.98 there and more wherever edits are fewer or closer together
(over 0.9999999 at a similarity of 0.8 in five-word shingles). Pairs of up to ``SHORT`` words are found without
chance: of the pieces into which d edits cut the longer text one is whole and has ``(m - d) // (d + 1)`` words or more, so both
are looked up by all their k-mers of that length. Blocks that have changed places count as edits.

With ``scattered=True`` a last step, which costs several times the rest and pairs the members of
k-mers one by one, compares those too: texts of m words at most d edits apart have at least ``t = m - k + 1 - k d`` labelled
k-mers in common, so in one order of all k-mers they share some (a quarter, at least ``MEET``)
among the first of each (a prefix filter). The order puts k-mers that are frequent in a sample last
and decides cost only; ``k`` is 3, or less where a short text would have nothing in common by this
count. Where they share more than ``DRAWN`` by this, only k-mers with a hash below a rate are
looked up, such that ``DRAWN`` shared ones are to be expected; pairs with ``ENOUGH`` of them are
aligned. That fewer come up has a chance of 1e-7 for a pair right at the threshold, and none
for texts below some 250 words.

Cases: null text is empty, and empty texts are one class; texts of a single word have
one k-mer, that word; a document without an id is in no class; rows with the same id are
compared by their own texts, and the id is in the smallest of their groups; an empty table gives an
empty result; texts are read whole whatever their length; only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.tables import counted_side, deal_buckets, each_group
from pathweave.operators.components import connected_components
from pathweave.session import cut_lineage, write_and_reread

K, ELL, SKETCHES = 2, 3, 48
#: Pairs whose longer text has so many words at most share a k-mer for certain.
SHORT = 29
WORDS_KEPT = 150_000
#: Up to this number of ids (8 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Words of a k-mer of the last step; documents from which its frequent ones are learned, and how many are kept.
GRAM, GRAM_DOCS, GRAMS_KEPT = 3, 4096, 100_000
#: Shared first k-mers that are asked for, where similar texts have so many.
MEET = 8
#: Shared k-mers to be expected of those that are drawn, and how many are asked for then.
DRAWN, ENOUGH = 24, 4
#: Members of a bucket that one task compares; larger buckets are dealt out.
PAIR_CHUNK = 2048
#: Words of a bucket's texts that one task holds, or those of two texts.
WORDS_CHUNK = 2_000_000
#: Counts of hashed words by which pairs are sorted out before their texts are read.
BINS = 256
#: A k-mer in one of so many texts of the sample is known to be shared.
COMMON = 64

_ODD = np.array([np.uint64(2 * int(x) + 1) for x in np.random.default_rng(101).integers(0, 2**63 - 1, SKETCHES)], dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash; emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


_words = _Words()


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_hashes(tokens: Sequence[str]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, tokens), dtype=np.uint64, count=len(tokens))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def kmers(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """A hash for each occurrence-labelled k-mer; a text of fewer than k words is one k-mer."""
    n = len(hashes) - k + 1
    if n < 1:
        k, n = len(hashes), min(1, len(hashes))
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * _STEP + hashes[i : i + n]
    out = _mixed(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    new = np.ones(n, dtype=bool)
    new[1:] = ranked[1:] != ranked[:-1]
    if not new.all():
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        label = np.empty(n, dtype=np.uint64)
        label[order] = np.arange(n) - first
        # a first occurrence is the same whether or not others repeat
        out = np.where(label > 0, _mixed(out + label * np.uint64(0xD6E8FEB86659FD93)), out)
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The keys under which a text is looked up, as signed 64-bit integers."""
    grams = kmers(hashes)
    if not len(grams):
        return np.zeros(0, dtype=np.int64)
    if len(grams) <= ELL:  # every function picks all of them
        at = np.arange(len(grams))[None, :]
    else:
        ranks = grams[None, :] * _ODD[:, None]
        at = np.sort(np.argpartition(ranks, ELL - 1, axis=1)[:, :ELL], axis=1)
    picked = grams[at]
    keys = np.arange(len(at), dtype=np.uint64)
    for i in range(at.shape[1]):
        keys = _mixed(keys * _STEP + picked[:, i])
    return keys.view(np.int64)


@lru_cache(maxsize=1000)
def whole_pieces(n: int, similarity: float) -> tuple[int, ...]:
    """The lengths of k-mers by which a short text of ``n`` words meets all similar ones."""
    longer = [(m, d) for m in range(n, SHORT + 1) if (d := edits(m, similarity)) and m - d <= n]
    return tuple(sorted({k for m, d in longer if (k := (m - d) // (d + 1))}))


def looked_up(hashes: np.ndarray, similarity: float) -> np.ndarray:
    """The keys of a text: its sketches, then those that short texts are certain to share."""
    keys = sketch(hashes)
    for k in whole_pieces(len(hashes), similarity) if len(hashes) <= SHORT else ():
        out = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            out = out * _STEP + hashes[i : i + len(out)]
        keys = np.append(keys, np.unique(_mixed(out)).view(np.int64))
    return keys


def distance_within(a: Sequence[str], b: Sequence[str], limit: int) -> int | None:
    """The edit distance of two word lists, or None if it is above ``limit``.

    Bands of growing width are tried, so close lists cost little.
    """
    if abs(len(a) - len(b)) > limit:
        return None
    begin, most = 0, min(len(a), len(b))
    while begin < most and a[begin] == b[begin]:
        begin += 1
    end = 0
    while end < most - begin and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[begin : len(a) - end], b[begin : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    bag = Counter(a)
    bag.subtract(b)  # what is left over on either side has to be changed
    if max(sum(v for v in bag.values() if v > 0), -sum(v for v in bag.values() if v < 0)) > limit:
        return None
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    width = max(8, abs(len(a) - len(b)))
    while True:
        width = min(width, limit)
        d = _banded(places, len(a), b, width)
        if d <= width:
            return d
        if width == limit:
            return None
        width *= 4


def _banded(places: dict[str, int], m: int, b: Sequence[str], k: int) -> int:
    """Edit distance if it is at most ``k``, else something above, by bit-parallel alignment
    (Myers 1999; Hyyro 2003) of the cells within ``k`` of the main diagonal.

    Bit t of a column's vectors is row j - k + t. ``up`` and ``down`` are the rows whose value
    is one more or one less than the row above; ``same`` are those equal to the diagonal.
    """
    k = max(k, abs(m - len(b)))
    full = (1 << 2 * k + 1) - 1
    up, down = (full >> k) << k, 0
    value = min(k, m)  # of cell (j + k, j) while there is such a row, then of cell (m, j)
    for j, w in enumerate(b, 1):
        at = places.get(w, 0)
        shift = j - k - 1
        equal = (at >> shift if shift >= 0 else at << -shift) & full
        same = ((((equal & up) + up) ^ up) | equal | down) & full
        right = (down | ~(same | up)) & full
        left = same & up
        row = m - j + k
        if row >= 2 * k:
            value += not same >> 2 * k & 1
        else:
            value += (right >> row & 1) - (left >> row & 1)
        up = (left | ~((same >> 1) | right)) & full
        down = (same >> 1) & right
    return value


def similar(a: str | None, b: str | None, similarity: float) -> bool:
    x, y = words(a), words(b)
    longer = max(len(x), len(y))
    return longer == 0 or distance_within(x, y, int(longer * (1 - similarity) + 1e-9)) is not None


def counts_of(hashes: np.ndarray) -> bytes:
    """How many words fall into each of ``BINS`` classes, 255 at most."""
    return np.minimum(np.bincount((hashes >> np.uint64(40)).astype(np.int64) % BINS, minlength=BINS), 255).astype(np.uint8).tobytes()


def sketched(docs: DataFrame, similarity: float, scattered: bool) -> DataFrame:
    """``doc, th, digest, n, keys, bins, grams, common`` of every row of ``docs(doc, th, text)``.

    ``grams`` are the k-mers of the last step, ``common`` those of them that many texts have; both are
    empty unless ``scattered``.
    """
    frequent = _frequent(docs) if scattered else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = frequent.value if frequent else (None, None)
        hot = known[counts > max(2, GRAM_DOCS // COMMON)] if frequent else None
        nothing = np.zeros(0, dtype=np.uint64)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.iloc[a : a + 500]
                rows = [word_hashes(words(t)) for t in part["text"]]
                first = [prefix(r, similarity, known, counts) if frequent else nothing for r in rows]
                shared = [np.isin(f, hot) if frequent else np.zeros(0, dtype=bool) for f in first]
                yield pd.DataFrame(
                    {
                        "doc": part["doc"].to_numpy(),
                        "th": part["th"].to_numpy(),
                        "digest": [xxhash.xxh128_digest(r.tobytes()) for r in rows],
                        "n": [len(r) for r in rows],
                        "keys": [looked_up(r, similarity) for r in rows],
                        "bins": [counts_of(r) for r in rows],
                        "grams": [f[~s].view(np.int64) for f, s in zip(first, shared, strict=True)],
                        "common": [f[s].view(np.int64) for f, s in zip(first, shared, strict=True)],
                    }
                )

    return docs.mapInPandas(run, "doc long, th long, digest binary, n int, keys array<long>, bins binary, grams array<long>, common array<long>")


def _frequent(docs: DataFrame) -> Broadcast:
    """Frequent k-mers of a sample and their counts, by k-mer."""
    spark = docs.sparkSession
    share = max(1, -(-docs.count() // GRAM_DOCS))

    def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["text"]:
                h = word_hashes(words(t))
                yield pd.DataFrame({"gram": np.unique(np.concatenate([kmers(h, k) for k in range(1, GRAM + 1)])).view(np.int64)})

    drawn = docs.filter(F.pmod(F.xxhash64("doc"), F.lit(share)) == 0).limit(2 * GRAM_DOCS).mapInPandas(learned, "gram long")
    top = drawn.groupBy("gram").count().filter("count > 1").orderBy(F.desc("count"), "gram").limit(GRAMS_KEPT).toPandas()
    grams = top["gram"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(grams)
    return spark.sparkContext.broadcast((grams[order], top["count"].to_numpy(dtype=np.int64)[order]))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The rows of ``pairs(a, b)`` whose texts are similar. ``b`` is joined last: one ``a`` may have many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(x, y, similarity) for x, y in zip(batch["a_text"], batch["b_text"], strict=True)]
            yield batch.loc[good, ["a", "b"]]

    a = texts.select(F.col("id").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("b_text"))
    return pairs.select("a", "b").join(a, "a").join(b, "b").mapInPandas(run, "a long, b long")


def compared(group: list, similarity: float) -> pa.RecordBatch | None:
    """Links that join the components within one bucket. Every pair of its members in different
    components is looked at, the nearest by their counts first, unless the two have met in a bucket of an
    earlier function; those that lengths and counts allow are aligned, and members that come together
    on the way aren't compared again."""
    key, _, _, side, ids, component, n, keys, bins, texts = group
    # texts of at most ELL k-mers have one sketch only; what short texts have behind their sketches isn't in order
    own = [k[: SKETCHES if m - K + 1 > ELL else 1] for k, m in zip(keys, n, strict=True)]
    sketches = np.array([list(k) + [0] * (SKETCHES - len(k)) for k in own], dtype=np.int64)
    table = int(np.argmax(sketches[0] == key[0]))
    n, side = np.array(n), np.array(side)
    counts = np.frombuffer(b"".join(bins), dtype=np.uint8).reshape(len(ids), BINS).astype(np.int16)
    _, root = np.unique(component, return_inverse=True)
    alone = not side.any()
    b = np.flatnonzero(side == 1)
    tokens = lru_cache(maxsize=256)(lambda i: words(texts[i]))
    found: list[tuple[int, int]] = []
    for x in np.flatnonzero(side == 0).tolist():
        y = np.arange(x + 1, len(ids)) if alone else b
        y = y[root[y] != root[x]]
        limit = np.floor(np.maximum(n[y], n[x]) * (1 - similarity) + 1e-9).astype(np.int64)
        fits = (np.abs(n[y] - n[x]) <= limit) & ~(sketches[y, :table] == sketches[x, :table]).any(axis=1)
        y, limit = y[fits], limit[fits]
        if not len(y):
            continue
        differ = counts[y] - counts[x]
        apart = np.maximum(np.maximum(differ, 0).sum(axis=1), np.maximum(-differ, 0).sum(axis=1))
        may = np.flatnonzero(apart <= limit)
        for i in may[np.argsort(apart[may], kind="stable")].tolist():
            other = int(y[i])
            if root[other] != root[x] and distance_within(tokens(x), tokens(other), int(limit[i])) is not None:
                found.append((ids[x], ids[other]))
                root[root == root[other]] = root[x]
    if not found:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])


def edits(n: int, similarity: float) -> int:
    return int(n * (1 - similarity) + 1e-9)


@lru_cache(maxsize=100_000)
def must_share(m: int, similarity: float) -> tuple[int, int] | None:
    """The largest k for which a text of ``m`` words and a similar one, not longer, have k-mers in
    common, and how many at least; None if they must be equal."""
    d = edits(m, similarity)
    return next(((k, t) for k in range(GRAM, 0, -1) if (t := m - k + 1 - k * d) >= 1), None) if d else None


def met(t: int) -> int:
    """How many of at least ``t`` common k-mers are common to the first ones of both texts."""
    return min(t, max(MEET, t // 4))


def rate(t: int) -> float:
    """The share of k-mers that is drawn where ``t`` are common."""
    return min(1.0, DRAWN / met(t))


def asked(m: int, similarity: float) -> int:
    """How many looked-up k-mers a text of ``m`` words and a similar one, not longer, have in common."""
    share = must_share(m, similarity)
    if share is None:
        return m + 1
    return min(met(share[1]), MEET) if rate(share[1]) == 1.0 else ENOUGH


@lru_cache(maxsize=100_000)
def prefix_lengths(n: int, similarity: float) -> tuple[tuple[int, int, float], ...]:
    """``(k, number of first k-mers, share that is drawn)`` by which a text of ``n`` words meets all similar ones.

    A pair goes by the k of its longer text, of m words.
    """
    spare: dict[int, tuple[int, float]] = {}
    m = n
    while m - edits(m, similarity) <= n:
        share = must_share(m, similarity)
        if share and n >= share[0]:
            k, t = share
            left, drawn = spare.get(k, (m, 0.0))
            spare[k] = (min(left, t - met(t)), max(drawn, rate(t)))
        m += 1
    return tuple((k, n - k + 1 - left, drawn) for k, (left, drawn) in spare.items())


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The k-mers under which a text is looked up in the last step."""
    out = [np.zeros(0, dtype=np.uint64)]
    for k, most, drawn in prefix_lengths(len(hashes), similarity):
        grams = kmers(hashes, k)
        count = np.zeros(len(grams), dtype=np.int64)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
            count = np.where(frequent[at] == grams, counts[at], 0)
        if most < len(grams):
            grams = grams[np.lexsort((grams, count))[:most]]
        out.append(grams if drawn == 1.0 else grams[_mixed(grams * _STEP) < np.uint64(int(drawn * 2.0**64))])
    return np.concatenate(out)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, id`` of the keys of two or more texts, from rows in order of their key; a row is held at most."""
    none = np.zeros(0, dtype=np.int64)
    last_key, last_id, waiting = none, none, False  # waiting: the last key has come once only
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, ids = (c.to_numpy() for c in batch.columns)
        again = bool(len(last_key)) and keys[0] == last_key[0]
        same = keys[1:] == keys[:-1]
        several = np.append(again, same) | np.append(same, False)
        held_back = not several[-1]  # whether it is shared shows in the next batch
        if again and waiting:
            keys_out, ids_out = np.append(last_key, keys[several]), np.append(last_id, ids[several])
        else:
            keys_out, ids_out = keys[several], ids[several]
        last_key, last_id, waiting = keys[-1:], ids[-1:], held_back
        yield pa.RecordBatch.from_arrays([pa.array(keys_out), pa.array(ids_out)], names=["key", "id"])


def unmet_pairs(sk: DataFrame, one: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: all pairs of texts in different components that may be similar by their first k-mers.

    ``sk`` has ``doc, th, grams, common``, ``one(doc, th, id, n, component)`` a row for each distinct text.
    """
    spark = sk.sparkSession
    one, _ = counted_side(one, BROADCAST_ROWS)
    mine = sk.join(one.select("doc", "th", "id"), ["doc", "th"])
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = mine.select(F.explode("grams").alias("key"), "id").repartition(parts, "key").sortWithinPartitions("key")
    rows = dealt.mapInArrow(meetings, "key long, id long").union(mine.select(F.explode("common").alias("key"), "id"))
    placed = write_and_reread(rows.join(one.select("id", "component", "n"), "id").select("key", "id", "component", "n"), "order-minhash-placed")
    mixed = placed.groupBy("key").agg(F.count("*").alias("count"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key", "count")
    mixed = cut_lineage(mixed)

    def pair(group: list) -> pa.RecordBatch | None:
        side, ids, root, n = (np.array(c) for c in group[3:])
        need = {m: asked(m, similarity) for m in set(n.tolist())}
        need = np.array([need[m] for m in n.tolist()])
        a, b = (side == 0).nonzero()[0], (side == 1).nonzero()[0]
        alone = len(b) == 0 and not side.any()
        found = []
        for x in a.tolist():
            y = np.arange(x + 1, len(ids)) if alone else b
            y = y[(root[y] != root[x]) & (np.abs(n[y] - n[x]) <= np.floor(np.maximum(n[y], n[x]) * (1 - similarity) + 1e-9))]
            found.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), np.where(n[y] > n[x], need[y], need[x])))
        if not sum(len(f[0]) for f in found):
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in (0, 1, 2)], names=["a", "b", "need"])

    members = placed.join(mixed.select("key"), "key", "left_semi").select("key", "id", "component", "n")
    return deal_buckets(members, mixed, PAIR_CHUNK, BROADCAST_ROWS).mapInArrow(each_group(pair), "a long, b long, need long").groupBy("a", "b", "need").count().filter("count >= need").select("a", "b")


def documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc, th, text``: the id, by which and by the text's hash a row is found again."""
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")
    return d.select("doc", F.xxhash64("text").alias("th"), "text")


def groups(d: DataFrame, similarity: float, scattered: bool) -> DataFrame:
    """``doc, th, first_doc, first_th`` of every row of ``documents``: the row with the smallest id of its group."""
    sk = write_and_reread(sketched(d, similarity, scattered), "order-minhash")
    # texts with the same words are one class, with a number of its own
    one = sk.groupBy("digest").agg(F.min(F.struct("doc", "th", "n", "keys")).alias("s")).select("digest", "s.*")
    one = write_and_reread(one.withColumn("id", F.monotonically_increasing_id()), "order-minhash-classes")
    # most keys are of one text only: they go by one shuffle of keys and ids
    parts = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = one.select(F.explode("keys").alias("key"), "id").repartition(parts, "key").sortWithinPartitions("key")
    several = cut_lineage(keyed.mapInArrow(meetings, "key long, id long"))
    centres = several.groupBy("key").agg(F.min("id").alias("first"), F.max_by("id", F.xxhash64("id", "key")).alias("other"))
    rows = cut_lineage(several.join(centres, "key").join(one.select("id", "n"), "id"))
    fits = lambda x, y: F.least(x, y) >= F.lit(similarity) * F.greatest(x, y)

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        held, _ = counted_side(one.select("doc", "th", "id").join(ids.distinct(), "id", "left_semi"), BROADCAST_ROWS)
        return write_and_reread(d.join(held, ["doc", "th"]).dropDuplicates(["id"]).select("id", "text"), name)

    texts = texts_of(rows.select("id"), "order-minhash-texts")
    lengths = rows.select("id", "n").distinct()

    def star(found: DataFrame | None, centre: str) -> DataFrame:
        """Links between the members of each bucket and its ``centre``, if not in one component."""
        p = rows.select(F.col(centre).alias("a"), F.col("id").alias("b"), F.col("n").alias("b_n")).filter("a <> b").distinct()
        p = p.join(lengths.select(F.col("id").alias("a"), F.col("n").alias("a_n")), "a").filter(fits(F.col("a_n"), F.col("b_n")))
        return joined(p if found is None else apart(p, found), found)

    def joined(pairs: DataFrame, found: DataFrame | None) -> DataFrame:
        """``found`` with the links of those ``pairs`` that are similar."""
        links = verified(pairs, texts, similarity)
        return connected_components(links if found is None else links.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")

    def apart(p: DataFrame, found: DataFrame) -> DataFrame:
        a = found.select(F.col("node").alias("a"), F.col("component").alias("a_comp"))
        b = found.select(F.col("node").alias("b"), F.col("component").alias("b_comp"))
        p = p.join(a, "a", "left").join(b, "b", "left")
        return p.filter(F.coalesce("a_comp", "a") != F.coalesce("b_comp", "b"))

    def placed(ids: DataFrame, found: DataFrame) -> DataFrame:
        """``ids`` with the component of each id."""
        return ids.join(found.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))

    found = star(star(None, "first"), "other")

    # what is left: pairs of one bucket in different components
    inside = cut_lineage(placed(rows.select("key", "id", "n"), found))
    mixed = inside.groupBy("key").agg(F.count("*").alias("count"), F.sum("n").alias("weight"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key", "count", "weight")
    mixed = cut_lineage(mixed)
    members = inside.join(mixed.select("key"), "key", "left_semi")
    held, _ = counted_side(one.select("doc", "th", "id", "keys").join(members.select("id").distinct(), "id", "left_semi"), BROADCAST_ROWS // SKETCHES)
    bins = sk.select("doc", "th", "bins").join(held, ["doc", "th"]).dropDuplicates(["id"]).select("id", "keys", "bins")
    members = members.join(bins.join(texts, "id"), "id").select("key", "id", "component", "n", "keys", "bins", "text")
    dealt = deal_buckets(members, mixed, PAIR_CHUNK, BROADCAST_ROWS, WORDS_CHUNK)
    more = dealt.mapInArrow(each_group(lambda group: compared(group, similarity)), "a long, b long")
    found = connected_components(more.union(found.select(F.col("node").alias("a"), F.col("component").alias("b"))), "a", "b")

    if scattered:  # what no sketch has brought together
        unmet, n_unmet = counted_side(unmet_pairs(sk.select("doc", "th", "grams", "common"), placed(one.select("doc", "th", "id", "n"), found), similarity), 0)
        if n_unmet:
            texts = texts_of(unmet.select(F.explode(F.array("a", "b")).alias("id")), "order-minhash-unmet")
            found = joined(unmet, found)

    whole = cut_lineage(placed(one.select("digest", "id", "doc", "th"), found))
    first = whole.groupBy("component").agg(F.min(F.struct("doc", "th")).alias("first"))
    first = whole.join(first, "component").select("digest", F.col("first.doc").alias("first_doc"), F.col("first.th").alias("first_th"))
    first, _ = counted_side(first, BROADCAST_ROWS)
    return sk.select("doc", "th", "digest").join(first, "digest").select("doc", "th", "first_doc", "first_th")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, scattered: bool = False) -> DataFrame:
    """``id, class_id`` of every distinct document id: the smallest id of its group."""
    found = groups(documents(docs, id_col, text_col), similarity, scattered)
    return found.groupBy(F.col("doc").alias("id")).agg(F.min("first_doc").alias("class_id"))


def keep_one(docs: DataFrame, columns: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, scattered: bool = False) -> DataFrame:
    """``docs`` with one document of each group, that with the smallest id; rows without an id stay.

    Rows with the same id and text are one document.
    """
    found = groups(documents(docs, id_col, text_col), similarity, scattered)
    kept = found.filter("doc = first_doc and th = first_th").groupBy("doc", "th").agg((F.count("*") > 1).alias("again"))
    kept, _ = counted_side(kept, BROADCAST_ROWS)
    # the caller's columns stay in a struct, so that no name can clash
    rows = docs.select(F.struct(*columns).alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"))
    held = rows.filter("doc is not null").join(kept, ["doc", "th"])
    once, again = held.filter("not again"), held.filter("again").groupBy("doc", "th").agg(F.first("row").alias("row"))
    return once.select("row.*").unionByName(again.select("row.*")).unionByName(rows.filter("doc is null").select("row.*"))
