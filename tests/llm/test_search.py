"""Ranked search against plain Python, and its blocks against all ways to cut."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pathweave.llm import search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, queries, k=10):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for q, text in queries:
        scored = []
        for i, c, length in held:
            m = 10 + (90 * length * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(q, rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(spark, docs, queries, **more):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(queries, "item_id long, text string")
    return sorted((tuple(r) for r in search.search(d, q, **more).select("query_id", "rank", "id", "score").collect()), key=repr)


def corpus(n, seed):
    rng = random.Random(seed)
    words = [w for w in ("the", "Of", "naïve", "x1", "Éa", "ÉA", "　und", "ca-fé", "a_b") for _ in range(3)] + [f"w{i}" for i in range(60)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice((1, 4, 30, 200))))) for i in range(n)]


@pytest.mark.parametrize("shard", (7, 40, 10_000))
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD_DOCS", shard)
    docs = corpus(160, 1) + [(200, None), (201, ""), (202, " .,-"), (None, "the w1 w2"), (7, "w1 w1 w1"), (7, "w1 w1 w1"), (203, "the w3 " * 30_000)]
    queries = [(0, "The w1 w2 of NAÏVE"), (1, None), (2, "?!"), (3, "unknown"), (4, "éa ÉA Éa"), (0, "w3"), (None, "w5 und"), (5, " ".join(f"w{i}" for i in range(60)))]
    assert found(spark, docs, queries) == brute(docs, queries)


def test_queries_in_several_passes(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_TERMS", 8)
    docs, queries = corpus(60, 2), [(i, f"w{i} w{i + 1} the") for i in range(20)]
    assert found(spark, docs, queries, k=3) == brute(docs, queries, 3)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, "a b")], []) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []


def test_blocks_are_the_best_cut():
    rng = np.random.default_rng(3)
    for n in (1, 2, 9, 11):
        scores = rng.zipf(1.5, n).astype(np.int64)
        price = search._price(scores)

        def cost(ends, scores=scores, price=price):
            return sum((b - a) * scores[a:b].max() + price for a, b in zip((0, *ends), ends, strict=False))

        ways = [(*c, n) for r in range(n) for c in itertools.combinations(range(1, n), r)]
        ends = search.blocks([scores, scores[:1]])[0]
        assert ends[-1] == n
        assert cost(tuple(ends)) == pytest.approx(min(map(cost, ways)))


def test_ranges_of_low_bound_are_not_read():
    rng = np.random.default_rng(4)
    docs = [np.sort(rng.choice(10_000, 3000, replace=False)) for _ in range(6)]
    scores = [rng.integers(1, 100, 3000) for _ in docs]
    for i in range(6):  # a dozen documents stand out
        scores[i][:12] += 10_000
        docs[i][:12] = np.arange(12)
    lists = search.Lists(docs, scores, 10_000)
    whole = np.zeros(10_000, np.int64)
    for d, s in zip(docs, scores, strict=True):
        whole[d] += s
    top = np.lexsort((np.arange(10_000), -whole))[:10]
    assert lists.best(range(6), 10) == [(d, whole[d]) for d in top]
    assert lists.read < 0.05 * 6 * 3000
