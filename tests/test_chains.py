"""Chains joined by list ranking, against a plain walk."""

import random

from pathweave.operators import build

EDGE = "id long, u long, v long, line array<long>, name string"


def walked(edges, keep):
    """Chains by walking from both their ends, one edge after the other."""
    at = {}
    for e in edges:
        for n in (e[1], e[2]):
            at.setdefault(n, []).append(e)
    inner = {n for n, es in at.items() if len(es) == 2 and es[0][0] != es[1][0] and es[0][4] == es[1][4] and n not in keep}

    def go(start, e):
        line, ids, here = [start], [], start
        while True:
            ids.append(e[0])
            own = e[3] if e[1] == here else e[3][::-1]
            line += own[1:]
            here = e[2] if e[1] == here else e[1]
            if here not in inner or here == start:
                return line, ids, here
            e = next(x for x in at[here] if x[0] != e[0])

    out, done = [], set()
    rings = []
    for n in sorted(at):
        for e in sorted(at[n]):
            if n in inner:
                continue
            line, ids, end = go(n, e)
            if frozenset(ids) not in done and (n < end or (n == end and (e[0] <= ids[-1]))):
                done.add(frozenset(ids))
                # an edge by itself keeps its direction
                out.append((e[0], e[1], e[2], tuple(e[3]), e[4]) if len(ids) == 1 else (min(ids), n, end, tuple(line), e[4]))
    seen = {i for s in done for i in s}
    for n in sorted(inner):  # what is left are rings
        e = min(at[n])
        if e[0] in seen:
            continue
        line, ids, end = go(n, e)
        seen |= set(ids)
        rings.append((min(ids), n, end, tuple(line), e[4]))
    return sorted(out + rings)


def check(spark, edges, keep=()):
    got = build.collapse_chains(spark.createDataFrame(edges, EDGE), spark.createDataFrame([(k,) for k in keep], "node long"), ["name"])
    assert sorted((r["id"], r["u"], r["v"], tuple(r["line"]), r["name"]) for r in got.collect()) == walked(edges, set(keep))


def edge(i, u, v, name="a"):
    return (i, u, v, [u, 1000 + i, v], name)


def test_rings_loops_and_forks(spark):
    rng = random.Random(3)
    edges = [edge(1, 1, 2), edge(2, 3, 2), edge(3, 3, 4)]  # edges drawn either way
    edges += [edge(10 + i, 10 + i, 10 + (i + 1) % 5) for i in range(5)]  # a ring
    edges += [edge(20, 20, 21), edge(21, 22, 21), edge(22, 22, 20), edge(23, 23, 20)]  # a loop at a junction that isn't its smallest node
    edges += [edge(24, 19, 23)]
    edges += [edge(30, 30, 31), edge(31, 31, 30)]  # two edges between two nodes
    edges += [edge(40, 40, 41), edge(41, 41, 42, "b"), edge(42, 42, 43, "b"), edge(43, 43, 44, None)]  # names end a chain
    edges += [edge(50, 50, 51), edge(51, 51, 52), edge(52, 52, 53)]
    edges += [edge(60, 60, 60)]
    rng.shuffle(edges)
    check(spark, edges, keep=(52, 12))


def test_random_graphs(spark):
    rng = random.Random(4)
    edges = []
    for i in range(400):
        u, v = rng.randrange(330), rng.randrange(330)
        if u != v:
            edges.append(edge(i, u, v, rng.choice(("a", "a", "a", "b"))))
    check(spark, edges, keep=rng.sample(range(330), 20))


def test_a_long_chain_and_a_long_ring_in_few_rounds(spark, monkeypatch):
    rounds = []
    cut = build.write_and_reread
    monkeypatch.setattr(build, "write_and_reread", lambda df, name: (rounds.append(1), cut(df, name))[1])
    names = list(range(6000))
    random.Random(5).shuffle(names)
    edges = [edge(names[i], i, i + 1) if i % 2 else (names[i], i + 1, i, [i + 1, 7000 + i, i], "a") for i in range(5000)]
    edges += [edge(10_000 + i, 20_000 + i, 20_000 + (i + 1) % 500) for i in range(500)]
    check(spark, edges)
    assert len(rounds) < 50


def test_no_edges(spark):
    check(spark, [])
