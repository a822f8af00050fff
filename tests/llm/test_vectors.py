"""Vector near-duplicates and nearest neighbours against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from pathweave.llm import hnsw, quantisation


def sample(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims))
    for i in range(n // 5):  # neighbours at all angles around the threshold
        v[n // 2 + i] = v[i] / np.linalg.norm(v[i]) + rng.standard_normal(dims) * rng.uniform(0.05, 0.7) / math.sqrt(dims)
    v = v.astype(np.float32)
    return np.concatenate([v, np.repeat(v[:1], copies, axis=0)])


ODD = [None, [0.0] * 16, [1.0] + [None] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], []]


def frame(spark, v):
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(50_000 + i, x, 0) for i, x in enumerate(ODD)] + [(None, [1.0] * 16, 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int").repartition(4)


def links_of(v, threshold=0.9):
    u = v.astype(float)
    u /= np.sqrt((u * u).sum(axis=1))[:, None]
    near = u @ u.T >= threshold
    np.fill_diagonal(near, False)
    return near


def roots(near):
    root = np.arange(len(near))
    while True:
        new = np.where(near, root[None, :], len(near)).min(axis=1)
        new = np.minimum(root, new)
        if (new == root).all():
            return root
        root = new


def test_links_equal_brute_force(spark):
    v = sample(1500, 16, 3, copies=400)
    near = links_of(v)
    got = {r.id: r for r in quantisation.links(frame(spark, v)).collect()}
    assert len(got) == len(v) + len(ODD) + 1
    n = np.array([got[i].n_links for i in range(len(v))])
    assert (n <= near.sum(axis=1)).all()
    assert n.sum() >= 0.999 * near.sum() > 0
    assert (n[len(v) - 400 :] >= 400).all()
    root = roots(near)
    assert np.mean([got[i].component_id == root[i] for i in range(len(v))]) > 0.999
    assert all(root[got[i].component_id] == root[i] for i in range(len(v)))
    for i in range(len(ODD)):
        assert got[50_000 + i].n_links == 0 and got[50_000 + i].component_id == 50_000 + i
    assert got[None].n_links == 0 and got[None].component_id is None


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(quantisation, "CHUNK", 64)
    rng = np.random.default_rng(8)
    base = rng.standard_normal(16)
    v = np.concatenate([base + rng.standard_normal((500, 16)) * 0.02, rng.standard_normal((100, 16))]).astype(np.float32)
    near = links_of(v)
    got = {r.id: r for r in quantisation.links(frame(spark, v)).collect()}
    assert [got[i].n_links for i in range(500)] == near[:500].sum(axis=1).tolist()
    assert {got[i].component_id for i in range(500)} == {0}


def test_rotation_gives_balanced_codes():
    v = sample(2000, 32, 5)
    x = quantisation.units(v.astype(float))
    mean, rotation = quantisation.learn_rotation(x, 1)
    bits = (x - mean) @ rotation >= 0
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.15
    start = np.where((x - mean) @ np.linalg.eigh((x - mean).T @ (x - mean))[1] >= 0, 1, -1)
    loss = lambda y, b: ((y - b * np.abs(y).mean()) ** 2).sum()
    turned = (x - mean) @ rotation
    assert loss(turned, np.where(turned >= 0, 1, -1)) <= loss((x - mean) @ np.linalg.eigh((x - mean).T @ (x - mean))[1], start) * 1.001


def test_empty_and_single(spark):
    none = frame(spark, sample(5, 16, 1)).limit(0)
    assert quantisation.links(none).count() == 0
    assert hnsw.nearest(none, F.col("id") % 2 == 0).count() == 0
    two = spark.createDataFrame([(4, [1.0, 0.0]), (6, [1.0, 1.0])], "vec_id long, embedding array<double>")
    out = hnsw.nearest(two, F.col("id") == 4).collect()
    assert [(r.query_id, r["rank"], r.id) for r in out] == [(4, 1, 6)] and abs(out[0].score - math.sqrt(0.5)) < 1e-15


def test_neighbours_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SMALLEST", 500)
    v = sample(1500, 16, 4, copies=300)
    got: dict = {}
    for r in hnsw.nearest(frame(spark, v), F.col("id") % 10 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    u = v.astype(float)
    norm = np.sqrt((u * u).sum(axis=1))
    hits = total = 0
    for q in range(0, len(v), 10):
        score = u @ u[q] / norm / norm[q]
        order = [i for i in sorted(range(len(v)), key=lambda i: (-round(score[i], 12), i)) if i != q][:5]
        assert [r for r, _, _ in got[q]] == [1, 2, 3, 4, 5]
        for (_, i, s), (_, j, t) in zip(got[q], got[q][1:], strict=False):
            assert s > t or (s == t and i < j)
        for _, i, s in got[q]:
            assert i != q and abs(s - score[i]) < 1e-12
        hits += len(set(order) & {i for _, i, _ in got[q]})
        total += 5
    assert len(got) == len(range(0, len(v), 10)) and hits >= 0.98 * total
    copy = got[1600]
    assert [i for _, i, _ in copy] == [0, 1500, 1501, 1502, 1503]


def test_graph_is_flat_and_can_be_read_back():
    x = quantisation.units(sample(600, 8, 9).astype(float))
    g = hnsw.build(x, 1)
    again = hnsw.Graph(x, g.levels, g.flat(), g.entry)
    for q in x[:20].astype(np.float32):
        assert g.search(q, 20) == again.search(q, 20)
    assert len(g.flat()) == sum(len(o) * (2 * hnsw.LINKS if i == 0 else hnsw.LINKS) for i, o in enumerate(g.order))


def test_lengths_and_repeated_ids(spark):
    """Vectors meet those of their own length; rows that share an id count by themselves."""
    rows = [(10, [1.0, 0.0, 0.0]), (11, [1.0, 0.01, 0.0])] + [(20 + i, [1.0, float(i)]) for i in range(3)] + [(30, [1.0, 0.0, 0.0, 5.0])]
    rows += [(1, [0.0, 1.0, 0.0, 0.0, 0.0]), (1, [0.0, 0.0, 1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.001, 0.0, 0.0]), (3, [0.0, 0.001, 1.0, 0.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.id, r.n_links, r.component_id) for r in quantisation.links(table).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (10, 1, 10), (11, 1, 10), (20, 0, 20), (21, 1, 21), (22, 1, 21), (30, 0, 30)]
    out = hnsw.nearest(table, F.col("id").isin(10, 20, 30, 1), k=2).collect()
    near = {}
    for r in sorted(out, key=lambda r: (r.query_id, r["rank"], r.id)):
        near.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert near == {10: [(1, 11)], 20: [(1, 21), (2, 22)], 1: [(1, 2), (1, 3), (2, 2), (2, 3)]}
    twice = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (2, [1.0, 0.1]), (5, [1.0, 0.2])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.id) for r in hnsw.nearest(twice, F.col("id") == 1).orderBy("rank").collect()] == [(1, 1, 2), (1, 2, 5)]
    assert sorted((r.id, r.n_links, r.component_id) for r in quantisation.links(twice).collect()) == [(1, 3, 1), (2, 3, 1), (2, 3, 1), (5, 3, 1)]


def test_huge_and_tiny_vectors(spark):
    rows = [(0, [0.0, 1.0]), (1, [1e200, 1e200]), (2, [1e-200, 1e-200]), (3, [5e-324, 0.0]), (4, [1.7e308, 1e300]), (50, [1.0, 1.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component_id) for r in quantisation.links(d).collect()}
    assert got == {0: (0, 0), 1: (2, 1), 2: (2, 1), 50: (2, 1), 3: (1, 3), 4: (1, 3)}
    near = [(r.rank, r.id, r.score) for r in hnsw.nearest(d, F.col("id") == 50).orderBy("rank").collect()]
    assert {x[1] for x in near[:2]} == {1, 2} and all(abs(x[2] - 1) < 1e-15 for x in near[:2])
    assert {x[1] for x in near[2:]} == {0, 3, 4} and all(abs(x[2] - math.sqrt(0.5)) < 1e-7 for x in near[2:])


def test_scaling_changes_no_digit():
    v = np.random.default_rng(9).standard_normal((200, 24))
    plain = v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
    assert (quantisation.units(v) == plain).all() and (quantisation.units(np.ldexp(v, 900)) == plain).all()


def test_walks_in_step_find_what_single_walks_find(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = hnsw.build(x, 23)
    points = np.concatenate([x[:3], rng.normal(size=(150, 24))])
    points = (points / np.linalg.norm(points, axis=1, keepdims=True)).astype(np.float32)
    one = [[n for _, n in graph.search(p, 200)] for p in points]
    low, walk = [], hnsw.Graph.walk
    monkeypatch.setattr(hnsw.Graph, "walk", lambda self, q, start, width, layer: (low.append(layer), walk(self, q, start, width, layer))[1])
    many = graph.search_all(points, 200)
    assert 0 not in low  # no point walks the lowest layer by itself
    true = np.argsort(-(points @ x.T), axis=1)[:, :5]
    share = lambda found: np.mean([len(set(f) & set(t)) for f, t in zip(found, true.tolist(), strict=True)]) / 5
    assert share(many.tolist()) >= max(0.98, share(one) - 0.005)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(one, many.tolist(), strict=True)]) >= 0.97 * 200
    assert all(len(set(m)) == len(m) for m in many.tolist()) and [m[0] for m in many[:3]] == [0, 1, 2]
    few = hnsw.build(x[:7], 23).search_all(points, 200)
    assert all(sorted(n for n in f if n >= 0) == list(range(7)) for f in few.tolist())
    assert hnsw.Graph(np.zeros((0, 24)), np.zeros(0, np.int32)).search_all(points, 9).shape == (len(points), 9)


def test_shards_are_not_put_together_into_few_tasks(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "SMALLEST", 40)
    tasks, kept = [], hnsw.write_and_reread

    def noted(df, name):
        out = kept(df, name)
        if name == "hnsw-index":
            tasks.append((len(out.inputFiles()), out.count()))
        return out

    monkeypatch.setattr(hnsw, "write_and_reread", noted)
    assert hnsw.nearest(frame(spark, sample(300, 8, 4)), F.col("id") % 50 == 0).count() > 0
    assert tasks and all(2 * files > shards >= 8 for files, shards in tasks)
