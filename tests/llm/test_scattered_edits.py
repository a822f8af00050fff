"""Near-duplicates with scattered edits, up to the threshold, in texts of all lengths."""

import random

from pathweave.llm import orderminhash as om


def test_every_pair_up_to_the_threshold_is_found(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for n in [*range(5, 31), 40, 60, 99, 100, 150, 300, 700, 1500, 4000]:
        text = [word() for _ in range(n)]
        other = text[:]
        d = int(n * 0.2 + 1e-9)
        for i in range(d):  # as far from each other as they can be
            other[i * n // d + n // d // 2] = word()
        rows += [(2 * len(rows), " ".join(text)), (2 * len(rows) + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in om.classes(docs, scattered=True).collect()}
    assert all(got[b] == a for (a, _), (b, _) in zip(rows[::2], rows[1::2], strict=True))
    assert len(set(got.values())) == len(rows) // 2


def test_prefixes_of_similar_texts_meet():
    rng = random.Random(8)
    none = (om.np.zeros(0, dtype=om.np.uint64), om.np.zeros(0, dtype=om.np.int64))
    for _ in range(3000):
        n = rng.randrange(4, 60)
        a = [rng.choice("abcdefghijkl") for _ in range(n)]
        b = a[:]
        for _ in range(om.edits(n, 0.8)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = [rng.choice("abcdefghijkl")] * rng.randrange(2)
        if a != b and om.similar(" ".join(a), " ".join(b), 0.8):
            x, y = (om.prefix(om.word_hashes(t), 0.8, *none) for t in (a, b))
            assert len(set(x.tolist()) & set(y.tolist())) >= min(om.must_share(max(len(a), len(b)), 0.8)[1], om.MEET)


def test_drawn_k_mers_of_long_texts_meet():
    """Long texts are looked up by a share of their k-mers; similar ones have as many in common as are asked for."""
    rng = random.Random(9)
    none = (om.np.zeros(0, dtype=om.np.uint64), om.np.zeros(0, dtype=om.np.int64))
    for n in [rng.randrange(200, 3000) for _ in range(150)]:
        a = [str(rng.randrange(10**9)) for _ in range(n)]
        b = a[:]
        d = om.edits(n, 0.8)
        for i in range(d):
            b[i * n // d + n // d // 2] = str(rng.randrange(10**9))
        x, y = (om.prefix(om.word_hashes(t), 0.8, *none) for t in (a, b))
        assert len(x) < 300 and len(set(x.tolist()) & set(y.tolist())) >= om.asked(n, 0.8)


def test_rows_that_share_an_id(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(5, text, 1), (5, "some other words that are not like it", 2), (5, text, 3), (3, text.replace("w20", "x"), 4), (9, "some other words that are not like it", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    assert {r.id: r.class_id for r in om.classes(docs).collect()} == {3: 3, 5: 3, 9: 5}
    kept = sorted((r.doc_id, r.k) for r in om.keep_one(docs, docs.columns).collect())
    assert kept == [(3, 4), (5, 2)]
