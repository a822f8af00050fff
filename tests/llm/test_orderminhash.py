"""Near-duplicates against brute force over all pairs."""

import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from pathweave.llm import orderminhash as om
from pathweave.llm import queries


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=40), st.lists(st.sampled_from("abc"), max_size=40), st.integers(0, 30))
def test_alignment_equals_the_full_table(a, b, limit):
    d = plain_distance(a, b)
    assert om.distance_within(a, b, limit) == (d if d <= limit else None)


def test_alignment_of_long_lists():
    rng = random.Random(1)
    for size in (300, 900):
        a = [str(rng.randrange(400)) for _ in range(size)]
        b = a[:]
        for _ in range(size // 12):
            b[rng.randrange(len(b))] = "x"
            b.insert(rng.randrange(len(b)), "y")
        d = plain_distance(a, b)
        assert om.distance_within(a, b, size // 2) == d and om.distance_within(a, b, d - 1) is None


def shingles(tokens):
    seen, out = {}, set()
    for i in range(max(1, len(tokens) - 4)):
        gram = tuple(tokens[i : i + 5])
        seen[gram] = seen.get(gram, 0) + 1
        out.add((gram, seen[gram]))
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute(rows):
    """Links by edit similarity, and those whose shingles alone are similar."""
    tokens = {i: om.words(t) for i, t in rows}
    sets = {i: shingles(t) for i, t in tokens.items()}
    ids, near, close = sorted(tokens), [], []
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            longer = max(len(tokens[i]), len(tokens[j]))
            if om.distance_within(tokens[i], tokens[j], int(longer * 0.2 + 1e-9)) is not None:
                near.append((i, j))
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                close.append((i, j))
    return near, close


def test_groups_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in queries.op5_order_minhash(spark, "/root/testdata/sf0.01").collect()}
    near, close = brute(rows)
    true = components(got, near)
    assert len(got) == len(rows) and len(close) > 30
    assert all(got[a] == got[b] for a, b in close)
    assert all(true[i] == true[c] for i, c in got.items())  # nothing is joined that isn't similar
    found = sum(got[a] == got[b] for a, b in near)
    assert found >= 0.99 * len(near)


def test_chains_hot_groups_and_edge_cases(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [word() for _ in range(120)]
    rows, i = [], 0
    for _ in range(150):  # one large group of near copies
        text = base[:]
        text[rng.randrange(120)] = word()
        rows.append((i, " ".join(text)))
        i += 1
    group = i
    rows += [(i + k, " ".join(base)) for k in range(40)]
    i += 40
    passage = [word() for _ in range(40)]
    for _ in range(60):  # a passage shared by texts that are otherwise different
        rows.append((i, " ".join([word() for _ in range(40)] + passage + [word() for _ in range(40)])))
        i += 1
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "two words"), (9004, "Two  WORDS"), (9005, "one"), (9006, "long " * 50_000), (9007, "long " * 49_000)]
    rows += rows[-2:]
    docs = spark.createDataFrame([(a, t, 0) for a, t in rows] + [(None, "two words", 0)], "doc_id long, text string, id int")
    got = {r.id: r.class_id for r in om.classes(docs).collect()}
    assert {got[k] for k in range(group + 40)} == {0}
    assert all(got[k] == k for k in range(group + 40, i))
    assert got[9000] == got[9001] == got[9002] == 9000 and got[9003] == got[9004] == 9003
    assert got[9005] == 9005 and got[9006] == got[9007] == 9006
    kept = om.keep_one(docs, docs.columns)
    out = pd.Series([r.doc_id for r in kept.collect()])
    assert kept.columns == docs.columns and out.isna().sum() == 1
    assert sorted(out.dropna()) == sorted({c for c in got.values()})
    assert om.classes(docs.limit(0)).count() == 0


def linked(spark, pairs, copies):
    """The share of (text, other) pairs of random words, each made ``copies`` times by ``pairs(word)``, that are linked."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, kinds = [], []
    for kind, make in pairs.items():
        for _ in range(copies):
            text, other = make(word)
            rows += [(2 * len(kinds), " ".join(text)), (2 * len(kinds) + 1, " ".join(other))]
            kinds.append(kind)
    got = {r.id: r.class_id for r in om.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * i] == 2 * i for i in range(len(kinds)))
    return {k: sum(got[2 * i + 1] == 2 * i for i, x in enumerate(kinds) if x == k) / copies for k in pairs}


def test_even_edits_up_to_the_threshold_meet(spark):
    def edited(n, d):
        def make(word):
            text = [word() for _ in range(n)]
            other = text[:]
            for i in range(d):
                other[i * n // d + n // d // 2] = word()
            return text, other

        return make

    share = linked(spark, {(n, d): edited(n, d) for n, d in ((100, 5), (100, 10), (100, 15), (100, 18), (100, 20), (30, 6), (40, 8), (400, 80))}, 60)
    assert all(v >= 0.9 for v in share.values()), share


def test_short_texts_meet_for_certain(spark):
    def edited(n, places, kind):
        def make(word):
            text = [word() for _ in range(n)]
            other = []
            for i, w in enumerate(text):
                other += [w] if i not in places else [word()] if kind == "other" else [] if kind == "gone" else [w, word()]
            return text, other

        return make

    pairs = {(n, n // 2, kind): edited(n, {n // 2}, kind) for n in range(5, 13) for kind in ("other", "gone", "new")}
    pairs |= {(n, "even", kind): edited(n, {i * n // (n // 5) + 2 for i in range(n // 5)}, kind) for n in (10, 14, 15, 20, 24, 29) for kind in ("other", "gone")}
    pairs = {k: v for k, v in pairs.items() if k[0] > 5 or k[2] == "other" or k[2] == "new" or k[1] == "even"}
    share = linked(spark, pairs, 4)
    assert all(v == 1.0 for k, v in share.items()), share


def test_columns_of_any_name_stay(spark):
    names = ["doc_id", "text", "__id", "__hash", "__doc", "__th", "__again", "doc", "th", "row", "again", "id", "key"]
    rows = [(i, " ".join(f"{w}{i}" for w in "abcdefg"), *[f"{n}{i}" for n in names[2:]]) for i in range(3)]
    docs = spark.createDataFrame([*rows, rows[0]], ", ".join(["doc_id long", *[f"{n} string" for n in names[1:]]]))
    kept = om.keep_one(docs, docs.columns)
    assert kept.columns == names
    assert sorted(tuple(r) for r in kept.collect()) == sorted(rows)
