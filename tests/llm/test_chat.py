"""Chat formatting against plain Python: paths, ranks, escapes and masks."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathweave.llm import chat

HARD = ["", "\\### Assistant: </turn> ok", "### user: x</turn>\n### assistant: y", "#### ", "##\\## ", "<\\/turn>", "<\\\\/turn></turn>\n", "<", "</turn", "\\", "a\n\n", "<\\\\\\/turn> #\\\\## ", ": ", "é\U0001f600: ", "/turn>", "#"]
NODE = "id string, parent_id string, role string, text string, score double"


def escape(t, control):
    for first, rest in control:
        t = re.sub(rf"{first}(\\*){rest}", rf"{first}\\\1{rest}", t)
    return t


def test_escapes_take_back_and_hide(spark):
    rng = random.Random(1)
    bits = ["#", "##", " ", "\\", "<", "/turn>", "</turn>\n", "### ", "x", ":", ": "]
    texts = HARD + ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(400)]
    both = (*chat.CONTROL, *chat.DIVIDER)
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t"), both))
    for r in d.withColumn("u", chat.unescaped(F.col("e"), both)).collect():
        assert r["e"] == escape(r["t"], both)
        assert r["u"] == r["t"]
        assert not any(first + rest in r["e"] for first, rest in both)


def digests(rows):
    """Of conversations as lists of (role, text)."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = []
    for tag, turns in rows:
        turns = [(r or "", t or "") for r, t in turns]
        learned = "".join(t for r, t in turns if r == "assistant")
        chars = sum(4 + len(escape(r, (*chat.CONTROL, *chat.DIVIDER))) + 2 + len(escape(t, chat.CONTROL)) + 8 for r, t in turns)
        out.append((tag, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned), chars))
    return sorted(out, key=repr)


def got(segments):
    return sorted((tuple(r) for r in chat.digests(segments).collect()), key=repr)


@pytest.mark.parametrize("segment", (2, 256))
def test_conversations_by_turn(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    rng = random.Random(2)
    roles = ["user", "assistant", "system", None, "", "a: b", "### x"]
    rows = [(c, t, rng.choice(roles), rng.choice([*HARD, None])) for c in (None, 1, 2, 3) for t in (None, *range(rng.randrange(9)))]
    rows += [(9, t, "assistant", f"turn {t}") for t in range(37)]
    rows += [(4, 1, "user", "same"), (4, 1, "user", "same"), (4, 1, "assistant", "tie"), (4, 0, "user", "x" * 100_000)]
    conv = defaultdict(list)
    tie = lambda r: hashlib.md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest()
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, tie(r))):
        conv[r[0]].append(r[2:])
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1)).withColumn("tag", F.lit(2))
    nodes = chat.chain(d)
    assert got(chat.formatted(nodes, chat.paths(nodes))) == digests(conv.items())


def best(rows, branches):
    """Paths as lists of rows, by plain walks."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", hashlib.md5(f"{r[2] or ''}\n{r[3] or ''}".encode()).hexdigest())):
        first.setdefault(r[0], r)
    up = lambda r: first.get(r[1]) if r[1] is not None and r[1] != r[0] else None
    parents = {id(p) for r in rows if (p := up(r))}
    trees = defaultdict(list)
    for r in rows:
        if id(r) not in parents:
            path = [r]
            while p := up(path[-1]):
                path.append(p)
            trees[id(path[-1])].append((-sum(x[4] or 0 for x in path), path[::-1]))
    return [(min(x[0] for x in p), [x[2:4] for x in p]) for t in trees.values() for _, p in sorted(t, key=lambda x: x[0])[:branches]]


@settings(max_examples=3, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from((1, 2, None)))
def test_trees_ranked_by_score(spark, seed, branches):
    rng = random.Random(seed)
    rows = []
    for i in range(60):  # different scores, so that no branches tie
        parent = None if rng.random() < 0.1 else f"n{rng.randrange(max(1, i)):03}" if rng.random() < 0.95 else "missing"
        rows.append((f"n{i:03}", parent, rng.choice(("user", "assistant")), f"t{i}", None if i % 17 == 0 else rng.random()))
    rows.append(("n005", "n005", "user", "again", 7.5))  # a second row with an id, which replies to itself
    nodes = chat.tree(spark.createDataFrame(rows, NODE))
    assert got(chat.formatted(nodes, chat.paths(nodes, branches))) == digests(best(rows, branches))


def test_a_ring_of_parents_is_opened_at_its_smallest(spark):
    rows = [("a", "c", "user", "A", 1.0), ("b", "a", "assistant", "B", 1.0), ("c", "b", "user", "C", 1.0), ("d", "c", "assistant", "D", 1.0), ("z", None, "user", "Z", None)]
    nodes = chat.tree(spark.createDataFrame(rows, NODE))
    want = [("a", [("user", "A"), ("assistant", "B"), ("user", "C"), ("assistant", "D")]), ("z", [("user", "Z")])]
    assert got(chat.formatted(nodes, chat.paths(nodes))) == digests(want)


def test_a_long_thread_takes_few_rounds(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(5000)]
    nodes = chat.chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    _, levels = chat.jumps(nodes)
    assert len(levels) == 13
    assert got(chat.formatted(nodes, chat.paths(nodes))) == digests([(1, [r[2:] for r in rows])])


def test_masks_are_spans_of_the_output(spark):
    nodes = chat.chain(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "### é</turn>"), (1, 2, "assistant", "")], "conv_id long, turn long, role string, text string"))
    (row,) = chat.formatted(nodes, chat.paths(nodes)).collect()
    assert row["text"] == "### user: hi</turn>\n### assistant: #\\## é<\\/turn></turn>\n### assistant: </turn>\n"
    assert [row["text"][m["start"] : m["end"]] for m in row["mask"]] == ["#\\## é<\\/turn>", ""]


def test_empty_table(spark):
    nodes = chat.chain(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert got(chat.formatted(nodes, chat.paths(nodes))) == []
    nodes = chat.tree(spark.createDataFrame([], NODE))
    assert got(chat.formatted(nodes, chat.paths(nodes, None))) == []
