"""Alignment of two tokenizers against the libraries on whole texts and plain Python."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathweave.llm import alignment

PATH_A, PATH_B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATH_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATH_B)


def tokens(libraries, text):
    """Ids and bytes of both sides, or None."""
    a, b = libraries
    if not text:
        return None
    letters = alignment.byte_letters()
    out = []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    out.append([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids])
    out.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
    whole = (" " + text).encode()
    return out if all(b"".join(t for _, t in side) == whole for side in out) else None


def spans(side):
    at, out = 0, []
    for i, t in side:
        out.append((i, at, at + len(t)))
        at += len(t)
    return out


def brute(libraries, rows):
    found = []
    for doc_id, text in rows:
        sides = tokens(libraries, text)
        if sides is None:
            found.append((doc_id, [], [], [], []))
            continue
        a, b = map(spans, sides)
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, links, low = [], [], 0
        for e in both:
            ga, gb = ([t for t in side if low < t[2] <= e] for side in (a, b))
            groups.append((ga, gb))
            links += [(x[0], y[0]) for x in ga for y in gb if max(x[1], y[1]) < min(x[2], y[2])]
            low = e
        found.append((doc_id, a, b, groups, links))
    n = Counter(p for *_, links in found for p in links)
    top = Counter()
    for (_, b), c in n.items():
        top[b] = max(top[b], c)
    out = []
    for doc_id, a, b, groups, links in found:
        listed = ";".join(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb) for ga, gb in groups)
        sha = hashlib.sha256(listed.encode()).hexdigest() if groups else ""
        out.append((doc_id, len(a), len(b), len(groups), len(links), sum(n[p] == top[p[1]] for p in links), sum(n[p] for p in links), sha))
    return sorted(out, key=repr)


AWKWARD = [
    None, "", " ", "\n", "  a", "a  b \n c", "a\tb", "a\r\nb", "x y 　z", "▁", "a ▁b", "<|endoftext|> <s> </s>", "\0", "a\0 b", "café naïve über", "\U0001f600\U0001f600 \U0001f468‍\U0001f469‍\U0001f467",
    "it's we'll I'd 'twas ''s", "1234567 12 3.14 -5", "\x1c a \x1d\nb\x85c d", "é ́", "=" * 300, " " * 70, "\n" * 40 + "end ", "word\nLine two\n\nPara", "中文字 日本語", "a" * 2000,
]


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["the", "of", "Zuein", "ément", "ing", " ", "  ", "\n", "\t", ".", ",", "'s", "12", "ß", "\U0001f600", "​", "-", " ", "A", "﻿"]
    return ["".join(rng.choice(bits) + rng.choice(("", " ", " ", "\n")) for _ in range(rng.choice((1, 5, 60)))) for _ in range(n)]


def test_pieces_encode_as_whole_texts(libraries):
    a, b = alignment.ByteLevel(alignment._read(PATH_A)), alignment.PieceModel(alignment._read(PATH_B))
    assert not b.whole
    for text in [*AWKWARD[1:], *texts(1, 1500)]:
        if text:
            assert "".join(alignment.pieces(text)) == " " + text
            sides = tokens(libraries, text)
            got = [e.encode([text])[0] for e in (a, b)]
            if sides is None:
                assert None in got
            else:
                assert [[int.from_bytes(g[i : i + 2], "little") for i in range(0, len(g), 2)] for g in got] == [[i for i, _ in s] for s in sides]


def result(spark, rows, **more):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").withColumn("key", F.lit("x")).withColumn("id", F.lit(1))
    return sorted((tuple(r) for r in alignment.align(d, PATH_A, PATH_B, **more).select("id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def documents():
    rows = [(i, t) for i, t in enumerate([*AWKWARD, *texts(2, 80)])]
    return [*rows, (5, AWKWARD[4]), (5, AWKWARD[4]), (None, "no id"), (7, "other text"), (900, " ".join(texts(3, 400)))]


@pytest.mark.parametrize("small", (False, True))
def test_equals_brute_force(spark, libraries, monkeypatch, small):
    # documents in many runs and batches, pairs handed on and joined
    more = {"batch": 50, "partial": 40, "most": 10} if small else {}
    for name, n in (("RUN", 7), ("TEXTS", 3)) if small else ():
        monkeypatch.setattr(alignment, name, n)
    assert result(spark, documents(), **more) == brute(libraries, documents())


def test_old_pieces_are_taken_over(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "CACHE", 20)
    e, some = alignment.ByteLevel(alignment._read(PATH_A)), texts(6, 200)
    assert [e.encode([t])[0] for t in some] == alignment.ByteLevel(alignment._read(PATH_A)).encode(some)


def test_counts_over_a_byte():
    import numpy as np

    codes, counts = np.array([3, 70_000, 4_000_000_000], dtype=np.uint32), np.array([254, 255, 70_000])
    assert [x.tolist() for x in alignment.unpacked(*alignment.packed(codes, counts))] == [codes.tolist(), counts.tolist()]


@pytest.mark.parametrize("batch", (alignment.BATCH, 40))
def test_groups_have_their_bytes_and_links(spark, libraries, monkeypatch, batch):
    monkeypatch.setattr(alignment, "RUN", min(alignment.RUN, batch))
    rows = [(i, t) for i, t in enumerate(texts(4, 30))] + [(99, " ".join(texts(5, 60)))]
    found = {}
    for r in alignment.groups(spark.createDataFrame(rows, "doc_id long, text string"), PATH_A, PATH_B, batch=batch).collect():
        found.setdefault(r["id"], []).append(r)
    for doc_id, text in rows:
        sides = tokens(libraries, text)
        if sides is None:
            assert doc_id not in found
            continue
        own = sorted(found[doc_id], key=lambda r: r["group"])
        assert [r["group"] for r in own] == list(range(len(own)))
        assert own[0]["begin"] == 0 and all(x["end"] == y["begin"] for x, y in zip(own, own[1:], strict=False)) and own[-1]["end"] == len((" " + text).encode())
        for side, name in enumerate(("a_ids", "b_ids")):
            assert [i for r in own for i in r[name]] == [i for i, _ in sides[side]]
        a, b = map(spans, sides)
        links = [(r["a_ids"][x["a"]], r["b_ids"][x["b"]]) for r in own for x in r["links"]]
        assert links == [(x[0], y[0]) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]


def test_empty_table(spark):
    assert result(spark, []) == []
