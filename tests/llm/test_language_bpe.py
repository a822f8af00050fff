"""Language identification by held-out accuracy; BPE against the tokenizer library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pathweave.llm import bpe, language, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
SMALL = "/root/testdata/sf0.01"


def test_bundle_is_the_sum_of_bound_letters():
    v = lambda c: language.letter_vector(ord(c) if c != " " else 0, 5).astype(int)
    grams = [" ab", "ab ", "b c", " c "]
    want = sum(np.roll(v(a), 2) * np.roll(v(b), 1) * v(c) for a, b, c in grams)
    assert (language.bundles(["Ab, -C!"], 5)[0] == want).all()
    assert not language.bundles(["", "12 34"], 5).any()
    rng = random.Random(1)
    many = ["".join(rng.choice("abcde ëж中") for _ in range(rng.randrange(0, 300))) for _ in range(50)]
    together = language.unit_bundles(many, 5)
    alone = np.concatenate([language.unit_bundles([t], 5) for t in many])
    assert np.allclose(together, alone, atol=1e-6)


def test_held_out_accuracy(spark):
    out = queries.op1_language_id(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id")
    held = out.filter("held_out and lang is not null")
    assert held.filter("lang = lang_pred").count() >= 0.97 * held.count() > 100
    assert out.filter("score < 0 or score > 1 or score is null or lang_pred is null").count() == 0
    assert out.filter("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0


def test_language_edge_cases(spark):
    rows = [(i, "the and that with this from", "en", 1) for i in range(30)] + [(100 + i, "der die das und nicht ein", "de", 1) for i in range(30)]
    rows += [(200, None, "en", 1), (201, "", "en", 1), (202, "123 ;;", None, 1), (203, "the and that " * 200_000, None, 1), (None, "der die das", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, prediction int")
    got = {r.doc_id: r for r in language.identify(docs).select("doc_id", "prediction.*").collect()}
    assert [got[i].lang for i in (200, 201, 202)] == ["und"] * 3 and got[200].score == 0
    assert got[203].lang == "en" and got[None].lang == "de"
    unlabelled = docs.drop("prediction").withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang for r in language.identify(unlabelled).select("prediction.*").collect()} == {"und"}
    assert language.identify(docs.drop("prediction").limit(0)).count() == 0


def plain_profile(text, seed=11):
    """A unit bundle letter by letter."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    letters = " " + " ".join(runs) + " " if runs else ""
    v = lambda c: language.letter_vector(0 if c == " " else ord(c), seed).astype(int)
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        total += np.roll(v(a), 2) * np.roll(v(b), 1) * v(c)
    norm = np.linalg.norm(total)
    return total / norm if norm else total


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(12)
    words = {"xx": "kala mora tuli sena".split(), "yy": "strum blick zwang pfad".split(), "zz": "oui aeio uoa eau".split()}
    rows = [(i, " ".join(rng.choice(words[k]) + rng.choice(["", "n", ", "]) for _ in range(rng.randrange(1, 25))), k if rng.random() < 0.8 else None, "s") for i, k in enumerate(rng.choice("xx yy zz".split()) for _ in range(120))]
    rows += [(500, None, "xx", "s"), (501, "12 !", "yy", "s"), (502, "kala strum", None, "s"), (502, "kala strum", None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    sums = {}
    for i, text, lang, _ in rows:
        if lang and text is not None and zlib.crc32(str(i).encode()) % 5:
            sums[lang] = sums.get(lang, 0) + plain_profile(text)
    langs = sorted(sums)
    prototypes = np.array([sums[k] / np.linalg.norm(sums[k]) for k in langs])
    got = queries.op1_language_id(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    texts = {i: t for i, t, _, _ in rows}
    for r in got:
        cosine = prototypes @ plain_profile(texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if not any(c.isalpha() for c in texts[r.doc_id] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert abs(r.score - max(cosine.max(), 0)) < 1e-4 and cosine[langs.index(r.lang_pred)] > cosine.max() - 1e-4


def test_every_code_point_is_split_as_the_library_does():
    # all planes with characters, and some of each block of the others
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x34000 or c % 61 == 0)]
    for shape in ("a{0}a1", " {0}!{0}"):
        texts = ["".join(shape.format(c) + "\n" for c in points[i : i + 64]) for i in range(0, len(points), 64)]
        ids, counts = bpe.encode_texts(texts, bpe.Merges(RANKS))
        edges = np.append(0, np.cumsum(counts))
        assert all(ids[a:b].tolist() == LIBRARY.encode_ordinary(t) for a, b, t in zip(edges[:-1], edges[1:], texts, strict=True))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("'srevlmtd \n\t1a.")), max_size=40), max_size=5))
def test_encoding_equals_the_library(texts):
    ids, counts = bpe.encode_texts(texts, bpe.Merges(RANKS))
    edges = np.append(0, np.cumsum(counts))
    for i, t in enumerate(texts):
        assert ids[edges[i] : edges[i + 1]].tolist() == LIBRARY.encode_ordinary(t)


def test_scan_equals_stepping_through():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, len(bpe.RULES), 5000).astype(np.uint8)
    state, want = bpe.FRESH, []
    for s in symbols:
        want.append(state)
        go, other = bpe.RULES[int(s)]
        state = go.get(state, other)
    for n in (1, 2, 17, 5000):
        assert bpe.states_before(symbols[:n]).tolist() == want[:n]


def test_round_trip_and_edge_cases(spark):
    rng = random.Random(4)
    texts = ["", None, "'s 're", "x" * 150_000, "ab  \n c" * 100_000] + ["".join(rng.choice("ab'sré中😀 \n1.") for _ in range(200)) for _ in range(600)]
    texts += texts[-3:]
    docs = spark.createDataFrame([(i, t, [1], b"") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, decoded binary").repartition(3)
    enc = bpe.encode(docs.select("doc_id", "text"), PATH)
    for r in bpe.decode(enc, PATH).collect():
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    for r in enc.collect():
        tokens = [LIBRARY.decode_single_token_bytes(i) for i in r.ids]
        assert list(r.offsets) == list(np.cumsum([0, *map(len, tokens)])[:-1])
    for r in queries.bpe_digests(docs).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert queries.bpe_digests(docs.limit(0)).count() == 0
