"""The pipeline against plain Python, and its stages on awkward rows."""

import hashlib
import re

import numpy as np
import public_tokenizers
import tiktoken
from test_native import ASSIGN, plain_targets
from test_orderminhash import brute, components

import corpus_pipeline as cp
from pathweave.llm import bpe, language, mixing

SMALL = "/root/testdata/sf0.001"


def plain_redact(t):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]{12,}", t)]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]{32,}", t)]
    found += [(m.start(), 3, m.end(), "pem") for m in re.finditer(r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----", t)]
    found += [(m.start(), 4, m.end(), "jwt") for m in re.finditer(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", t)]
    out, at = [], 0
    for a, _, b, kind in sorted(found):
        if a >= at:
            out += [t[at:a], f"[{kind}]"]
            at = b
    return "".join(out) + t[at:]


def plain_mix(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + size(r["text"])
    targets, out = plain_targets(sizes), []
    for s in sizes:
        own = sorted((hashlib.md5(f"1:{r['doc_id']}".encode()).hexdigest(), r["doc_id"], r["text"]) for r in rows if r["source"] == s)
        whole = int(targets[s] // sizes[s]) if sizes[s] else 0
        rest, before = round(targets[s] - whole * sizes[s]), 0
        for _, i, t in own:
            n = size(t)
            part = max(0, min(n, rest - before))
            out += [(i, t)] * (whole + (n > 0 and 2 * part >= n))
            before += n
    return out


def test_pipeline_equals_plain_python(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    langs, prototypes = language.fit(docs)
    cosine = language.unit_bundles([r["text"] for r in rows], 11) @ prototypes.T
    rows = [r for r, c in zip(rows, cosine.max(axis=1), strict=True) if c >= cp.MIN_LIKENESS and any(map(str.isalpha, r["text"]))]
    assert langs and len(rows) >= 0.98 * docs.count()
    near, _ = brute([(r["doc_id"], r["text"]) for r in rows])
    group = components([r["doc_id"] for r in rows], near)
    rows = [{**r, "text": plain_redact(r["text"])} for r in rows if group[r["doc_id"]] == r["doc_id"]]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = []
    for i, t in plain_mix(rows):
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    got = cp.run(spark, SMALL).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_stages_on_awkward_rows(spark):
    words = "the and that with this from these are which some other words of a text".split()
    rng = np.random.default_rng(1)
    text = lambda: " ".join(rng.choice(words, 30))
    rows = [(i, text(), "en", ["a", "b", None][i % 3], 1, 7, "x") for i in range(40)]
    rows += [(100, None, None, None, None, None, None), (101, "", "en", "a", 0, 1, ""), (102, "123 456", None, "b", 7, 1, "k"), (103, "the and " * 40_000, "en", "b", 1, 1, "k"), (None, text(), "en", "a", 1, 1, "k"), (104, "token = abcdefgh1234 " + text(), "en", "a", 1, 1, "k")]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, prediction string").repartition(3)
    out = docs
    seen = []
    for name, stage in cp.STAGES:
        out = stage(spark, out, SMALL)
        if name != cp.STAGES[-1][0]:
            assert tuple(out.columns) == cp.COLUMNS
        seen.append({r.doc_id for r in out.select("doc_id").collect()})
        if name == "secrets":
            assert out.filter("doc_id = 104").first().text.startswith("[assign] ")
        if name == "near_dedup":
            assert out.filter("doc_id = 0").count() == 1
    assert seen[0] == set(range(40)) | {103, 104, None} and seen[1] == seen[2] == seen[0]
    for name, stage in cp.STAGES:
        assert stage(spark, docs.select(*cp.COLUMNS).limit(0), SMALL).count() == 0, name


def test_mix_repeats_whole_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i % 2 else "b") for i in range(40)], "doc_id long, text string, source string")
    taken = {r.id: r.repeats for r in mixing.draw(docs, whole_documents=True).collect()}
    mixed = mixing.mix(docs, docs.columns).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in mixed} == {k: v for k, v in taken.items() if v} and sum(taken.values()) == 60
