"""Archives and id files: exact round trips, and results against plain Python."""

import gzip
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pathweave.llm import files, idfiles, queries, rangecoder, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def decoded(data):
    return np.concatenate([np.zeros(0, np.uint32), *rangecoder.decode_blocks(data)])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 131071), max_size=300), st.integers(1, 30), st.booleans())
def test_blocks_round_trip(ids, times, few):
    ids = np.array(ids, dtype=np.int64) % (7 if few else 131072)
    ids = np.tile(ids, times)
    assert (decoded(b"".join(rangecoder.encode_blocks(ids))) == ids).all()


def test_a_span_of_a_whole_word_survives():
    span = np.array([1 << 48, 1 << 40, (1 << 48) - 1], dtype=np.uint64)
    assert rangecoder._grown(span).tolist() == [2**64 - 1, 2**56 - 1, 2**64 - 1 - 2**16]


@pytest.mark.parametrize("seed", range(6))
def test_short_blocks_end_in_padding(seed):
    rng = np.random.default_rng(seed)
    for n in rng.integers(1, 3 * rangecoder.BLOCK, 12):
        ids = np.minimum(rng.zipf(1.2, n), 49407)
        assert (decoded(b"".join(rangecoder.encode_blocks(ids))) == ids).all()


def test_blocks_are_independent_checked_and_small():
    ids = np.random.default_rng(1).zipf(1.3, 20_000) % 49408
    blocks = list(rangecoder.encode_blocks(ids))
    assert len(blocks) == -(-20_000 // rangecoder.BLOCK)
    assert (decoded(blocks[3]) == ids[3 * rangecoder.BLOCK : 4 * rangecoder.BLOCK]).all()
    assert sum(map(len, blocks)) < 2 * len(ids)
    repeated = np.tile(np.arange(40), 500)
    assert sum(map(len, rangecoder.encode_blocks(repeated))) < 0.2 * len(repeated)
    spoilt = bytearray(blocks[0])
    spoilt[100] ^= 4
    with pytest.raises(ValueError, match="checksum"):
        decoded(bytes(spoilt))


def texts():
    rng = random.Random(9)
    pool = list("abcdeÉß  \n\t\x1c\x85　'.,!?123") + ["don't", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "É", "word", "中", "😀"]
    out = ["".join(rng.choice(pool) for _ in range(rng.randrange(0, 80))) for _ in range(400)]
    return out + ["", None, " ", "long " * 60_000, "x" * 30_000, "hello <|endoftext|> x", "a<|startoftext|>,b", "<|endoftext|><|endoftext|>"] + out[:3]


def test_id_files(spark):
    t = Tokenizer.from_file(TOKENIZER)
    rows = [(i if i != 11 else None, x, 7) for i, x in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long").repartition(5)
    want, start = {}, 0
    for i, x, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = idfiles.write_and_read(docs, TOKENIZER, n_files=3).collect()
    assert len(got) == len(rows) and {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want
    whole = idfiles.write_and_read(docs, TOKENIZER, n_files=2, by_pieces=False).collect()
    assert {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in whole} == want
    assert idfiles.write_and_read(docs.limit(0), TOKENIZER).count() == 0
    twice = docs.filter("doc_id < 5").union(docs.filter("doc_id < 5"))
    out = idfiles.write_and_read(twice, TOKENIZER).orderBy("start").collect()
    assert [r.id for r in out] == sorted(r.id for r in out) and len(out) == 10
    assert all(b.start == a.start + a.n_tokens for a, b in zip(out, out[1:], strict=False))


def test_pieces_of_other_tokenizers():
    """One whose tokens hold blanks, and where capitals count, gets whole texts."""
    pieces = idfiles.Pieces(public_tokenizers.path("byte_bpe_50k.json"))
    assert not pieces.apart and not pieces.folds
    assert idfiles.Pieces(TOKENIZER).apart and idfiles.Pieces(TOKENIZER).folds


def test_archives(spark, tmp_path):
    rng = random.Random(2)
    bodies = ["<p>é" + "x" * n for n in (10, 1200, 1200, 5000)] + ["", None, "y" * 999, "z" * 1000, "w" * 200_000]
    rows = [(i if i != 5 else None, rng.choice(["http://a.b/c d\r\nX: 1", "http://é.org/", None]), rng.choice(bodies), "k") for i in range(300)] + [(299, "u", bodies[1], "k")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(4)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    largest = {}
    for i, _, x, _ in rows:
        if len((x or "").encode()) >= 1000 and i is not None:
            largest[x] = max(largest.get(x, -1), i)
    key = lambda r: tuple(map(str, r))
    want = []
    for i, _, x, _ in rows:
        data = (x or "").encode()
        revisit = len(data) >= 1000 and i != largest[x]
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", largest[x] if revisit else None))
    got = [tuple(r) for r in queries.op6_warc(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)

    index = warc.archive(pages)
    some = index.filter("id % 7 = 0").collect()
    for r in some:
        raw = gzip.decompress(files.read_range(r.file, r.offset, r.length))
        assert raw.startswith(b"WARC/1.0\r\nWARC-Type: " + r.record_type.encode()) and raw.endswith(b"\r\n\r\n")
        assert raw.count(b"\r\nX: 1") == 0
    back = warc.read(index.filter("id % 7 = 0")).collect()
    assert sorted(r.id for r in back) == sorted(r.id for r in some)
    assert warc.read(warc.archive(pages.limit(0))).count() == 0
    assert warc.archive(pages).agg(F.sum("length")).first()[0] == sum(len(files.read_all(p)) for (p,) in index.select("file").distinct().collect())


def test_reads_are_coalesced():
    assert warc.coalesced([(0, 10), (10, 5), (20, 5), (20 + 2 * warc.GAP, 7)]) == [(0, 25, [(0, 10), (10, 5), (20, 5)]), (20 + 2 * warc.GAP, 27 + 2 * warc.GAP, [(20 + 2 * warc.GAP, 7)])]
    far = [(i * 1000, 1000) for i in range(20_000)]
    reads = warc.coalesced(far)
    assert max(e - b for b, e, _ in reads) <= warc.READ and sum(len(o) for _, _, o in reads) == len(far)
    assert warc.coalesced([(0, 3 * warc.READ), (3 * warc.READ, 5)])[0][1] == 3 * warc.READ
