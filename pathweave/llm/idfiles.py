"""Token ids in binary files: documents by ascending id, ids coded by a context-mixing range coder.

Writing deals the documents out by ranges of their id, so that file k holds ids above those of
file k - 1; each task encodes its documents with the tokenizers library and codes the ids in
groups of bounded size. A file is a magic number, the blocks of ``rangecoder`` one after the
other, a compressed table of documents (id, number of ids) and a trailer with the table's
place. It gets its name when it is whole, and it counts once the task's row stands in the
manifest, a table that Spark commits; what a lost task leaves behind is in no manifest.

Reading takes the manifest, reads and decodes each file, checks the blocks' checksums, and
gives each document's place in the whole sequence of ids.

White space never belongs to a token of this kind of tokenizer (it splits there before its
merges), so texts are split between blanks by Arrow, a chunk of them at a time, and the library
sees each distinct piece that it has not seen lately. A word of plain letters, which normalisation
and its splitting leave alone, goes to the library's model as it is. ``by_pieces=False`` gives
it whole texts, and a tokenizer that isn't of this kind gets them whole as well. The strings of
special tokens in a text become these tokens, as the library's plain call has it.

Cases: null or empty text is the end id alone; documents with equal ids follow each other by
text; a null document id comes first and is read back as null; an empty table gives no files
and an empty result; only the named columns are read.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pathweave.llm import files
from pathweave.llm.rangecoder import BLOCK, LANES, decode_blocks, encode_blocks
from pathweave.session import scratch_path, write_and_reread

MAGIC = b"PWIDS\0\0\2"
TAIL = struct.Struct("<QQQ")  # where the table begins, its compressed length, documents
NO_ID = -(2**63)
BASE = 300_000
CHUNK = 8 << 20  # bytes of text that are split at once
MARK = "\0"
#: Letters that lower case maps one to one and normalisation leaves alone, then ASCII marks but the apostrophe.
LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}"
PLAIN = rf"^(?P<word>[{LETTERS}]+)(?P<marks>[!-&(-/:-@\[-`{{-~]*)$"
#: These letters in lower case.
LOWER = [chr(c) for c in (*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100))]


def gathered(flat: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``chosen`` of runs that lie one after the other in ``flat``, and their lengths."""
    ends = np.cumsum(lengths)
    own = lengths[chosen]
    shift = (ends - lengths)[chosen] - (np.cumsum(own) - own)
    return flat[np.repeat(shift, own) + np.arange(own.sum())], own


class Pieces:
    """Texts to ids as 16-bit integers, by their pieces between blanks; each distinct piece of a chunk is encoded once."""

    def __init__(self, path: str):
        self.base: dict[str, bytes] = {"": b""}
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the ids of this tokenizer need more than 16 bits")
        one, other = self.whole("Ab"), self.whole("c")
        #: whether blanks only divide; whether capitals don't count
        self.apart = self.whole(f" Ab \t{MARK}\n c ") == one + self.whole(MARK) + other and len(self.whole(MARK)) == 2
        self.folds = one == self.whole("ab")
        self.mark = int(np.frombuffer(self.whole(MARK), dtype="<u2")[0]) if self.apart else -1
        #: how the model spells letters; whether a lower-case word is one call of the model
        self.spelt: dict[int, str] = {}
        self.direct = False
        if self.apart and self.folds and self.tokenizer.pre_tokenizer:
            self.spelt = {ord(c): "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(c)) for c in LOWER}
            probes = ["".join(LOWER), *("".join(LOWER[k : k + n]) for n in (1, 2, 5) for k in range(len(LOWER)))]
            self.learn_words(probes)
            self.direct = all(self.base[p] == self.whole(p) for p in probes)
            self.base = {"": b""}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def learn(self, new: list[str]) -> None:
        """The ids of other parts of pieces, many as one text.

        A character that none of these holds stands between them as a token of its own.
        """
        base = self.base
        for piece in [p for p in new if MARK in p]:
            base[piece] = self.whole(piece)
        plain = [p for p in new if MARK not in p]
        for a in range(0, len(plain), 2048):
            some = plain[a : a + 2048]
            ids = np.array(self.tokenizer.encode(f" {MARK} ".join([*some, ""]), add_special_tokens=False).ids, dtype="<u2")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(some):
                raise ValueError("the mark between pieces isn't a token of its own")
            raw, begin = ids.tobytes(), 0
            for piece, end in zip(some, ends.tolist(), strict=True):
                base[piece] = raw[2 * begin : 2 * end]
                begin = end + 1

    def learn_words(self, new: list[str]) -> None:
        """The ids of words of ``LOWER`` letters, which normalisation and splitting leave alone."""
        model, spelt = self.tokenizer.model.tokenize, self.spelt
        for a in range(0, len(new), 2048):
            some = new[a : a + 2048]
            tokens = [model(w if w.isascii() else w.translate(spelt)) for w in some]
            raw = np.array([t.id for own in tokens for t in own], dtype="<u2").tobytes()
            ends = [2 * n for n in accumulate(map(len, tokens))]
            self.base.update(zip(some, [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)], strict=True))

    def known(self, words: pa.Array, others: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all of ``words``, then of all ``others``, and how many each has."""
        both = [a.to_numpy(zero_copy_only=False).tolist() for a in (words, others)]
        parts = both[0] + both[1]
        codes = list(map(self.base.get, parts))
        unknown = [k for k, c in enumerate(codes) if c is None]
        if len(self.base) + len(unknown) > BASE:  # what has come up again stays
            self.base = {"": b""} | {p: c for p, c in zip(parts, codes, strict=True) if c is not None}
        simple = bisect_left(unknown, len(both[0])) if self.direct else 0
        self.learn_words([parts[k] for k in unknown[:simple]])
        self.learn([parts[k] for k in unknown[simple:]])
        for k in unknown:
            codes[k] = self.base[parts[k]]
        return np.frombuffer(b"".join(codes), dtype="<u2"), np.fromiter(map(len, codes), np.int64, len(codes)) // 2

    def distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces one after the other, and how many each has."""
        if not self.folds:
            return self.known(pa.array([], pa.string()), pieces)
        # a plain word with marks behind it is split before its merges, and capitals don't count
        parts = pc.extract_regex(pieces, PLAIN)
        plain = parts.is_valid()
        words = pc.utf8_lower(pc.struct_field(parts, "word")).filter(plain).dictionary_encode()
        others = pa.chunked_array([pc.struct_field(parts, "marks").filter(plain), pieces.filter(pc.invert(plain))]).combine_chunks().dictionary_encode()
        flat, lengths = self.known(words.dictionary, others.dictionary)
        word, other = words.indices.to_numpy(), others.indices.to_numpy() + len(words.dictionary)
        # two parts a piece: a word and its marks, or nothing and the whole
        order = np.full((len(pieces), 2), len(lengths))
        whole = plain.to_numpy(zero_copy_only=False)
        order[whole, 0], order[whole, 1], order[~whole, 1] = word, other[: len(word)], other[len(word) :]
        got, own = gathered(flat, np.append(lengths, 0), order.ravel())
        return got, own.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and how many each text has."""
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        pieces = split.flatten().dictionary_encode()
        ids, own = gathered(*self.distinct(pieces.dictionary), pieces.indices.to_numpy())
        ends = np.append(0, np.cumsum(own))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, np.diff(ends)


_pieces: dict[str, Pieces] = {}


def _tokenizer(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def file_bytes(groups: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], stats: dict) -> Iterator[bytes]:
    """The parts of one file from groups of (document ids, how many ids each has, their ids)."""
    at = len(MAGIC)
    yield MAGIC
    table, waiting, held = [], [], 0

    def coded(n: int) -> Iterator[bytes]:
        nonlocal waiting, held
        ids = np.concatenate([*waiting, np.zeros(0, np.uint16)])
        yield from encode_blocks(ids[:n])
        waiting, held = [ids[n:].copy()], len(ids) - n

    for docs, lengths, ids in groups:
        table.append(np.array([docs, lengths], dtype="<i8"))
        waiting.append(ids)
        held += len(ids)
        while held >= BLOCK * LANES:
            for part in coded(BLOCK * LANES):
                at += len(part)
                yield part
    for part in coded(held):
        at += len(part)
        yield part
    rows = np.concatenate(table, axis=1) if table else np.zeros((2, 0), dtype="<i8")
    packed = zlib.compress(rows.tobytes(), 1)
    yield packed
    yield TAIL.pack(at, len(packed), rows.shape[1])
    stats |= {"documents": rows.shape[1], "ids": int(rows[1].sum())}


def file_documents(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """The documents of a file, in order, with their ids."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a file of token ids")
    at, size, n = TAIL.unpack(data[-TAIL.size :])
    rows = np.frombuffer(zlib.decompress(data[at : at + size]), dtype="<i8").reshape(2, n)
    groups = decode_blocks(data[len(MAGIC) : at])
    held = np.zeros(0, np.uint32)
    for doc, count in zip(*rows.tolist(), strict=True):
        parts = [held]
        have = len(held)
        while have < count:
            more = next(groups)
            parts.append(more)
            have += len(more)
        held = np.concatenate(parts) if len(parts) > 1 else held
        yield doc, held[:count]
        held = held[count:]


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have up to ``CHUNK`` bytes together; a longer text is a run of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        before = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        yield a, b
        a = b


def write(docs: DataFrame, folder: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, by_pieces: bool = True, n_files: int | None = None) -> DataFrame:
    """Write the files; returns the manifest: ``file_no, path, documents, ids, bytes``."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n_files = n_files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.repartitionByRange(n_files, F.col("id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _tokenizer(tokenizer)

        def groups() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for batch in batches:
                docs = batch.column("id").fill_null(NO_ID).to_numpy()
                texts = batch.column("text")
                for a, b in chunks(texts):
                    some = texts.slice(a, b - a)
                    if by_pieces and pieces.apart:
                        ids, lengths = pieces.encode(some)
                    else:
                        codes = [pieces.whole(t) for t in some.to_pylist()]
                        ids, lengths = np.frombuffer(b"".join(codes), dtype="<u2"), np.array([len(c) // 2 for c in codes])
                    yield docs[a:b], lengths + 1, np.insert(ids, np.cumsum(lengths), end_id)

        number = TaskContext.get().partitionId()
        stats: dict = {}
        path = f"{folder}/ids-{number:06d}-{uuid.uuid4().hex}.bin"
        size = files.write_bytes(path, file_bytes(groups(), stats))
        if stats["documents"]:
            row = {"file_no": number, "path": path, "documents": stats["documents"], "ids": stats["ids"], "bytes": size}
            types = pa.schema([("file_no", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
            yield pa.RecordBatch.from_pylist([row], types)

    manifest = d.mapInArrow(run, "file_no int, path string, documents long, ids long, bytes long")
    return write_and_reread(manifest, "id-manifest")


def read(manifest: DataFrame) -> DataFrame:
    """A row per document of the files: ``id, start, n_tokens, ids_crc32``."""
    # a row per file: its order needs one small partition
    before = F.sum("ids").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("ids")
    placed = manifest.select("path", before.alias("base"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                rows, start = [], int(base)
                for doc, ids in file_documents(files.read_all(path)):
                    rows.append((None if doc == NO_ID else doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                out = pd.DataFrame(rows, columns=["id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"id": "Int64"})

    n = max(1, manifest.count())
    return placed.repartition(n, "path").mapInPandas(run, "id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write ``docs`` to a fresh folder in the shared one and read the files back."""
    return read(write(docs, scratch_path(docs.sparkSession, "token-ids"), tokenizer, **options))
