"""Alignment of two tokenizers' tokens by a sweep over where they end.

Each text, with a space before it, is cut into tokens by A (a byte-level BPE of the tokenizers
library) and by B (a sentencepiece BPE with byte fallback). The end events of both are united,
dealt out by document and sorted by byte offset within the partitions; a machine walks each
partition and holds no more than the tokens since the last place where both sides ended:

* where both end, a group of A and B tokens closes;
* each place where either ends closes the overlap of one A and one B token, a link; so the
  links of a text are as many as the different ends.

An event row holds a run of ends of one side: the byte offset at which the run begins and the
ids, whose byte lengths give the ends. Runs are short (``RUN``), so long documents come as many rows.

How often each pair of ids is linked is summed over the corpus from the sums that the tasks have
made; the documents' own pairs, written with them, are then looked up. Up to ``most`` different
pairs (16 bytes each) are sent to all tasks; more are joined by a shuffle.

Texts are encoded by pieces that begin with a single blank or line feed between other characters:
there both tokenizers start a token, whatever comes before. The pieces repeat and are cached. That
no token of the vocabularies reaches over such a place is checked when they are loaded; otherwise
whole texts are encoded.

Cases: a text that is null, empty, or whose tokens' bytes on either side aren't those of the
space and the text, has no tokens and is reported with zeros; special tokens' strings are plain
text; every row is a document of its own, known by its place in the input, which must be a stable
one (a table, not the unsorted result of a shuffle); repeated and null ids are kept as they are;
an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.session import cut_lineage, write_and_reread

RUN = 16_384  # tokens of an event row
BATCH = 262_144  # tokens that the machine works on at a time
CACHE = 300_000  # pieces whose tokens are known, in each of two generations
TEXTS = 256  # texts that are looked up together
PARTIAL = 1_000_000  # different pairs that a task sums up before it hands them on
PAIRS = 2_000_000
A, B = 0, 1

#: Before a single blank or line feed between characters that aren't white.
CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
MAX_VOCABULARY_BYTES = 64_000_000

EVENTS = "key long, id long, side int, offset long, void boolean, tokens binary"
SWEPT = "key long, id long, n_a long, n_b long, n_groups long, n_links long, sha string, pairs binary, counts binary"
GROUPS = "key long, id long, group long, begin long, end long, a_ids array<int>, b_ids array<int>, links array<struct<a:int,b:int>>"


def pieces(text: str) -> list[str]:
    """A space and ``text``, cut where both tokenizers begin a token."""
    joined = " " + text
    if "\0" not in text and " ".join(text.split()) == text.replace("\n", " "):
        return joined.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")[1:]
    return CUT.split(joined)


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters
    stand for themselves, the other bytes in order for the letters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b <= 0xFF and b != 0xAD)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder(dict):
    """Piece -> its ids as 16-bit integers, or None where their bytes aren't the piece's."""

    whole = False  # whether texts have to be encoded in one go

    def __init__(self, tokens: Sequence[bytes]):
        super().__init__()
        if len(tokens) > 1 << 16:
            raise ValueError("the ids of this tokenizer need more than 16 bits")
        self.tokens = tokens
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.old: dict[str, bytes | None] = {}

    def ids(self, pieces: list[str]) -> list[list[int]]:
        raise NotImplementedError

    def learn(self, texts: list[list[str]]) -> None:
        wanted = {p for t in texts for p in t}
        if len(self) > CACHE:  # what comes up again is taken over from the old generation
            self.old = dict(self)
            self.clear()
        new = []
        for p in wanted:
            if p not in self:
                if p in self.old:
                    self[p] = self.old[p]
                else:
                    new.append(p)
        token = self.tokens.__getitem__
        for piece, ids in zip(new, self.ids(new), strict=True):
            same = b"".join(map(token, ids)) == piece.encode("utf-8", "surrogatepass")
            self[piece] = np.array(ids, dtype="<u2").tobytes() if same else None

    def encode(self, texts: list[str]) -> list[bytes | None]:
        cut = [[" " + t] if self.whole else pieces(t) for t in texts]
        self.learn(cut)
        get = self.__getitem__
        found = [list(map(get, c)) for c in cut]
        return [None if None in f else b"".join(f) for f in found]


class ByteLevel(Encoder):
    def __init__(self, data: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(data.decode())
        self.library.encode_special_tokens = True
        letters, special = byte_letters(), self.library.get_added_tokens_decoder()
        names = [self.library.id_to_token(i) or "" for i in range(self.library.get_vocab_size())]
        super().__init__([n.encode() if i in special else bytes(letters[c] for c in n) for i, n in enumerate(names)])

    def ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch(pieces, add_special_tokens=False)]


class PieceModel(Encoder):
    """A model that puts a space before a text; a piece's own one is therefore left out."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=data)
        n = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(n)]
        super().__init__([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        self.blank = self.library.piece_to_id("▁")
        self.whole = any(re.search("[^▁]▁|\n", p) for p in names)

    def ids(self, pieces: list[str]) -> list[list[int]]:
        found = self.library.encode([p[1:] if p[0] == " " else p for p in pieces], num_threads=1)
        # what begins with a line feed got the space as a token of its own
        return [ids if p[0] == " " or ids[:1] != [self.blank] else ids[1:] for p, ids in zip(pieces, found, strict=True)]


KINDS: tuple[Callable[[bytes], Encoder], ...] = (ByteLevel, PieceModel)
_loaded: dict[tuple[int, str], Encoder] = {}


def _encoder(side: int, data: bytes) -> Encoder:
    """The encoder of a vocabulary, kept from task to task."""
    key = (side, hashlib.md5(data).hexdigest())
    if key not in _loaded:
        _loaded[key] = KINDS[side](data)
    return _loaded[key]


def _read(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def ends(docs: DataFrame, side: int, data: bytes) -> DataFrame:
    """The end events of one side for ``docs(key, id, text)``. A document that can't be aligned gets
    one row that says so, before all others; A gives it to those without text."""
    shared = docs.sparkSession.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(side, shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                texts = [t.as_py() or "" for t in part.column(2)]
                rows: list[tuple] = []
                for r, (text, ids) in enumerate(zip(texts, encoder.encode(texts), strict=True)):
                    if not text or ids is None:
                        if text or side == A:
                            rows.append((r, -1, True, b""))
                        continue
                    begin = 0
                    for k in range(0, len(ids), 2 * RUN):
                        run_ids = ids[k : k + 2 * RUN]
                        rows.append((r, begin, False, run_ids))
                        if len(ids) > 2 * RUN:
                            begin += int(encoder.size[np.frombuffer(run_ids, dtype="<u2")].sum())
                if rows:
                    which, offset, void, tokens = zip(*rows, strict=True)
                    own = [part.column(c).take(pa.array(which)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays(
                        [*own, pa.array([side] * len(rows), type=pa.int32()), pa.array(offset, type=pa.int64()), pa.array(void), pa.array(tokens, type=pa.binary())],
                        names=["key", "id", "side", "offset", "void", "tokens"],
                    )

    return docs.mapInArrow(run, EVENTS)


class Part:
    """Tokens of one document between two places where both sides end."""

    __slots__ = ("a", "b", "doc", "last")

    def __init__(self, doc: Doc, a: np.ndarray, b: np.ndarray, last: bool):
        self.doc, self.a, self.b, self.last = doc, a, b, last


class Doc:
    """What is known of a document so far."""

    def __init__(self, key: int, id_: int | None):
        self.key, self.id, self.void = key, id_, False
        self.n_a = self.n_b = self.n_groups = self.n_links = self.bytes = 0
        self.sha, self.pairs = hashlib.sha256(), []


def machine(rows: Iterator[tuple], sizes: tuple[np.ndarray, np.ndarray], batch: int) -> Iterator[list[Part]]:
    """Batches of about ``batch`` tokens of the parts of documents, from event rows in order (key, id, side, offset, void, tokens)."""
    out: list[Part] = []
    held = waiting = 0
    doc: Doc | None = None
    tokens: tuple[list, list] = ([], [])

    def close(last: bool) -> None:
        """Move what lies before the last common end, at the end of a document everything."""
        nonlocal tokens, held, waiting
        a, b = (np.concatenate(t) if t else np.zeros(0, "<u2") for t in tokens)
        if not last:
            ea, eb = np.cumsum(sizes[A][a]), np.cumsum(sizes[B][b])
            both = np.intersect1d(ea, eb, assume_unique=True)
            if not len(both):
                return
            na, nb = np.searchsorted(ea, both[-1], "right"), np.searchsorted(eb, both[-1], "right")
            tokens = ([a[na:]], [b[nb:]])
            a, b = a[:na], b[:nb]
        else:
            tokens = ([], [])
        waiting = sum(len(t) for side in tokens for t in side)
        out.append(Part(doc, a, b, last))
        held += len(a) + len(b)

    for key, id_, side, _, void, ids in rows:
        if doc is None or key != doc.key:
            if doc is not None:
                close(True)
            if held >= batch:
                yield out
                out, held = [], 0
            doc = Doc(key, id_)
        doc.void |= void
        if doc.void:
            continue
        tokens[side].append(np.frombuffer(ids, dtype="<u2"))
        waiting += len(ids) // 2
        if waiting >= batch:
            close(False)
            if held >= batch:
                yield out
                out, held = [], 0
    if doc is not None:
        close(True)
        yield out


class Swept:
    """Groups and links of a batch of parts, whose bytes lie on one axis, part after part."""

    def __init__(self, parts: list[Part], sizes: tuple[np.ndarray, np.ndarray]):
        self.a = np.concatenate([p.a for p in parts]).astype(np.int64)
        self.b = np.concatenate([p.b for p in parts]).astype(np.int64)
        ea, eb = np.cumsum(sizes[A][self.a]), np.cumsum(sizes[B][self.b])
        places = np.concatenate([ea, eb])
        order = np.argsort(places, kind="stable")  # two runs in order
        place, from_a = places[order], order < len(ea)
        same = place[1:] == place[:-1]
        first = np.append(True, ~same)[: len(place)]
        at = np.flatnonzero(first)
        #: of each link: where it ends, its tokens' positions, and whether a group ends with it
        self.place = place[at]
        self.link_a = np.cumsum(from_a)[at] - from_a[at]
        self.link_b = at - self.link_a
        self.both = np.append(same, False)[: len(place)][at]
        self.group = np.cumsum(self.both) - self.both
        of_entry = self.group[np.cumsum(first) - 1]
        self.group_a, self.group_b = of_entry[from_a], of_entry[~from_a]
        n = int(self.both.sum())
        self.in_a, self.in_b = np.bincount(self.group_a, minlength=n), np.bincount(self.group_b, minlength=n)
        self.ends = self.place[self.both]
        # bounds of the parts in tokens, links and groups
        self.part_a, self.part_b = np.cumsum([len(p.a) for p in parts]), np.cumsum([len(p.b) for p in parts])
        stop = np.append(0, ea)[self.part_a]
        self.part_end = stop
        self.part_links = np.searchsorted(self.place, stop, "right")
        self.part_groups = np.searchsorted(self.ends, stop, "right")


class Listing:
    """Decimal ids with what follows them, as rows of a table of bytes."""

    def __init__(self, n_a: int, n_b: int):
        self.second = 2 * n_a
        names = [f"{i}{mark}".encode() for n, last in ((n_a, "|"), (n_b, ";")) for i in range(n) for mark in (",", last)]
        self.length = np.array([len(x) for x in names], dtype=np.int64)
        self.wide = max(map(len, names), default=1)
        self.table = np.frombuffer(b"".join(x.ljust(self.wide, b"\0") for x in names), dtype=np.uint8).reshape(-1, self.wide)

    def text(self, s: Swept) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` of all groups, and where each part's text ends."""
        last_a, last_b = (np.append(g[1:] != g[:-1], True)[: len(g)] for g in (s.group_a, s.group_b))
        rows = np.empty(len(s.a) + len(s.b), np.int64)
        rows[np.arange(len(s.a)) + (np.cumsum(s.in_b) - s.in_b)[s.group_a]] = 2 * s.a + last_a
        rows[np.arange(len(s.b)) + np.cumsum(s.in_a)[s.group_b]] = self.second + 2 * s.b + last_b
        stops = np.append(0, np.cumsum(self.length[rows]))[s.part_a + s.part_b]
        return self.table[rows].tobytes().translate(None, b"\0"), stops


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(codes, kind="stable")
    codes, counts = codes[by], counts[by]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
    return codes[starts], np.add.reduceat(counts, starts) if len(starts) else counts


_NAMES = [c.split()[0] for c in SWEPT.split(", ")]
_KINDS = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def digests(batches: Iterator[list[Part]], sizes: tuple[np.ndarray, np.ndarray], partial: int) -> Iterator[pa.RecordBatch]:
    """A row per document with its counts, digest and pairs; and rows without key with the task's pairs."""
    listing = Listing(len(sizes[A]), len(sizes[B]))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n_held = 0

    def handed_on() -> Iterator[pa.RecordBatch]:
        codes, counts = _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        for k in range(0, len(codes), partial // 4):
            some = slice(k, k + partial // 4)
            yield _rows([(None, None, 0, 0, 0, 0, None, codes[some].astype("<u4").tobytes(), counts[some].astype("<i8").tobytes())])

    for parts in batches:
        s = Swept(parts, sizes)
        text, stops = listing.text(s)
        owner = np.repeat(np.arange(len(parts), dtype=np.uint64), np.diff(s.part_links, prepend=0))
        codes = np.sort((owner << np.uint64(32)) | (s.a[s.link_a].astype(np.uint64) << np.uint64(16)) | s.b[s.link_b].astype(np.uint64))
        starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])[: len(codes)])
        counts = np.diff(np.append(starts, len(codes)))
        codes = codes[starts]
        bounds = np.searchsorted(codes, np.arange(1, len(parts) + 1, dtype=np.uint64) << np.uint64(32))
        codes = codes.astype(np.uint32)
        out, t0, c0, l0, g0 = [], 0, 0, 0, 0
        for p, t1, c1, l1, g1 in zip(parts, stops.tolist(), bounds.tolist(), s.part_links.tolist(), s.part_groups.tolist(), strict=True):
            d = p.doc
            if len(p.a) and not d.void:
                if d.n_a:
                    d.sha.update(b";")
                d.sha.update(text[t0 : t1 - 1])
                d.n_a, d.n_b, d.n_links, d.n_groups = d.n_a + len(p.a), d.n_b + len(p.b), d.n_links + l1 - l0, d.n_groups + g1 - g0
                d.pairs.append((codes[c0:c1], counts[c0:c1]))
            if p.last:
                own = d.pairs[0] if len(d.pairs) == 1 else _summed(*(np.concatenate(x) for x in zip(*d.pairs, strict=True))) if d.pairs else (codes[:0], counts[:0])
                out.append((d.key, d.id, d.n_a, d.n_b, d.n_groups, d.n_links, d.sha.hexdigest() if d.n_a else "", *packed(*own)))
            t0, c0, l0, g0 = t1, c1, l1, g1
        held.append((codes, counts))
        n_held += len(codes)
        if out:
            yield _rows(out)
        if n_held >= 4 * partial:
            held = [_summed(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            n_held = len(held[0][0])
            if n_held >= partial:
                yield from handed_on()
                held, n_held = [], 0
    if n_held:
        yield from handed_on()


def packed(codes: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """A document's pairs: steps between the codes, and counts of a byte each with the larger ones behind."""
    small = np.minimum(counts, 255).astype(np.uint8)
    return np.diff(codes, prepend=codes[:0].dtype.type(0)).astype("<u4").tobytes(), small.tobytes() + counts[counts >= 255].astype("<u4").tobytes()


def unpacked(pairs: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    codes = np.cumsum(np.frombuffer(pairs, dtype="<u4"), dtype=np.int64)
    n = np.frombuffer(counts, dtype=np.uint8)[: len(codes)].astype(np.int64)
    n[n == 255] = np.frombuffer(counts[len(codes) :], dtype="<u4")
    return codes, n


def group_rows(batches: Iterator[list[Part]], sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row per group."""
    for parts in batches:
        s = Swept(parts, sizes)
        lists = lambda values, n: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), values)
        before_a, before_b = np.cumsum(s.in_a) - s.in_a, np.cumsum(s.in_b) - s.in_b
        pairs = pa.StructArray.from_arrays([pa.array((x - before[s.group]).astype(np.int32)) for x, before in ((s.link_a, before_a), (s.link_b, before_b))], names=["a", "b"])
        n_part = np.diff(s.part_groups, prepend=0)
        part = np.repeat(np.arange(len(parts)), n_part)
        number, base, g0, e0 = [], [], 0, 0
        for p, g1, e1 in zip(parts, s.part_groups.tolist(), s.part_end.tolist(), strict=True):
            number.append(p.doc.n_groups - g0)
            base.append(p.doc.bytes - e0)
            p.doc.n_groups, p.doc.bytes = p.doc.n_groups + g1 - g0, p.doc.bytes + e1 - e0
            g0, e0 = g1, e1
        begin, end = np.append(0, s.ends[:-1])[: len(s.ends)], s.ends
        shift = np.array(base, dtype=np.int64)[part]
        columns = [
            pa.array(np.array([p.doc.key for p in parts], dtype=np.int64)[part]), pa.array([p.doc.id for p in parts], type=pa.int64()).take(pa.array(part)),
            pa.array(np.arange(len(s.ends)) + np.array(number, dtype=np.int64)[part]), pa.array(begin + shift), pa.array(end + shift),
            lists(pa.array(s.a.astype(np.int32)), s.in_a), lists(pa.array(s.b.astype(np.int32)), s.in_b), lists(pairs, np.bincount(s.group, minlength=len(s.ends))),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in GROUPS.split(", ")])


def _sweep(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, work: Callable, schema: str, batch: int) -> DataFrame:
    data = _read(path_a), _read(path_b)
    shared = docs.sparkSession.sparkContext.broadcast(data)
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    events = ends(keyed, A, data[A]).unionByName(ends(keyed, B, data[B]))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.repartition(parts, "key").sortWithinPartitions("key", "offset", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = tuple(_encoder(side, d).size for side, d in enumerate(shared.value))
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield from work(machine(rows, sizes, batch), sizes)

    return dealt.mapInArrow(run, schema)


def groups(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH) -> DataFrame:
    """A row per group: its place among its document's groups, its bytes in the space and the text, the
    ids of both sides, and its links as positions in these."""
    return _sweep(docs, path_a, path_b, id_col, text_col, group_rows, GROUPS, batch).drop("key")


def _pairs(rows: DataFrame) -> DataFrame:
    """``a, b, n`` of the tasks' sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pairs, counts in zip(batch.column(0), batch.column(1), strict=True):
                codes = np.frombuffer(pairs.as_buffer(), dtype="<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(np.frombuffer(counts.as_buffer(), dtype="<i8"))], names=["code", "n"])

    return rows.select("pairs", "counts").mapInArrow(run, "code long, n long")


def pair_counts(swept: DataFrame) -> DataFrame:
    """``code, n, best``: how many links hold a pair of ids, and whether none of its B id's pairs has more."""
    counts = cut_lineage(_pairs(swept.filter(F.col("key").isNull())).groupBy("code").agg(F.sum("n").alias("n")))
    b = F.col("code").bitwiseAND(F.lit(0xFFFF))
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return cut_lineage(counts.withColumn("b", b).join(most, "b").select("code", "n", (F.col("n") == F.col("most")).alias("best")))


def align(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", batch: int = BATCH, partial: int = PARTIAL, most: int = PAIRS) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    swept = write_and_reread(_sweep(docs, path_a, path_b, id_col, text_col, functools.partial(digests, partial=partial), SWEPT, batch), "alignment")
    counts = pair_counts(swept)
    own = swept.filter(F.col("key").isNotNull())
    kept = ["id", "n_a", "n_b", "n_groups", "n_links"]
    if counts.count() > most:
        return _joined(own, counts, kept)
    shared = docs.sparkSession.sparkContext.broadcast(_table(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = shared.value
        for batch in batches:
            n_best, total = [], []
            for pairs, counts in zip(batch.column(6), batch.column(7), strict=True):
                codes, own = unpacked(pairs.as_py(), counts.as_py())
                at = np.searchsorted(known, codes)
                n_best.append(int((own * best[at]).sum()))
                total.append(int((own * n[at]).sum()))
            more = [pa.array(n_best, type=pa.int64()), pa.array(total, type=pa.int64()), batch.column(5)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *more], names=[*kept, "n_best", "count_sum", "groups_sha256"])

    schema = ", ".join(f"{c} long" for c in [*kept, "n_best", "count_sum"]) + ", groups_sha256 string"
    return own.select(*kept, "sha", "pairs", "counts").mapInArrow(run, schema)


def _table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The counted pairs, of which there are few, as arrays in order."""
    t = counts.toArrow()
    codes = t["code"].to_numpy()
    by = np.argsort(codes)
    return codes[by], t["n"].to_numpy()[by], t["best"].to_numpy(zero_copy_only=False).astype(bool)[by]


def _joined(own: DataFrame, counts: DataFrame, kept: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, pairs, n in zip(*batch.columns, strict=True):
                codes, own_n = unpacked(pairs.as_py(), n.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), key.as_py())), pa.array(codes), pa.array(own_n)], names=["key", "code", "own"])

    each = own.select("key", "pairs", "counts").mapInArrow(run, "key long, code long, own long").join(counts, "code")
    sums = each.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("own")).otherwise(0)).alias("n_best"), F.sum(F.col("own") * F.col("n")).alias("count_sum"))
    d = own.join(sums, "key", "left")
    return d.select(*kept, F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), F.col("sha").alias("groups_sha256"))
