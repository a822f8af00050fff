"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Where a text is split before the merges follows from a small automaton. Each code point has a
class (letter, number, blank, other, apostrophe), refined by what comes right after it; each
class maps the automaton's states to states. Such maps compose associatively, and only a few
dozen different ones arise, so the state before every place of a whole batch comes from one
blocked scan with table look-ups, without a regular expression and without a loop over
characters. The slices between boundaries go through a bounded cache of finished merges.

Encoding keeps the byte offset of each token; decoding writes the tokens' bytes to these
offsets in one vectorised step.

The vocabulary is a file of ranks, read on the driver (a few MB, its size is checked) and sent
to the tasks; its path is a parameter.

Cases: null text is encoded as empty, to no tokens; texts of any length are encoded whole, a
longer one than ``CHUNK`` as a chunk of its own; every row is encoded by itself, so ties,
repeated rows and empty tables need no care. Columns to keep are named by the caller; the
result's own names are ``ids``, ``offsets`` and ``decoded``.
"""

from __future__ import annotations

import base64
import heapq
import os
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 250_000
CACHE = 150_000
MAX_VOCABULARY_BYTES = 64_000_000

# The characters with the Unicode property White_Space.
WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, 0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# Letters and numbers (first and last code point) that Unicode 16.0, after which the
# vocabulary's library splits, has beyond the 15.1 of Python's tables.
NEWER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))

LETTER, NUMBER, OTHER, BLANK = range(4)
# symbols: a class with what its right neighbours make of it
S_LETTER, S_NUMBER, S_OTHER, S_SHORT, S_LONG, S_SPACE_BEFORE, S_BLANK_BEFORE, S_BLANK, S_END = range(9)
# states: what the last character has begun
FRESH, WORD, DIGITS, MARKS, SPACE, BLANKS, ONE_LEFT, TWO_LEFT = range(8)
#: Symbol -> (the states in which it continues the token, to which state; the state otherwise).
RULES = {
    S_LETTER: ({WORD: WORD, SPACE: WORD, TWO_LEFT: ONE_LEFT, ONE_LEFT: FRESH}, WORD),
    S_NUMBER: ({DIGITS: DIGITS, SPACE: DIGITS}, DIGITS),
    S_OTHER: ({MARKS: MARKS, SPACE: MARKS}, MARKS),
    S_SHORT: ({MARKS: MARKS, SPACE: MARKS}, ONE_LEFT),  # an apostrophe before s, t, m or d
    S_LONG: ({MARKS: MARKS, SPACE: MARKS}, TWO_LEFT),  # an apostrophe before re, ve or ll
    S_SPACE_BEFORE: ({}, SPACE),  # the last space before something else goes with that
    S_BLANK_BEFORE: ({}, FRESH),  # another last blank stands alone
    S_BLANK: ({BLANKS: BLANKS}, BLANKS),  # a blank with a blank or the end after it
    S_END: ({}, FRESH),
}
N_STATES = 8


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    for newer, kind in ((NEWER_LETTERS, LETTER), (NEWER_NUMBERS, NUMBER)):
        for first, last in newer:
            out[first : last + 1] = kind
    out[list(WHITE)] = BLANK
    return out


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The map of each symbol, the product table of all maps that arise, and what each map does to each state."""
    maps = [tuple(go.get(s, other) for s in range(N_STATES)) for go, other in RULES.values()]
    known = {m: i for i, m in enumerate(dict.fromkeys(maps))}
    queue = list(known)
    for m in queue:  # grows while new products arise
        for step in maps:
            product = tuple(step[s] for s in m)
            if product not in known:
                known[product] = len(known)
                queue.append(product)
    table = np.array([[known[tuple(b[s] for s in a)] for b in known] for a in known], dtype=np.uint16)
    return np.array([known[m] for m in maps], dtype=np.uint16), table, np.array(list(known), dtype=np.uint8)


def states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by a blocked scan over the symbols' maps."""
    of_symbol, product, apply = _monoid()
    n = len(symbols)
    width = max(1, int(np.sqrt(n) / 4))
    rows = -(-n // width)
    padded = np.full(rows * width, S_END, dtype=np.uint8)
    padded[:n] = symbols
    maps = of_symbol[padded].reshape(rows, width).T.astype(np.intp)  # a step of all blocks is a contiguous row
    flat, k = product.ravel(), product.shape[1]
    scanned = np.empty(maps.shape, dtype=np.intp)
    scanned[0] = maps[0]
    for j in range(1, width):
        scanned[j] = flat[scanned[j - 1] * k + maps[j]]
    entry = np.empty(rows, dtype=np.uint8)
    state = FRESH
    for i, m in enumerate(scanned[-1]):  # one step a block
        entry[i] = state
        state = apply[m, state]
    out = np.empty((width, rows), dtype=np.uint8)
    out[0] = entry
    out[1:] = apply[scanned[:-1], entry[None, :]]
    return out.T.ravel()[:n]


def boundaries(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Where tokens begin in the texts, each followed by an end mark, and where each text begins."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begins[1:])
    kind = _classes()[codes]
    after = np.append(codes[1:], 0), np.append(codes[2:], [0, 0])
    end = np.zeros(len(codes), dtype=bool)
    end[begins[1:] - 1] = True
    symbol = np.array([S_LETTER, S_NUMBER, S_OTHER, S_BLANK], dtype=np.uint8)[kind]
    more = np.append(~end[1:] & (kind[1:] != BLANK), False)
    blank = kind == BLANK
    symbol[blank & more] = S_BLANK_BEFORE
    symbol[(codes == 0x20) & more] = S_SPACE_BEFORE
    mark = np.flatnonzero(codes == ord("'"))
    one, two = after[0][mark], after[1][mark[: len(mark)]]
    is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
    symbol[mark[is_(one, "stmd")]] = S_SHORT
    symbol[mark[(is_(one, "rv") & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = S_LONG
    symbol[end] = S_END
    before = states_before(symbol)
    goes_on = np.zeros((len(RULES), N_STATES), dtype=bool)
    for s, (go, _) in RULES.items():
        goes_on[s, list(go)] = True
    return np.flatnonzero(~goes_on[symbol, before]), begins


def read_ranks(path: str) -> dict[bytes, int]:
    """The tokens of a rank file: base64 and rank on each line."""
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the neighbours of lowest rank, the leftmost first, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the two has been merged otherwise since
        alive[j], end[i], nxt[i] = False, stop, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        for a in (prv[i], i):
            if a >= 0 and nxt[a] < n and (r := ranks.get(piece[a : end[nxt[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[nxt[a]]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class Merges(dict):
    """Piece -> its ids as little-endian bytes. When it is full it becomes the old generation, from
    which pieces that come up again are taken over, and the one before that goes."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = np.array(merge(piece.encode("utf-8", "surrogatepass"), self.ranks), dtype="<u4").tobytes()
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


_merges: dict[str, Merges] = {}


def merges_for(key: str, ranks: dict[bytes, int]) -> Merges:
    """The cache of a vocabulary, kept from task to task."""
    if key not in _merges:
        _merges.clear()
        _merges[key] = Merges(ranks)
    return _merges[key]


def encode_texts(texts: Sequence[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and how many each text has."""
    begins, owner = boundaries(texts)
    joined = "\0".join([*texts, ""])
    edges = np.append(begins, len(joined)).tolist()
    where = np.searchsorted(begins, owner).tolist()
    get, ids, counts = merges.__getitem__, [], np.zeros(len(texts), dtype=np.int64)
    for i in range(len(texts)):
        # the last boundary of a text is its end mark
        a, b = where[i], where[i + 1] - 1
        own = b"".join([get(joined[edges[k] : edges[k + 1]]) for k in range(a, b)])
        counts[i] = len(own) // 4
        ids.append(own)
    return np.frombuffer(b"".join(ids), dtype="<u4"), counts


def _parts(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The texts of an Arrow column in chunks of bounded size."""
    begin, held, part = 0, 0, []
    for i, t in enumerate(column):
        t = t.as_py() or ""
        if part and held + len(t) > CHUNK:
            yield begin, part
            begin, held, part = i, 0, []
        part.append(t)
        held += len(t)
    if part:
        yield begin, part


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    edges = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=edges[1:])
    return pa.ListArray.from_arrays(pa.array(edges), pa.array(values.astype(np.int32, copy=False)))


class Vocabulary:
    """The tokens of a rank file, to be shared with tasks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.begin = np.cumsum(self.size) - self.size
        ordered = sorted((r, t) for t, r in ranks.items())
        self.letters = np.frombuffer(b"".join(t for _, t in ordered), dtype=np.uint8)

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte in its text at which each token begins."""
        size = self.size[ids]
        at = np.cumsum(size) - size
        first = np.cumsum(counts) - counts
        base = at[np.minimum(first, max(len(at) - 1, 0))] if len(at) else np.zeros(len(counts), dtype=np.int64)
        return at - np.repeat(base, counts)

    def texts(self, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts' bytes: each token's written at its offset."""
        n = self.size[ids]
        total = np.append(0, np.cumsum(n))
        bounds = np.append(0, np.cumsum(counts))
        start = total[bounds]  # of each text in what is written
        out = np.zeros(int(start[-1]), dtype=np.uint8)
        within = np.arange(len(out)) - np.repeat(total[:-1], n)
        out[np.repeat(offsets + np.repeat(start[:-1], counts), n) + within] = self.letters[np.repeat(self.begin[ids], n) + within]
        whole = out.tobytes()
        return [whole[a:b] for a, b in zip(start.tolist(), start[1:].tolist(), strict=False)]


def _fields(df: DataFrame, keep: Sequence[str], *more: tuple[str, T.DataType]) -> tuple[int, T.StructType]:
    kept = [T.StructField(f.name, f.dataType) for f in df.select(*keep).schema]
    return len(kept), T.StructType([*kept, *[T.StructField(n, t) for n, t in more]])


IDS = T.ArrayType(T.IntegerType())


def _encoder(docs: DataFrame, path: str, text_col: str, keep: Sequence[str], decoded: bool) -> DataFrame:
    ranks = read_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, Vocabulary(ranks)))
    key = f"{path}:{shared._jbroadcast.id()}"
    n, schema = _fields(docs, keep, ("ids", IDS), ("decoded", T.BinaryType()) if decoded else ("offsets", IDS))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, vocabulary = shared.value
        merges = merges_for(key, ranks)
        for batch in batches:
            for begin, texts in _parts(batch.column(n)):
                ids, counts = encode_texts(texts, merges)
                offsets = vocabulary.offsets(ids, counts)
                last = pa.array(vocabulary.texts(ids, offsets, counts), type=pa.binary()) if decoded else _lists(offsets, counts)
                same = [batch.column(i).slice(begin, len(texts)) for i in range(n)]
                yield pa.RecordBatch.from_arrays([*same, _lists(ids, counts), last], names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids`` and ``offsets`` (the byte at which each token begins)."""
    return _encoder(docs, path, text_col, keep, decoded=False)


def round_trip(docs: DataFrame, path: str, *, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``ids`` and ``decoded``, what ``decode`` makes of them, in one pass."""
    return _encoder(docs, path, text_col, keep, decoded=True)


def decode(encoded: DataFrame, path: str, *, keep: Sequence[str] = ("doc_id", "ids")) -> DataFrame:
    """``keep`` columns with ``decoded``: the bytes of the tokens ``ids``, each written at its ``offsets``."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(read_ranks(path)))
    n, schema = _fields(encoded, keep, ("decoded", T.BinaryType()))
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, max(batch.num_rows, 1), 64):
                part = batch.slice(a, 64)
                ids, offsets = part.column(n), part.column(n + 1)
                flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.array(ids.value_lengths().fill_null(0).to_pylist(), dtype=np.int64)
                texts = pa.array(shared.value.texts(flat(ids), flat(offsets), counts), type=pa.binary())
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(n)], texts], names=names)

    return encoded.select(*keep, F.col("ids").alias("__ids"), F.col("offsets").alias("__offsets")).mapInArrow(run, schema)
