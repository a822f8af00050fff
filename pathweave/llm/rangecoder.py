"""A context-mixing range coder for token ids.

Ids are coded in blocks that know nothing of each other: contexts start anew and each block has
its own checksum. So many blocks can be coded in step, a numpy vector over the blocks taking
the place of a loop over ids; ``LANES`` blocks at a time keep memory bounded.

Within a block three contexts predict the next id: order 2 and order 1 by the id that followed
the same two or one ids last, order 0 by the id that leads the block's count. Each has a
confidence, from how often it has been right. The prediction of the highest confident order is
put to the test: what the three say for or against it is mixed in the logistic domain, and the
outcome is range-coded with the mixed probability. The weights of the mix are learned from the
outcomes of all blocks coded in step and stand in each block's head, so that a step looks its
probability up. An id that was not predicted follows in the block's second stream: its bit
length, by a prefix code that is learned and stated likewise, and its remaining bits.

A block is a head of little-endian numbers (ids, range-coded words, words of the second stream,
crc32 of the ids, four weights, the lengths of the prefix code in half bytes) and then the 16-bit
words of both streams.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np

BLOCK = 2048
LANES = 3072
HEAD = struct.Struct("<IIII4h9s")

_U = np.uint64
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 40)
_BITS = 12  # of a probability
_SLOTS1, _SLOTS2 = 10, 11  # bits of a context's hash
_KINDS = 18  # bit lengths 0 to 17: ids below 131072
_SURE = 7  # the highest confidence, in the low bits of a table entry
_LONGEST = 12  # of a prefix

#: A table entry is its order, id and confidence, so that the largest is that of the highest order; none is 0.
_ORDER = np.array([[0], [1 << 28], [2 << 28]], np.int32)
_ENTRY = np.int32((1 << 20) - 1)
_OTHER = np.int32(_SURE + 1)
#: The confidence that follows each one if the id was right, and then that of an id that replaces another, in three bits each.
_NEXT = np.int32(sum(c << 3 * k for k, c in enumerate((1, 2, 3, 4, 5, 6, 7, 7, 1))))

#: All that a step's mix depends on: for orders 0 and 1, by which bits their confidence differs from that of
#: the prediction (``_OTHER`` if they say another id), then its confidence and its order.
_STATES = np.arange(3 << 11)
_DIFFERS = [_STATES & 15, _STATES >> 4 & 15]
_HAS, _OF = _STATES >> 8 & 7, _STATES >> 11
#: What a context of each confidence says for its id, and against another one, in log-odds.
_FOR = np.array([-900, -300, 0, 200, 350, 450, 550, 700]) / 256
_AGAINST = -500 / 256
#: The inputs of the mix in each state, the last one constant.
_INPUTS = np.stack([*(np.where(d < _OTHER, _FOR[(d ^ _HAS) & _SURE], _AGAINST) for d in _DIFFERS), np.where(_OF == 2, _FOR[_HAS], _AGAINST), np.ones(len(_STATES))], axis=1)


def _mixed(weights: np.ndarray) -> np.ndarray:
    """The probability of each state, of 2^12, under four weights in 1/4096."""
    log_odds = np.clip((_INPUTS * 256).astype(np.int64) @ weights.astype(np.int64) >> 12, -2048, 2047)
    return _SQUASH[log_odds + 2048]


_SQUASH = np.clip(np.round((1 << _BITS) / (1 + np.exp(-(np.arange(-2048, 2048)) / 256))), 8, (1 << _BITS) - 8).astype(_U)


def _learned(seen: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Weights of the mix from how often each state was seen and how often its prediction was right."""
    own = np.flatnonzero(seen)
    inputs, seen, right = _INPUTS[own], seen[own], right[own]
    weights = np.array([0.3, 0.3, 0.3, 0.0])
    for _ in range(12):  # Newton's steps of a logistic regression
        p = 1 / (1 + np.exp(-np.clip((inputs * weights).sum(axis=1), -8, 8)))
        slope = (inputs * (right - seen * p)[:, None]).sum(axis=0) - 0.01 * weights
        bend = np.einsum("s,si,sj->ij", seen * p * (1 - p), inputs, inputs) + 0.01 * np.eye(4)
        weights = np.clip(weights + np.clip(np.linalg.solve(bend, slope), -1, 1), -7.9, 7.9)
    return np.round(weights * 4096).astype("<i2")


def _prefix_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a prefix code (Huffman's) for all kinds, at most ``_LONGEST``."""
    least = int(counts.sum()) // 300 + 1  # the rarest kinds have the longest prefixes
    while True:
        heap = [(max(int(c), least), k, [k]) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        lengths = np.zeros(_KINDS, np.int64)
        while len(heap) > 1:
            (a, k, some), (b, _, more) = heapq.heappop(heap), heapq.heappop(heap)
            lengths[some + more] += 1
            heapq.heappush(heap, (a + b, k, some + more))
        if lengths.max() <= _LONGEST:
            return lengths
        least *= 2


def _prefixes(lengths: np.ndarray) -> np.ndarray:
    """The code of each kind, by length and kind in ascending order, in the high of ``_LONGEST`` bits."""
    room = 1 << np.maximum(_LONGEST - lengths, 0)
    order = np.lexsort((np.arange(_KINDS), lengths))
    ends = np.cumsum(room[order])
    starts = np.zeros(_KINDS, np.int64)
    starts[order] = ends - room[order]
    return starts


def _nibbles(lengths: np.ndarray) -> bytes:
    return (lengths[0::2] | lengths[1::2] << 4).astype(np.uint8).tobytes()


def _from_nibbles(raw: bytes) -> np.ndarray:
    both = np.frombuffer(raw, np.uint8).astype(np.int64)
    return np.stack([both & 15, both >> 4], axis=1).ravel()


#: Bits that follow each bit length: all but the leading one; and that one.
_EXTRA = np.maximum(np.arange(_KINDS) - 1, 0)
_LEADING = np.where(np.arange(_KINDS) > 0, 1 << _EXTRA, 0)
_KIND = np.frexp(np.arange(1 << _KINDS - 1, dtype=np.float32))[1].astype(np.int8)


class _Contexts:
    def __init__(self, n: int):
        lane = np.arange(n)  # indices are of numpy's own index type, which saves a copy at each use
        self.base1, self.base2 = lane << _SLOTS1, lane << _SLOTS2
        self.table1, self.table2 = np.zeros(n << _SLOTS1, np.int32), np.zeros(n << _SLOTS2, np.int32)
        self.entries = np.zeros((3, n), np.int32)  # of each order; that of order 0 stays here
        self.at1, self.at2 = self.base1, self.base2
        self.product = np.zeros(n, np.int64)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The id to test and the state of the mix."""
        entries = self.entries
        self.table1.take(self.at1, out=entries[1], mode="clip")
        self.table2.take(self.at2, out=entries[2], mode="clip")
        state = np.maximum(entries[0], entries[1])
        np.maximum(state, entries[2], out=state)
        chosen = state & _ENTRY
        state &= ~_ENTRY
        state >>= 17
        state |= (chosen & _SURE) << 8
        differs = entries[:2] & _ENTRY
        differs ^= chosen
        np.minimum(differs, _OTHER, out=differs)
        state |= differs[0]
        state |= differs[1] << 4
        chosen >>= 3
        return chosen, state

    def learn(self, ids: np.ndarray) -> None:
        """Take note of the ids that came, as 64-bit integers: a context that was right becomes surer, another takes the new id."""
        fresh = (ids.astype(np.int32) << 3) | _ORDER
        after = self.entries
        after ^= fresh
        np.minimum(after, _OTHER, out=after)
        after *= np.int32(3)
        np.right_shift(_NEXT, after, out=after)
        after &= _SURE
        after |= fresh
        self.table1[self.at1] = after[1]
        self.table2[self.at2] = after[2]
        product = ids * 40503
        at2 = self.product
        at2 ^= product
        at2 >>= 3
        at2 &= (1 << _SLOTS2) - 1
        at2 += self.base2
        at1 = product >> 4
        at1 &= (1 << _SLOTS1) - 1
        at1 += self.base1
        product *= 5
        self.at1, self.at2, self.product = at1, at2, product


def _settle(low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """The lanes whose leading word is certain, or made so where the span has become too small."""
    may = np.flatnonzero(span <= _TOP)
    some, wide = low.take(may), span.take(may)
    done = (some ^ (some + (wide - _U(1)))) < _TOP
    small = ~done & (wide < _BOTTOM)
    if small.any():
        span[may[small]] = (~some[small] + _U(1)) & (_BOTTOM - _U(1))
        done |= small
    return may[done]


def _grown(span: np.ndarray) -> np.ndarray:
    """A span after its lanes' leading word has gone; less by one, as a whole one of 2^64 can't be held."""
    return ((span - _U(1)) << _U(16)) + _U(0xFFFF)


def encode_blocks(ids: np.ndarray) -> Iterator[bytes]:
    """The blocks of a one-dimensional array of ids below 131072."""
    for begin in range(0, len(ids), BLOCK * LANES):
        part = ids[begin : begin + BLOCK * LANES].astype(np.int32)
        n = -(-len(part) // BLOCK)
        width = min(BLOCK, len(part))
        table = np.zeros((n, width), np.int32)
        table.ravel()[: len(part)] = part
        counts = np.full(n, width)
        counts[-1] = len(part) - (n - 1) * width
        states, hits = _outcomes(np.ascontiguousarray(table.T))
        seen = np.bincount(states.ravel(), minlength=len(_STATES))
        right = np.bincount(states[hits], minlength=len(_STATES))
        weights = _learned(seen, right)
        words, used = _range_coded(_mixed(weights), states, hits)
        lengths, rest = _rest_coded(table, ~np.ascontiguousarray(hits.T))
        raw = table.astype("<u4")
        for i in range(n):
            own = raw[i, : counts[i]].tobytes()
            head = HEAD.pack(counts[i], used[i], len(rest[i]), zlib.crc32(own), *weights.tolist(), _nibbles(lengths))
            yield head + words[i, : used[i]].tobytes() + rest[i].tobytes()


def _outcomes(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each step and lane the state of the mix, and whether the id was the one tested."""
    steps, n = columns.shape
    contexts = _Contexts(n)
    states, hits = np.empty((steps, n), np.int16), np.empty((steps, n), bool)
    for step, ids in enumerate(columns):
        chosen, state = contexts.predict()
        states[step] = state
        np.equal(chosen, ids, out=hits[step])
        contexts.learn(ids.astype(np.int64))
    return states, hits


def _range_coded(mixed: np.ndarray, states: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    steps, n = states.shape
    low, span = np.zeros(n, _U), np.full(n, 2**64 - 1, _U)
    room = steps + 4  # a step settles one word at most
    out, used = np.zeros(n * room, "<u2"), np.arange(n) * room
    for state, hit in zip(states, hits, strict=True):
        cut = (span >> _U(_BITS)) * mixed.take(state)
        low += cut * (~hit).astype(_U)
        span = np.where(hit, cut, span - cut)
        if len(go := _settle(low, span)):
            word = low.take(go)
            at = used.take(go)
            out[at] = word >> _U(48)
            used[go] = at + 1
            low[go] = word << _U(16)
            span[go] = _grown(span.take(go))
    for shift in (48, 32, 16, 0):
        out[used] = low >> _U(shift) & _U(0xFFFF)
        used += 1
    return out.reshape(n, room), used - np.arange(n) * room


def _rest_coded(table: np.ndarray, missed: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids that were not predicted: lengths of the prefixes, and the second stream of each block."""
    kinds = _KIND.take(table)
    lengths = _prefix_lengths(np.bincount(kinds[missed], minlength=_KINDS))
    sizes = lengths + _EXTRA  # at most 28 bits
    # the prefix takes the place of the leading one
    instead = (_prefixes(lengths) >> _LONGEST - lengths << _EXTRA) - _LEADING
    out = []
    for a in range(0, len(table), 64):  # few at a time stay in the cache
        some = missed[a : a + 64]
        kind = kinds[a : a + 64][some]
        code = table[a : a + 64][some] + instead.take(kind)
        size = sizes.take(kind)
        ends = np.cumsum(size)
        last = np.append(0, ends)[np.cumsum(some.sum(axis=1))]
        bits = np.diff(last, prepend=0)
        # each block begins at a word of 32 bits, and a code touches two at most
        begin = np.append(0, np.cumsum(bits + 31 >> 5))
        at = ends - size + np.repeat(begin[:-1] * 32 - (last - bits), some.sum(axis=1))
        code <<= 64 - size - (at & 31)
        code, at = code.view(_U), at >> 5
        # no two codes share a bit, so that sums join them
        wide = sum(np.bincount(at + k, weights=half, minlength=begin[-1] + 1)[: begin[-1] + 1] for k, half in enumerate((code >> _U(32), code & _U(0xFFFFFFFF))))
        wide = wide.astype(np.uint32)
        words = np.stack([wide >> 16, wide & 0xFFFF], axis=1).astype("<u2")
        out += [words[i:j].ravel() for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    return lengths, out


def decode_blocks(data: bytes) -> Iterator[np.ndarray]:
    """The ids of consecutive blocks, in groups of up to ``LANES`` blocks; raises on a bad checksum."""
    heads, at = [], 0
    while at < len(data):
        head = HEAD.unpack_from(data, at)
        heads.append((*head[:4], head[4:8], head[8], at + HEAD.size))
        at += HEAD.size + 2 * (head[1] + head[2])
    for begin in range(0, len(heads), LANES):
        group = heads[begin : begin + LANES]
        words = np.zeros((len(group), max(h[1] for h in group) + 8), np.uint16)
        rest = np.zeros((len(group), max(h[2] for h in group) + 4), np.uint16)
        for i, (_, w, r, _, _, _, where) in enumerate(group):
            words[i, :w] = np.frombuffer(data, "<u2", w, where)
            rest[i, :r] = np.frombuffer(data, "<u2", r, where + 2 * w)
        whole = _decode(words, rest, [h[4] for h in group], [h[5] for h in group], min(BLOCK, max(h[0] for h in group)))
        for i, (count, _, _, crc, _, _, _) in enumerate(group):
            if zlib.crc32(whole[i, :count].tobytes()) != crc:
                raise ValueError(f"block {begin + i} fails its checksum")
        yield np.concatenate([whole[i, : h[0]] for i, h in enumerate(group)])


def _numbered(stated: list) -> tuple[list, np.ndarray]:
    """What different blocks state, once each, and its number for every block."""
    names = {x: k for k, x in enumerate(dict.fromkeys(stated))}
    return list(names), np.array([names[x] for x in stated])


def _decode(words: np.ndarray, rest: np.ndarray, weights: list, codes: list, steps: int) -> np.ndarray:
    n, room = words.shape
    contexts = _Contexts(n)
    all_weights, weight_no = _numbered(weights)
    mixed = np.concatenate([_mixed(np.array(w)) for w in all_weights])
    all_codes, code_no = _numbered(codes)
    looked_up = np.concatenate([_looked_up(c) for c in all_codes])
    mix_base = None if len(all_weights) == 1 else weight_no * len(_STATES)
    code_base = None if len(all_codes) == 1 else code_no << _LONGEST
    # 48 bits at each word of the second streams
    wide = rest.shape[1]
    ahead = np.zeros((n, wide), np.int64)
    for k in range(3):
        ahead[:, : wide - k] |= rest[:, k:].astype(np.int64) << 32 - 16 * k
    ahead, bit = ahead.ravel(), np.arange(n) * (wide * 16)
    low, span, code = np.zeros(n, _U), np.full(n, 2**64 - 1, _U), np.zeros(n, _U)
    for k in range(4):
        code = code << _U(16) | words[:, k].astype(_U)
    flat, read = words.ravel(), np.arange(n) * room + 4
    out = np.zeros((steps, n), "<u4")
    for step in range(steps):
        chosen, state = contexts.predict()
        cut = (span >> _U(_BITS)) * mixed.take(state if mix_base is None else state + mix_base, mode="clip")
        miss = code - low >= cut
        # what the second stream would give, and how far it goes on if the test fails
        window = ahead.take(bit >> 4, mode="clip") << (bit & 15)
        top = window >> 48 - _LONGEST
        top &= (1 << _LONGEST) - 1
        if code_base is not None:
            top += code_base
        size = looked_up.take(top, mode="clip")
        instead = size >> 5
        size &= 31
        window >>= 48 - size
        window &= (1 << size) - 1
        window -= instead
        ids = np.where(miss, window, chosen)
        beyond = miss.astype(np.int64)
        size *= beyond
        bit += size
        low += cut * beyond.view(_U)
        span = np.where(miss, span - cut, cut)
        if len(go := _settle(low, span)):
            at = read.take(go)
            code[go] = code.take(go) << _U(16) | flat.take(at, mode="clip").astype(_U)
            read[go] = at + 1
            low[go] = low.take(go) << _U(16)
            span[go] = _grown(span.take(go))
        out[step] = ids
        contexts.learn(ids)
    return np.ascontiguousarray(out.T)


def _looked_up(code: bytes) -> np.ndarray:
    """For the next ``_LONGEST`` bits of a second stream: what its code has more than the id, then five bits for its length."""
    lengths = _from_nibbles(code)
    starts = _prefixes(lengths)
    order = np.lexsort((np.arange(_KINDS), lengths))
    kind = order[np.searchsorted(starts[order], np.arange(1 << _LONGEST), side="right") - 1]
    instead = (starts >> _LONGEST - lengths << _EXTRA) - _LEADING
    return (instead << 5 | lengths + _EXTRA)[kind]
