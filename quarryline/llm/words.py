"""Words of an Arrow column of texts, found and hashed on its bytes, without a Python object a word.

UTF-8 keeps every byte of a non-ASCII character at 0x80 or above, so both of the contracts' word
classes are sets of bytes, and lower-casing A to Z is a table. A word's hash is a polynomial in an
odd base over random 64-bit values of its bytes, taken from running sums, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from quarryline.llm.common import U64, mix64

SEPARATORS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Fixed classes of the contracts: bytes that make up words.
SPACED = ~SEPARATORS
PLAIN = np.isin(np.arange(256), [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PIECE = 1 << 18
BASE = 0xC6BC279692B5C323
INVERSE = pow(BASE, -1, 1 << 64)


def _values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)))


VALUES = {False: _values(), True: _values()[LOWER]}


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not POWERS or len(POWERS[0]) < n:
        POWERS[:] = [_powers(BASE, max(n, 2 * PIECE)), _powers(INVERSE, max(n, 2 * PIECE))]
    return POWERS[0], POWERS[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and where each begins and the last ends. Null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[edges[0] : edges[-1]] if data is not None and edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return raw, edges - edges[0]


class Words:
    """``starts`` and ``ends`` of all words in ``data``; those of document k are ``edges[k]:edges[k + 1]``."""

    def __init__(self, column: pa.Array, kind: np.ndarray = SPACED) -> None:
        self.data, self.docs = buffers(column)
        inside = kind[self.data]
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        bound = self.docs[:-1][np.diff(self.docs) > 0]
        begins[bound] = inside[bound]
        last = self.docs[1:][np.diff(self.docs) > 0] - 1
        stops[last] = inside[last]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.edges = np.searchsorted(self.starts, self.docs)

    def counts(self) -> np.ndarray:
        return np.diff(self.edges)

    def hashes(self, lower: bool = False) -> np.ndarray:
        values, out = VALUES[lower], np.empty(len(self.starts), dtype=U64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(out):
                lo = self.starts[at]
                to = max(at + 1, int(np.searchsorted(self.ends, lo + PIECE, side="right")))
                hi = self.ends[to - 1]
                up, down = powers(hi - lo + 1)
                sums = np.zeros(hi - lo + 1, dtype=U64)
                np.cumsum(values[self.data[lo:hi]] * up[: hi - lo], out=sums[1:])
                s, e = self.starts[at:to] - lo, self.ends[at:to] - lo
                out[at:to] = mix64((sums[e] - sums[s]) * down[s] + (e - s).astype(U64))
                at = to
        return out

    def joined(self, keep: np.ndarray | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the (kept) words of each document, joined by one space, and the documents' edges in them."""
        starts, ends, counts = self.starts, self.ends, self.counts()
        if keep is not None:
            at = np.flatnonzero(keep)
            owner = np.searchsorted(self.edges, at, side="right") - 1
            starts, ends, counts = starts[at], ends[at], np.bincount(owner, minlength=len(counts))
        lengths = ends - starts
        firsts = np.cumsum(counts) - counts
        gap = np.ones(len(starts), dtype=np.int64)
        gap[firsts[counts > 0]] = 0
        total = np.cumsum(lengths + gap)
        out = np.full(int(total[-1]) if len(total) else 0, 32, dtype=np.uint8)
        # word bytes are copied by one gather: each output byte but the gaps comes from its word
        shift = np.repeat(starts - (total - lengths), lengths + gap)
        source = np.arange(len(out)) + shift
        inside = np.ones(len(out), dtype=bool)
        inside[(total - lengths - gap)[gap > 0]] = False
        out[inside] = self.data[source[inside]]
        if lower:
            out = LOWER[out]
        return out, np.concatenate([[0], total])[np.concatenate([firsts, [len(starts)]])]


def texts(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A text column from bytes and edges."""
    return pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(np.ascontiguousarray(edges, dtype=np.int64)), pa.py_buffer(data)).cast(pa.string())


def word_hash(word: str, lower: bool = False) -> int:
    """The hash that :meth:`Words.hashes` gives one word."""
    column = pa.array([word])
    whole = Words(column, np.ones(256, dtype=bool))
    return int(whole.hashes(lower)[0])


#: Constants of the published XXH64 function.
P1, P2, P3, P4, P5 = (U64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _left(x: np.ndarray, k: int) -> np.ndarray:
    return (x << U64(k)) | (x >> U64(64 - k))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many byte ranges at once, a length at a time; rare lengths go to the library."""
    out = np.empty(len(starts), dtype=U64)
    if not len(out):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    fours = np.ndarray((len(data) + 5,), dtype="<u4", buffer=padded.data, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths.astype(np.uint32) if lengths.max() >= 1 << 16 else lengths.astype(np.uint16), kind="stable")
    sizes = lengths[order]
    cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], sizes[1:] != sizes[:-1]])), [len(sizes)]])
    view = memoryview(np.ascontiguousarray(data))
    with np.errstate(over="ignore"):
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at, n = order[a:b], int(sizes[a])
            if b - a < 24:
                out[at] = [xxhash.xxh64_intdigest(view[x : x + n], seed) for x in starts[at].tolist()]
                continue
            p, s, k = starts[at], U64(seed), 0
            if n >= 32:
                lanes = [np.full(b - a, v, dtype=U64) for v in (s + P1 + P2, s + P2, s, s - P1)]
                while k + 32 <= n:
                    for j in range(4):
                        lanes[j] = _left(lanes[j] + eights[p + (k + 8 * j)] * P2, 31) * P1
                    k += 32
                h = _left(lanes[0], 1) + _left(lanes[1], 7) + _left(lanes[2], 12) + _left(lanes[3], 18)
                for lane in lanes:
                    h = (h ^ (_left(lane * P2, 31) * P1)) * P1 + P4
            else:
                h = np.full(b - a, s + P5, dtype=U64)
            h += U64(n)
            while k + 8 <= n:
                h = _left(h ^ (_left(eights[p + k] * P2, 31) * P1), 27) * P1 + P4
                k += 8
            if k + 4 <= n:
                h = _left(h ^ (fours[p + k].astype(U64) * P1), 23) * P2 + P3
                k += 4
            while k < n:
                h = _left(h ^ (data[p + k].astype(U64) * P5), 11) * P1
                k += 1
            h = (h ^ (h >> U64(33))) * P2
            h = (h ^ (h >> U64(29))) * P3
            out[at] = h ^ (h >> U64(32))
    return out


def slices(batch: pa.RecordBatch, name: str = "text", most: int = 8 << 20):
    """Parts of a batch whose texts have about ``most`` bytes; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    _, edges = buffers(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def pieces(values: np.ndarray, firsts: np.ndarray, kind=pa.binary()) -> pa.Array:
    """A binary column: ``values`` (bytes) cut at ``firsts``."""
    edges = np.concatenate([firsts, [len(values)]]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(firsts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(values))]).cast(kind)
