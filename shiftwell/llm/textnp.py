"""Vectorised text kernels on Arrow string buffers.

A batch of texts is one UTF-8 byte buffer and its offsets; words, lines and
shingles are found and hashed with numpy over the whole buffer, without a
Python object for each word.  Texts are always read whole; a buffer is only
cut between documents, so memory follows ``CHUNK_BYTES`` or the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: Odd multipliers of the byte and word polynomials (fixed values, any odd numbers do).
BYTE_MUL, WORD_MUL = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F

#: ``[^\x20\x09-\x0D]``: every byte but ASCII white space belongs to a word.
NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing: digits, a-z, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z, the rest unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, mul: int):
        self.mul, self.inv = mul, pow(mul, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.r_[U64(1), np.full(size, m, U64)]) for m in (self.mul, self.inv))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BYTE_MUL), _Powers(WORD_MUL)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all input bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null text has no bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = col.chunk(0) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``limit`` bytes each, a longer text alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


class Words:
    """Words of some documents: ``start``, ``end`` (bytes), ``doc`` (index), ``first`` (of each document, and the total)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NON_SPACE):
        self.data, self.offsets = data, offsets
        inside = table[data]
        before = np.empty_like(inside)
        after = np.empty_like(inside)
        if len(data):
            before[0], before[1:] = False, inside[:-1]
            after[-1], after[:-1] = False, inside[1:]
            cuts = offsets[(offsets > 0) & (offsets < len(data))]
            before[cuts] = False
            after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def spans_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans of the buffer."""
        up, down = _BYTES.get(len(self.data) + 1)
        if not hasattr(self, "_sums"):
            self._sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum((self.data + np.uint16(1)).astype(U64) * up[:-1], out=self._sums[1:])
        h = (self._sums[end] - self._sums[start]) * down[start]
        return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def hashes(self) -> np.ndarray:
        if not hasattr(self, "_hashes"):
            self._hashes = self.spans_hash(self.start, self.end)
        return self._hashes

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n words that lie within a document, and their first words."""
        at = self.window_starts(n)
        return rolling(self.hashes(), n)[at] if len(at) else np.zeros(0, U64), at

    def window_starts(self, n: int) -> np.ndarray:
        total = len(self.start)
        if total < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.doc[: total - n + 1] == self.doc[n - 1 :])


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbours of h."""
    up, down = _WORDS.get(len(h) + 1)
    sums = np.zeros(len(h) + 1, U64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[: len(h) - n + 1] + U64(n))


def per_doc(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values in the ranges that the offsets ``first`` mark."""
    sums = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "biu" else np.float64)
    np.cumsum(values, out=sums[1:])
    return np.diff(sums[first])


def covered(n: int, starts: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a span [start, start + length)."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + length, -1)
    return np.cumsum(edge[:n]) > 0


def repeats(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (doc, hash): is it found more than once; is there an earlier one."""
    many, later = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h):
        order = np.lexsort((h, doc)) if len(h) < 64 else np.argsort(mix(h + doc.astype(U64) * U64(0xA0761D6478BD642F)), kind="stable")
        d, v = doc[order], h[order]
        same = (d[1:] == d[:-1]) & (v[1:] == v[:-1])
        later[order[1:][same]] = True
        many[order[1:][same]] = True
        many[order[:-1][same]] = True
    return many, later


def texts(col: pa.Array) -> list[str]:
    """Python strings, a null as the empty text."""
    return [x or "" for x in col.to_pylist()]
