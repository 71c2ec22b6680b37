"""Words of Arrow text columns, in slices of a bounded number of bytes, and their hashes.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``; those separators are single
bytes in UTF-8, so boundaries are found on raw bytes and nothing is decoded.

``Tokens`` serves the operators that compare words: hashes of words (XXH3, 64 bits) bring candidates
together, and stretches of words are compared by 128-bit BLAKE2b digests of their bytes.  ``Words`` serves
hashed features: polynomial hashes of words and of pieces of them in whole-array steps, which
different words may share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text handled at once; a longer single document is its own slice.
SLICE_BYTES = 1 << 20

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_ROOT)) | _U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: For letter runs: all ASCII but letters and digits separates.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_powers: dict[int, np.ndarray] = {}


def powers(root: int, n: int) -> np.ndarray:
    """``root ** i mod 2**64`` for i < n, grown on demand and kept by the worker."""
    have = _powers.get(root)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, root & _M64, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[root] = have
    return have[:n]


def _inverse(root: int) -> int:
    return pow(root, -1, 1 << 64)


def window_hash(values: np.ndarray, k: int, root: int) -> np.ndarray:
    """Polynomial hash of every k consecutive 64-bit values (crossing documents too)."""
    n = len(values)
    if n < k:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(root, n), out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * powers(_inverse(root), n - k + 1))


class Words:
    """Words of a slice of documents: ``doc`` (row in the slice), byte ``start``/``end``, ``hash``."""

    __slots__ = ("doc", "start", "end", "hash", "first", "count", "total")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, separators: np.ndarray = _SPACE):
        size, docs = len(data), len(offsets) - 1
        word = ~separators[data]
        before = np.zeros(size + 1, dtype=bool)
        before[1:] = word
        before[offsets[:-1]] = False
        self.start = np.flatnonzero(word & ~before[:size])
        after = np.zeros(size + 1, dtype=bool)
        after[:size] = word
        after[offsets[1:]] = False
        self.end = np.flatnonzero(word & ~after[1:]) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(docs), self.count)
        total = np.zeros(size + 1, dtype=np.uint64)
        np.cumsum((_LOWER if lower else _BYTE)[data] * powers(_ROOT, size), out=total[1:])
        self.total = total
        self.hash = self.piece(self.start, self.end)

    def piece(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes from start to end."""
        return mix((self.total[end] - self.total[start]) * powers(_inverse(_ROOT), len(self.total))[start])


DIGEST = np.dtype([("x", "<u8"), ("y", "<u8")])


class Tokens:
    """Words of a slice of documents: their bytes, ``hash`` and ``doc``; of each document ``first`` and
    ``count``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        block = data.tobytes()
        if lower:
            block = block.lower()  # of bytes: A-Z only
        words, count = [], []
        for low, high in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = block[low:high].split()  # of bytes: at the six separators only
            words += own
            count.append(len(own))
        self.words = words
        self.count = np.asarray(count, dtype=np.int64)
        self.first = np.r_[0, np.cumsum(self.count)]
        self.doc = np.repeat(np.arange(len(count)), self.count)
        self.hash = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        self._joined: tuple[bytes, np.ndarray] | None = None

    def digests(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """128-bit digests of the words from low to high (exclusive, at least one), joined by spaces."""
        if self._joined is None:
            self._joined = b" ".join(self.words), np.r_[0, np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1)]
        block, at = self._joined
        make = hashlib.blake2b
        return np.frombuffer(b"".join([make(block[a:b], digest_size=16).digest() for a, b in zip(at[low].tolist(), (at[high] - 1).tolist())]), dtype=DIGEST)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(word index, hash) of each k-word window that lies within one document."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        inside = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        value = mix(self.hash[inside])
        for j in range(1, k):
            value = mix(value + self.hash[inside + j])
        return inside, value


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary Arrow column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    if len(column) == 0 or offs is None:
        return np.zeros(len(column) + 1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive row ranges of at most ``limit`` bytes (or one row): (from, to, offsets, bytes)."""
    offsets, raw = text_buffers(column)
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), rows)
        yield at, to, offsets[at : to + 1] - offsets[at], raw[offsets[at] : offsets[to]]
        at = to
