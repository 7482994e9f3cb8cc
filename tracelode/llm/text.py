"""Vectorised word splitting and hashing over Arrow string arrays.

Everything here is a small helper that runs inside Spark tasks: it turns one
Arrow batch of texts into numpy arrays of word positions and 64-bit word
hashes, so that the operators work on whole batches and never on single words.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``.  That set is
ASCII, so working on UTF-8 bytes gives the same words as working on code
points.  Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once inside a task; a longer single text is handled alone.
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Separators for terms: all ASCII but letters and digits, so that other scripts stay whole.
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_P = int(_RNG.integers(0, 2**63, dtype=np.uint64)) * 2 + 1
_P_INV = pow(_P, -1, 2**64)
_pow = np.ones(1, np.uint64)
_ipow = np.ones(1, np.uint64)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library: nothing to trim
    _trim = None


def tidy(batches: Iterator) -> Iterator:
    """The same batches; after each one, memory that Arrow and the C library hold unused goes back to the system.

    Spark keeps Python workers for later tasks, and without this each keeps the most that it ever had.
    """
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()
        if _trim:
            _trim(0)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n (kept between batches of a task)."""
    global _pow, _ipow
    if len(_pow) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, _P, np.uint64)
        steps[0] = 1
        _pow = np.cumprod(steps, dtype=np.uint64)
        steps = np.full(size, _P_INV, np.uint64)
        steps[0] = 1
        _ipow = np.cumprod(steps, dtype=np.uint64)
    return _pow[:n], _ipow[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64-bit values evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signed(x: np.ndarray) -> np.ndarray:
    """Spark's BIGINT view of unsigned 64-bit hashes."""
    return x.view(np.int64)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n + 1 offsets, starting at 0."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        kind = np.int64
    else:
        texts, kind = texts.cast(pa.string()), np.int32
    _, at, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(at, kind, len(texts) + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    body = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return body, at - at[0]


def chunks(batch: pa.RecordBatch, column: int | str, most: int = CHUNK_BYTES, most_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``most`` bytes; every row is in one slice."""
    _, at = raw(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1), i + most_rows)
        yield batch.slice(i, j - i)
        i = j


@dataclass
class Words:
    """Words of n texts: bytes, start and end of each word, first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))


def split(texts: pa.Array, lower: bool = True, space: np.ndarray = _SPACE) -> Words:
    """Words of each text; ``lower`` lower-cases A-Z; ``space`` says which bytes separate words."""
    data, at = raw(texts)
    if lower:
        data = LOWER[data]
    word = ~space[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[at] = True
    before = np.ones(len(data), bool)
    before[1:] = ~word[:-1]
    after = np.ones(len(data), bool)
    after[:-1] = ~word[1:]
    start = np.flatnonzero(word & (before | fresh[:-1]))
    end = np.flatnonzero(word & (after | fresh[1:])) + 1
    return Words(data, start, end, np.searchsorted(start, at))


def windows(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words within each text, and the first window of each text.

    A text with 1 to n - 1 words gives one window of all its words; an empty one gives none.
    """
    count = np.diff(first)
    rows = np.repeat(np.arange(len(count)), np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype)))
    ptr = np.searchsorted(rows, np.arange(len(count) + 1))
    at = first[:-1][rows] + (np.arange(len(rows)) - ptr[rows])
    out = np.zeros(len(rows), np.uint64)
    left = first[1:][rows] - at
    padded = np.concatenate([h, np.zeros(n, np.uint64)])
    for k in range(n):
        out = np.where(k < left, mix(out * np.uint64(0x9E3779B97F4A7C15) + padded[at + k] + np.uint64(k + 1)), out)
    return out, ptr
