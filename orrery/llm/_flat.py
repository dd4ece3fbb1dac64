"""Vectorised text kernels: many documents as one byte buffer, hashed with numpy and no per-word Python.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. Its 64-bit hash mixes its length and its 8-byte halves one after the
other, so words of up to 8 bytes never share one; words above 16 bytes take theirs from BLAKE2. Runs of a few
words or bytes are polynomials over such values modulo 2**64 with an odd base, finished by an avalanche mix. That is for short runs
alone: from 1024 values on, pairs exist that collide whatever the base. Equal words hash alike in every process; two different ones
by chance with odds of 2**-64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
SLICE = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit avalanche."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix((np.arange(256, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15))
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
_BASE = 0xD6E8FEB86659FD93
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    if len(_powers[0]) <= n:
        n = max(n, 1 << 16)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(n + 1, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def _ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, some dozens of values at most; ranges may overlap."""
    power, inverse = _power(len(values))
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * U64(0x9E3779B97F4A7C15))


def buffers(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offset of each (one more than texts); null counts as empty."""
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    text = text.cast(pa.large_binary()).fill_null(b"") if text.null_count else text.cast(pa.large_binary())
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = text.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about ``most`` bytes; a longer document is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


class Words:
    """Words of some documents: byte spans in ``raw``, and where each document's words begin (``at``, one more)."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE):
        begins = np.zeros(len(raw) + 1, bool)
        begins[offsets] = True
        solid = ~space[raw]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | begins[1:-1]
        last[:-1] &= ~solid[1:] | begins[1:-1]
        self.raw, self.start, self.end = raw, np.flatnonzero(first), np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        size = self.end - self.start
        eight = np.ndarray((len(self.raw) + 1,), "<u8", np.concatenate([self.raw, np.zeros(8, np.uint8)]), 0, (1,))
        out = mix(size.astype(U64) + U64(0x9E3779B97F4A7C15))
        for t in (0, 8):
            at = np.flatnonzero(size > t)
            out[at] = mix(out[at] ^ (eight[self.start[at] + t] & _LOW[np.minimum(size[at] - t, 8)]))
        view = memoryview(self.raw)
        for k in np.flatnonzero(size > 16).tolist():
            out[k] = int.from_bytes(hashlib.blake2b(view[self.start[k] : self.end[k]], digest_size=8).digest(), "little")
        return out


def word_hashes(text: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of every text, and where each text's words begin (one more than texts)."""
    raw, offsets = buffers(text)
    found, at = [np.zeros(0, U64)], [np.zeros(1, np.int64)]
    n = 0
    for a, b in pieces(offsets):
        part = raw[offsets[a] : offsets[b]]
        words = Words(LOWER[part] if lower else part, offsets[a : b + 1] - offsets[a])
        found.append(words.hashes())
        at.append(words.at[1:] + n)
        n += len(found[-1])
    return np.concatenate(found), np.concatenate(at)


def shingles(words: np.ndarray, at: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every n consecutive words inside one text, and the index of each one's first word.

    short: a text with 1 to n - 1 words gives its whole sequence as one shingle.
    """
    count = np.diff(at)
    own = np.maximum(count - n + 1, 0)
    if short:
        own = np.where((count > 0) & (own == 0), 1, own)
    owner = np.repeat(np.arange(len(count)), own)
    start = at[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
    end = np.minimum(start + n, at[1:][owner])
    return _ranges(words, start, end), start
