"""Whole Arrow batches of texts as flat numpy arrays: words, word hashes and shingle hashes.

Texts are taken in blocks of about ``BLOCK`` bytes so that memory stays
bounded for any row count; a longer text is a block of its own.  A null text
counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD6E8FEB86659FD93)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which each input bit changes half of the output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + (1 << 16))
        _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)]).cumprod(dtype=np.uint64) for base in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n+1 offsets of the texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(wide) if column.type != wide else column
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row behind the last, bytes, offsets) of runs of texts."""
    data, offsets = flat(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + BLOCK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words, and for each text the number of its first word, and one more."""
    n = len(data)
    text = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets[offsets <= n]] = True
    before = np.zeros(n, bool)
    before[1:] = text[:-1]
    starts = np.flatnonzero(text & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = text[1:]
    ends = np.flatnonzero(text & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, alike wherever the word stands."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; those that cross texts are the caller's to leave out."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= _STEP
        out += hashes[k : n + k]
    return mix(out)


def whole(hashes: np.ndarray) -> np.uint64:
    """One hash of a short sequence of words."""
    out = 0x51ED270B + len(hashes)
    for h in hashes.tolist():
        out = (out * int(_STEP) + h) & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([out], np.uint64))[0]
