"""Vectorised words and word-shingle hashes of many texts at once."""

from __future__ import annotations

import numpy as np

#: White space between words: the ASCII space and the controls tab to carriage return.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` pseudo-random 64-bit values, the same for the same seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(256, 1)
_POWER = stream(64, 2) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    global _POWER
    if n > len(_POWER):
        _POWER = stream(max(n, 2 * len(_POWER)), 2) | np.uint64(1)
    return _POWER


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the first word of each row (with the end)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    inner = ~_SPACE[data]
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts] = inner[cuts]
    last[cuts - 1] = inner[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    lens = ends - starts
    at = np.flatnonzero(inner)
    place = at - np.repeat(starts, lens)
    value = _BYTE[data[at]]
    value *= _powers(int(lens.max()))[place]
    begin = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=begin[1:])
    h = np.add.reduceat(value, begin) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(h), np.searchsorted(starts, offsets).astype(np.int64)


def shingles(word: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles in order, and each row's first one (with the end).

    A row of fewer than k words has its whole sequence as one shingle; a row
    without words has none.
    """
    n_words = np.diff(bounds)
    count = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    out_bounds = np.zeros(len(bounds), np.int64)
    np.cumsum(count, out=out_bounds[1:])
    out = np.zeros(int(out_bounds[-1]), np.uint64)
    if not len(out):
        return out, out_bounds
    weight = _powers(64 + k)[64 - 1 : 64 - 1 + k] if k else _POWER[:0]
    row = np.repeat(np.arange(len(count)), count)
    begin = bounds[row] + (np.arange(len(out)) - out_bounds[row])
    length = np.minimum(n_words[row], k)
    for j in range(k):
        use = length > j
        out[use] += word[begin[use] + j] * weight[j]
    out += length.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
    return mix(out), out_bounds
