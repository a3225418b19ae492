"""Bucket identifiers of fixed-length strings by prefix doubling, and their anchors, on arrays of bytes."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(33)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of its start and of a later part of it."""
    h = x * _A
    h ^= h >> np.uint64(32)
    h += y
    h *= _B
    h ^= h >> np.uint64(29)
    return h


def identifiers(data: np.ndarray, q: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of the q-gram (q a power of two) and of the string of ``length`` bytes (over q) that start at each byte.

    Each round refines all buckets at once: a position's new identifier is that of its bucket and of the bucket at a later offset, which
    is what sorting by the two would number.
    """
    ids, size, grams = _BYTE[data], 1, None
    while True:
        if size == q:
            grams = ids
        if 2 * size > length:
            break
        ids = joined(ids[:-size], ids[size:])
        size *= 2
    if size < length:
        rest = length - size
        ids = joined(ids[:-rest], ids[rest:])
    return grams, ids


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(grams: np.ndarray, width: int) -> np.ndarray:
    """The place of the least q-gram, by hash, in each ``width`` consecutive places; the first of equals."""
    bits = np.uint64(max(1, int(len(grams)).bit_length()))
    h = grams * np.uint64(0xC4CEB9FE1A85EC53)
    keyed = (h ^ (h >> np.uint64(31))) >> bits << bits | np.arange(len(grams), dtype=np.uint64)
    return (sliding_min(keyed, width) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
