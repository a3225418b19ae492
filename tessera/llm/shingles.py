"""Sets of word shingles as sorted 64-bit hashes, computed on the UTF-8 bytes of whole batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; longer texts are cut at white space.
SLICE = 1 << 20

_rng = np.random.default_rng(20)
_ODD = np.uint64(int(_rng.integers(1 << 62)) * 2 + 1)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and of its inverse."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE // 4)
        inverse = np.uint64(pow(int(_ODD), -1, 1 << 64))
        for name, x in (("up", _ODD), ("down", inverse)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in ``data``, and how many lie before each of ``cuts`` (places that no word crosses)."""
    space = _SPACE[data]
    first, last = ~space, ~space
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    inner = cuts[(cuts > 0) & (cuts < len(data))]
    first[inner] = ~space[inner]
    last[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.searchsorted(starts, cuts)


def _words_of(texts: pa.Array) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1)
        j = min(j, len(texts))
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= SLICE or j > i + 1:
            h, at = word_hashes(data[a:b], offsets[i : j + 1] - a)
            for x, y in zip(at[:-1], at[1:]):
                yield h[x:y]
        else:
            parts = []
            while a < b:  # one long text
                e = min(a + SLICE, b)
                if e < b:
                    back = np.flatnonzero(_SPACE[data[a:e]])
                    if len(back):
                        e = a + int(back[-1]) + 1
                    else:
                        ahead = np.flatnonzero(_SPACE[data[e:b]])
                        e = e + int(ahead[0]) + 1 if len(ahead) else b
                parts.append(word_hashes(data[a:e], np.array([0, e - a]))[0])
                a = e
            yield np.concatenate(parts)
        i = j


def sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles, sorted; a text with fewer words is one shingle, one without words none."""
    if texts.null_count:
        texts = texts.fill_null("")
    factors = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    for h in _words_of(texts):
        n = min(words, len(h))
        if not n:
            yield h
            continue
        m = len(h) - n + 1
        g = np.full(m, n, np.uint64)
        for k in range(n):
            g = (g ^ h[k : k + m]) * factors[k % len(factors)] + (g >> np.uint64(29))
        yield np.unique(mix(g))


def set_id(shingles: np.ndarray) -> int:
    """One number for a set, as a signed long."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(shingles))], np.uint64)).view(np.int64)[0])
