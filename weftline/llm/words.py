"""Vectorised hashing of words and of runs of consecutive words, over the UTF-8 bytes of many texts at once.

A word is a longest run of bytes that are not ASCII white space (0x20, 0x09 to 0x0D).
Hashes have 64 bits; two different runs of words share one with probability 2 ** -64.
"""

from __future__ import annotations

import numpy as np

from .common import ranges

#: Odd, so that its powers can be inverted modulo 2 ** 64.
BASE = 0x9E3779B97F4A7C15
GRAM = 0xD6E8FEB86659FD93
#: Texts longer than this are hashed in parts cut at white space.
PART_BYTES = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random value for each byte, and the bytes with A-Z lower-cased.
BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i below n or more; kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


def _hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, len(data))[: len(data)], out=total[1:])
    back = powers(pow(BASE, -1, 1 << 64), len(data) + 1)
    return mix((total[ends] - total[starts]) * back[starts])


def word_edges(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end byte) of the longest runs of bytes that aren't in ``space``, within texts."""
    inner = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1] | edge[1:-1]
    last[:-1] &= ~inner[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of each word, and the n + 1 offsets of the texts in these arrays."""
    if lower:
        data = LOWER[data]
    starts, ends = word_edges(data, offsets, space)
    bounds = np.searchsorted(starts, offsets)
    if len(data) <= 2 * PART_BYTES:
        return _hash_words(data, starts, ends), starts, ends, bounds
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + PART_BYTES, "right")))
        a, b = starts[at], ends[to - 1]
        out[at:to] = _hash_words(data[a:b], starts[at:to] - a, ends[at:to] - a)
        at = to
    return out, starts, ends, bounds


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive values (len - n + 1 of them, none if fewer), by doubling."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    have, width, parts = hashes, 1, []
    rest = n
    while rest:
        if rest & 1:
            parts.append((have, width))
        rest >>= 1
        if rest:
            have = have[:-width] * np.uint64(pow(GRAM, width, 1 << 64)) + have[width:]
            width *= 2
    count, out, at = len(hashes) - n + 1, None, 0
    for part, width in parts:
        piece = part[at : at + count]
        out = piece.copy() if out is None else out * np.uint64(pow(GRAM, width, 1 << 64)) + piece
        at += width
    return mix(out)


def in_texts(bounds: np.ndarray, n: int, count: int) -> np.ndarray:
    """Which of ``count`` starts have a run of n values within one text."""
    inside = np.ones(count, bool)
    cuts = bounds[1:-1]
    if n > 1 and len(cuts):
        at = ranges(np.maximum(cuts - n + 1, 0), np.minimum(cuts, n - 1))
        inside[at[at < count]] = False
    return inside


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have, span = values, 1
    while span * 2 <= width:
        have = np.minimum(have[:-span], have[span:])
        span *= 2
    rest = width - span
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have
