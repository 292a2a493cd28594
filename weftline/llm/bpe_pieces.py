"""Byte-level BPE by distinct pieces: texts are cut as the tokenizers' pattern cuts them, and each distinct piece is encoded once.

The cut is made with byte classes for texts of ASCII and the letters U+00C0 to U+017F that have no apostrophe before a
contraction's letter. Every other text goes to the tokenizer whole, or, when long, in segments that end where
the pattern always ends a match: between a character that isn't white space and one that is, and between a letter and a digit.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from .common import ranges
from .words import BASE, BYTE, PART_BYTES, mix, powers

_SPACE, _LETTER, _DIGIT, _OTHER = 0, 1, 2, 3
KIND = np.full(256, _OTHER, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
KIND[48:58] = _DIGIT
KIND[65:91] = KIND[97:123] = _LETTER
KIND[0x80:0xC0] = KIND[[0xC3, 0xC4, 0xC5]] = _LETTER
#: Lead bytes of characters outside the ranges named above.
STRANGE = np.zeros(256, bool)
STRANGE[0xC0:] = True
STRANGE[[0xC3, 0xC4, 0xC5]] = False
CONTRACTED = np.zeros(256, bool)
CONTRACTED[[ord(c) for c in "strvmld"]] = True
SEGMENT_CHARS = 1 << 16
#: Distinct pieces that a worker keeps; beyond that it starts anew, which changes no result.
KEPT_PIECES = 1_500_000
#: The table has room for these and those of one text, of at most PART_BYTES, besides.
SLOT_BITS = 22


def plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts the byte classes describe fully."""
    odd = STRANGE[data]
    odd[:-1] |= (data[:-1] == 39) & CONTRACTED[data[1:]]
    odd[:-1] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
    count = np.concatenate(([0], np.cumsum(odd)))
    return count[offsets[1:]] == count[offsets[:-1]]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First bytes of the pattern's matches in texts for which ``plain`` holds."""
    kind = KIND[data]
    n = len(data)
    before = np.full(n, 255, np.uint8)
    before[1:] = kind[:-1]
    after = np.full(n, _SPACE, np.uint8)
    after[:-1] = kind[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[heads] = 255
    after[heads[heads > 0] - 1] = _SPACE
    spaced = np.zeros(n, bool)
    spaced[1:] = data[:-1] == 32
    spaced[heads] = False
    white = kind == _SPACE
    return np.flatnonzero(np.where(white, (before != _SPACE) | (after != _SPACE), (before != kind) & ~spaced))


def segments(text: str, most: int = SEGMENT_CHARS) -> list[str]:
    """The text in parts of about ``most`` characters, cut only where no match of the pattern crosses."""
    if len(text) <= most:
        return [text]
    import regex

    cut = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
    out, at = [], 0
    while len(text) - at > most:
        found = cut.search(text, at + most)
        if not found:
            break
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


_encoders: dict[tuple, PieceEncoder] = {}


def kept_encoder(key: tuple, make: Callable[[], PieceEncoder]) -> PieceEncoder:
    """The encoder that this worker keeps for ``key`` from one task to the next; ``make`` gives one if there is none."""
    if key not in _encoders:
        _encoders[key] = make()
    return _encoders[key]


def one_by_one(encode_many: Callable[[list[str]], list[list[int]]]) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(ids, ids a piece) of pieces whose bytes lie end to end, each given to ``encode_many`` as a string."""

    def encode(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw, ends = data.tobytes(), np.cumsum(sizes)
        found = encode_many([raw[a:b].decode() for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)])
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint16, int(count.sum())), count

    return encode


class PieceEncoder:
    """Encodes many texts. ``encode_many`` takes strings and gives their ids; ``encode_pieces`` does so for the pattern's matches."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], encode_pieces: Callable | None = None):
        self.encode_many, self.encode_pieces = encode_many, encode_pieces or one_by_one(encode_many)
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(1 << SLOT_BITS, np.uint64), np.zeros(1 << SLOT_BITS, np.int32)  # open addressing; 0 is free
        self.at, self.count, self.ids = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32), np.zeros(1 << 18, np.uint16)
        self.pieces = self.used = 0

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out, open_, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(open_):
            held = self.keys[slot]
            same = held == keys[open_]
            out[open_[same]] = self.rows[slot[same]]
            on = ~same & (held != 0)
            open_, slot = open_[on], slot[on] + 1 & (1 << SLOT_BITS) - 1
        return out

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        ids, count = self.encode_pieces(data[ranges(starts, sizes)], sizes)
        first, self.pieces = self.pieces, self.pieces + len(keys)
        start, self.used = self.used, self.used + len(ids)
        for name, least in (("at", self.pieces), ("count", self.pieces), ("ids", self.used)):
            have = getattr(self, name)
            if len(have) < least:
                setattr(self, name, np.concatenate((have, np.zeros(max(len(have), least - len(have)), have.dtype))))
        self.at[first : self.pieces], self.count[first : self.pieces], self.ids[start : self.used] = start + np.cumsum(count) - count, count, ids
        open_, slot = np.arange(len(keys)), (keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        while len(open_):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[open_[free]]
            won = self.keys[slot] == keys[open_]
            self.rows[slot[won]] = first + open_[won]
            open_, slot = open_[~won], slot[~won] + 1 & (1 << SLOT_BITS) - 1

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, n + 1 offsets of the texts in them)."""
        fine = plain(data, offsets) & (np.diff(offsets) <= PART_BYTES)
        if fine.all():
            return self._plain(data, offsets)
        parts, counts = [], np.zeros(len(fine), np.int64)
        edges = np.flatnonzero(np.concatenate(([True], fine[1:] != fine[:-1], [True])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if fine[a]:
                ids, cut = self._plain(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                parts.append(ids)
                counts[a:b] = np.diff(cut)
                continue
            for i in range(a, b):
                found = self.encode_many(segments(data[offsets[i] : offsets[i + 1]].tobytes().decode()))
                one = np.fromiter((x for y in found for x in y), np.uint16, sum(map(len, found)))
                parts.append(one)
                counts[i] = len(one)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum(counts)))

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        ends = np.append(starts[1:], len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE[data] * powers(BASE, len(data))[: len(data)], out=total[1:])
        keys = mix((total[ends] - total[starts]) * powers(pow(BASE, -1, 1 << 64), len(data) + 1)[starts])
        keys[keys == 0] = 1
        if self.pieces > KEPT_PIECES:
            self.clear()
        place = self._find(keys)
        missing = np.flatnonzero(place < 0)
        if len(missing):
            distinct, first = np.unique(keys[missing], return_index=True)
            first = missing[first]
            self._learn(distinct, data, starts[first], ends[first] - starts[first])
            place[missing] = self._find(keys[missing])
        count = self.count[place].astype(np.int64)
        ids = self.ids[ranges(self.at[place], count)]
        ahead = np.concatenate(([0], np.cumsum(count)))
        return ids, ahead[np.searchsorted(starts, offsets)]
