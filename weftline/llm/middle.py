"""Fill-in-middle transformation: texts are cut in three at two unit boundaries and written in another order.

The boundaries of a text are found in overlapping chunks: whether a unit starts at a byte depends only on that byte and the one before it,
so a chunk that sees one byte more on its left counts its starts without any other chunk. Prefix sums over the counts say which chunk owns
each of the two cut ranks, and only those chunks are read again. All chunks of many texts are counted together, and those of a long
text a slab at a time, so memory is bounded by one text and a slab.

Null and empty texts are plain and have no units. Rows without an id are left out; repeated rows and ids are transformed row by row. Texts
that hold a mark are plain, so each output can be undone from itself and its form alone. An empty table gives an empty result.
Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PIECE_BYTES, ranges, spans, text_bytes, text_columns
from .words import SPACE

#: Prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
CHUNK = 1024
#: Whether a unit starts at the right one of two adjacent bytes of UTF-8.
UNITS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {
    "code point": lambda left, right: right & 0xC0 != 0x80,
    "word": lambda left, right: SPACE[left] & ~SPACE[right],
    "line": lambda left, right: left == 10,
}
FORMS = ("plain", "psm", "spm")


def starts(data: np.ndarray, at: np.ndarray, heads: np.ndarray, unit: str) -> np.ndarray:
    """Whether a unit starts at each of the bytes ``at``; heads: the texts' first bytes, in order."""
    out = UNITS[unit](data[np.maximum(at - 1, 0)], data[at])
    found = np.searchsorted(heads, at)
    out[found < len(heads)] |= heads[found[found < len(heads)]] == at[found < len(heads)]
    return out


class Cutter:
    """Counts the units of texts whose bytes lie end to end, and finds the bytes at which units of given rank start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str, chunk: int = CHUNK):
        self.data, self.offsets, self.unit = data, offsets, unit
        sizes = np.diff(offsets)
        self.heads = offsets[:-1][sizes > 0]
        per_text = -(-sizes // chunk)
        nth = ranges(np.zeros(len(sizes), np.int64), per_text)
        self.lo = np.repeat(offsets[:-1], per_text) + nth * chunk
        self.hi = np.minimum(self.lo + chunk, np.repeat(offsets[1:], per_text))
        counts = np.zeros(len(self.lo), np.int64)
        for a, b in spans(np.append(self.lo, len(data)), PIECE_BYTES):
            inner = starts(data, np.arange(self.lo[a], self.hi[b - 1]), self.heads, unit)
            counts[a:b] = np.add.reduceat(inner, self.lo[a:b] - self.lo[a], dtype=np.int64)
        self.ahead = np.concatenate(([0], np.cumsum(counts)))
        self.base = self.ahead[np.concatenate(([0], np.cumsum(per_text)))]
        self.units = np.diff(self.base)

    def places(self, rank: np.ndarray) -> np.ndarray:
        """The byte, from the first text's start, at which each text's unit of this rank starts; its end if there is none."""
        out, inside = self.offsets[1:].copy(), np.flatnonzero(rank < self.units)
        if not len(inside):
            return out
        wanted = self.base[inside] + rank[inside]
        owner = np.searchsorted(self.ahead, wanted, "right") - 1
        read, back = np.unique(owner, return_inverse=True)
        at = ranges(self.lo[read], self.hi[read] - self.lo[read])
        found = at[starts(self.data, at, self.heads, self.unit)]
        held = self.ahead[read + 1] - self.ahead[read]
        out[inside] = found[(np.cumsum(held) - held)[back] + wanted - self.ahead[owner]]
        return out


def draws(id_col: Column, salt: str) -> list[Column]:
    """Four numbers below 2 ** 32 from the sha256 of salt and id."""
    digest = F.sha2(F.concat(F.lit(salt), id_col.cast("string")), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def transformed(docs: DataFrame, unit: str = "code point", plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, salt: str = "1:", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_units, middle_units (null if plain) and output.

    The cuts stand after the smaller and the larger of two drawn numbers modulo n + 1. Of the texts without a mark,
    plain_percent stay as they are and spm_percent of the others put the suffix first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = (x.encode() for x in marks)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            kind, h1, h2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4))
            for a, b in spans(offsets, PIECE_BYTES):
                raw, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                cutter = Cutter(raw, own, unit)
                n = cutter.units
                first, second = h1[a:b] % (n + 1), h2[a:b] % (n + 1)
                low, high = np.minimum(first, second), np.maximum(first, second)
                whole, out = raw.tobytes(), []
                for form, x, i, j, y in zip(kind[a:b].tolist(), own[:-1].tolist(), cutter.places(low).tolist(), cutter.places(high).tolist(), own[1:].tolist(), strict=True):
                    if form == 0:
                        out.append(whole[x:y])
                    elif form == 1:
                        out.append(b"".join((p, whole[x:i], s, whole[j:y], m, whole[i:j])))
                    else:
                        out.append(b"".join((s, whole[j:y], p, whole[x:i], m, whole[i:j])))
                plain = kind[a:b] == 0
                columns = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(np.array(FORMS)[kind[a:b]]), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_units", "middle_units", "output"])

    rows = text_columns(docs, id_col, text_col)
    h1, h2, h3, h4 = draws(F.col("doc_id"), salt)
    marked = F.col("text") == ""
    for mark in marks:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when(marked | (h3 % 100 >= 100 - plain_percent), 0).when(h4 % 100 < spm_percent, 2).otherwise(1)
    return rows.select("doc_id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2")).mapInArrow(run, "doc_id long, n long, form string, prefix_units long, middle_units long, output string")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text from an output and its form; what stands between marks holds none, so the marks are found by themselves."""
    part = F.split(output, "|".join(rf"\Q{x}\E" for x in marks), -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """The digest columns of ``transformed``'s rows."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))
