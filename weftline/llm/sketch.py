"""Count-min sketches of a whole corpus: each task counts its own rows, tasks' counts are merged by slices of cells.

Counts stop at 2, as the question is only whether a value may occur twice. The merged sketch is ``rows`` bitmaps of
2 ** bits cells, whatever the size of the corpus, so it is safe to broadcast.
A value that occurs at least twice has its bit set in every row: the sketch errs on one side only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import mix

SLICES = 64
_ROW_SALT = 0xA0761D6478BD642F


def cells(values: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(values + np.uint64((row + 1) * _ROW_SALT & (1 << 64) - 1)) >> np.uint64(64 - bits)


class Repeated:
    """The merged sketch: which values may occur twice or more."""

    def __init__(self, rows: int, bits: int, bitmap: np.ndarray):
        self.rows, self.bits, self.bitmap = rows, bits, bitmap

    def __call__(self, values: np.ndarray) -> np.ndarray:
        out = np.ones(len(values), bool)
        size = 1 << (self.bits - 3)
        for row in range(self.rows):
            at = cells(values, row, self.bits)
            out &= (self.bitmap[row * size + (at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


def repeated(df: DataFrame, values: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], rows: int, bits: int) -> Repeated:
    """The sketch of all values that ``values`` takes from df's partitions."""
    part = (rows << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            at = np.concatenate(held)
            at.sort()
            new = np.concatenate(([True], at[1:] != at[:-1]))
            more = np.concatenate((at[1:] == at[:-1], [False]))[new]
            at = at[new]
            cut = np.searchsorted(at, np.arange(SLICES + 1, dtype=np.int64) * part)
            ids, blobs = [], []
            for s in range(SLICES):
                one, two = at[cut[s] : cut[s + 1]], more[cut[s] : cut[s + 1]]
                if len(one):
                    code = (np.diff(one, prepend=s * part) * 2 + two).astype(np.uint32)
                    large = code[code >= 255]
                    ids.append(s)
                    blobs.append(np.uint32(len(large)).tobytes() + large.tobytes() + np.minimum(code, 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["slice", "cells"])

        for v in values(batches):
            for row in range(rows):
                held.append((cells(v, row, bits) + np.uint64(row << bits)).astype(np.int64))
                n += len(v)
            if n >= 6_000_000:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                blob = blob.as_buffer()
                n = int(np.frombuffer(blob, np.uint32, 1)[0])
                code = np.frombuffer(blob, np.uint8, offset=4 + 4 * n).astype(np.int64)
                code[code == 255] = np.frombuffer(blob, np.uint32, n, 4)
                have = seen.setdefault(s, np.zeros(part, np.uint8))
                at = np.cumsum(code >> 1)
                have[at] = np.minimum(have[at] + 1 + (code & 1).astype(np.uint8), 2)
        for s, have in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(have >= 2, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    merged = df.mapInArrow(count, "slice int, cells binary").repartition(SLICES, "slice").mapInArrow(merge, "slice int, bits binary")
    bitmap = np.zeros((rows << bits) // 8, np.uint8)
    for s, blob in merged.collect():
        bitmap[s * part // 8 : (s + 1) * part // 8] = np.frombuffer(blob, np.uint8)
    return Repeated(rows, bits, bitmap)


def bucket_slices(df: DataFrame, values: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> DataFrame:
    """(slice, counts): how often values fall in each of 2 ** bits buckets (their top bits), over all partitions; the counts, of 4 bytes, of SLICES runs of buckets."""
    part = (1 << bits) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for v in values(batches):
            at, n = np.unique(v >> np.uint64(64 - bits), return_counts=True)
            total[at.astype(np.int64)] += n
        at = np.flatnonzero(total)
        cut = np.searchsorted(at, np.arange(SLICES + 1) * part)
        for s in range(SLICES):
            one = at[cut[s] : cut[s + 1]]
            if len(one):
                code = np.stack((np.diff(one, prepend=s * part), total[one])).astype(np.uint32).T.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([code], pa.binary())], ["slice", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                code = np.frombuffer(blob.as_buffer(), np.uint32).reshape(-1, 2).astype(np.int64)
                total.setdefault(s, np.zeros(part, np.int64))[np.cumsum(code[:, 0])] += code[:, 1]
        for s, have in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.minimum(have, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["slice", "counts"])

    return df.mapInArrow(count, "slice int, counts binary").repartition(SLICES, "slice").mapInArrow(merge, "slice int, counts binary")


def bucket_counts(df: DataFrame, values: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> np.ndarray:
    """The counts of all buckets, on the driver."""
    part, out = (1 << bits) // SLICES, np.zeros(1 << bits, np.uint32)
    for s, blob in bucket_slices(df, values, bits).collect():
        out[s * part : (s + 1) * part] = np.frombuffer(blob, np.uint32)
    return out
