"""What the two operators on repeated passages share: windows that may repeat, and runs of removed windows by document.

A window's minimiser is the smallest hash of the short grams inside it. Equal windows have equal minimisers, and
at as many places, so a count-min sketch of the minimisers' places never counts a repeated window once: windows whose
minimiser is estimated to occur once are surely unique. There are far fewer minimisers than windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ranges, runs, text_columns
from .words import grams, in_texts, mix, sliding_min

RUNS = "bucket int, runs binary"


def windows(units: np.ndarray, bounds: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, which of them are minimisers' places, each window's minimiser, which windows are within one text)."""
    g = grams(units, gram)
    if len(units) < width:
        return g, np.zeros(len(g), bool), np.zeros(0, np.uint64), np.zeros(0, bool)
    span = width - gram + 1
    least = sliding_min(g, span)
    inside = in_texts(bounds, width, len(least))
    # A gram is some window's minimiser if the largest minimiser of the windows that hold it equals it.
    padded = np.full(len(g) + span - 1, ~np.uint64(0))
    padded[span - 1 : span - 1 + len(least)] = np.where(inside, ~least, ~np.uint64(0))
    return g, ~sliding_min(padded, span) == g, least, inside


def pack_runs(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> bytes:
    return np.concatenate(([len(doc)], np.diff(doc, prepend=0), start, length)).astype("<i8").tobytes()


def unpack_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values = np.frombuffer(blob, "<i8")
    n = int(values[0])
    return np.cumsum(values[1 : n + 1]), values[n + 1 : 2 * n + 1], values[2 * n + 1 :]


def bucket_of(doc: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(doc.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def run_batches(doc: np.ndarray, start: np.ndarray, length: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs of removed windows, a row for each bucket of documents."""
    bucket = bucket_of(doc, buckets)
    order = np.lexsort((start, doc, bucket))
    bucket, doc, start, length = bucket[order], doc[order], start[order], length[order]
    # Runs that touch become one.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + length[:-1])
    heads = np.flatnonzero(new)
    if len(heads):
        length = np.add.reduceat(length, heads)
    bucket, doc, start = bucket[heads], doc[heads], start[heads]
    cut = runs(bucket)
    return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]] if len(doc) else [], pa.int32()), pa.array([pack_runs(doc[a:b], start[a:b], length[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], ["bucket", "runs"])


class RunBuffer:
    """Gathers removed windows of many groups, so that a task writes a row for each bucket and not for each group and bucket."""

    def __init__(self, buckets: int, most: int = 2_000_000):
        self.buckets, self.most, self.held, self.n = buckets, most, [], 0

    def add(self, doc: np.ndarray, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((doc, start))
        self.n += len(doc)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            doc, start = (np.concatenate(x) for x in zip(*self.held, strict=True))
            yield run_batches(doc, start, np.ones(len(doc), np.int64), self.buckets)
        self.held, self.n = [], 0


def buckets_for(df: DataFrame, times: int) -> int:
    """Buckets in proportion to the session's shuffle partitions, which grow with the input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) * times


def applied(docs: DataFrame, removed: DataFrame, buckets: int, finish: Callable, names: list[str], schema: str) -> DataFrame:
    """Each text beside its runs: ``finish(ids, bytes, offsets, run's text, start, length)`` gives arrays for ``schema``.

    One shuffle by buckets of documents; in a partition a bucket's runs come first and its texts then stream by.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(doc, buckets), pa.int32()), *batch.columns], ["bucket", "doc_id", "text"])

    texts = docs.mapInArrow(place, "bucket int, doc_id long, text string").select("bucket", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("binary").alias("runs"))
    found = removed.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "runs")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, ready = None, [], None
        for batch in batches:
            cut = runs(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column(1).to_numpy(zero_copy_only=False))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                part = batch.slice(a, b - a)
                bucket = part.column(0)[0].as_py()
                if bucket != at:
                    at, held, ready = bucket, [], None
                if part.column(1)[0].as_py() == 0:
                    held += [unpack_runs(x.as_buffer()) for x in part.column(4)]
                    continue
                if ready is None:
                    doc, start, length = (np.concatenate([x[i] for x in held]) if held else np.zeros(0, np.int64) for i in range(3))
                    order = np.argsort(doc, kind="stable")
                    ready, held = (doc[order], start[order], length[order]), []
                for ids, data, offsets in pieces([part.select([2, 3])]):
                    lo, hi = np.searchsorted(ready[0], ids, "left"), np.searchsorted(ready[0], ids, "right")
                    own = ranges(lo, hi - lo)
                    text = np.repeat(np.arange(len(ids)), hi - lo)
                    yield pa.RecordBatch.from_arrays(finish(ids, data, offsets, text, ready[1][own], ready[2][own]), names)

    both = texts.unionByName(found).repartition("bucket").sortWithinPartitions("bucket", "kind")
    return both.mapInArrow(finished, schema)


def covered(sizes: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Which units, of texts with ``sizes`` units laid end to end, lie in a removed window."""
    base = np.cumsum(sizes) - sizes
    step = np.zeros(int(sizes.sum()) + 1, np.int32)
    np.add.at(step, base[text] + start, 1)
    np.add.at(step, base[text] + start + length + width - 1, -1)
    return np.cumsum(step)[:-1] > 0


__all__ = ["RunBuffer", "applied", "buckets_for", "covered", "run_batches", "text_columns", "windows"]
