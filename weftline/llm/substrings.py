"""Substring deduplication: word windows that occurred before are removed.

A window is ``width`` consecutive words of one document. Three passes read the texts: (1) partitions' count-min
sketches of the windows' minimisers are merged, (2) only windows estimated repeated are grouped, exactly, by 64-bit
hashes of their words, (3) each document loses the words that later occurrences cover. A task groups its own windows first
and passes on one place, the earliest, for each, so a passage that stands in a third of all documents costs the grouping one row a task.

The order of occurrences is by doc_id, then by start. Null texts are empty; texts with fewer words than a window lose
nothing. Rows with one doc_id count as one document: what is removed from it is removed from each. Rows without doc_id are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, ranges, runs, text_columns
from .repeats import RUNS, RunBuffer, applied, buckets_for, covered, run_batches, windows
from .sketch import repeated
from .words import grams, word_edges, words

WIDTH = 20
GRAM = 8
SKETCH_ROWS, SKETCH_BITS = 2, 27
#: Windows that a task groups at once.
HELD = 1_500_000


def _first(keys: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(each key's first place by doc and start; the others, in order). Rows that repeat a document hold its first place again, which isn't another."""
    order = np.lexsort((start, doc, keys))
    keys, doc, start = keys[order], doc[order], start[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    return order[new], order[(doc != doc[head]) | (start != start[head])]


def removed_runs(rows: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """Runs of windows that aren't the first of their words; rows has doc_id and text."""

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, data, offsets in pieces(batches):
            h, _, _, bounds = words(data, offsets)
            g, chosen, _, _ = windows(h, bounds, width, gram)
            yield g[chosen]

    maybe = repeated(rows, minimisers, SKETCH_ROWS, SKETCH_BITS)
    groups = buckets_for(rows, 8)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, doc, start = (np.concatenate(x) for x in zip(*held, strict=True))
            first, later = _first(keys, doc, start)
            if len(later):
                found = run_batches(doc[later], start[later], np.ones(len(later), np.int64), buckets)
                yield pa.RecordBatch.from_arrays([pa.array([-1] * found.num_rows, pa.int32()), *found.columns], ["group", "bucket", "runs"])
            group = (keys[first] % np.uint64(groups)).astype(np.int64)
            first = first[np.lexsort((start[first], doc[first], group))]
            group = (keys[first] % np.uint64(groups)).astype(np.int64)
            cut = runs(group)
            blobs = [np.concatenate((keys[first[a:b]].view(np.int64), np.diff(doc[first[a:b]], prepend=0), start[first[a:b]])).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(group[cut[:-1]], pa.int32()), pa.array([0] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["group", "bucket", "runs"])

        for doc, data, offsets in pieces(batches):
            h, _, _, bounds = words(data, offsets)
            _, _, least, inside = windows(h, bounds, width, gram)
            if not len(least):
                continue
            at = np.flatnonzero(inside)
            at = at[maybe(least[at])]
            if len(at):
                text = np.searchsorted(bounds, at, "right") - 1
                held.append((grams(h, width)[at], doc[text], at - bounds[text]))
                n += len(at)
                if n >= HELD:
                    yield from out()
                    held, n = [], 0
        if n:
            yield from out()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for g, blob in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                seen.setdefault(g, []).append(np.frombuffer(blob.as_buffer(), np.int64).reshape(3, -1))
        found = RunBuffer(buckets)
        for blobs in seen.values():
            keys, doc, start = np.concatenate([b[0] for b in blobs]).view(np.uint64), np.concatenate([np.cumsum(b[1]) for b in blobs]), np.concatenate([b[2] for b in blobs])
            _, later = _first(keys, doc, start)
            yield from found.add(doc[later], start[later])
        yield from found.flush()

    from .common import shared_dir, written

    found = written(rows.mapInArrow(candidates, "group int, bucket int, runs binary"), shared_dir(rows.sparkSession), "candidates")
    across = found.where("group >= 0").repartition("group").mapInArrow(group, RUNS)
    return found.where("group < 0").select("bucket", "runs").unionByName(across)


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``texts``, kept: the words that stay, joined by one space."""
    rows = text_columns(docs, id_col, text_col)
    buckets = buckets_for(rows, 4)
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + texts]

    def finish(ids, data, offsets, text, start, length):
        a, b = word_edges(data, offsets)
        bounds = np.searchsorted(a, offsets)
        gone = covered(np.diff(bounds), text, start, length, width)
        count = np.concatenate(([0], np.cumsum(gone)))
        keep = np.flatnonzero(~gone)
        size = b[keep] - a[keep] + 1
        out = np.append(data, np.uint8(32))[ranges(a[keep], size)]
        ends = np.cumsum(size)
        out[ends - 1] = 32
        cut = np.concatenate(([0], ends))[np.searchsorted(keep, bounds)]
        raw = out.tobytes()
        kept = [raw[x : max(x, y - 1)] for x, y in zip(cut[:-1], cut[1:], strict=True)]
        columns = [pa.array(ids), pa.array(np.diff(bounds)), pa.array(np.diff(count[bounds])), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        return columns + [pa.array([x.decode() for x in kept], pa.string())] * texts

    kinds = ["long", "long", "long", "string", "string"]
    return applied(rows, removed_runs(rows, width, gram, buckets), buckets, finish, names, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=False)))
