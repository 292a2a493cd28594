"""Suffix-array deduplication: bytes covered by a string of ``width`` bytes that a document with a smaller id also holds.

Places are dealt by content: a window's minimiser names the group in which all windows equal to it meet, so each group can be
worked on by itself. A task sends the texts around its repeated minimisers, as segments of windows with one minimiser; of
equal segments within a task only the smallest document's goes on, and the others are known to repeat it.

In a group, the distinct segments are laid end to end and their suffixes sorted by their first 64 bytes. Common
prefixes are derived by increasing value: level l + 1 extends level l's intervals of the Burrows-Wheeler order backward by one
symbol, and a boundary appears between two neighbours that start with one symbol if the suffixes after it lie in different
intervals of level l. It stops at ``width``: the intervals left are the sets of equal windows.

Null texts are empty. Texts shorter than a window lose nothing. Rows with one doc_id count as one document. Overlaps
count; windows are judged on the input. Rows without doc_id are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ranges, runs, text_columns
from .repeats import RUNS, RunBuffer, applied, buckets_for, covered, run_batches, windows
from .sketch import repeated
from .words import BASE, BYTE, mix, powers

WIDTH = 50
GRAM = 16
SKETCH_ROWS, SKETCH_BITS = 2, 28
#: Bytes of segments that a task compares at once.
HELD = 24 << 20
#: Bytes that are hashed at once: eight bytes are held for each, several times.
PIECE = 1 << 19
#: Bytes of segments whose suffixes are sorted together, or one minimiser's, if they are more.
TOGETHER = 1 << 17


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, sorted by their first ``depth`` or more symbols, by doubling; the end is after every byte of UTF-8."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, 255, np.uint8)))
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | padded[k : k + n]
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    rank = np.full(n + depth, n, np.uint64)
    rows, width = np.arange(n), 8
    mine = order
    while True:
        rank[mine] = rows[new][np.cumsum(new) - 1]  # the rank of a class is its first row
        # Only rows in classes of two or more move on, each within its class.
        rows = rows[~(new & np.append(new[1:], True))]
        if width >= depth or not len(rows):
            return order
        mine = order[rows]
        key = rank[mine] << np.uint64(32) | rank[mine + width]
        by = np.argsort(key)
        mine, key = mine[by], key[by]
        order[rows] = mine
        new = np.concatenate(([True], key[1:] != key[:-1]))
        width *= 2


def equal_windows(text: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order, the number of each one's set of suffixes that agree in their first ``width`` symbols)."""
    order = suffix_order(text, width)
    n = len(text)
    row_of = np.empty(n + 1, np.int64)
    row_of[order] = np.arange(n)
    row_of[n] = n  # the empty suffix
    after = row_of[order + 1]  # the row of a suffix without its first symbol
    head = text[order]
    boundary = np.concatenate(([True], head[1:] != head[:-1]))
    interval = np.zeros(n + 1, np.int32 if n < 1 << 31 else np.int64)  # 0 for the empty suffix
    rows = np.flatnonzero(~boundary)  # those still in one interval with the row before
    low, high = after[rows - 1], after[rows]
    np.cumsum(boundary, out=interval[:n])
    found = interval[low] != interval[high]
    fresh, rows, low, high = rows[found], rows[~found], low[~found], high[~found]
    boundary[fresh] = True
    # A row whose two suffixes go on in neighbouring rows opens just when a boundary falls between those; others are looked up.
    near = high == low + 1
    waits = np.zeros(n, bool)
    waits[rows[near]] = True
    before = np.zeros(n + 1, np.int64)
    before[after] = np.arange(n)
    rows, low, high = rows[~near], low[~near], high[~near]
    for _ in range(2, width):
        if not len(fresh):
            break
        one = before[fresh]
        one = one[waits[one]]
        waits[one] = False
        if len(rows):
            if len(fresh) + 2 * len(rows) < n // 16:
                fresh.sort()
                found = np.searchsorted(fresh, low, "right") != np.searchsorted(fresh, high, "right")
            else:
                np.cumsum(boundary, out=interval[:n])
                found = interval[low] != interval[high]
            one = np.concatenate((one, rows[found]))
            rows, low, high = rows[~found], low[~found], high[~found]
        boundary[one] = True
        fresh = one
    return order, np.cumsum(boundary) - 1


def removed_runs(rows: DataFrame, width: int, gram: int, buckets: int) -> DataFrame:
    """Runs of windows that also start in a document with a smaller id; rows has doc_id and text."""

    def minimisers(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, data, offsets in pieces(batches, PIECE):
            g, chosen, _, _ = windows(BYTE[data], offsets, width, gram)
            yield g[chosen]

    maybe = repeated(rows, minimisers, SKETCH_ROWS, SKETCH_BITS)
    groups = buckets_for(rows, 16)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            key, same, doc, start, count, at = (np.concatenate([x[i] for x in held]) for i in range(6))
            base = np.cumsum([0, *(len(x[6]) for x in held[:-1])])
            at = at + np.repeat(base, [len(x[0]) for x in held])
            data = np.concatenate([x[6] for x in held])
            order = np.lexsort((doc, same))
            head = runs(same[order])
            least = np.repeat(doc[order][head[:-1]], np.diff(head))
            later = order[doc[order] > least]
            if len(later):
                found = run_batches(doc[later], start[later], count[later], buckets)
                yield pa.RecordBatch.from_arrays([pa.array([-1] * found.num_rows, pa.int32()), *found.columns], ["group", "bucket", "runs"])
            first = order[doc[order] == least]
            group = (mix(key[first]) % np.uint64(groups)).astype(np.int64)
            by = np.argsort(group, kind="stable")
            first, group = first[by], group[by]
            cut = runs(group)
            packer, blobs = zstandard.ZstdCompressor(level=1), []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own = first[a:b]
                head = np.concatenate(([len(own)], key[own].view(np.int64), doc[own], start[own], count[own])).astype(np.int64)
                blobs.append(packer.compress(head.tobytes() + data[ranges(at[own], count[own] + width - 1)].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(group[cut[:-1]], pa.int32()), pa.array([0] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["group", "bucket", "runs"])

        for doc, data, offsets in pieces(batches, PIECE):
            units = BYTE[data]
            _, _, least, inside = windows(units, offsets, width, gram)
            if not len(least):
                continue
            new = np.ones(len(least), bool)
            new[1:] = (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])
            heads = np.flatnonzero(new)
            count = np.diff(np.append(heads, len(least)))
            kept = inside[heads]
            kept[kept] = maybe(least[heads[kept]])
            heads, count = heads[kept], count[kept]
            if len(heads):
                total = np.zeros(len(data) + 1, np.uint64)
                np.cumsum(units * powers(BASE, len(data))[: len(data)], out=total[1:])
                ends = heads + count + width - 1
                same = mix((total[ends] - total[heads]) * powers(pow(BASE, -1, 1 << 64), len(data) + 1)[heads] + count.astype(np.uint64))
                text = np.searchsorted(offsets, heads, "right") - 1
                held.append((least[heads], same, doc[text], heads - offsets[text], count, heads, data))
                size += len(data)
                if size >= HELD:
                    yield from out()
                    held, size = [], 0
        if held:
            yield from out()

    def repeats(distinct: list[bytes], own: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, starts) of windows that a smaller document holds, of segments whose text is ``distinct[own]``."""
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, own, doc)
        length = np.fromiter(map(len, distinct), np.int64, len(distinct))
        text = np.frombuffer(b"".join(distinct), np.uint8)
        order, cls = equal_windows(text, width)
        base = np.cumsum(length) - length
        window = np.zeros(len(text), bool)
        window[ranges(base, length - width + 1)] = True
        segment = np.repeat(np.arange(len(distinct)), length)
        rows_in = window[order]
        cls, place = cls[rows_in], order[rows_in]
        heads = runs(cls)
        smallest = np.empty(len(text), np.int64)
        smallest[place] = np.repeat(np.minimum.reduceat(least[segment[place]], heads[:-1]), np.diff(heads))
        at = ranges(base[own], count)
        by = np.repeat(np.arange(len(own)), count)
        gone = smallest[at] < doc[by]
        at, by = at[gone], by[gone]
        return doc[by], start[by] + at - base[own[by]]

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[bytes]] = {}
        for batch in batches:
            known = pc.less(batch.column(0), 0)
            yield batch.filter(known).select(["bucket", "runs"])
            for g, blob in zip(*(c.to_pylist() for c in batch.filter(pc.invert(known)).select(["group", "runs"]).columns), strict=True):
                seen.setdefault(g, []).append(blob)
        packer, removed = zstandard.ZstdDecompressor(), RunBuffer(buckets)
        for g in list(seen):
            blobs = [packer.decompress(x) for x in seen.pop(g)]
            sizes = [int(np.frombuffer(x, np.int64, 1)[0]) for x in blobs]
            heads = [np.frombuffer(x, np.int64, 4 * n, 8).reshape(4, n) for x, n in zip(blobs, sizes, strict=True)]
            # A minimiser that came once, for all the sketch's estimate, has no window that another place could equal.
            doc, start, count = (np.concatenate([h[k] for h in heads]) for k in (1, 2, 3))
            _, back, times = np.unique(np.concatenate([h[0] for h in heads]), return_inverse=True, return_counts=True)
            pick = np.flatnonzero(times[back] > 1)
            pick = pick[np.argsort(back[pick], kind="stable")]
            if not len(pick):
                continue
            size = count + width - 1
            home = np.repeat(np.arange(len(blobs)), sizes)
            end = np.concatenate([8 + 32 * n + np.cumsum(h[3] + width - 1) for n, h in zip(sizes, heads, strict=True)])
            # Minimisers are compared a few at a time, so that what is sorted stays in the processor's cache.
            before, each = np.cumsum(size[pick]) - size[pick], runs(back[pick])
            cut = runs(np.repeat(before[each[:-1]] // TOGETHER, np.diff(each)))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                mine = pick[a:b]
                which: dict[bytes, int] = {}
                own = np.array([which.setdefault(blobs[k][z - n : z], len(which)) for k, z, n in zip(home[mine].tolist(), end[mine].tolist(), size[mine].tolist(), strict=True)])
                yield from removed.add(*repeats(list(which), own, doc[mine], start[mine], count[mine]))
        yield from removed.flush()

    # Runs that are known already pass through, dealt by their bucket of documents.
    found = rows.mapInArrow(segments, "group int, bucket int, runs binary")
    return found.repartition(F.when(F.col("group") < 0, -1 - F.col("bucket")).otherwise(F.col("group"))).mapInArrow(group, RUNS)


def deduplicated(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", bytes_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (longest removed runs), kept_sha256 and, with ``bytes_kept``, kept."""
    rows = text_columns(docs, id_col, text_col)
    buckets = buckets_for(rows, 4)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + bytes_kept]

    def finish(ids, data, offsets, text, start, length):
        gone = covered(np.diff(offsets), text, start, length, width)
        count = np.concatenate(([0], np.cumsum(gone)))[offsets]
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[heads] = gone[heads]
        spans = np.concatenate(([0], np.cumsum(first)))[offsets]
        raw = data[~gone].tobytes()
        cut = offsets - count
        kept = [raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        columns = [pa.array(ids), pa.array(np.diff(offsets)), pa.array(np.diff(count)), pa.array(np.diff(spans)), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        return columns + [pa.array(kept, pa.binary())] * bytes_kept

    kinds = ["long", "long", "long", "long", "string", "binary"]
    return applied(rows, removed_runs(rows, width, gram, buckets), buckets, finish, names, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=False)))
