"""Best-fit packing of token ids into sequences of at most SIZE tokens, improved by swap-based local search.

Documents longer than a sequence are cut from the end into whole sequences; what is left at their beginning, and every shorter document, is
dealt into tasks of about ROWS pieces. A task packs its pieces by best fit and then improves the sequences that are not full: it takes
them from the emptiest on and moves one or two of its pieces into another, for nothing or for one piece of that one, whenever this makes
the sum of squared fills larger, until the sequence is empty or nothing helps. Rounds follow: the sequences that are still not full are dealt
anew, into as many tasks as they then need, until one task has seen all of them or a round frees less than one in a thousand.

A round's rows are sequences with the pieces that they hold, at most SIZE of them, so no group is ever larger, and each round is a written
table. Only counts come to the driver. The number of sequences is not proven least: packing is NP-hard.

Null and empty texts are the end id alone. Repeated rows and ids are packed row by row, each piece at a place of its own. Rows without an
id are left out. An empty table gives no sequence. Columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_pieces import kept_encoder
from .common import pieces, ranges, shared_dir, text_columns, written
from .token_files import VOCABULARY, library_encoder

SIZE, END = 1024, 2
#: Pieces that a task packs, about.
ROWS = 50_000
SEQUENCES = "sequence_id long, fill int, uids array<long>, sizes array<int>, offsets array<int>"


def tokenized(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 16-bit integers) and ids_crc32 (of the ids as 32-bit integers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers as P

        place = path or P.path(VOCABULARY)
        own = kept_encoder(("tokenizers", place), lambda: library_encoder(place))
        for doc, data, offsets in pieces(batches):
            ids, cut = own(data, offsets)
            ids = np.insert(ids, cut[1:], np.uint16(end)).astype("<u2")
            cut = cut + np.arange(len(cut))
            total = np.diff(cut)
            count = -(-total // size)
            nth = ranges(np.zeros(len(doc), np.int64), count)
            start = np.maximum(nth * size - np.repeat(count * size - total, count), 0)
            length = np.diff(np.append(start, 0))
            length[np.cumsum(count) - 1] = total - start[np.cumsum(count) - 1]
            at = np.repeat(cut[:-1], count) + start
            raw, wide = ids.tobytes(), ids.astype("<u4").tobytes()
            bounds = list(zip(at.tolist(), (at + length).tolist(), strict=True))
            columns = [pa.array(np.repeat(doc, count)), pa.array(nth.astype(np.int32)), pa.array(start), pa.array(length), pa.array([raw[2 * a : 2 * b] for a, b in bounds], pa.binary()), pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in bounds], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids", "ids_crc32"])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long")


def best_fit(sizes: np.ndarray, order: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece, taken in the order given: the fullest that has room, or a new one."""
    with_gap: list[list[int]] = [[] for _ in range(size + 1)]
    out, gaps, bins = np.zeros(len(sizes), np.int64), 0, 0  # bit g of gaps: there is a bin with room for g
    for i, s in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fits := gaps >> s:
            gap = s + (fits & -fits).bit_length() - 1
            b = with_gap[gap].pop()
            if not with_gap[gap]:
                gaps ^= 1 << gap
        else:
            b, gap, bins = bins, size, bins + 1
        out[i] = b
        if gap > s:
            with_gap[gap - s].append(b)
            gaps |= 1 << gap - s
    return out


def offers(own: list[int], sizes: np.ndarray) -> dict[int, tuple[int, ...]]:
    """For each size that one or two of these pieces have together, the pieces."""
    by_size: dict[int, list[int]] = {}
    for i in own:
        by_size.setdefault(int(sizes[i]), []).append(i)
    out: dict[int, tuple[int, ...]] = {s: (x[0],) for s, x in by_size.items()}
    distinct = sorted(by_size)
    for k, s in enumerate(distinct):
        for t in distinct[k:]:
            if s != t or len(by_size[s]) > 1:
                out.setdefault(s + t, (by_size[s][0], by_size[t][-1]))
    return out


def improved(sizes: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """The bin of each piece after local search. Full bins stay as they are.

    Every change adds d tokens to a bin of fill f and takes them from one of fill g, which makes the squares larger by 2 * d * (f - g + d); of the
    changes that a bin can make, the one that adds most is made. For a partner piece the largest offer that fits is the best, so one table
    lookup a partner finds it. The sum of squares is a bounded whole number, so the search ends.
    """
    fill = np.bincount(bins, sizes).astype(np.int64)
    count, n = len(fill), len(sizes)
    held: list[list[int]] = [[] for _ in range(count)]
    for i, b in enumerate(bins.tolist()):
        held[b].append(i)
    # What a bin may give back: one of its pieces, or nothing.
    back, at = np.concatenate((sizes, np.zeros(count, np.int64))), np.concatenate((bins, np.arange(count)))
    used, least, changed = int((fill > 0).sum()), -(-int(sizes.sum()) // size), True
    while changed and used > least:
        changed = False
        open_ = np.flatnonzero((fill[at] > 0) & (fill[at] < size))
        for giver in np.argsort(fill, kind="stable").tolist():
            while used > least and 0 < fill[giver] < size:
                offer = offers(held[giver], sizes)
                largest = np.zeros(2 * size + 1, np.int64)
                largest[list(offer)] = list(offer)
                np.maximum.accumulate(largest, out=largest)
                have = fill[at[open_]]
                add = largest[back[open_] + size - have] - back[open_]
                gain = np.where((add > 0) & (at[open_] != giver) & (have > 0) & (have < size), add * (have - fill[giver] + add), 0)
                best = int(np.argmax(gain))
                if gain[best] <= 0:
                    break
                partner, taker, d = int(open_[best]), int(at[open_[best]]), int(add[best])
                for i in offer[d + int(back[partner])]:
                    held[giver].remove(i)
                    held[taker].append(i)
                    at[i] = taker
                if partner < n:
                    held[taker].remove(partner)
                    held[giver].append(partner)
                    at[partner] = giver
                fill[giver] -= d
                fill[taker] += d
                used, changed = used - (fill[giver] == 0), True
    return at[:n].copy()


def searched(sizes: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """``improved`` on the pieces of bins that aren't full."""
    fill, out = np.bincount(bins, sizes), bins.copy()
    some = np.flatnonzero(fill[bins] < size)
    if len(some):
        numbers, own = np.unique(bins[some], return_inverse=True)
        out[some] = numbers[improved(sizes[some], own, size)]
    return out


def arranged(sizes: np.ndarray, bins: np.ndarray | None, size: int) -> np.ndarray:
    """The bin of each piece, numbered from 0: of the starts tried, the one that leaves the fewest bins. They are best fit by descending
    size, best fit with the pieces over half a bin first, and the bins as they are, if given."""
    starts = [best_fit(sizes, order, size) for order in (np.argsort(-sizes, kind="stable"), np.argsort(2 * sizes <= size, kind="stable"))]
    tried = [np.unique(searched(sizes, x, size), return_inverse=True)[1] for x in (starts if bins is None else [bins, *starts])]
    return min(tried, key=lambda x: int(x.max(initial=-1)))


def one_round(rows: DataFrame, turn: int, size: int) -> DataFrame:
    """SEQUENCES made in each partition of rows, which are (uid, length) in turn 0 and SEQUENCES later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uids, sizes, bins, known = [], [], [], 0
        for batch in batches:
            if turn == 0:
                uids.append(batch.column(0).to_numpy())
                sizes.append(batch.column(1).to_numpy())
                continue
            uids.append(batch.column(0).flatten().to_numpy())
            sizes.append(batch.column(1).flatten().to_numpy())
            bins.append(np.repeat(np.arange(len(batch)) + known, np.diff(batch.column(0).offsets.to_numpy())))
            known += len(batch)
        if not uids or not sum(map(len, uids)):
            return
        uid, length = np.concatenate(uids), np.concatenate(sizes).astype(np.int64)
        order = np.argsort(uid)  # the same whatever order the shuffle gave
        uid, length = uid[order], length[order]
        own = arranged(length, np.concatenate(bins)[order] if turn else None, size)
        order = np.lexsort((np.arange(len(own)), own))
        cut = np.concatenate(([0], np.flatnonzero(np.diff(own[order])) + 1, [len(own)])).astype(np.int32)
        first = (turn << 55) + (TaskContext.get().partitionId() << 28)
        fill = np.add.reduceat(length[order], cut[:-1])
        offset = np.cumsum(length[order]) - length[order] - np.repeat(np.cumsum(fill) - fill, np.diff(cut))
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (uid[order], length[order].astype(np.int32), offset.astype(np.int32))]
        yield from pa.table([pa.array(first + np.arange(len(fill))), pa.array(fill.astype(np.int32)), *lists], ["sequence_id", "fill", "uids", "sizes", "offsets"]).to_batches(5_000)

    return rows.mapInArrow(run, SEQUENCES)


def placements(parts: DataFrame, folder: str, size: int = SIZE, rows: int = ROWS) -> DataFrame:
    """uid, sequence_id and offset of pieces with uid and length; whole sequences get negative numbers."""
    whole = parts.where(F.col("length") >= size).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = parts.where(F.col("length") < size).select("uid", "length")
    n, turn, bins, done = short.count(), 0, None, []
    while True:
        tasks = max(1, -(-n // rows))
        key = F.col("uid") if turn == 0 else F.xxhash64("sequence_id", F.lit(turn))
        dealt = short.repartition(tasks, key)
        made = written(one_round(dealt if turn == 0 else dealt.select("uids", "sizes"), turn, size), folder, f"turn_{turn}")
        short = made.where(F.col("fill") < size)
        left = short.agg(F.count("*").alias("bins"), F.coalesce(F.sum(F.size("uids")), F.lit(0)).alias("n"), F.coalesce(F.sum("fill"), F.lit(0)).alias("fill")).first()
        after = made.count()
        gained = None if bins is None else bins - after
        if tasks == 1 or left["bins"] * size - left["fill"] < size or (gained is not None and gained * 1000 < bins):
            done.append(made)
            break
        done.append(made.where(F.col("fill") >= size))
        n, bins, turn = left["n"], left["bins"], turn + 1
    all_ = done[0]
    for x in done[1:]:
        all_ = all_.unionByName(x)
    each = all_.select("sequence_id", F.explode(F.arrays_zip("uids", "offsets")).alias("p")).select(F.col("p.uids").alias("uid"), "sequence_id", F.col("p.offsets").cast("long").alias("offset"))
    return each.unionByName(whole)


def packed(docs: DataFrame, size: int = SIZE, path: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS) -> DataFrame:
    """What ``tokenized`` gives, with sequence_id and offset of each piece. Without ids in what is read from it, ids aren't shuffled."""
    folder = shared_dir(docs.sparkSession)
    parts = written(tokenized(docs, size, path, end, id_col, text_col).withColumn("uid", F.monotonically_increasing_id()), folder, "pieces")
    return parts.join(placements(parts.select("uid", "length"), folder, size, rows), "uid").drop("uid")


def sequences(rows: DataFrame) -> DataFrame:
    """sequence_id, n and ids of the sequences that ``packed`` made; a sequence holds at most its size of pieces."""
    in_place = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate("pieces", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), in_place.alias("pieces")).select("sequence_id", "n", joined.alias("ids"))


def digests(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
