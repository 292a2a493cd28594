"""Consensus of each candidate's sequences by votes on a draft.

The draft is a candidate's sequence of median length. Every sequence is aligned to it from end to end, in a band, and votes on each letter
of the draft (its own letter, or none) and on what stands behind it. Votes are counted a batch at a time and added, so a candidate with any number of
sequences can be spread over many tasks. The winning letters are the draft of the next round.

Sequences that are null or empty have no vote. With one or two sequences the draft wins its ties. Sequences may have any letters.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH, MISMATCH, GAP = 2, -3, -3
#: Cells of the alignments that are worked on at once.
CELLS = 1 << 24
ROUNDS = 2
#: Half the band's width: so many letters, and this share of the longer sequence.
BAND, BAND_SHARE = 32, 0.05
_LOW = -(1 << 29)
VOTES = "candidate long, side int, pos long, behind boolean, symbol string, own boolean, n long"


def split_sequences(reads: DataFrame) -> DataFrame:
    """upper and lower parts of (seq, upper_end, lower_start), 0-based offsets."""
    return reads.withColumn("upper", F.expr("substring(seq, 1, cast(upper_end as int))")).withColumn("lower", F.expr("substring(seq, cast(lower_start as int) + 1, length(seq))"))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def matrix(rows: list[np.ndarray]) -> np.ndarray:
    """The rows from column 1 on, filled up with 0."""
    out = np.zeros((len(rows), 1 + max(map(len, rows), default=0)), np.uint32)
    for r, x in enumerate(rows):
        out[r, 1 : len(x) + 1] = x
    return out


def aligned(drafts: list[np.ndarray], texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
    """(best scores, for each text the letters at its draft's places 1 and so on, or 0, letters behind places as (text, place, nth, letter)).

    Row i of all texts is computed together: cell k is the draft's place i + low + k, so a step along both stays in its column. Steps along
    the draft alone, which depend on the cell before, are a running maximum.
    """
    n, sizes, count = np.array([len(d) for d in drafts]), np.array([len(t) for t in texts]), len(texts)
    half = BAND + (BAND_SHARE * np.maximum(n, sizes)).astype(np.int64)
    low, longest = np.minimum(0, n - sizes) - half, int(sizes.max(initial=0))
    width = int((np.abs(n - sizes) + 2 * half).max(initial=0)) + 1
    letters, draft, rows = matrix(texts), matrix(drafts), np.arange(count)
    # The draft's letters under the moving band: column c of row r is place low + c.
    under = np.zeros((count, longest + width + 1), np.uint32)
    places = low[:, None] + np.arange(longest + width + 1)
    fits = (places >= 1) & (places <= n[:, None])
    under[fits] = draft[np.nonzero(fits)[0], places[fits]]
    cell = np.arange(width)
    first = low[:, None] + cell
    score = np.where((first >= 0) & (first <= n[:, None]), first * GAP, _LOW).astype(np.int32)
    ways = np.zeros((longest + 1, count, width), np.uint8)  # 1: a letter of both, 2: of the text, 3: of the draft
    ways[0] = 3
    ends, last = np.zeros(count, np.int32), n - sizes - low
    ends[sizes == 0] = score[sizes == 0, last[sizes == 0]]
    slope = (GAP * cell).astype(np.int32)
    outside = ~((places >= 0) & (places <= n[:, None]))
    text = np.full_like(score, _LOW)
    for i in range(1, longest + 1):
        band = slice(i, i + width)
        both = score + np.where(under[:, band] == letters[:, i, None], np.int32(MATCH), np.int32(MISMATCH))
        both[~fits[:, band]] = _LOW
        text[:, :-1] = score[:, 1:] + GAP
        best = np.maximum(both, text)
        best[outside[:, band]] = _LOW
        run = np.maximum.accumulate(best - slope, axis=1) + slope
        ways[i] = np.where(run > best, 3, np.where(both >= text, 1, 2))
        run[outside[:, band]] = _LOW
        score = run
        done = np.flatnonzero(sizes == i)
        ends[done] = score[done, last[done]]
    at, i = n.copy(), sizes.copy()
    out, behind = np.zeros((count, int(n.max(initial=0))), np.uint32), []
    while True:
        open_ = rows[(i > 0) | (at > 0)]
        if not len(open_):
            return ends, out, behind
        x, j = i[open_], at[open_]
        way = ways[x, open_, np.clip(j - x - low[open_], 0, width - 1)]
        way[x == 0], way[j == 0] = 3, 2
        pair, own = open_[way == 1], open_[way == 2]
        out[pair, at[pair] - 1] = letters[pair, i[pair]]
        if len(own):
            behind += zip(own.tolist(), at[own].tolist(), i[own].tolist(), letters[own, i[own]].tolist(), strict=True)
        i[open_[way != 3]] -= 1
        at[open_[way != 2]] -= 1


def votes(groups: np.ndarray, drafts: list[str], texts: list[str], times: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(group, place, whether behind it, symbol, whether it is the draft's own, votes): what texts say of their drafts, one draft a group.

    times: how many votes each text has, one by default. Texts without a letter behind a place don't vote there: those are all the others.
    A text that equals its draft votes for each of its letters and isn't aligned: no other alignment has its score.
    """
    times = np.ones(len(texts), np.int64) if times is None else times
    whole, parts = [codes(d) for d in drafts], [codes(t) for t in texts]
    same = np.array([d == t for d, t in zip(drafts, texts, strict=True)], bool)
    order = np.lexsort((np.array([len(d) for d in whole]), np.array([len(t) for t in parts])))
    order = order[~same[order]]
    of_group = {int(g): d for g, d in zip(groups, whole, strict=True)}
    alike, which = np.unique(groups[same], return_inverse=True)
    total = np.zeros(len(alike), np.int64)
    np.add.at(total, which, times[same])
    long = np.array([len(of_group[g]) for g in alike.tolist()], np.int64)
    first = np.concatenate([np.zeros(0, np.uint32), *(of_group[g] for g in alike.tolist())]).astype(np.int64)
    held = [np.stack((np.repeat(alike, long), np.arange(len(first)) - np.repeat(np.cumsum(long) - long, long) + 1, first, np.repeat(total, long)))]
    extra: dict[tuple[int, int, str], int] = {}
    at = 0
    while at < len(order):  # as many at once as have room; sorted, so their lengths are alike
        to, width = at, 0
        while to < len(order):
            n, m = len(whole[order[to]]), len(parts[order[to]])
            width = max(width, abs(n - m) + 2 * (BAND + int(BAND_SHARE * max(n, m))) + 1)
            if to > at and (to + 1 - at) * (m + 1) * width > CELLS:
                break
            to += 1
        own = order[at:to]
        _, found, behind = aligned([whole[x] for x in own], [parts[x] for x in own])
        row, place = np.nonzero(np.arange(found.shape[1]) < np.array([len(whole[x]) for x in own])[:, None])
        held.append(np.stack((groups[own][row], place + 1, found[row, place].astype(np.int64), times[own][row])))
        joined: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, p, nth, letter in behind:
            joined.setdefault((r, p), []).append((nth, letter))
        for (r, p), x in joined.items():
            key = (int(groups[own[r]]), p, "".join(chr(c) for _, c in sorted(x)))
            extra[key] = extra.get(key, 0) + int(times[own[r]])
        at = to
    every = np.concatenate(held, axis=1)
    order = np.lexsort(every[2::-1])
    every, weight = every[:3, order], every[3, order]
    cut = np.flatnonzero(np.concatenate(([True], (every[:, 1:] != every[:, :-1]).any(axis=0))))
    group, place, letter = every[:, cut]
    n = np.add.reduceat(weight, cut)
    own = np.array([of_group[g][p - 1] == x for g, p, x in zip(group.tolist(), place.tolist(), letter.tolist(), strict=True)], bool)
    symbol = [chr(x) if x else "" for x in letter.tolist()]
    late = sorted(extra.items())
    join = lambda a, b: np.concatenate((a, np.array(b, a.dtype)))
    return join(group, [g for (g, _, _), _ in late]), join(place, [p for (_, p, _), _ in late]), join(np.zeros(len(group), bool), [True] * len(late)), symbol + [x for (_, _, x), _ in late], join(own, [False] * len(late)), join(n, [v for _, v in late])


def voted(rows: DataFrame) -> DataFrame:
    """VOTES of rows (candidate, side, seq, draft, times), counted a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            candidate, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            keys, group = np.unique(np.stack((candidate, side)), axis=1, return_inverse=True)
            which, place, late, symbol, own, n = votes(group.reshape(-1), batch.column(3).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_numpy())
            columns = [pa.array(keys[0, which]), pa.array(keys[1, which].astype(np.int32)), pa.array(place), pa.array(late), pa.array(symbol, pa.string()), pa.array(own), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, ["candidate", "side", "pos", "behind", "symbol", "own", "n"])

    return rows.select("candidate", "side", "seq", "draft", "times").mapInArrow(run, VOTES)


def called(counted: DataFrame, drafts: DataFrame) -> DataFrame:
    """(candidate, side, draft, n) of the winning symbols: of equally many votes the draft's own, then the first by letter. drafts: candidate, side, draft, n."""
    total = counted.groupBy("candidate", "side", "pos", "behind", "symbol").agg(F.sum("n").alias("n"), F.bool_or("own").alias("own"))
    best = total.groupBy("candidate", "side", "pos", "behind").agg(F.min_by(F.struct("symbol", "n"), F.struct(-F.col("n"), ~F.col("own"), "symbol")).alias("won"), F.sum("n").alias("all"))
    placed = best.groupBy("candidate", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "behind", "won", "all"))).alias("places"))
    # Behind a place, those that say nothing are as many as there are sequences without the others.
    symbol = lambda x: F.when(x["behind"] & (x["won"]["n"] <= F.col("n") - x["all"]), F.lit("")).otherwise(x["won"]["symbol"])
    letters = F.array_join(F.transform("places", symbol), "")
    return placed.join(drafts.select("candidate", "side", "n"), ["candidate", "side"]).select("candidate", "side", letters.alias("draft"), "n")


def drafts(rows: DataFrame) -> DataFrame:
    """(candidate, side, draft, n): a sequence nearest to the median length, the longest and then the first of them, and how many there are.
    rows: candidate, side, seq, its smallest ord, and times, how often it is there."""
    middle = rows.groupBy("candidate", "side").agg(F.percentile(F.length("seq"), 0.5, F.col("times")).alias("middle"), F.sum("times").alias("n"))
    near = F.struct(F.abs(F.length("seq") - F.col("middle")), -F.length("seq"), "ord", "seq")
    return rows.join(middle, ["candidate", "side"]).groupBy("candidate", "side").agg(F.min_by("seq", near).alias("draft"), F.max("n").alias("n"))


def consensus(rows: DataFrame, folder: str, rounds: int = ROUNDS) -> DataFrame:
    """(candidate, upper, lower) of (candidate, ord, upper, lower): '' where a candidate has no letters on a side.

    The sequences, each once with the number of its votes, and each round's drafts are written to folder, so nothing is computed twice. Sequences meet their draft in a join whose hot keys
    Spark splits, as what follows needs no key together.
    """

    def written(df: DataFrame, name: str) -> DataFrame:
        path = f"{folder.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.col(s).alias("seq")) for i, s in enumerate(("upper", "lower")))))
    every = rows.select("candidate", "ord", sides.alias("x")).groupBy("candidate", "x.side", "x.seq").agg(F.min("ord").alias("ord"), F.count("*").alias("times"))
    every = written(every, "sequences")
    spoken = every.where(F.length("seq") > 0)
    now = written(drafts(spoken), "drafts_0")
    for turn in range(rounds):
        votes_ = voted(spoken.join(now.where(F.length("draft") > 0).select("candidate", "side", "draft"), ["candidate", "side"]))
        now = written(called(votes_, now), f"drafts_{turn + 1}")
    texts = [F.coalesce(F.max(F.when(F.col("side") == i, F.col("draft"))), F.lit("")).alias(s) for i, s in enumerate(("upper", "lower"))]
    return every.select("candidate").distinct().join(now.groupBy("candidate").agg(*texts), "candidate", "left").na.fill("", ["upper", "lower"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
