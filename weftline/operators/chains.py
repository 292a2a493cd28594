"""Second alignment: reads against gene sequences by colinear chains of shared minimisers.

A minimiser is a k-mer with the smallest hash of w in a row, of a k-mer and its reverse complement the one with the smaller hash, so both
strands of a read find it. Minimisers that the references hold very often are no anchors. Anchors of one read, reference and strand are chained by
a sparse dynamic programme: an anchor adds the letters that it doesn't share with the one before it, less a cost for
the difference of the two gaps, which is smaller where the reference has the longer gap, as introns are. Of the chains, best first, those that share
most of their part of the read with a better one stay only if they are nearly as good.

A chain ends with its outer anchors, up to w - 1 letters or the first errors short of where a base-level alignment would end.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, W = 16, 5
#: Longest gap between anchors on the read and on the reference (an intron).
READ_GAP, REFERENCE_GAP = 10_000, 200_000
MIN_SCORE, MIN_ANCHORS = 20, 3
#: A chain that shares more than this part of its span on the read with a better one needs this part of its score.
MASKED, NEARLY = 0.5, 0.8
#: Share of the distinct minimisers that are left out as too frequent; those found up to HOT_LEAST times always stay.
HOT_SHARE, HOT_LEAST = 2e-4, 10
BASE = 0x9E3779B97F4A7C15
COMPLEMENT = np.arange(256, dtype=np.uint8)
COMPLEMENT[[65, 67, 71, 84]] = [84, 71, 67, 65]
UPPER = np.arange(256, dtype=np.uint8)
UPPER[97:123] -= 32
KNOWN = np.zeros(256, bool)
KNOWN[[65, 67, 71, 84]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def picked(text: bytes, k: int, w: int, dna: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, whether the reverse complement has it) of a sequence's minimisers; with dna, k-mers with other letters than ACGT are none."""
    data = UPPER[np.frombuffer(text, np.uint8)] if dna else np.frombuffer(text, np.uint8)
    n = len(data) - k + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    value, back = mixed(data.astype(np.uint64) + 1), mixed(COMPLEMENT[data].astype(np.uint64) + 1)
    forward, reverse, factor = np.zeros(n, np.uint64), np.zeros(n, np.uint64), 1
    for i in range(k):
        reverse += back[i : i + n] * np.uint64(factor)
        forward += value[k - 1 - i : k - 1 - i + n] * np.uint64(factor)
        factor = factor * BASE % (1 << 64)
    forward, reverse = mixed(forward), mixed(reverse) if dna else np.full(n, np.uint64(2**64 - 1))
    least = np.minimum(forward, reverse)
    none = np.uint64(2**64 - 1)
    least[forward == reverse] = none
    if dna:
        odd = np.concatenate(([0], np.cumsum(~KNOWN[data])))
        least[odd[k:] != odd[:n]] = none
    width = min(w, n)
    smallest = least[: n - width + 1].copy()
    for i in range(1, width):
        np.minimum(smallest, least[i : i + n - width + 1], out=smallest)
    chosen = np.zeros(n, bool)
    for i in range(width):
        chosen[i : i + n - width + 1] |= least[i : i + n - width + 1] == smallest
    at = np.flatnonzero(chosen & (least != none))
    return at, least[at], reverse[at] < forward[at]


def minimizers(sequences: DataFrame, id_col: str, k: int = K, w: int = W, dna: bool = True) -> DataFrame:
    """(id_col, hash, at, reverse) of sequences (id_col, seq); null and short sequences have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                at, found, reverse = picked((text.as_py() or "").encode(), k, w, dna)
                which = pa.array(np.full(len(at), i))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(found.view(np.int64)), pa.array(at), pa.array(reverse)], [id_col, "hash", "at", "reverse"])

    kind = sequences.schema[id_col].dataType.simpleString()
    return sequences.select(id_col, "seq").mapInArrow(run, f"{id_col} {kind}, hash long, at long, reverse boolean")


def without_hot(found: DataFrame, share: float = HOT_SHARE, least: int = HOT_LEAST) -> DataFrame:
    """The rows whose hash is found no more often than the quantile 1 - share of the distinct hashes, or ``least`` times."""
    counts = found.groupBy("hash").agg(F.count("*").alias("n"))
    most = counts.agg(F.percentile_approx("n", 1 - share, 10_000)).first()[0]
    return found.join(counts.where(F.col("n") > max(most or 0, least)), "hash", "left_anti")


def chained(q: np.ndarray, r: np.ndarray, k: int, read_gap: int = READ_GAP, reference_gap: int = REFERENCE_GAP) -> tuple[np.ndarray, np.ndarray]:
    """(score of the best chain that ends with each anchor, the anchor before it or -1); anchors are sorted by r, then q.

    All earlier anchors within the two longest gaps are tried, so the scores are exact.
    """
    score, before = np.full(len(q), float(k)), np.full(len(q), -1)
    first = np.searchsorted(r, r - reference_gap)
    for i in range(1, len(q)):
        a = first[i]
        dq, dr = q[i] - q[a:i], r[i] - r[a:i]
        value = score[a:i] + step(dq, dr, k)
        value[(dq <= 0) | (dr <= 0) | (dq > read_gap)] = -np.inf
        if len(value):
            best = len(value) - 1 - int(np.argmax(value[::-1]))
            if value[best] > k:
                score[i], before[i] = value[best], a + best
    return score, before


def step(dq: np.ndarray, dr: np.ndarray, k: int) -> np.ndarray:
    """What an anchor adds that lies dq and dr behind the one before it."""
    gap = np.abs(dr - dq)
    linear, log = 0.01 * k * gap, 0.5 * np.log2(gap + 1)
    return np.minimum(np.minimum(dq, dr), k) - np.where(dr > dq, np.minimum(linear, log), linear + log)


def best_chains(q: np.ndarray, r: np.ndarray, k: int, read_gap: int = READ_GAP, reference_gap: int = REFERENCE_GAP, min_score: float = MIN_SCORE, min_anchors: int = MIN_ANCHORS) -> list[tuple[float, int, int, int, int, int]]:
    """(score, anchors, first q, last q, first r, last r) of chains without a common anchor, best first."""
    order = np.lexsort((q, r))
    q, r = q[order], r[order]
    score, before = chained(q, r, k, read_gap, reference_gap)
    used, out = np.zeros(len(q), bool), []
    for end in np.lexsort((np.arange(len(q)), -score)).tolist():
        if used[end] or score[end] < min_score:
            continue
        own, i = [], end
        while i >= 0 and not used[i]:
            own.append(i)
            used[i] = True
            i = int(before[i])
        left = score[end] - (score[i] if i >= 0 else 0.0)
        if left >= min_score and len(own) >= min_anchors:
            out.append((float(left), len(own), int(q[own[-1]]), int(q[end]), int(r[own[-1]]), int(r[end])))
    return sorted(out, reverse=True)


def kept(found: list[tuple]) -> list[tuple]:
    """Of chains (score, ..., q_st, q_en at -2, -1), best first, those that no better one masks, or that are nearly as good as it."""
    out: list[tuple] = []
    for x in found:
        masks = [y for y in out if min(x[-1], y[-1]) - max(x[-2], y[-2]) > MASKED * min(x[-1] - x[-2], y[-1] - y[-2])]
        if all(x[0] >= NEARLY * y[0] for y in masks):
            out.append(x)
    return out


HITS = "id {}, ref_id {}, ord long, reverse boolean, q_st long, q_en long, r_st long, r_en long, blen long, anchors long, score double"


def hits(anchors: DataFrame, k: int = K, min_score: float = MIN_SCORE, min_anchors: int = MIN_ANCHORS) -> DataFrame:
    """HITS of anchors (id, ref_id, same strand or not as ``reverse``, q, r): half-open places on read and reference; ord counts a read's
    hits from the best. A read's anchors are brought together, as many as its length and the bound on frequent minimisers allow."""
    kinds = [anchors.schema[c].dataType.simpleString() for c in ("id", "ref_id")]
    schema = HITS.format(*kinds)

    def one(rows: pa.Table) -> pa.Table:
        refs, reverse = rows["ref_id"].combine_chunks().dictionary_encode(), rows["reverse"].to_numpy()
        q, r, code = rows["q"].to_numpy(), rows["r"].to_numpy(), refs.indices.to_numpy() * 2 + reverse
        found = []
        for c in np.unique(code).tolist():
            own = code == c
            x, y = q[own], r[own]
            for score, n, q0, q1, r0, r1 in best_chains(x, -y if c % 2 else y, k, min_score=min_score, min_anchors=min_anchors):
                r0, r1 = (-r1, -r0) if c % 2 else (r0, r1)
                found.append((score, n, refs.dictionary[c // 2].as_py(), bool(c % 2), r0, r1 + k, q0, q1 + k))
        best = kept(sorted(found, key=lambda x: (-x[0], x[6], str(x[2]))))
        id_ = rows["id"][0].as_py()
        table = [(id_, x[2], i, x[3], x[6], x[7], x[4], x[5], max(x[7] - x[6], 0), x[1], x[0]) for i, x in enumerate(best)]
        columns = list(zip(*table, strict=True)) or [[]] * 11
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, [rows.schema.field("id").type, rows.schema.field("ref_id").type, pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.float64()], strict=True)], ["id", "ref_id", "ord", "reverse", "q_st", "q_en", "r_st", "r_en", "blen", "anchors", "score"])

    return anchors.select("id", "ref_id", "reverse", "q", "r").groupBy("id").applyInArrow(one, schema)


def align(reads: DataFrame, references: DataFrame, asked: DataFrame | None = None, k: int = K, w: int = W, dna: bool = True, min_score: float = MIN_SCORE, min_anchors: int = MIN_ANCHORS) -> DataFrame:
    """HITS of reads (read_id, seq) on references (ref_id, seq).

    asked (id, read_id, ref_id, read_length) limits what is aligned to what: each id is a read, cut at read_length if that isn't null, with
    the references it names; a read may have several. Without it each read is its own id and tried on every reference.
    """
    own = minimizers(reads, "read_id", k, w, dna)
    theirs = without_hot(minimizers(references, "ref_id", k, w, dna)).select("ref_id", "hash", F.col("at").alias("r"), F.col("reverse").alias("r_reverse"))
    if asked is None:
        pairs = own.withColumn("id", F.col("read_id")).join(theirs, "hash")
    else:
        want = asked.select("id", "read_id", "ref_id", "read_length").distinct()
        cut = own.join(want, "read_id").where((F.col("at") + k <= F.col("read_length")) | F.col("read_length").isNull())
        pairs = cut.join(theirs, ["ref_id", "hash"])
    anchors = pairs.select("id", "ref_id", (F.col("reverse") != F.col("r_reverse")).alias("reverse"), F.col("at").alias("q"), "r")
    return hits(anchors, k, min_score, min_anchors)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
