"""Toxicity from the nearest labelled examples by exact TF-IDF cosine, with block-max inverted indexes.

Terms. A word (a longest run of ASCII letters, digits and bytes beyond ASCII, A-Z lower-cased) has up to seven stems: its first 4 to 9
bytes, and itself. Stems are hashed into 2 ** BITS buckets. The lexicon holds the at most LEXICON buckets that lean most to
label 1: the examples with label 1 that hold one exceed what their share lets expect by LEAN standard deviations. A word's term is the
strongest stem of it that the lexicon holds; all other words share one term, so a vector covers the whole text and its
length says how much of the text the lexicon's words are. A term weighs (1 + ln tf) * idf, with idf = 1 + ln((1 + n) / (1 + df)) over all n documents.

Index. Examples with equal vectors are one entry with the number of its examples and of those with label 1. Entries lie in blocks of BLOCK; the
index keeps each term's postings by block and each block's largest weight of a term. For a batch of queries the bounds of all
blocks are one product; a block is scored for the queries whose bound reaches their NEIGHBOURS-th best cosine so far. The neighbours are
exact: all examples whose cosine is at least that of the NEIGHBOURS-th, so examples tied with it vote too, whatever their order.

Votes weigh 1 / (1 - cosine + NEAR). The share of the votes for label 1 is turned into a probability by logistic scaling, fitted on the
examples whose id's hash is a multiple of CALIBRATION: they had no part in the choice of terms, and join the index afterwards.

Examples are at most ``examples`` labelled rows, those with the smallest hashes of their ids, so the index has a bounded size;
document frequencies and scores cover all rows. Null and empty texts count as texts without a word of the lexicon.
Ids without text or label don't matter. An id with two labels has the larger; rows with one id are all scored, and all of
them are examples. Without any example every score is 0. Columns other than those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, pieces, shared_dir, text_columns, written
from .sketch import bucket_counts, bucket_slices
from .words import BASE, BYTE, LOWER, mix, words

BITS = 22
PREFIXES = (4, 5, 6, 7, 8, 9)
LEXICON = 400
#: Standard deviations, and examples with label 1, that a term of the lexicon needs.
LEAN, LEAST = 3.5, 3
EXAMPLES = 20_000
#: Examples that are searched for at once when the scores are calibrated.
ASKED = 100
CALIBRATION = 5
BLOCK = 64
NEIGHBOURS = 25
NEAR = 0.02
CUT = 0.3
TIE = 1e-6
_NO_WORD = np.ones(256, bool)
_NO_WORD[48:58] = _NO_WORD[65:91] = _NO_WORD[97:123] = _NO_WORD[128:] = False


def stems(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First the words' texts and the words a text; then, for each kind of stem, (bucket, the word's place)."""
    data = LOWER[data]
    hashes, starts, ends, bounds = words(data, offsets, space=_NO_WORD)
    yield np.repeat(np.arange(len(offsets) - 1), np.diff(bounds)), np.diff(bounds)
    shift = np.uint64(64 - BITS)
    yield (mix(hashes) >> shift).astype(np.int64), np.arange(len(starts))
    alive, value = np.arange(len(starts)), np.zeros(len(starts), np.uint64)
    for k in range(max(PREFIXES)):
        long = ends[alive] - starts[alive] > k
        alive = alive[long]
        value = value[long] * np.uint64(BASE) + BYTE[data[starts[alive] + k]]
        if k + 1 in PREFIXES:
            yield (mix(value + np.uint64(k)) >> shift).astype(np.int64), alive


_places: dict[bytes, np.ndarray] = {}


def places(lexicon: np.ndarray) -> np.ndarray:
    """Of each bucket its place in the lexicon, or LEXICON. A worker keeps the last table, so only the lexicon is sent."""
    key = lexicon.tobytes()
    if key not in _places:
        _places.clear()
        _places[key] = np.full(1 << BITS, LEXICON, np.int16)
        _places[key][lexicon] = np.arange(len(lexicon))
    return _places[key]


def vectors(data: np.ndarray, offsets: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, times) of the lexicon's terms and, as term LEXICON, of all other words. place: of a bucket, or LEXICON."""
    found = stems(data, offsets)
    text, count = next(found)
    term = np.full(len(text), LEXICON, place.dtype)
    for bucket, word in found:
        term[word] = np.minimum(term[word], place[bucket])
    hit = term < LEXICON
    key, times = np.unique(text[hit] * (LEXICON + 1) + term[hit], return_counts=True)
    rest = np.maximum(count - np.bincount(text[hit], minlength=len(count)), 0)
    rest[count == 0] = 1
    own = np.flatnonzero(rest)
    text, term = np.concatenate((key // (LEXICON + 1), own)), np.concatenate((key % (LEXICON + 1), np.full(len(own), LEXICON)))
    return text, term, np.concatenate((times, rest[own]))


def unit_rows(n: int, text: np.ndarray, term: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The vectors, of length 1, as rows of a dense matrix."""
    out = np.zeros((n, LEXICON + 1), np.float32)
    out[text, term] = (1 + np.log(times)) * idf[term]
    return out / np.sqrt((out**2).sum(axis=1, keepdims=True))


class Index:
    """Unit vectors of examples by term, in blocks, with the largest weight of each term in each block."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, times: np.ndarray | None = None):
        """times: how many examples each row stands for; ids has the smallest of them."""
        times = np.ones(len(rows)) if times is None else times.astype(float)
        order = np.lexsort(rows.T[::-1]) if len(rows) else np.zeros(0, np.int64)  # like beside like: tighter bounds
        ids, labels, rows, times = ids[order], labels[order], rows[order], times[order]
        new = np.ones(len(rows), bool)
        new[1:] = (np.abs(rows[1:] - rows[:-1]) > TIE / 10).any(axis=1)
        heads = np.flatnonzero(new)
        self.n, self.ones = (np.add.reduceat(x, heads) if len(rows) else np.zeros(0) for x in (times, labels * times))
        entry = np.cumsum(new) - 1
        self.ids = np.full(len(heads), np.iinfo(np.int64).max)
        np.minimum.at(self.ids, entry, ids)
        rows = rows[heads]
        self.entries, self.blocks = len(rows), (len(rows) + BLOCK - 1) // BLOCK
        term, owner = np.nonzero(rows.T)
        self.term, self.owner, self.weight = term.astype(np.int16), owner.astype(np.int32), rows[owner, term]
        self.most = np.zeros((rows.shape[1], self.blocks), np.float32)
        np.maximum.at(self.most, (term, owner // BLOCK), self.weight)
        self.slope, self.shift = 1.0, 0.0
        self._tiles: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return {**self.__dict__, "_tiles": {}}

    def tile(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """(terms that the block's postings hold, their weights as a matrix of terms and entries)."""
        if not self._tiles:
            by = np.argsort(self.owner // BLOCK, kind="stable")
            cut = np.searchsorted(self.owner[by] // BLOCK, np.arange(self.blocks + 1))
            for b in range(self.blocks):
                own = by[cut[b] : cut[b + 1]]
                terms, at = np.unique(self.term[own], return_inverse=True)
                weights = np.zeros((len(terms), min(BLOCK, self.entries - b * BLOCK)), np.float32)
                weights[at, self.owner[own] - b * BLOCK] = self.weight[own]
                self._tiles[b] = (terms, weights)
        return self._tiles[block]

    def cosines(self, queries: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        """Queries by entries: the cosine, or -1 where it is surely below the k-th best."""
        out = np.full((len(queries), self.entries), -1, np.float32)
        bound = queries @ self.most + np.float32(TIE)
        # Each query's most promising block first; then every block for the queries that it can still serve.
        first = bound.argmax(axis=1)
        held = np.full((len(queries), k), -1, np.float32)  # the k best so far; the least of them is the mark to reach

        def scored(block: int, own: np.ndarray) -> None:
            terms, weights = self.tile(block)
            found = queries[np.ix_(own, terms)] @ weights
            out[own, block * BLOCK : block * BLOCK + weights.shape[1]] = found
            held[own] = np.partition(np.concatenate((held[own], found), axis=1), -k, axis=1)[:, -k:]

        for block in np.unique(first).tolist():
            scored(block, np.flatnonzero(first == block))
        for block in np.argsort(-bound.max(axis=0), kind="stable").tolist():
            own = np.flatnonzero((bound[:, block] >= held.min(axis=1) - TIE) & (first != block))
            if len(own):
                scored(block, own)
        return out

    def votes(self, queries: np.ndarray, evidence: int = 3) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """(share of the votes for label 1, ids and cosines of the nearest entries) of distinct queries."""
        share, near, nearness = np.zeros(len(queries)), [], []
        found = self.cosines(queries)
        for i, row in enumerate(found):
            order = np.argsort(-row, kind="stable")[: NEIGHBOURS + 1]
            reach = min(int(np.searchsorted(np.cumsum(self.n[order]), NEIGHBOURS)), len(order) - 1)
            own = np.flatnonzero(row >= max(row[order[reach]] - TIE, -0.5))
            weight = self.n[own] / (1 - np.minimum(row[own], 1) + NEAR)
            share[i] = (weight * self.ones[own] / self.n[own]).sum() / weight.sum()
            order = own[np.lexsort((self.ids[own], -np.round(row[own], 5)))][:evidence]
            near.append(self.ids[order].tolist())
            nearness.append([round(float(x), 5) for x in row[order]])
        return share, near, nearness

    def score(self, queries: np.ndarray) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
        """(score, evidence's ids, evidence's cosines) of all queries; equal ones are searched once."""
        if not self.entries:
            return np.zeros(len(queries)), [[]] * len(queries), [[]] * len(queries)
        plain = queries[:, LEXICON] >= 1 - TIE / 10  # no word of the lexicon: by far the most frequent vector
        ask = np.concatenate((np.flatnonzero(plain)[:1], np.flatnonzero(~plain)))
        back = np.zeros(len(queries), np.int64)
        back[ask] = np.arange(len(ask))
        share, near, nearness = self.votes(queries[ask])
        return self.calibrated(share)[back], [near[i] for i in back], [nearness[i] for i in back]

    def calibrated(self, share: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _logit(share) + self.shift)))

    def calibrate(self, share: np.ndarray, labels: np.ndarray, times: np.ndarray | float = 1.0) -> None:
        """Logistic scaling by Newton's steps, held near the identity by a weak prior. times: how many examples have a share."""
        x = _logit(share)
        for _ in range(50):
            p = 1 / (1 + np.exp(-(self.slope * x + self.shift)))
            w, off = times * p * (1 - p), times * (p - labels)
            g = np.array([(off * x).sum() + self.slope - 1, off.sum() + self.shift])
            h = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 1]])
            step = np.linalg.solve(h, g)
            self.slope, self.shift = max(self.slope - step[0], 0.05), self.shift - step[1]
            if np.abs(step).max() < 1e-9:
                break


def _logit(share: np.ndarray) -> np.ndarray:
    p = np.clip(share, 0.005, 0.995)
    return np.log(p / (1 - p))


def leaning(examples: DataFrame) -> np.ndarray:
    """The lexicon's buckets, strongest first, from (text, label). Each task picks from its own buckets, so the counts of all of them are nowhere together."""
    learnt = examples.where("label in (0, 1)").select("label", "text")
    totals = {r["label"]: r["n"] for r in learnt.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ratio = totals.get(1, 0) / max(1, sum(totals.values()))

    def held_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for label, data, offsets in pieces(batches):
            found = stems(data, offsets)
            text, _ = next(found)
            bucket, word = (np.concatenate(x) for x in zip(*found, strict=True))
            key = np.unique(text[word] << BITS | bucket)
            yield ((key & (1 << BITS) - 1) << 1 | label[key >> BITS]).astype(np.uint64) << np.uint64(63 - BITS)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                zeros, ones = np.frombuffer(blob.as_buffer(), np.uint32).reshape(-1, 2).T
                held = np.flatnonzero(ones >= LEAST)
                found = ones[held].astype(np.float64)
                expected = (found + zeros[held]) * ratio
                lean = (found - expected) / np.sqrt(expected + 1)
                order = np.argsort(-lean, kind="stable")[:LEXICON]
                order = order[lean[order] >= LEAN]
                yield pa.RecordBatch.from_arrays([pa.array(s * len(ones) + held[order]), pa.array(lean[order])], ["bucket", "lean"])

    chosen = bucket_slices(learnt, held_stems, BITS + 1).mapInArrow(pick, "bucket long, lean double").orderBy(F.desc("lean"), "bucket").limit(LEXICON)
    return np.array([r["bucket"] for r in chosen.collect()], np.int64)


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index:
    """An index from docs (doc_id, text) and labels (doc_id, label 0 or 1)."""
    rows = text_columns(docs)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("doc_id is not null and label is not null")
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(CALIBRATION)).alias("fold")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)
    kinds = sorted((r["doc_id"], r["label"], r["fold"]) for r in chosen.collect())  # at most ``examples`` rows
    known, value, fold = (np.array([x[i] for x in kinds], np.int64) for i in range(3))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, doc), max(len(known) - 1, 0))
            own = np.flatnonzero(known[at] == doc) if len(known) else np.zeros(0, np.int64)
            if len(own):
                taken = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(value[at[own]]), pa.array(fold[at[own]])], ["doc_id", "text", "label", "fold"])

    sample = written(rows.mapInArrow(labelled, "doc_id long, text string, label long, fold long"), shared_dir(docs.sparkSession), "examples")

    lexicon = leaning(sample.where("fold <> 0"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        place = places(lexicon)
        for _, data, offsets in pieces(batches):
            yield np.append(vectors(data, offsets, place)[1], np.full(len(offsets) - 1, LEXICON + 1)).astype(np.uint64) << np.uint64(48)

    counts = bucket_counts(rows, terms, 16).astype(np.float64)
    idf = 1 + np.log((1 + counts[LEXICON + 1]) / (1 + counts[: LEXICON + 1]))

    def example(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = places(lexicon)
        for batch in batches:
            kind = dict(zip(batch.column(0).to_pylist(), zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True), strict=True))
            for doc, data, offsets in pieces([batch.select([0, 1])]):
                text, term, times = vectors(data, offsets, place)
                times[np.bincount(text, minlength=len(doc))[text] == 1] = 1  # a vector of one term is the same whatever its times
                order = np.lexsort((term, text))
                cut = np.searchsorted(text[order], np.arange(len(doc) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x[order], pa.int64())) for x in (term, times)]
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array([kind[i][0] for i in doc.tolist()], pa.int64()), pa.array([kind[i][1] for i in doc.tolist()], pa.int64()), *lists], ["doc_id", "label", "fold", "term", "times"])

    kinds = ["term", "times", "label", "fold"]
    held = sample.mapInArrow(example, "doc_id long, label long, fold long, term array<long>, times array<long>")
    # Examples with equal vectors are one row here: most have no word of the lexicon.
    held = held.groupBy(*kinds).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).toArrow()
    held = held.take(pa.array(np.lexsort((held["fold"].to_numpy(), held["label"].to_numpy(), held["doc_id"].to_numpy())))).combine_chunks()
    ids, label, apart, n = (held[c].to_numpy() for c in ("doc_id", "label", "fold", "n"))
    lists = [held[c].combine_chunks() for c in ("term", "times")]
    term, times = (x.flatten().to_numpy() for x in lists)
    dense = unit_rows(len(ids), np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy())), term, times, idf)
    del held, lists, term, times
    own, asked = apart != 0, np.flatnonzero(apart == 0)
    index = Index(ids[own], label[own], dense[own], n[own])
    if index.entries and len(asked):
        found = [index.votes(dense[asked[at : at + ASKED]])[0] for at in range(0, len(asked), ASKED)]
        del index  # one index at a time
        whole = Index(ids, label, dense, n)
        whole.calibrate(np.concatenate(found), label[asked], n[asked])
        index = whole
    index.lexicon, index.idf = lexicon, idf
    return index


def scored(data: np.ndarray, offsets: np.ndarray, index: Index) -> tuple[np.ndarray, list[list[int]], list[list[float]]]:
    return index.score(unit_rows(len(offsets) - 1, *vectors(data, offsets, places(index.lexicon)), index.idf))


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, and the evidence: the smallest ids and the cosines of the three nearest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, offsets in pieces(batches):
            found, near, cosines = scored(data, offsets, index)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(found, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "nearest", "cosines"])

    return text_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, nearest array<long>, cosines array<double>")


def kept(docs: DataFrame, index: Index, cut: float = CUT, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all columns, whose score is below ``cut``; rows without an id too."""
    at = docs.columns.index(text_col)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pieces([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["row", "text"])])
            stays = [scored(data, offsets, index)[0] < cut for _, data, offsets in whole]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0, bool), *stays])))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id"):
    """Rows that are never learnt from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))


def predictions(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    index = fit(docs, training_labels(labels))
    return score(docs, index).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "nearest", "cosines")
