"""Document fingerprints by I-Match with randomised lexicons.

Terms are words, A-Z lower-cased. The lexicon holds the terms whose inverse document frequency, over its maximum
ln(n), is within a band; document frequencies are counted over all documents in 2 ** DF_BITS buckets, so the table has one size
however large the corpus is. Besides the lexicon itself there are SEEDS random subsets of it for each density 1/2, 1/4 .. 1/2 ** DENSITIES; they are
fixed, the same for every document. For each of these lexicons a document's distinct terms in it are sorted and hashed to one component. An
edit changes a component only if it touches one of these terms, so the dense subsets tell short texts apart and the sparse ones stay the same in edited
long texts. A component of no term is 0. A document with no term in the band uses all its terms; one without words has zeros only.

The likeness of two fingerprints is the share of equal components among those that are not 0 in both; two of zeros only are alike (1).
Equal texts have equal fingerprints. Null texts are empty. Rows with one id are ordered by text. Columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, runs, text_columns
from .sketch import bucket_counts
from .words import BASE, mix, powers, words

DF_BITS = 22
#: Inverse document frequency over ln(number of documents).
BAND = (0.25, 0.97)
SEEDS, DENSITIES = 8, 8
LEXICONS = 1 + SEEDS * DENSITIES
_ORDER = 0xC2B2AE3D27D4EB4F


def distinct_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text's place, term hash) without repeats, in order."""
    hashes, _, _, bounds = words(data, offsets, lower=True)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """Which buckets of terms are within the band, as bits; docs has doc_id and text."""

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, data, offsets in pieces(batches):
            yield distinct_terms(data, offsets)[1]

    counts = bucket_counts(docs, values, DF_BITS)
    n = docs.count()
    idf = np.log(max(n, 2) / np.maximum(counts, 1)) / np.log(max(n, 2))
    return np.packbits((counts > 0) & (idf >= band[0]) & (idf <= band[1]))


def fingerprints(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """One row of LEXICONS 16-bit components a text."""
    n = len(offsets) - 1
    out = np.zeros((n, LEXICONS), np.uint16)
    text, term = distinct_terms(data, offsets)
    at = (term >> np.uint64(64 - DF_BITS)).astype(np.int64)
    kept = (inside[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    none = np.bincount(text[kept], minlength=n) == 0
    kept |= none[text]
    text, term = text[kept], term[kept]

    def component(k: int, text: np.ndarray, term: np.ndarray) -> None:
        """Hash each text's terms, which are in order."""
        if not len(text):
            return
        cut = runs(text)
        rank = np.arange(len(text)) - np.repeat(cut[:-1], np.diff(cut))
        sums = np.add.reduceat(mix(term) * powers(_ORDER, int(np.diff(cut).max()))[rank], cut[:-1])
        out[text[cut[:-1]], k] = np.maximum((mix(sums) >> np.uint64(48)).astype(np.uint16), 1)

    component(0, text, term)
    for seed in range(SEEDS):
        own, ours, value = text, term, mix(term ^ np.uint64((seed + 1) * BASE & (1 << 64) - 1))
        for density in range(1, DENSITIES + 1):
            chosen = value >> np.uint64(64 - density) == 0
            own, ours, value = own[chosen], ours[chosen], value[chosen]
            component(1 + seed * DENSITIES + density - 1, own, ours)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the fingerprints in each row."""
    some = (a != 0) | (b != 0)
    return np.where(some.any(axis=1), ((a == b) & some).sum(axis=1) / np.maximum(some.sum(axis=1), 1), 1.0)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def fingerprint(docs: DataFrame, inside: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint (LEXICONS components of 4 hex digits) of every row."""
    rows = text_columns(docs, id_col, text_col)
    inside = lexicon(rows) if inside is None else inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, offsets in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array([x.astype(">u2").tobytes().hex() for x in fingerprints(data, offsets, inside)], pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, "doc_id long, fingerprint string")


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or all, of the next
    document in ascending doc_id; after the last comes the first. Rows are dealt by ranges of doc_id that begin at
    existing ids, and a range's first row also goes to the range before it, so no order over all rows is needed.
    """
    rows = text_columns(docs)
    inside = lexicon(rows)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    splits = np.unique(np.array(rows.approxQuantile("doc_id", [i / parts for i in range(parts)], 1 / (8 * parts)), np.int64))
    first = rows.agg(F.min("doc_id")).first()[0]
    if first is not None:
        splits = np.unique(np.append(splits, first))
    names, kind = ["part", "last", "doc_id", "text"], "part int, last boolean, doc_id long, text string"

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.searchsorted(splits, doc, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.zeros(len(doc), bool)), *batch.columns], names)
            heads = np.flatnonzero(splits[at] == doc)
            if len(heads):
                taken = batch.take(pa.array(heads))
                yield pa.RecordBatch.from_arrays([pa.array((at[heads] - 1) % len(splits), pa.int32()), pa.array(np.ones(len(heads), bool)), *taken.columns], names)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, int, str]] = []
        size = 0

        def out() -> pa.RecordBatch:
            pairs = [(a, b) for a, b in zip(held[:-1], held[1:], strict=True) if not a[1] and a[0] == b[0]]
            edited = [t[: n - n // 4] + after[: n // 4] for (_, _, _, t), (_, _, _, after) in pairs for n in [len(t)]]
            own, after, new = (fingerprints(*joined(x), inside) for x in ([a[3] for a, _ in pairs], [b[3] for _, b in pairs], edited))
            hexed = lambda x: pa.array([v.astype(">u2").tobytes().hex() for v in x], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([a[2] for a, _ in pairs], pa.int64()), pa.array([len(a[3]) for a, _ in pairs], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()), hexed(own), hexed(new), pa.array(likeness(own, new)), pa.array(likeness(own, after))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[3])
                if size > 1 << 20 and len(held) > 1:
                    yield out()
                    held, size = held[-1:], len(row[3])
        if len(held) > 1:
            yield out()

    dealt = rows.mapInArrow(deal, kind).repartition(parts, "part").sortWithinPartitions("part", "last", "doc_id", "text")
    return dealt.mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
