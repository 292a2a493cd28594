"""Exact n-gram Jaccard join with set relations: blocks of index lists are skipped, and answers derived from a similar set's.

A document's set has the hashes of its distinct shingles of ``n`` words. Documents link if their sets' Jaccard similarity
is at least ``percent`` / 100.

1. Index: each shingle goes, packed by document, to one of as many buckets as there are shuffle partitions; there its frequency is
   counted. Shingles of one document only can't be shared; the others return to their documents with their frequency.
   A document whose unshared shingles alone fill its prefix (its |s| - ceil(t|s|) + 1 rarest) has no link and is done.
2. Lists: the shared shingles in the prefixes of the rest, with size band and position. A list's blocks are its entries of
   a size band and a range of positions, relative to the size. Two sets that link have a first shared shingle after which both have enough
   left, so an entry is joined only with the blocks of its list that sizes and positions allow (``allowed``); all others are skipped.
3. Leaders: each set is compared with the set that is first in most of its blocks, and clusters of the sets that
   link to one leader are formed. Similar sets, near copies above all, fall into one cluster, and within one component nothing more is asked.
4. For clusters of different components that share a block, the leaders' overlap is computed once; two single sets that were compared with one leader
   are left out if what they share with it, and have beside it, is too little. A pair of members shares at most
   the leaders' overlap plus the shared shingles that the members have beside their leaders; only pairs whose bound reaches the threshold are compared;
   for the pairs of clusters left, overlaps with all members are derived from that with their leader and the few shingles in which
   they differ from it. Bounds come from computed answers alone, so no link is lost, and no pairs are emitted.

Equal sets are one: the index holds sets by a 64-bit hash of the whole set, in whichever and how many rows they stand, and the smallest doc_id stands for all.
Hashes have 64 bits; shingles are compared by a bucket and 40 bits. Null and empty texts, and those without words, have the empty set and no link.
Rows with one doc_id are one document: the largest of their sets stands for it, and the others link nothing. Rows without doc_id are left out. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, ranges, runs, shared_dir, text_columns, written
from .components import components
from .repeats import bucket_of
from .words import grams, in_texts, mix, words

N = 4
PERCENT = 85
HELD = 1_000_000
TOKEN_BITS = 40
#: Members of a leader that one task compares.
MEMBERS = 1000
_END = 0xA24BAED4963EE407


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, sorted, end to end; n + 1 offsets). Fewer words than n are one shingle."""
    h, _, _, bounds = words(data, offsets, lower=True)
    g = grams(h, n)
    inside = in_texts(bounds, n, len(g))
    count = np.diff(bounds)
    short = np.flatnonzero((count > 0) & (count < n))
    at = np.flatnonzero(inside)
    text = np.searchsorted(bounds, at, "right") - 1
    extra = np.zeros(len(short), np.uint64)
    for i, t in enumerate(short):
        value = 0
        for x in h[bounds[t] : bounds[t + 1]].tolist():
            value = (value * _END + x) & (1 << 64) - 1
        extra[i] = value
    text, value = np.concatenate((text, short)), np.concatenate((g[at], mix(extra + np.uint64(1))))
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return value[new], np.searchsorted(text[new], np.arange(len(offsets)))


def set_keys(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(values))))
    return mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64)).view(np.int64)


def set_table(rows: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, key): equal keys mean equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, data, offsets in pieces(batches):
            values, cut = shingle_sets(data, offsets, n)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.diff(cut)), pa.array(set_keys(values, cut))], ["doc_id", "n_shingles", "key"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, key long")


def prefix(size, percent: int):
    """Length of the prefix of sets of these sizes."""
    return size - (size * percent + 99) // 100 + 1


def need(a: Column, b: Column, percent: int) -> Column:
    """The overlap that sets of sizes a and b need."""
    return F.ceil((a + b) * percent / F.lit(100 + percent) - 1e-9)


def shared_sets(rows: DataFrame, table: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc_id, size, unique, tokens) of the documents that may link: shared shingles as 64-bit numbers, rarest first."""
    buckets = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            doc, values = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (values >> np.uint64(TOKEN_BITS)).astype(np.int64) % buckets
            order = np.argsort(bucket.astype(np.int32), kind="stable")
            bucket, doc, values = bucket[order], doc[order], values[order]
            low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8]
            cut, blobs = runs(bucket), []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                head = runs(doc[a:b])
                own = doc[a:b][head[:-1]]
                blobs.append(np.concatenate(([len(own)], np.diff(own, prepend=0), np.diff(head))).astype("<i8").tobytes() + low[a:b].tobytes())
            return pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for _, data, offsets in pieces(batches):
            values, cut = shingle_sets(data, offsets, n)
            keys, new = set_keys(values, cut), np.zeros(len(cut) - 1, bool)
            for i, key in enumerate(keys.tolist()):
                if key not in seen:
                    seen.add(key)
                    new[i] = cut[i + 1] > cut[i]
            count = np.diff(cut)[new]
            held.append((np.repeat(keys[new], count), values[ranges(cut[:-1][new], count)]))
            size += len(held[-1][1])
            if size >= HELD:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(b, []).append(blob)
        width = TOKEN_BITS // 8
        for bucket in list(seen):
            docs, values = [], []
            for blob in seen.pop(bucket):
                k = int(np.frombuffer(blob, "<i8", 1)[0])
                own, count = np.frombuffer(blob, "<i8", 2 * k, 8).reshape(2, k)
                docs.append(np.repeat(np.cumsum(own), count))
                full = np.zeros((int(count.sum()), 8), np.uint8)
                full[:, :width] = np.frombuffer(blob, np.uint8, offset=8 + 16 * k).reshape(-1, width)
                values.append(full.reshape(-1).view("<u8"))
            doc, value = np.concatenate(docs), np.concatenate(values)
            order = np.argsort(value, kind="stable")
            value, doc = value[order], doc[order]
            cut = runs(value)
            kept = np.repeat(np.diff(cut), np.diff(cut)) > 1
            value, doc = value[kept], doc[kept]
            # A set that stands in rows of several tasks comes several times.
            order = np.lexsort((doc, value))
            value, doc = value[order], doc[order]
            new = np.ones(len(value), bool)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            value, doc = value[new], doc[new]
            cut = runs(value)
            times = np.repeat(np.diff(cut), np.diff(cut))
            kept = times > 1
            if not kept.any():
                continue
            value, doc, times = value[kept] | np.uint64(bucket << TOKEN_BITS), doc[kept], np.minimum(times[kept], 1 << 30)
            home = bucket_of(doc, buckets)
            order = np.lexsort((doc, home))
            value, doc, times, home = value[order], doc[order], times[order], home[order]
            cut = runs(home)
            rank = np.minimum(times, 255).astype(np.uint8)
            blobs = [np.concatenate(([b - a], np.diff(doc[a:b], prepend=0))).astype("<i8").tobytes() + value[a:b].astype("<u8").tobytes() + rank[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(home[cut[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(batch.column(0).to_numpy(), buckets), pa.int32()), *batch.columns], ["bucket", "key", "doc_id", "size"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[int, list[np.ndarray]] = {}
        blobs: dict[int, list[bytes]] = {}
        for batch in batches:
            bucket = batch.column(0).to_numpy(zero_copy_only=False)
            own = np.flatnonzero(batch.column(4).is_null().to_numpy(zero_copy_only=False))
            if len(own):
                part = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.take(pa.array(own)).columns[1:4]]).astype(np.int64)
                for b in np.unique(bucket[own]):
                    sizes.setdefault(int(b), []).append(part[:, bucket[own] == b])
            for i in np.flatnonzero(~batch.column(4).is_null().to_numpy(zero_copy_only=False)).tolist():
                blobs.setdefault(int(bucket[i]), []).append(batch.column(4)[i].as_py())
        for bucket in list(blobs):
            docs, values, ranks = [], [], []
            for blob in blobs.pop(bucket):
                k = int(np.frombuffer(blob, "<i8", 1)[0])
                docs.append(np.cumsum(np.frombuffer(blob, "<i8", k, 8)))
                values.append(np.frombuffer(blob, "<u8", k, 8 + 8 * k))
                ranks.append(np.frombuffer(blob, np.uint8, k, 8 + 16 * k))
            doc, value, rank = np.concatenate(docs), np.concatenate(values), np.concatenate(ranks)
            order = np.lexsort((value, rank, doc))
            doc, value = doc[order], value[order]
            known = np.concatenate(sizes.pop(bucket, [np.zeros((3, 0), np.int64)]), axis=1)
            known = known[:, np.argsort(known[0], kind="stable")]
            # Sets that stand for no document, as a larger one has its doc_id, are left out.
            there = np.isin(doc, known[0])
            doc, value = doc[there], value[there]
            if not len(doc):
                continue
            cut = runs(doc)
            _, own, size = known[:, np.searchsorted(known[0], doc[cut[:-1]])]
            unique = np.maximum(size - np.diff(cut), 0)
            raw = value.astype("<u8").tobytes()
            for at in range(0, len(own), 2000):
                rows_out = [i for i in range(at, min(at + 2000, len(own))) if unique[i] < prefix(size[i], percent)]
                if rows_out:
                    yield pa.RecordBatch.from_arrays([pa.array(own[rows_out]), pa.array(size[rows_out]), pa.array(unique[rows_out]), pa.array([raw[8 * cut[i] : 8 * cut[i + 1]] for i in rows_out], pa.binary())], ["doc_id", "size", "unique", "tokens"])

    found = rows.mapInArrow(index, "bucket int, blob binary").repartition(buckets, "bucket").mapInArrow(frequencies, "bucket int, blob binary")
    found = found.select("bucket", *(F.lit(None).cast("long").alias(c) for c in ("key", "doc_id", "size")), "blob")
    known = table.where("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("size"))
    known = known.mapInArrow(placed, "bucket int, key long, doc_id long, size long").withColumn("blob", F.lit(None).cast("binary"))
    return found.unionByName(known).repartition(buckets, "bucket").mapInArrow(gather, "doc_id long, size long, unique long, tokens binary")


def block_width(percent: int) -> float:
    """The span of a block of positions, relative to the size: half of what sets of equal size can have before their first shared shingle."""
    ratio = percent / 100
    return (1 - 2 * ratio / (1 + ratio)) / 2


def allowed(percent: int) -> list[tuple[int, int, int]]:
    """(block, difference of bands, other block): which blocks of a list can hold the first shared shingle of two linked sets.

    Of sets with sizes a and r * a, at least t / (1 + t) * (1 + r) * a shingles must be left from the first shared one on, in both.
    """
    t, width, slack = percent / 100, block_width(percent), 1e-6
    last = int((1 - t) / width) + 1
    out = []
    for block in range(last + 1):
        for other in range(last + 1):
            most = (1 - block * width) * (1 + t) / t - 1  # of r, by the first set
            least = 1 / max((1 - other * width) * (1 + t) / t - 1, 1e-9)
            for step, low, high in ((-1, t, 1), (0, t, 1 / t), (1, 1, 1 / t)):
                if max(low, least) <= min(high, most) + slack:
                    out.append((block, step, other))
    return out


def postings(sets: DataFrame, percent: int) -> DataFrame:
    """(token, id, size, at, band, block) of the shared shingles in prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                doc, size, unique = (batch.column(i).slice(at, 500).to_numpy(zero_copy_only=False) for i in range(3))
                count = np.maximum(prefix(size, percent) - unique, 0)
                tokens = [np.frombuffer(x.as_buffer(), "<i8")[:k] for x, k in zip(batch.column(3).slice(at, 500), count, strict=True)]
                count = np.fromiter(map(len, tokens), np.int64, len(tokens))
                who = np.repeat(np.arange(len(doc)), count)
                place = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count) + unique[who]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(doc[who]), pa.array(size[who]), pa.array(place)], ["token", "id", "size", "at"])

    step = np.log(100 / percent)
    out = sets.mapInArrow(run, "token long, id long, size long, at long")
    return out.withColumn("band", F.floor(F.log(F.col("size").cast("double")) / F.lit(float(step))).cast("int")).withColumn("block", F.floor(F.col("at") / F.col("size") / F.lit(block_width(percent)) + F.lit(1e-9)).cast("int"))


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, both) for pairs (a, b) of documents in sets. A b with many partners is dealt over several tasks."""
    loads = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int").alias("shares"))
    first = pairs.join(sets.select(F.col("doc_id").alias("a"), "tokens"), "a").join(loads, "b").select("b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), "a", "tokens")
    second = sets.select(F.col("doc_id").alias("b"), "tokens").join(loads, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("a"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for b, share, kind, a, tokens in zip(*batch.columns, strict=True):
                values = np.frombuffer(tokens.as_buffer(), "<u8")
                if kind.as_py() == 0:
                    at, own = (b.as_py(), share.as_py()), np.sort(values)
                elif at == (b.as_py(), share.as_py()) and len(own):
                    place = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    for x, v in zip(out, (a.as_py(), at[0], int((own[place] == values).sum())), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b", "both"])

    return first.unionByName(second).repartition("b", "share").sortWithinPartitions("b", "share", "kind").mapInArrow(run, "a long, b long, both long")


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs with both sets' sizes, overlap, and whether they link."""
    size = sets.select("doc_id", "size")
    out = overlaps(pairs, sets).join(size.withColumnsRenamed({"doc_id": "a", "size": "size_a"}), "a").join(size.withColumnsRenamed({"doc_id": "b", "size": "size_b"}), "b")
    return out.withColumn("linked", F.col("both") * 100 >= percent * (F.col("size_a") + F.col("size_b") - F.col("both")))


def linked_sets(sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """(a, b): enough links to connect all documents in sets that links connect."""
    lists = written(postings(sets, percent), folder, "lists")
    # Step 3: the first id of a block leads it.
    heads = lists.groupBy("token", "band").agg(F.min("id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    votes = lists.select("token", "band", "id").join(heads, ["token", "band"]).where("leader <> id").groupBy("id", "leader").count()
    chosen = votes.groupBy("id").agg(F.max_by("leader", F.struct("count", -F.col("leader"))).alias("leader"))
    stars = written(links_of(chosen.select(F.col("id").alias("a"), F.col("leader").alias("b")), sets, percent), folder, "stars")
    edges = stars.where("linked").select("a", "b")
    labels = written(components(edges, folder, "first"), folder, "labels")
    # A cluster is a leader and the sets that link to it; every other set is a cluster of its own.
    # What a member has beside its leader: shingles of one document only can't be shared with any other either.
    member = stars.where("linked").select(F.col("a").alias("id"), F.col("b").alias("cluster"), "both")
    clusters = sets.select(F.col("doc_id").alias("id"), "size", (F.col("size") - F.col("unique")).alias("shared")).join(member, "id", "left").join(labels, "id", "left")
    # A set without a cluster keeps its overlap with the leader that it was compared with, unless it leads others, of which nothing is known.
    lone = stars.where("not linked").select(F.col("a").alias("id"), F.col("b").alias("pivot"), F.col("both").alias("pivot_both"))
    lone = lone.join(member.select(F.col("cluster").alias("id")).distinct(), "id", "left_anti")
    clusters = clusters.join(lone, "id", "left").select("id", "size", F.coalesce("cluster", "id").alias("cluster"), F.coalesce(F.col("shared") - F.col("both"), F.lit(0)).alias("beside"), F.coalesce("component", "id").alias("component"), "pivot", "pivot_both", (F.col("shared") - F.col("pivot_both")).alias("pivot_beside"))
    clusters = written(clusters, folder, "clusters")
    # Step 4: lists with more than one component, as one row for each cluster, band and block.
    pivots = ["pivot", "pivot_both", "pivot_beside"]
    tagged = lists.join(clusters.select("id", "cluster", "component", *pivots), "id")
    mixed = tagged.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("token")
    rows = tagged.join(mixed, "token").groupBy("token", "cluster", "component", "band", "block").agg(F.min("size").alias("low"), F.max("size").alias("high"), *(F.max(c).alias(c) for c in pivots))
    rows = written(rows, folder, "mixed")
    other = rows.select("token", *(F.col(c).alias(f"{c}_2") for c in ("cluster", "component", "band", "block", "low", "high", *pivots)))
    blocks = F.broadcast(sets.sparkSession.createDataFrame(allowed(percent), "block int, step int, block_2 int"))  # of a fixed size
    asked = rows.join(blocks, "block").withColumn("band_2", F.col("band") + F.col("step"))
    # Two sets share at most what both share with one pivot and what both have beside it. Sets too far from a pivot, as of a large group of
    # near copies those with many edits, make no pairs with each other.
    most = F.least("pivot_both", "pivot_both_2") + F.least("pivot_beside", "pivot_beside_2")
    far = F.coalesce((F.col("pivot") == F.col("pivot_2")) & (most * (100 + percent) < (F.col("low") + F.col("low_2")) * percent), F.lit(False))
    pairs = asked.join(other, ["token", "band_2", "block_2"]).where(~far & (F.col("cluster") < F.col("cluster_2")) & (F.col("component") != F.col("component_2")) & (F.col("low") * percent <= F.col("high_2") * 100) & (F.col("low_2") * percent <= F.col("high") * 100))
    pairs = pairs.select(F.col("cluster").alias("a"), F.col("cluster_2").alias("b")).distinct()
    tops = written(links_of(pairs, sets, percent), folder, "tops")
    edges = edges.unionByName(tops.where("linked").select("a", "b"))
    labels = written(components(edges, folder, "second"), folder, "labels-2")
    # (100 + percent) * overlap >= percent * (both sizes): what a member has at most towards that, besides its leader's overlap. Members with
    # nothing beside their leader may link where leaders do not, as they are smaller; only of two clusters without members is nothing left to ask.
    best = clusters.groupBy("cluster").agg(F.max(F.col("beside") * (100 + percent) - F.col("size") * percent).alias("best"), F.max(F.col("id") != F.col("cluster")).alias("more"))
    open_pairs = _apart(tops.where("not linked").select("a", "b", "both"), labels)
    for side in ("a", "b"):
        open_pairs = open_pairs.join(best.withColumnsRenamed({"cluster": side, "best": f"best_{side}", "more": f"more_{side}"}), side)
    open_pairs = written(open_pairs.where((F.col("more_a") | F.col("more_b")) & (F.col("both") * (100 + percent) + F.col("best_a") + F.col("best_b") >= 0)), folder, "open")
    # The larger cluster of a pair is indexed, the other's sets are its queries.
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    turned = open_pairs.join(sizes.withColumnsRenamed({"cluster": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"cluster": "b", "n": "n_b"}), "b")
    turned = turned.select(F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")).alias("cluster"), F.when(F.col("n_a") >= F.col("n_b"), F.col("b")).otherwise(F.col("a")).alias("asks"))
    return edges.unionByName(written(derived(turned, clusters, sets, percent), folder, "last"))


def derived(pairs: DataFrame, clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of the sets of cluster ``asks`` to those of ``cluster``, for each set and share of members the first found.

    A member is kept as what it lacks of its leader and what it has beside it. A set's overlap with each member is the one
    with the leader, less what the member lacks of it, plus what it has beside: no set is compared as a whole with any member.
    """
    tokens = sets.select(F.col("doc_id").alias("id"), "size", "tokens")
    indexed = pairs.select("cluster").distinct().join(clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / F.lit(MEMBERS)).cast("int").alias("shares")), "cluster")
    every = F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")
    leaders = indexed.select("cluster", every, F.lit(0).alias("kind"), F.col("cluster").alias("id"))
    members = clusters.where("id <> cluster").select("cluster", "id").join(indexed, "cluster").select("cluster", F.pmod(F.xxhash64("id"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("kind"), "id")
    queries = pairs.join(clusters.select(F.col("cluster").alias("asks"), "id"), "asks").select("cluster", "id").distinct().join(indexed, "cluster").select("cluster", every, F.lit(2).alias("kind"), "id")
    rows = leaders.unionByName(members).unionByName(queries).join(tokens, "id").select("cluster", "share", "kind", "id", "size", "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = top = index = None
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for cluster, share, kind, doc, size, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.sort(np.frombuffer(blob, "<u8"))
                if kind == 0:
                    at, top, held, index = (cluster, share), values, [(doc, size, np.zeros(0, np.int64), values[:0])], None
                    continue
                if at != (cluster, share):
                    continue
                if kind == 1:
                    held.append((doc, size, np.flatnonzero(~np.isin(top, values, assume_unique=True)), np.setdiff1d(values, top, assume_unique=True)))
                    continue
                if index is None:
                    lacks, extra = [x[2] for x in held], [x[3] for x in held]
                    index = (np.array([x[0] for x in held]), np.array([x[1] for x in held]), np.concatenate(lacks), np.repeat(np.arange(len(held)), [len(x) for x in lacks]), np.concatenate(extra), np.repeat(np.arange(len(held)), [len(x) for x in extra]), max(len(x) for x in extra))
                    held = []
                ids, own, lack, lack_of, more, more_of, most = index
                mine = np.isin(top, values, assume_unique=True)
                base = int(mine.sum())
                if (base + most) * (100 + percent) < percent * (size + int(own.min())):
                    continue
                both = base - np.bincount(lack_of, mine[lack], len(ids)) + np.bincount(more_of, np.isin(more, values), len(ids))
                found = np.flatnonzero((100 * both >= percent * (own + size - both)) & (ids != doc))
                if len(found):
                    out.append((int(ids[found].min()), doc))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.repartition("cluster", "share").sortWithinPartitions("cluster", "share", "kind").mapInArrow(run, "a long, b long")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) that lie in different components; ids without a label are their own."""
    for side in ("a", "b"):
        pairs = pairs.join(labels.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    return pairs.where("coalesce(c_a, a) <> coalesce(c_b, b)").drop("c_a", "c_b")


def joined(docs: DataFrame, n: int = N, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every document."""
    rows = text_columns(docs, id_col, text_col)
    folder = shared_dir(docs.sparkSession)
    table = written(set_table(rows, n).groupBy("doc_id").agg(F.max(F.struct("n_shingles", "key")).alias("s")).select("doc_id", "s.*"), folder, "sets")
    sets = written(shared_sets(rows, table, n, percent), folder, "shared")
    full = table.where("n_shingles > 0")
    equal = full.groupBy("key").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # Keys with more than a quarter of a partition's share of rows, four a partition at most, are broadcast: no task gets all of such a group.
    share = table.count() / (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = F.broadcast(written(equal.where(F.col("copies") > share), folder, "hot").select("key", "first"))
    apart = full.join(hot, "key", "left")
    rest = apart.where("first is null").drop("first").join(equal.where(F.col("copies") <= share).select("key", "first"), "key")
    copies = apart.where("first is not null").unionByName(rest.select(*apart.columns)).where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"))
    found = components(copies.unionByName(linked_sets(sets, percent, folder)), folder, "all")
    return table.join(found.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id")), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
