"""Benchmark decontamination: item-sized windows by SimHash, found through a multi-index over Hamming blocks, then verified.

Words are longest runs of lower-cased A-Z, digits and characters beyond ASCII; shingles have SHINGLE words, and a shingle's
weight falls with the number of items that hold it. Of a document, every window of an item's size counts whose shingles that items of
this size hold weigh enough: the similarity asked for, times the least weight of an item of this size and of the window's
other shingles. A window below that bound is below the similarity for each item of its size, so none that could pass is left out.
Each distinct window gets a 64-bit SimHash over its weighted shingles. Items' SimHashes are cut into BLOCKS blocks of 8
bits: if two fingerprints differ in at most RADIUS bits, then some block differs in at most FLIPS bits, so an
equi-join on (size, block, value) with all values at that distance finds every pair within the radius. Pairs within it are verified by
weighted Jaccard similarity.

DataFrame functions only. Texts or items that are null or without words match nothing; an item with fewer words than a
shingle is one shingle, and is compared with the runs of as many words. A document shorter than an item is one window. Rows with one doc_id or item id are told apart by a hash of
their text, equal rows count once; of several texts the best window is reported. Rows without an id match nothing. The shingles of the items are broadcast while there are at most BROADCAST_ROWS of them, else joined by a shuffle.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_dir, text_columns, written
from .licenses import word_array

SHINGLE = 5
SIMILARITY = 0.8
BLOCKS, FLIPS = 8, 2
#: The largest distance at which some of BLOCKS blocks surely differs in at most FLIPS bits.
RADIUS = BLOCKS * (FLIPS + 1) - 1
BROADCAST_ROWS = 1_000_000
#: Neighbouring windows that are cut from one row.
CHUNK = 64
#: Weights are whole, so this only guards a bound against rounding.
SLACK = 1e-6


def shingles(words: Column, n: int | Column = SHINGLE) -> Column:
    """Hashes of the runs of n words, in order; fewer words are one run; no words, none."""
    last = F.greatest(F.size(words) - n + 1, F.lit(1))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def simhashes(rows: DataFrame, keys: list[str], hashes: str, weights: str, out: str) -> DataFrame:
    """keys and ``out``, 64 bits: bit i is set if the weights of the shingles with it exceed half of all. Weights are small whole numbers."""
    mask, low = F.lit(1 << 32 | 1).cast("long"), F.lit((1 << 32) - 1).cast("long")
    each = rows.select(*keys, F.explode(F.zip_with(hashes, weights, lambda h, w: F.struct(h.alias("h"), w.alias("w")))).alias("x")).select(*keys, F.col("x.h").alias("h"), F.col("x.w").alias("w"))
    # Two counters of 32 bits at a time: bits k and k + 32.
    lanes = each.groupBy(*keys).agg(F.sum("w").alias("total"), *(F.sum(F.shiftrightunsigned("h", k).bitwiseAND(mask) * F.col("w")).alias(f"lane{k}") for k in range(32)))
    code = F.lit(0).cast("long")
    for k in range(32):
        for part, value in ((F.col(f"lane{k}").bitwiseAND(low), 1 << k), (F.shiftrightunsigned(f"lane{k}", 32), 1 << (k + 32))):
            code = code.bitwiseOR(F.when(part * 2 > F.col("total"), F.lit(value - (1 << 64) if value >= 1 << 63 else value)).otherwise(F.lit(0)).cast("long"))
    return lanes.select(*keys, code.alias(out))


def blocks(code: Column) -> Column:
    return F.array(*(F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(code, 8 * b).bitwiseAND(F.lit(255)).cast("int").alias("value")) for b in range(BLOCKS)))


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """doc_id, item_id, start (first word of the best window), n_words (its size), distance, similarity: each pair that leaks."""
    # An item is an id and a text, so that a repeated row is no second item and another text of the id is one.
    item = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    item = item.select(F.struct("id", F.xxhash64("text").alias("key")).alias("item_id"), word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    item = item.select("item_id", F.size("words").alias("n"), F.array_distinct(shingles(F.col("words"))).alias("own"), shingles(F.col("words")).alias("all"))
    n_items = F.lit(max(1, items.count()))
    # Whole weights from 4 to 16: a shingle of one item or none weighs most.
    frequency = item.select("item_id", F.explode("own").alias("sh")).groupBy("sh").agg(F.count(F.lit(1)).alias("df"))
    most = 16
    weight = F.greatest(F.lit(4), F.round(F.lit(most) * F.log((n_items + 1) / (F.col("df") + F.lit(0.0))) / F.log((n_items + 1) / F.lit(1.0)))).cast("long")
    weighted = item.select("item_id", "n", F.explode("own").alias("sh")).join(frequency, "sh").groupBy("item_id", "n").agg(F.collect_list(F.struct("sh", weight.alias("w"))).alias("own"))
    weighted = weighted.select("item_id", "n", F.col("own.sh").alias("item_sh"), F.col("own.w").alias("item_w"))
    weighted = weighted.join(simhashes(weighted, ["item_id"], "item_sh", "item_w", "item_code"), "item_id")
    folder = shared_dir(docs.sparkSession)
    weighted = written(weighted, folder, "items")

    # Of each item size: its least item, and the shingles, of ``l`` words, that items of this size hold.
    sizes = F.broadcast(weighted.select("n", F.aggregate("item_w", F.lit(0).cast("long"), lambda s, w: s + w).alias("w")).groupBy("n").agg(F.min("w").alias("least")))
    length = F.least(F.col("n"), F.lit(SHINGLE))
    anchors = weighted.select("n", length.alias("l"), F.explode(F.arrays_zip("item_sh", "item_w")).alias("x")).select("l", F.col("x.item_sh").alias("sh"), "n", F.col("x.item_w").alias("w")).distinct()
    small = anchors.count() <= BROADCAST_ROWS
    kept = F.broadcast if small else lambda x: x
    weights = kept(anchors.select("l", "sh", "w").distinct())
    lengths = sorted(r["l"] for r in weighted.select(length.alias("l")).distinct().collect())  # at most SHINGLE of them
    rows = text_columns(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("key"), "text")
    split = rows.select("doc_id", "key", word_array(F.col("text")).alias("words")).select("doc_id", "key", "words", F.explode(F.array(*map(F.lit, lengths)).cast("array<int>")).alias("l"))
    hits = split.select("doc_id", "key", F.size("words").alias("size"), "l", F.posexplode(shingles(F.col("words"), F.col("l"))).alias("pos", "sh")).join(kept(anchors), ["l", "sh"])
    # The held shingles of a window weigh a sum that changes only where a shingle comes in or goes out.
    last = F.greatest(F.lit(0), F.col("size") - F.col("n"))
    first, final = F.greatest(F.lit(0), F.col("pos") - F.col("n") + F.col("l")), F.least(F.col("pos"), last)
    steps = F.array(F.struct(F.least(first, last).alias("at"), F.col("w").alias("w")), F.struct((final + 1).alias("at"), (-F.col("w")).alias("w")))
    steps = hits.select("doc_id", "key", "l", "n", F.explode(steps).alias("x")).groupBy("doc_id", "key", "l", "n", F.col("x.at").alias("at")).agg(F.sum("x.w").alias("w"))
    along = Window.partitionBy("doc_id", "key", "l", "n").orderBy("at")
    spans = steps.select("doc_id", "key", "l", "n", "at", F.lead("at").over(along).alias("to"), F.sum("w").over(along).alias("held")).join(sizes, "n").where(F.col("to").isNotNull() & (F.col("held") + SLACK >= F.col("least") * F.lit(similarity)))
    spans = spans.groupBy("doc_id", "key", "l").agg(F.collect_list(F.struct("n", "least", "at", "to")).alias("spans"))
    # The shingles of the documents with such windows, each with its weight.
    texts = rows.join(spans.select("doc_id", "key", "l"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key", "l"])
    # The words are a column of their own, below the generator: within it they would be split again for each shingle.
    texts = texts.select("doc_id", "key", "l", word_array(F.col("text")).alias("words"))
    texts = texts.select("doc_id", "key", "l", F.posexplode(shingles(F.col("words"), F.col("l"))).alias("pos", "sh")).join(weights, ["l", "sh"], "left")
    # A shingle counts once a window: there where its last place before, if any, lies outside.
    texts = texts.withColumn("before", F.coalesce(F.lag("pos").over(Window.partitionBy("doc_id", "key", "l", "sh").orderBy("pos")), F.lit(-1)))
    texts = texts.groupBy("doc_id", "key", "l").agg(F.sort_array(F.collect_list(F.struct("pos", "sh", "w", "before"))).alias("all"))
    # A row for CHUNK neighbouring windows holds the shingles of these alone, so that no row of a window carries its whole text.
    width = lambda x: x["n"] - F.col("l")
    cut = lambda x, c: F.struct(x["n"].alias("n"), x["least"].alias("least"), c.alias("at"), F.least(c + CHUNK, x["to"]).alias("to"), F.slice("all", c + 1, F.least(c + CHUNK, x["to"]) - c + width(x)).alias("part"))
    chunks = F.flatten(F.transform("spans", lambda x: F.transform(F.sequence(x["at"], x["to"] - 1, F.lit(CHUNK)), lambda c: cut(x, c))))
    windows = texts.join(spans, ["doc_id", "key", "l"]).select("doc_id", "l", F.explode(chunks).alias("x")).select("doc_id", "l", "x.*").select("doc_id", "l", "n", "least", "at", "part", F.explode(F.sequence("at", F.col("to") - 1)).alias("start"))
    own = F.filter(F.slice("part", F.col("start") - F.col("at") + 1, F.col("n") - F.col("l") + 1), lambda x: x["before"] < F.col("start"))
    windows = windows.select("doc_id", "n", "least", "start", own.alias("own"))
    held, beside = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x["w"], F.lit(0))), F.size(F.filter("own", lambda x: x["w"].isNull())) * most
    windows = windows.where(held + SLACK >= (F.col("least") + beside) * F.lit(similarity))
    windows = windows.select("doc_id", "n", "start", F.col("own.sh").alias("win_sh"), F.transform("own.w", lambda w: F.coalesce(w, F.lit(most).cast("long"))).alias("win_w"))
    windows = written(windows.withColumn("win", F.xxhash64("win_sh", "n")), folder, "windows")
    # Equal windows of copies share one fingerprint and one verification.
    distinct = windows.select("win", "n", "win_sh", "win_w").dropDuplicates(["win"])
    coded = written(simhashes(distinct, ["win", "n"], "win_sh", "win_w", "code"), folder, "codes")

    flips = [0, *(sum(1 << b for b in c) for k in range(1, FLIPS + 1) for c in combinations(range(8), k))]
    probes = weighted.select("item_id", "n", "item_sh", "item_w", "item_code", F.explode(blocks(F.col("item_code"))).alias("b"))
    probes = probes.select("item_id", "n", "item_sh", "item_w", "item_code", F.col("b.block").alias("block"), F.explode(F.transform(F.array(*map(F.lit, flips)), lambda f: F.col("b.value").bitwiseXOR(f))).alias("value"))
    index = probes.select("n", "block", "value", "item_id", "item_code")
    near = coded.select("win", "n", "code", F.explode(blocks(F.col("code"))).alias("b")).select("win", "n", "code", F.col("b.block").alias("block"), F.col("b.value").alias("value")).join(index, ["n", "block", "value"])
    near = near.withColumn("distance", F.bit_count(F.col("code").bitwiseXOR(F.col("item_code")))).where(F.col("distance") <= RADIUS).select("win", "item_id", "distance").distinct()
    both = near.join(distinct.select("win", "win_sh", "win_w"), "win").join(weighted.select("item_id", "item_sh", "item_w"), "item_id")
    shared = F.filter(F.arrays_zip("item_sh", "item_w"), lambda x: F.array_contains(F.col("win_sh"), x["item_sh"]))
    total = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda s, x: s + x)
    both = both.select("win", "item_id", "distance", F.aggregate(shared, F.lit(0).cast("long"), lambda s, x: s + x["item_w"]).alias("in_both"), total("item_w").alias("in_item"), total("win_w").alias("in_win"))
    good = both.select("win", "item_id", "distance", (F.col("in_both") / (F.col("in_item") + F.col("in_win") - F.col("in_both"))).alias("similarity")).where(F.col("similarity") >= similarity)
    found = windows.select("doc_id", "win", "start", "n").join(good, "win")
    best = found.groupBy("doc_id", F.col("item_id.id").alias("item_id")).agg(F.max_by(F.struct("start", "n", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("x"))
    return best.select("doc_id", "item_id", F.col("x.start").cast("long").alias("start"), F.col("x.n").cast("long").alias("n_words"), F.col("x.distance").cast("int").alias("distance"), F.round("x.similarity", 6).alias("similarity"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs, with all columns, in which no item leaks."""
    return docs.join(matches(docs, items, similarity).select("doc_id").distinct(), "doc_id", "left_anti")
