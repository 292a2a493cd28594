"""Source divergence audit: how far the term distributions of a language's sources lie apart, and which terms set a source off.

A term is a longest run of ASCII letters and bytes above 0x7F, A-Z lower-cased; each row is a document. A language keeps the terms that
stand in at least ``min_docs`` of its documents. A source gives a kept term the share 1 + floor(scale * (count + smoothing) / (N +
smoothing * V)), where V is the number of kept terms and N the sum of the source's counts over them.

The sum of absolute differences of two sources over all V terms starts from what terms that neither has would give, V times the
difference of the two zero-count shares. An inverted index of terms then corrects it: the postings that one source has, counted by
share, are summed up to the other's zero-count share, and a term that both have adds one correction where the two ranges from
zero-count share to share overlap, that is, where it isn't zero. No term is looked at for sources that don't have it.

Null languages, sources and texts are empty strings; such rows count as documents. Repeated rows count each time. A source without kept
terms, or without any text, is compared as the others are; a language with a single source has no pairs. An empty table gives an
empty result. Columns other than the three named are not read. Texts of any length are counted in parts of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BATCH_BYTES, bounded_batches, shared_dir, spans, text_bytes, written
from .words import LOWER, word_edges

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Bytes that stand in no term.
OUTSIDE = np.ones(256, bool)
OUTSIDE[65:91] = OUTSIDE[97:123] = OUTSIDE[128:] = False
#: Rows of counts that a task holds before it hands them on.
HELD_ROWS = 400_000
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def parts(data: np.ndarray, most: int = BATCH_BYTES) -> Iterator[np.ndarray]:
    """A text in parts of about ``most`` bytes that end where no term goes on."""
    at = 0
    while len(data) - at > most:
        end = at + most
        while end < len(data):  # the next byte outside terms, looked for a stretch at a time
            out = np.flatnonzero(OUTSIDE[data[end : end + 4096]])
            if len(out):
                end += int(out[0])
                break
            end = min(end + 4096, len(data))
        yield data[at:end]
        at = end
    yield data[at:]


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts, and the text of each."""
    first, end = word_edges(data, offsets, OUTSIDE)
    packed = np.ascontiguousarray(LOWER[data[~OUTSIDE[data]]])
    ends = np.concatenate(([0], np.cumsum(end - first))).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(packed)).dictionary_encode(), np.searchsorted(offsets, first, "right") - 1


def counted(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> pa.Table:
    """(group, term, n, docs) of texts and their groups; offsets and group belong to whole texts."""
    found, text = terms(data, offsets)
    codes, width = found.indices.to_numpy().astype(np.int64), max(len(found.dictionary), 1)
    pairs, n = np.unique(text * width + codes, return_counts=True)  # a row a text and term
    key = group[pairs // width] * width + pairs % width
    keys, back = np.unique(key, return_inverse=True)
    total = np.bincount(back, n, len(keys)).astype(np.int64)
    return pa.table({"group": keys // width, "term": found.dictionary.take(pa.array(keys % width)), "n": total, "docs": np.bincount(back, minlength=len(keys)).astype(np.int64)})


def long_text(data: np.ndarray, group: int) -> pa.Table:
    """The same of one text that is counted in parts."""
    each = [counted(x, np.array([0, len(x)]), np.array([group])) for x in parts(data)]
    one = pa.concat_tables(each).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["group", "term", "n"])
    return one.append_column("docs", pa.array(np.ones(len(one), np.int64)))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents with it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[tuple[str, str], int] = {}
        held: list[pa.Table] = []

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by(["group", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(["group", "term", "n", "docs"])

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            which, (langs, sources) = table["group"].to_numpy(), (pa.array(x, pa.string()) for x in zip(*names, strict=True))
            columns = [langs.take(pa.array(which)), sources.take(pa.array(which)), *(table[x] for x in ("term", "n", "docs"))]
            yield from pa.table(columns, COUNTS).to_batches(50_000)

        for batch in batches:
            own = [names.setdefault(x, len(names)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            group, (data, offsets) = np.array(own, np.int64), text_bytes(batch.column(2))
            for a, b in spans(offsets, BATCH_BYTES):
                raw, cut = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                held.append(long_text(raw, own[a]) if len(raw) > BATCH_BYTES else counted(raw, cut, group[a:b]))
            if sum(map(len, held)) > HELD_ROWS:
                held = [merged()]
                if len(held[0]) > HELD_ROWS // 2:
                    yield from out(held.pop())
        if held:
            yield from out(merged())

    bounded_batches(docs.sparkSession)
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column, smoothing: int = SMOOTHING, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + smoothing) / (total + smoothing * kept)), exact: the product is a decimal."""
    product = (count + smoothing).cast("decimal(19,0)") * F.lit(scale).cast("decimal(10,0)")
    return F.call_function("div", product, (total + smoothing * kept).cast("decimal(19,0)")) + 1


class Index:
    """The tables that the audit is made from, written to a shared folder: kept terms, their postings, and the groups."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, lang_col: str = "lang", source_col: str = "source", text_col: str = "text"):
        folder = shared_dir(docs.sparkSession)
        counts = written(term_counts(docs, lang_col, source_col, text_col), folder, "counts")
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
        postings = written(counts.drop("docs").join(kept, ["lang", "term"]), folder, "kept")
        name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        every = docs.select(name(lang_col).alias("lang"), name(source_col).alias("source")).distinct()
        langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("in_lang").alias("lang_total"))
        totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
        zero = F.when(F.col("v") > 0, share(F.lit(0), F.col("total"), F.col("v"), smoothing, scale)).otherwise(F.lit(0))
        #: lang, source, total, v, lang_total, zero (the share of terms that the source lacks; 0 if no term is kept)
        self.groups = written(groups.withColumn("zero", zero), folder, "groups")
        rows = postings.join(self.groups, ["lang", "source"])
        own, common = share(F.col("n"), F.col("total"), F.col("v"), smoothing, scale), share(F.col("in_lang"), F.col("lang_total"), F.col("v"), smoothing, scale)
        #: lang, source, term, zero, share, lang_share
        self.postings = written(rows.select("lang", "source", "term", "zero", own.alias("share"), common.alias("lang_share")), folder, "postings")

    def pairs(self) -> DataFrame:
        """lang, source, other, value: the sum of differences over all kept terms, for every two sources of a language, both ways."""
        side = lambda s: self.groups.select("lang", "v", F.col("source").alias(s), F.col("zero").alias(f"{s}_zero"))
        both = side("a").join(side("b").drop("v"), "lang").where("a < b")
        start = both.select("lang", "a", "b", (F.col("v") * F.abs(F.col("a_zero") - F.col("b_zero"))).alias("value"))
        total = start.unionByName(self.one_sided(both)).unionByName(self.shared()).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other"))))
        return total.select("lang", ways.alias("way"), "value").select("lang", "way.*", "value")

    def one_sided(self, both: DataFrame) -> DataFrame:
        """What the terms of one source alone change: each adds its rise over the zero-count share, less twice the part of the rise
        below the other's zero-count share. Rises are counted by size; running sums along them serve all others of a source at once."""
        rises = self.postings.groupBy("lang", "source", (F.col("share") - F.col("zero")).alias("rise")).agg(F.count("*").alias("n"))
        totals = rises.groupBy("lang", "source").agg(F.sum(F.col("rise") * F.col("n")).alias("all_rise"), F.sum("n").alias("all_n"))
        gap = lambda s, o: F.greatest(F.col(f"{o}_zero") - F.col(f"{s}_zero"), F.lit(0))
        asked = F.explode(F.array(*(F.struct(F.col(s).alias("source"), gap(s, o).alias("rise")) for s, o in ("ab", "ba"))))
        queries = both.select("lang", "a", "b", asked.alias("q")).select("lang", "q.source", "q.rise", F.lit(0).cast("long").alias("n"), "a", "b")
        none = F.lit(None).cast("string")
        along = Window.partitionBy("lang", "source").orderBy("rise").rangeBetween(Window.unboundedPreceding, 0)
        lines = rises.select("lang", "source", "rise", "n", none.alias("a"), none.alias("b")).unionByName(queries)
        below = lines.withColumn("low", F.sum(F.col("rise") * F.col("n")).over(along)).withColumn("low_n", F.sum("n").over(along)).where("a is not null")
        part = F.col("low") + F.col("rise") * (F.col("all_n") - F.col("low_n"))
        return below.join(totals, ["lang", "source"]).select("lang", "a", "b", (F.col("all_rise") - 2 * part).alias("value"))

    def shared(self) -> DataFrame:
        """What terms change that both sources have: less twice the overlap of the two rises, where they overlap."""
        side = lambda s: self.postings.select("lang", "term", F.col("source").alias(s), F.col("zero").alias(f"{s}_zero"), F.col("share").alias(f"{s}_share"))
        overlap = F.least("a_share", "b_share") - F.greatest("a_zero", "b_zero")
        return side("a").join(side("b"), ["lang", "term"]).where((F.col("a") < F.col("b")) & (overlap > 0)).select("lang", "a", "b", (-2 * overlap).alias("value"))

    def terms(self, top: int = TOP) -> DataFrame:
        """lang, source, term, value and rank of the terms whose share is farthest above the language's, the ``top`` first of each source."""
        order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "term")
        value = (F.col("share") - F.col("lang_share")).alias("value")
        return self.postings.where("share > lang_share").select("lang", "source", "term", value).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, top: int = TOP, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank: part ``pair`` has every other source of the language, part ``term`` the top terms."""
    index = Index(docs, min_docs, smoothing, scale, lang_col, source_col, text_col)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "other")
    pairs = index.pairs().withColumn("rank", F.row_number().over(order))
    one = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank")
    return one.unionByName(index.terms(top).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank"))
