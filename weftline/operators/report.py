"""Refinement, confidence levels and the final report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr as E
from ..params import FusionParams

DEFAULT = FusionParams()
#: Tags of fusions that are seen in normal tissue.
NORMAL_TAGS = ["ConjoinG", "Babiceanu_Normal", "Greger_Normal", "GTEx_recurrent_StarF2019", "DGD_PARALOGS", "BodyMap"]


def annotation_state(pairs: DataFrame, library: DataFrame) -> DataFrame:
    """Adds state: NORMAL_FUSION or PASS by the tags of A--B, else of B--A; null if neither is listed."""
    one = library.select(F.col("left_gene").alias("up_gene"), F.col("right_gene").alias("lo_gene"), F.col("tags").alias("tags_ab"))
    two = library.select(F.col("right_gene").alias("up_gene"), F.col("left_gene").alias("lo_gene"), F.col("tags").alias("tags_ba"))
    tags = F.coalesce("tags_ab", "tags_ba")
    out = pairs.join(one, ["up_gene", "lo_gene"], "left").join(two, ["up_gene", "lo_gene"], "left")
    normal = F.arrays_overlap(tags, F.array(*map(F.lit, NORMAL_TAGS)))
    return out.withColumn("state", F.when(tags.isNotNull(), F.when(F.coalesce(normal, F.lit(False)), "NORMAL_FUSION").otherwise("PASS"))).drop("tags_ab", "tags_ba")


#: Doublings of a bin above which a range is cut into the largest blocks there are.
LEVELS = 12


def blocks(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The bins low to high as blocks (level, node), node n of a level being the bins from n * 2 ** level on, 2 ** level of them: each bin is in
    one block, and there are at most two blocks a level below the last, however long the range."""
    kind = "array<struct<level:int,node:bigint>>"
    start = F.struct(low.alias("a"), high.alias("b"), F.array().cast(kind).alias("out"))
    at = lambda level, node: F.array(F.struct(level.cast("int").alias("level"), node.cast("bigint").alias("node")))
    none = F.array().cast(kind)

    def step(s: Column, level: Column) -> Column:
        open_ = s["a"] <= s["b"]
        left = open_ & (s["a"] % 2 == 1)
        a = s["a"] + left.cast("bigint")
        right = (a <= s["b"]) & (s["b"] % 2 == 0)
        b = s["b"] - right.cast("bigint")
        out = F.concat(s["out"], F.when(left, at(level, s["a"])).otherwise(none), F.when(right, at(level, s["b"])).otherwise(none))
        more = a <= b  # else nothing is left, and must not be after halving
        return F.struct(F.when(more, F.floor(a / 2)).otherwise(0).alias("a"), F.when(more, F.floor(b / 2)).otherwise(-1).alias("b"), out.alias("out"))

    def last(s: Column) -> Column:
        rest = F.when(s["a"] <= s["b"], F.transform(F.sequence(s["a"], s["b"]), lambda n: F.struct(F.lit(levels).alias("level"), n.alias("node")))).otherwise(none)
        return F.concat(s["out"], rest)

    return F.aggregate(F.sequence(F.lit(0), F.lit(levels - 1)), start, step, last)


def genes_between(candidates: DataFrame, genes: DataFrame, bin_size: int = 100_000) -> DataFrame:
    """Candidates with their protein coding genes between: same chrom, starting after the first and ending before the last gene.

    An equi-join on blocks of bins of gene starts: a gene is in one block of each level, a candidate's range in few, so nothing grows with the range but the
    genes found in it. candidates: id, chrom, low, high, strand (null unless both genes share one), up_gene, lo_gene.
    """
    number = lambda c: F.floor(F.col(c) / bin_size)
    levels = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.floor(number("start") / F.pow(F.lit(2.0), k)).alias("node")))).alias("block")
    g = genes.where("type = 'protein_coding'").select(F.col("gene").alias("between"), F.col("chrom"), F.col("start").alias("g_start"), F.col("end").alias("g_end"), F.col("strand").alias("g_strand"), levels)
    c = candidates.where("low <= high").withColumn("block", F.explode(blocks(number("low"), number("high"))))
    hit = (F.col("g_start") > F.col("low")) & (F.col("g_end") < F.col("high")) & (F.col("strand").isNull() | (F.col("strand") == F.col("g_strand"))) & (F.col("between") != F.col("up_gene")) & (F.col("between") != F.col("lo_gene"))
    return c.join(g, ["chrom", "block"]).where(hit).drop("block")


def near_hits(candidates: DataFrame, hits: DataFrame, window: int = DEFAULT.near_window) -> DataFrame:
    """For each candidate, its last hit near its range and how many: both of (id, chrom, start, end), hits with ord."""
    c = candidates.select("id", F.col("chrom").alias("c_chrom"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    close = (F.col("chrom") == F.col("c_chrom")) & ((F.abs(F.col("start") - F.col("c_start")) <= window) | (F.abs(F.col("end") - F.col("c_end")) <= window))
    return hits.join(c, "id").where(close).groupBy("id").agg(F.max_by("start", "ord").alias("hit_start"), F.max_by("end", "ord").alias("hit_end"), F.count(F.lit(1)).alias("n_hits"))


def level(m: Column, g: Column, m0_strand: Column, has_graph: Column, has_genome: Column, normal: Column, exact: Column, same_chrom: Column, distance: Column, other_between: Column, any_between: Column, coding: Column, params: FusionParams = DEFAULT) -> Column:
    """The confidence level from what the checks found.

    m: graph check with both boundaries snapped (m0_strand is its part that chrom and strand agree); g: genome check; exact:
    final breakpoints near the genome's; other_between: an unrelated named gene lies between; any_between: any gene does.
    Without graph alignments a fusion is rejected and has no level (null); without genome alignments it stays at 3.
    """
    ok = m & m0_strand
    near_same = F.when(other_between, 5).when(any_between, F.when(distance > params.middle_distance, 4).otherwise(2)).otherwise(2)
    alone = F.when(~same_chrom, 3).when(distance > params.far_distance, 5).otherwise(near_same)
    raw = F.when(ok & normal, 2).when(ok & g, F.when(exact, 5).otherwise(4)).when(ok, alone).when(g, 3).otherwise(1)
    lowered = F.when(raw.isin(1, 2) | coding, raw).otherwise(F.greatest(F.lit(3), raw - 1))
    return F.when(~has_graph, F.lit(None).cast("int")).when(~has_genome, 3).otherwise(lowered)


def collapsed(fusions: DataFrame) -> DataFrame:
    """One row for each unordered pair of genes, from (ord, up_gene, up_chrom, lo_gene, lo_chrom, up_bp, lo_bp, level, reads); other columns are those of the winning row.

    With a level 5: its breakpoint group with most distinct reads wins, and reads are those of all rows. Else the best
    level's row with most reads wins. Ties go to the first row.
    """
    pair = F.array_sort(F.array(F.struct(F.col("up_gene").alias("gene"), F.col("up_chrom").alias("chrom")), F.struct(F.col("lo_gene").alias("gene"), F.col("lo_chrom").alias("chrom"))))
    rows = fusions.where("level between 2 and 5").withColumn("pair", pair)
    groups = rows.withColumn("g", F.when(F.col("level") == 5, F.struct("up_bp", "lo_bp")).otherwise(F.struct(F.lit(None).cast("bigint").alias("up_bp"), (-F.col("ord")).alias("lo_bp"))))
    kept = [x for x in fusions.columns if x not in ("reads", "level")]
    best = groups.groupBy("pair", "level", "g").agg(F.array_distinct(F.flatten(F.collect_list("reads"))).alias("own"), F.min("ord").alias("first"), F.min_by(F.struct(*kept), "ord").alias("row"))
    order = F.struct("level", F.size("own"), -F.col("first"))
    out = best.groupBy("pair").agg(F.max_by("row", order).alias("row"), F.max("level").alias("best_level"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("own")))).alias("reads"))
    unnamed = F.col("row.up_gene").contains("ENSG") | F.col("row.lo_gene").contains("ENSG")
    final = F.when((F.col("best_level") != 2) & unnamed, F.greatest(F.lit(3), F.col("best_level") - 1)).otherwise(F.col("best_level"))
    return out.select("row.*", final.alias("level"), "reads")


def isoforms(fusions: DataFrame) -> DataFrame:
    """Level 5 rows of a pair by breakpoint: the one with most reads stands for the others; a row for each breakpoint pair."""
    w = Window.partitionBy("up_gene", "lo_gene", "up_bp", "lo_bp").orderBy(F.size("reads").desc(), "ord")
    reads = fusions.where("level = 5").groupBy("up_gene", "lo_gene", "up_bp", "lo_bp").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("reads")))).alias("all_reads"))
    top = fusions.where("level = 5").withColumn("n", F.row_number().over(w)).where("n = 1").select("ord", "up_gene", "lo_gene", "up_bp", "lo_bp")
    return top.join(reads, ["up_gene", "lo_gene", "up_bp", "lo_bp"])


def report(rows: DataFrame, least: int = DEFAULT.min_supporting_reads) -> DataFrame:
    """The eight text fields of each fusion with enough reads; rows also has up_ and lo_ sign, start and end, the aligned parts of the genes."""
    point = F.concat(F.col("up_chrom"), F.lit(":"), F.col("up_bp"), F.lit("; "), F.col("lo_chrom"), F.lit(":"), F.col("lo_bp"))
    region = lambda s: F.concat(F.col(f"{s}_chrom"), F.col(f"{s}_sign"), F.lit(": "), F.col(f"{s}_start"), F.lit(", "), F.col(f"{s}_end"))
    flag = F.concat(F.lit("flag = "), F.col("level"), F.lit(": "), E.level_text(F.col("level")))
    reads = F.array_join(F.transform("reads", lambda x: x.cast("string")), ";")
    return rows.where(F.size("reads") >= least).select(F.col("up_gene").alias("gene1"), F.col("lo_gene").alias("gene2"), point.alias("break_points"), region("up").alias("region1"), region("lo").alias("region2"), F.size("reads").cast("bigint").alias("support_num"), flag.alias("rank_class"), reads.alias("supporting_reads"))


#: The names of the report's fields in its first line.
HEADER = ["#gene1 name", "gene2 name", "break points", "gene1 position", "gene2 position", "support num", "rank class", "supporting reads information"]


def report_lines(reported: DataFrame) -> DataFrame:
    """value: the report's first line and its rows, fields joined by tabs, in one part in that order, as a text sink takes them."""
    head = reported.sparkSession.createDataFrame([(0, "\t".join(HEADER))], "nth int, value string")
    rows = reported.select(F.lit(1).alias("nth"), F.concat_ws("\t", *reported.columns).alias("value"))
    return head.unionByName(rows).coalesce(1).sortWithinPartitions("nth", "value").select("value")


def scored(fusions: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """The rows of truth (gene1, gene2, gene1bp, gene2bp) with called, that a fusion of the two genes was found in either order, and
    placed, that both breakpoints of one lie within the tolerance."""
    pair = lambda a, b: (F.least(a, b).alias("gene_a"), F.greatest(a, b).alias("gene_b"))
    found = fusions.select(*pair("up_gene", "lo_gene"), "up_gene", "up_bp", "lo_bp")
    first, second = (F.when(F.col("up_gene") == F.col("gene1"), F.col(x)).otherwise(F.col(y)) for x, y in (("up_bp", "lo_bp"), ("lo_bp", "up_bp")))
    close = (F.abs(first - F.col("gene1bp")) <= tolerance) & (F.abs(second - F.col("gene2bp")) <= tolerance)
    rows = truth.withColumns({"gene_a": F.least("gene1", "gene2"), "gene_b": F.greatest("gene1", "gene2")}).join(found, ["gene_a", "gene_b"], "left")
    return rows.groupBy("gene1", "gene2", "gene1bp", "gene2bp").agg((F.count("up_gene") > 0).alias("called"), F.coalesce(F.bool_or(close), F.lit(False)).alias("placed"))


def matched(calls: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """One-to-one matches of calls (id, up_gene, lo_gene, up_bp, lo_bp) and truth rows (id, gene1, gene2, gene1bp, gene2bp): call, truth, distance.

    Genes may stand in either order. A call and a truth row can match if both breakpoints lie within the tolerance; their distance is the sum
    of the two. The nearest two that are both free match first, of equally near ones those with the smaller ids, truth before call. Only rows of one pair of genes meet.
    """
    pair = lambda a, b: (F.least(a, b).alias("gene_a"), F.greatest(a, b).alias("gene_b"))
    known = truth.select(*pair("gene1", "gene2"), F.col("id").alias("truth"), "gene1", "gene1bp", "gene2bp")
    found = calls.select(*pair("up_gene", "lo_gene"), F.col("id").alias("call"), "up_gene", "up_bp", "lo_bp")
    straight = (F.abs(F.col("up_bp") - F.col("gene1bp")), F.abs(F.col("lo_bp") - F.col("gene2bp")))
    crossed = (F.abs(F.col("lo_bp") - F.col("gene1bp")), F.abs(F.col("up_bp") - F.col("gene2bp")))
    same = (F.col("gene_a") == F.col("gene_b")) | (F.col("up_gene") == F.col("gene1"))
    near = lambda x: F.when((x[0] <= tolerance) & (x[1] <= tolerance), x[0] + x[1])
    distance = F.least(F.when(same, near(straight)), F.when(~same | (F.col("gene_a") == F.col("gene_b")), near(crossed)))
    kind = "array<struct<distance:bigint,truth:bigint,call:bigint>>"
    near_ones = known.join(found, ["gene_a", "gene_b"]).withColumn("distance", distance).where("distance is not null")
    listed = near_ones.groupBy("gene_a", "gene_b").agg(F.array_sort(F.collect_list(F.struct("distance", "truth", "call"))).cast(kind).alias("x"))
    taken = lambda done, x: F.exists(done, lambda d: (d["truth"] == x["truth"]) | (d["call"] == x["call"]))
    chosen = F.aggregate("x", F.array().cast(kind), lambda done, x: F.when(taken(done, x), done).otherwise(F.concat(done, F.array(x))))
    return listed.select(F.explode(chosen).alias("m")).select("m.call", "m.truth", "m.distance")


def accuracy(calls: DataFrame, truth: DataFrame, tolerance: int) -> DataFrame:
    """One row: calls, truths, matches (of both breakpoints), pairs_found (truth rows whose pair of genes was called), precision and recall of
    the matches; precision is null without calls, recall without truth rows."""
    pairs = calls.select(F.least("up_gene", "lo_gene").alias("a"), F.greatest("up_gene", "lo_gene").alias("b")).distinct()
    met = truth.join(pairs, (F.least("gene1", "gene2") == F.col("a")) & (F.greatest("gene1", "gene2") == F.col("b")), "left_semi")
    kinds = [("calls", calls), ("truths", truth), ("matches", matched(calls, truth, tolerance)), ("pairs_found", met)]
    marked = kinds[0][1].select(F.lit(kinds[0][0]).alias("kind"))
    for name, rows in kinds[1:]:
        marked = marked.unionByName(rows.select(F.lit(name).alias("kind")))
    out = marked.agg(*(F.count_if(F.col("kind") == name).alias(name) for name, _ in kinds))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.withColumn("precision", part("matches", "calls")).withColumn("recall", part("matches", "truths"))
