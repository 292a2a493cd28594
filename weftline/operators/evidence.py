"""The facts behind a candidate's confidence level, from second alignments of its consensus sequences.

candidates: ord, up_gene, up_chrom, up_sign, up_bp, up_path, and the same for lo, reads. graph_hits: id (a candidate's ord), side ('upper' or 'lower'), line_no
and the columns of ``text.gaf``; genome_hits: id, line_no and the columns of ``text.sam``. genes: gene, chrom, strand, type, start, end and the boundary
lists f_exons and b_exons. Genes are joined by name; Spark broadcasts them where their size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..params import FusionParams
from . import report

DEFAULT = FusionParams()
SIDES = {"up": "upper", "lo": "lower"}


def first_graph_hits(graph_hits: DataFrame) -> DataFrame:
    """(id, up_hit, lo_hit): each side's first alignment, with its path's extent and corrected breakpoint."""
    named = F.get("items", 0)
    parts = {"path": F.col("path"), "items": F.col("items"), "hit_chrom": F.get(F.split(named, ":"), 0), "hit_gene": F.get(F.split(named, ":"), 1)}
    low, high = E.extent("path")
    at = F.when(F.col("side") == "upper", E.corrected_breakpoint("path", F.col("ref_len"), F.col("ref_start"), F.col("ref_end"), True)).otherwise(E.corrected_breakpoint("path", F.col("ref_len"), F.col("ref_start"), F.col("ref_end"), False))
    rows = graph_hits.select("id", "side", "line_no", F.struct(*(v.alias(k) for k, v in parts.items()), low.alias("low"), high.alias("high"), at.alias("bp")).alias("hit"))
    one = lambda side: F.min_by("hit", F.when(F.col("side") == side, F.col("line_no")))
    return rows.groupBy("id").agg(*(one(side).alias(f"{s}_hit") for s, side in SIDES.items()))


def gene_matches(name: Column, hit: Column, gene: Column, other: Column, chrom: Column) -> Column:
    """The hit's gene is the candidate's, or one name holds the other; else, on one chromosome, the two genes overlap and all of the path lies
    inside the overlap and in the hit's gene. gene and other are their ranges, null for genes that aren't in the table, which overlap nothing."""
    low, high = F.greatest(gene["start"], other["start"]), F.least(gene["end"], other["end"])
    inside = F.forall(hit["items"], lambda i: (F.get(F.split(i, ":"), 0) == chrom) & (F.get(F.split(i, ":"), 1) == hit["hit_gene"]) & (E.item_start(i) >= low) & (E.item_end(i) <= high))
    return (name == hit["hit_gene"]) | name.contains(hit["hit_gene"]) | hit["hit_gene"].contains(name) | F.coalesce(gene["start"].isNotNull() & other["start"].isNotNull() & (chrom == hit["hit_chrom"]) & (low < high) & inside, F.lit(False))


def boundaries(gene: Column, sign: Column, upper: bool) -> Column:
    """The ends of exons for an upper gene read forward or a lower one read backward, else their starts."""
    return F.when((sign == ">") == F.lit(upper), gene["b_exons"]).otherwise(gene["f_exons"])


def genome_hits_of(hits: DataFrame) -> DataFrame:
    """(id, genome): each consensus sequence's alignments in order; an aligner gives few."""
    rows = hits.select("id", F.struct("line_no", "chrom", "start", "end", "is_reverse", (~F.col("is_secondary") & (F.col("mapq") >= 1)).alias("usable")).alias("h"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list("h")).alias("genome"))


def near_side(side: str, window: int):
    """Whether a genome alignment matches the side's first graph alignment."""
    return lambda h: F.coalesce(h["usable"] & (h["chrom"] == F.col(f"{side}_chrom")) & (E.near(h["start"], F.col(f"{side}_hit.low"), window) | E.near(h["end"], F.col(f"{side}_hit.high"), window)), F.lit(False))


def leveled(candidates: DataFrame, graph_hits: DataFrame, genome_hits: DataFrame, genes: DataFrame, library: DataFrame, params: FusionParams = DEFAULT) -> DataFrame:
    """The candidates with their level (null or 1: rejected) and refined breakpoints. Genes that are not in the table start and end at 0 and match nothing."""
    rows = candidates
    ranges = F.struct("start", "end", "strand", "type", "f_exons", "b_exons")
    for s in SIDES:
        rows = rows.join(genes.select(F.col("gene").alias(f"{s}_gene"), F.col("chrom").alias(f"{s}_chrom"), ranges.alias(f"{s}_g")), [f"{s}_gene", f"{s}_chrom"], "left")
    rows = rows.join(genes_between(rows, genes), "ord", "left")
    rows = rows.join(first_graph_hits(graph_hits).withColumnRenamed("id", "ord"), "ord", "left").join(genome_hits_of(genome_hits).withColumnRenamed("id", "ord"), "ord", "left")
    for s in SIDES:
        seen = genes.select(F.col("gene").alias("n"), F.col("chrom").alias("c"), F.struct("start", "end").alias(f"{s}_seen"))
        rows = rows.join(seen, (F.col("n") == F.col(f"{s}_hit.hit_gene")) & (F.col("c") == F.col(f"{s}_hit.hit_chrom")), "left").drop("n", "c")
        last = F.try_element_at(F.filter("genome", near_side(s, params.near_window)), F.lit(-1))
        rows = rows.withColumn(f"{s}_genome", E.genome_breakpoint(last["start"], last["end"], last["is_reverse"], s == "up"))
    either = F.filter("genome", lambda h: near_side("up", params.near_window)(h) | near_side("lo", params.near_window)(h))
    rows = report.annotation_state(rows.withColumn("n_near", F.size(either)), library)
    c = F.col
    g = c("up_genome").isNotNull() & c("lo_genome").isNotNull() & (c("n_near") >= 2)
    m = F.lit(True)
    for s in SIDES:
        m = m & (c(f"{s}_chrom") == c(f"{s}_hit.hit_chrom")) & c(f"{s}_hit.path").startswith(c(f"{s}_sign")) & gene_matches(c(f"{s}_gene"), c(f"{s}_hit"), c(f"{s}_g"), c(f"{s}_seen"), c(f"{s}_chrom"))
        edges = boundaries(c(f"{s}_g"), c(f"{s}_sign"), s == "up")
        rows = rows.withColumn(f"{s}_snapped", E.nearest_boundary(c(f"{s}_hit.bp"), edges, params.exon_snap_graph))
        rows = rows.withColumn(f"{s}_on_genome", F.coalesce(E.nearest_boundary(c(f"{s}_genome"), edges, params.exon_snap_genome), c(f"{s}_genome")))
    rows = rows.withColumn("m", F.coalesce(m & c("up_snapped").isNotNull() & c("lo_snapped").isNotNull(), F.lit(False))).withColumn("g", F.coalesce(g, F.lit(False)))
    mapped, graphed = c("genome").isNotNull(), c("up_hit").isNotNull() & c("lo_hit").isNotNull()
    final = {s: F.when(~mapped, c(f"{s}_bp")).when(c("m"), c(f"{s}_snapped")).when(c("g"), c(f"{s}_on_genome")).otherwise(c(f"{s}_bp")) for s in SIDES}
    exact = F.lit(True)
    for s in SIDES:
        exact = exact & E.near(final[s], c(f"{s}_genome"), params.exon_boundary_distance)
    coding = F.coalesce((c("up_g.type") == "protein_coding") & (c("lo_g.type") == "protein_coding"), F.lit(False))
    normal = F.coalesce(c("state") == "NORMAL_FUSION", F.lit(False))
    value = report.level(c("m"), c("g"), F.lit(True), graphed, mapped, normal, exact, c("up_chrom") == c("lo_chrom"), F.abs(final["up"] - final["lo"]), F.coalesce(c("other_between"), F.lit(False)), c("other_between").isNotNull(), coding, params)
    place = [F.coalesce(c(f"{s}_g")[x], F.lit(0)).alias(f"{s}_{x}") for s in SIDES for x in ("start", "end")]
    return rows.select("ord", *(c(f"{s}_{x}") for s in SIDES for x in ("gene", "chrom", "sign")), final["up"].alias("up_bp"), final["lo"].alias("lo_bp"), *place, value.alias("level"), "reads")


def genes_between(rows: DataFrame, genes: DataFrame) -> DataFrame:
    """(ord, other_between) of candidates on one chromosome with genes between: whether one is named and unrelated to the pair's names."""
    on = rows.where("up_chrom = lo_chrom")
    strand = F.when(F.col("up_g.strand") == F.col("lo_g.strand"), F.col("up_g.strand"))
    c = on.select("ord", F.col("up_chrom").alias("chrom"), F.least("up_g.start", "lo_g.start").alias("low"), F.greatest("up_g.end", "lo_g.end").alias("high"), strand.alias("strand"), "up_gene", "lo_gene")
    named = ~F.col("between").contains("ENSG") & ~(F.col("between").contains(F.col("up_gene")) & F.col("between").contains(F.col("lo_gene")))
    return report.genes_between(c, genes).groupBy("ord").agg(F.bool_or(named).alias("other_between"))
