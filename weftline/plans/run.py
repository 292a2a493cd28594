"""The two commands as functions: the graph's tables from an annotation and a genome, and fusions from alignments.

External aligners are not called: ``candidates`` takes the reads' alignments to the graph; ``detect`` also takes those of the consensus
sequences that ``consensus_fasta`` writes, to the graph and to the genome. Alignments and annotations are DataFrames of (line_no, value), see
``text.lines``; the genome comes in pieces, see ``sequence_files.fasta_pieces``. folder is one that all executors share: the steps' tables are
written there, so plans stay small and lost executors cost little.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators import chains, cluster, consensus, evidence, graph, reads, regions, report
from ..params import FusionParams
from ..sources import text
from ..sources.sequence_files import PIECE

DEFAULT = FusionParams()


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df, written as Parquet and read back."""
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def annotation_rows(lines: DataFrame) -> DataFrame:
    """Placed annotation rows; rows without gene_id are left out."""
    name = lambda k: F.try_element_at("attributes", F.lit(k))
    rows = text.gff(lines).withColumn("gene_id", name("gene_id")).where("gene_id is not null")
    return graph.placed(rows.select("line_no", "seqid", "type", "start", "end", "strand", F.coalesce(name("gene_name"), "gene_id").alias("gene_name"), F.coalesce(name("gene_type"), F.lit("gene")).alias("gene_type")))


class Counts:
    """Numbers of rows seen on the way, observed while the tables are written; ``table`` is a row a step, in the order of the steps."""

    def __init__(self):
        self.seen: dict[str, Observation] = {}
        self.known: dict[str, int] = {}

    def of(self, name: str, rows: DataFrame) -> DataFrame:
        self.seen[name] = Observation(name)
        return rows.observe(self.seen[name], F.count(F.lit(1)).alias("n"))

    def __getitem__(self, name: str) -> int:
        """Known after the first action on what ``of`` gave."""
        return self.known[name] if name in self.known else self.seen[name].get["n"]

    def written(self, like: DataFrame, folder: str) -> None:
        rows = [(i, name, self[name]) for i, name in enumerate([*self.seen, *self.known])]
        written(like.sparkSession.createDataFrame(rows, "nth int, step string, n long").coalesce(1), folder, "counts")


def exon_sequences(nodes: DataFrame, pieces: DataFrame, piece: int = PIECE) -> DataFrame:
    """(seqid, gene_uid, start, end, seq) of exon ranges; a range without a letter of the genome has no row."""
    want = nodes.select("seqid", "gene_uid", "start", "end").distinct()
    found = regions.cut(want.select(F.col("seqid").alias("seq_id"), F.col("start").alias("from"), F.col("end").alias("to")), pieces, piece)
    return want.join(found.withColumnsRenamed({"seq_id": "seqid", "from": "start", "to": "end"}), ["seqid", "start", "end"]).select("seqid", "gene_uid", "start", "end", "seq")


def build_graph(gff: DataFrame, pieces: DataFrame, folder: str, piece: int = PIECE) -> dict[str, DataFrame]:
    """nodes, edges, paths, genes (as ``text.gene_table`` gives them) and gfa, the S, L and P lines with is_pc."""
    rows = written(annotation_rows(gff), folder, "annotation")
    nodes, edges = graph.exon_nodes(rows), graph.exon_edges(rows)
    sequenced = exon_sequences(nodes, pieces, piece)
    bounds = lambda x: F.transform(F.filter(F.split(x, ";"), lambda v: v != ""), lambda v: v.cast("bigint")).alias(x)
    genes = graph.gene_positions(rows).select(F.col("gene_name").alias("gene"), "chrom", "strand", F.col("gene_type").alias("type"), "start", "end", bounds("f_exons"), bounds("b_exons"))
    kinds = graph.classes(rows)
    records = graph.gfa_records(nodes, edges, sequenced).unionByName(graph.path_records(nodes, kinds)).join(kinds.drop("class"), ["seqid", "gene_uid"], "left")
    tables = {"nodes": nodes, "edges": edges, "paths": graph.transcript_paths(nodes), "genes": genes, "gfa": records}
    return {name: written(table, folder, name) for name, table in tables.items()}


def second_alignment(sequences: DataFrame, pieces: DataFrame, genes: DataFrame, folder: str, params: FusionParams = DEFAULT, piece: int = PIECE) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """What ``candidates`` takes as hits: it aligns the reads of pairs to the flanked sequences of their genes, by ``chains.align``.

    sequences: seq_id, seq of the reads. The genes' sequences are written to the folder, as the table gene_sequences and as FASTA, total_reference.
    """

    def hits(asked: DataFrame, known: DataFrame) -> DataFrame:
        own = regions.gene_regions(genes.join(known, "gene", "left_semi"), params.gene_extension)
        made = written(regions.region_sequences(own, pieces, piece), folder, "gene_sequences")
        regions.fasta(made).write.mode("overwrite").text(f"{folder.rstrip('/')}/total_reference")
        sides = asked.select("id", "read_id", "read_length", F.explode(F.array("up_gene", "lo_gene")).alias("gene"))
        want = sides.join(made.select("gene", F.col("header").alias("ref_id")), "gene")
        wanted = sequences.select(F.col("seq_id").alias("read_id"), "seq").join(asked.select("read_id").distinct(), "read_id", "left_semi")
        found = chains.align(wanted, made.select(F.col("header").alias("ref_id"), "seq"), want.select("id", "read_id", "ref_id", "read_length"))
        return found.join(made.select("gene", F.col("header").alias("ref_id")), "ref_id").select("id", "gene", "q_st", "q_en", "blen", "ord")

    return hits


def candidates(gaf: DataFrame, genes: DataFrame, folder: str, hits: DataFrame | Callable[[DataFrame, DataFrame], DataFrame] | None = None, params: FusionParams = DEFAULT) -> DataFrame:
    """Pairs of genes that reads join, in clusters: read filter, routing, breakpoints, scores and groups.

    hits: a second alignment of reads to genes, see ``reads.realigned``, of which those to genes of pairs with enough reads count, or a function that
    makes it from the pairs' reads and those genes, see ``second_alignment``; without it no pair is taken out by it. Pairs with too few reads stay until the report,
    unless params.strict_support: then those left after the second alignment need enough.

    Written besides: rejected_lines, unknown_genes (gene, chrom, records in reads of two genes; pairs with
    them are lost, as nothing is known of their strand) and counts.
    """
    counts = Counts()
    good, bad = text.gaf(counts.of("lines", gaf))
    gene = F.get(E.item_genes(F.get("items", 0)), 0)
    rows = good.select("read_id", F.col("line_no").alias("ord"), gene.alias("gene"), F.get(F.split(F.get("items", 0), ":"), 0).alias("chrom"), F.substring("path", 1, 1).alias("sign"), "read_start", "read_end", "block_len", "mapq", "items", "read_len")
    several = counts.of("reads of several records", reads.grouped(counts.of("records", rows)))
    fine = several.withColumn("read_len", F.get("recs", 0)["read_len"]).where(~reads.overlapping(F.col("recs"), params.overlap_reject) & ~reads.alike(F.col("recs")))
    if params.skip_chr_m:
        fine = fine.where(~F.exists("recs", lambda r: F.get(r["items"], 0).startswith("chrM")))
    fine = written(counts.of("reads of two genes", fine), folder, "split_reads")
    pairs = reads.routed(fine, genes, params)
    raw = lambda s: F.expr(f"concat({s}.sign, array_join({s}.items, {s}.sign))")
    named = [F.col(f"{s}.{x}").alias(f"{s}_{x}") for s in ("up", "lo") for x in ("gene", "chrom", "sign", "items", "mapq", "read_start", "read_end")]
    found = pairs.select("read_id", F.col("up.ord").alias("ord"), F.coalesce("read_length", "lo.read_end").alias("read_length"), *named, raw("up").alias("up_raw"), raw("lo").alias("lo_raw"))
    found = written(counts.of("pairs", found), folder, "routed")
    if hits is not None:
        asked = found.select(F.col("ord").alias("id"), "read_id", "up_gene", "lo_gene", F.col("up_read_start").alias("up_start"), F.col("up_read_end").alias("up_end"), F.col("lo_read_start").alias("lo_start"), F.col("lo_read_end").alias("lo_end"), "read_length")
        enough = reads.supported(found, params.min_supporting_reads)
        known = written(enough.select(F.explode(F.array("gene_a", "gene_b")).alias("gene")).distinct(), folder, "known_genes")
        aligned = hits(asked, known) if callable(hits) else hits.join(known, "gene", "left_semi")
        found = found.join(reads.realigned(asked, aligned, params).select(F.col("id").alias("ord")), "ord", "left_semi")
    found = found.select("read_id", "ord", *(f"{s}_{x}" for s in ("up", "lo") for x in ("gene", "chrom", "sign")), E.breakpoint("up_raw", True).alias("up_bp"), E.breakpoint("lo_raw", False).alias("lo_bp"), F.array_join(E.normal_path("up_raw"), ",").alias("up_path"), F.array_join(E.normal_path("lo_raw"), ",").alias("lo_path"), E.pair_score(F.col("up_mapq"), F.col("lo_mapq"), F.size("up_items"), F.size("lo_items")).alias("score"), F.col("up_read_end").alias("upper_end"), F.col("lo_read_start").alias("lower_start"))
    found = written(counts.of("confirmed pairs", found.where("up_bp is not null and lo_bp is not null")), folder, "pairs")
    if params.strict_support:
        enough = reads.supported(found, params.min_supporting_reads)
        found = found.join(enough, (F.least("up_gene", "lo_gene") == enough["gene_a"]) & (F.greatest("up_gene", "lo_gene") == enough["gene_b"]), "left_semi")
    out = written(counts.of("clustered pairs", cluster.path_groups(cluster.leaders(found, params.bp_cluster_distance, f"{folder.rstrip('/')}/leaders"))), folder, "clustered")
    counts.known["rejected lines"] = counts["lines"] - counts["records"]
    # What was rejected is looked for only where there is any: it takes another pass over the lines.
    written(bad if counts.known["rejected lines"] else bad.limit(0), folder, "rejected_lines")
    seen = fine.select(F.explode("recs").alias("r")).groupBy("r.gene", "r.chrom").agg(F.count("*").alias("records"))
    unknown = seen.join(genes, ["gene", "chrom"], "left_anti")
    counts.known["records of unknown genes"] = written(unknown, folder, "unknown_genes").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    counts.written(gaf, folder)
    return out


def fusion_candidates(clustered: DataFrame) -> DataFrame:
    """One row a path group: its best member's chromosomes and strands, its breakpoint group's modes, all its reads, and its name."""
    group = [*cluster.PAIR, "bp_group"]
    stats = cluster.stats(clustered).select(*group, "path_group", F.col("best").alias("ord"), "reads")
    facts = clustered.select("ord", *(f"{s}_{x}" for s in ("up", "lo") for x in ("chrom", "sign"))).dropDuplicates(["ord"])
    name = F.concat_ws("_", "up_gene", "lo_gene", F.concat(F.lit("group"), "bp_group"), F.concat(F.lit("path"), "path_group"))
    modes = cluster.modes(clustered).withColumnsRenamed({"up_bp_mode": "up_bp", "lo_bp_mode": "lo_bp"})
    return stats.join(modes, group).join(facts, "ord").withColumn("name", name)


def consensus_fasta(clustered: DataFrame, sequences: DataFrame, folder: str, params: FusionParams = DEFAULT) -> DataFrame:
    """value: FASTA lines of each candidate's upper, lower and whole consensus, where both halves are long enough. sequences: seq_id, seq."""
    group = [*cluster.PAIR, "bp_group", "path_group"]
    named = clustered.join(fusion_candidates(clustered).select(*group, F.col("ord").alias("candidate"), "name"), group)
    own = named.join(sequences.withColumnRenamed("seq_id", "read_id"), "read_id")
    made = consensus.consensus(consensus.split_sequences(own).select("candidate", "ord", "upper", "lower"), f"{folder.rstrip('/')}/consensus")
    long = made.where((F.length("upper") >= params.min_consensus_length) & (F.length("lower") >= params.min_consensus_length)).join(named.select("candidate", "name").distinct(), "candidate")
    line = lambda kind, seq: F.concat(F.lit(">"), "name", F.lit(f"_0_{kind}\n"), seq)
    return long.select(F.explode(F.array(line("upper", F.col("upper")), line("lower", F.col("lower")), line("full", F.concat("upper", "lower")))).alias("value"))


def hit_names(rows: DataFrame, query: str, kinds: list[str], fusions: DataFrame) -> DataFrame:
    """Alignments of consensus sequences with id, the candidate's ord, and side; names have five parts or more and end with a kind."""
    last = F.regexp_extract(query, "_([a-z]+)$", 1)
    tagged = rows.withColumn("side", last).where(last.isin(*kinds)).withColumn("name", F.regexp_extract(query, r"^(.+_group\d+_path\d+)_", 1))
    return tagged.join(fusions.select("name", F.col("ord").alias("id")), "name").drop("name")


def detect(clustered: DataFrame, genes: DataFrame, library: DataFrame | None, second_gaf: DataFrame, second_sam: DataFrame, folder: str, params: FusionParams = DEFAULT) -> DataFrame:
    """The report's rows from clustered candidates and the alignments of their consensus sequences. Without a library no pair is known to be normal.
    Of second_gaf, what stands before the first line that can't be read counts."""
    if library is None:
        library = clustered.sparkSession.createDataFrame([], "left_gene string, right_gene string, tags array<string>")
    fusions = written(fusion_candidates(clustered), folder, "fusions")
    on_graph = hit_names(text.before_first(*text.gaf(second_gaf)), "read_id", ["upper", "lower"], fusions)
    on_genome = hit_names(text.sam(second_sam), "query", ["full"], fusions)
    leveled = evidence.leveled(fusions, on_graph, on_genome, genes, library, params)
    return report.report(report.collapsed(leveled), params.min_supporting_reads)
