"""Splicing graph tables from ordered annotation rows (gff: line_no, seqid, type, start, end, strand, attributes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def placed(rows: DataFrame) -> DataFrame:
    """Adds gene_uid (genes counted along a sequence) and path_num (transcripts counted within a gene).

    rows: line_no, seqid, type, start, end, strand, gene_name, gene_type. Partitioned by sequence.
    """
    along = Window.partitionBy("seqid").orderBy("line_no")
    out = rows.withColumn("gene_uid", F.sum((F.col("type") == "gene").cast("int")).over(along))
    within = Window.partitionBy("seqid", "gene_uid").orderBy("line_no")
    return out.withColumn("path_num", F.sum((F.col("type") == "transcript").cast("int")).over(within)).withColumn("prev_type", F.lag("type").over(within))


def exon_nodes(rows: DataFrame) -> DataFrame:
    """One node for each exon range of a gene, with the paths that hold it."""
    out = rows.where("type = 'exon'").groupBy("seqid", "gene_uid", "gene_name", "start", "end")
    return out.agg(F.sort_array(F.collect_list("path_num")).alias("paths")).withColumn("repeat", F.size("paths") > 1)


def exon_edges(rows: DataFrame) -> DataFrame:
    """Distinct edges between exons that follow one another in a transcript."""
    w = Window.partitionBy("seqid", "gene_uid", "path_num").orderBy("line_no")
    out = rows.where("type = 'exon'").select("seqid", "gene_uid", F.lag("start").over(w).alias("from_start"), F.lag("end").over(w).alias("from_end"), F.col("start").alias("to_start"), F.col("end").alias("to_end"))
    return out.where("from_start is not null").distinct()


def transcript_paths(nodes: DataFrame) -> DataFrame:
    """A path's exons by start."""
    out = nodes.select("seqid", "gene_uid", F.explode("paths").alias("path_num"), "start", "end").distinct()
    return out.groupBy("seqid", "gene_uid", "path_num").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x")).select("seqid", "gene_uid", "path_num", F.col("x.start").alias("starts"), F.col("x.end").alias("ends"))


def gene_positions(rows: DataFrame) -> DataFrame:
    """A row a gene name and sequence (the last gene of a name wins); boundaries are distinct and sorted as text."""
    genes = rows.where("type = 'gene'").groupBy("gene_name", "seqid").agg(F.max_by(F.struct("gene_uid", "strand", "gene_type", "start", "end"), "line_no").alias("g"))
    bounds = rows.where("type = 'exon'").groupBy("seqid", "gene_uid").agg(F.array_sort(F.collect_set(F.col("start").cast("string"))).alias("f"), F.array_sort(F.collect_set(F.col("end").cast("string"))).alias("b"))
    out = genes.select("gene_name", "seqid", "g.*").join(bounds, ["seqid", "gene_uid"], "left")
    text = lambda x: F.coalesce(F.array_join(x, ";"), F.lit(""))
    return out.select("gene_name", F.col("seqid").alias("chrom"), "strand", "gene_type", "start", "end", text("f").alias("f_exons"), text("b").alias("b_exons"))


def gfa_records(nodes: DataFrame, edges: DataFrame, sequences: DataFrame | None = None) -> DataFrame:
    """S and L lines of the graph; sequences (seqid, gene_uid, start, end, seq) fill the segments, else '*'."""
    name = lambda a, b: F.concat_ws("", "seqid", F.lit(":"), "gene_name", F.lit(":"), F.col(a), F.lit("-"), F.col(b))
    segments = nodes.join(sequences, ["seqid", "gene_uid", "start", "end"], "left") if sequences is not None else nodes.withColumn("seq", F.lit(None).cast("string"))
    s = segments.select("seqid", "gene_uid", F.lit("S").alias("kind"), F.concat_ws("\t", F.lit("S"), name("start", "end"), F.coalesce("seq", F.lit("*"))).alias("line"))
    named = edges.join(nodes.select("seqid", "gene_uid", "gene_name").distinct(), ["seqid", "gene_uid"])
    link = named.select("seqid", "gene_uid", F.lit("L").alias("kind"), F.concat_ws("\t", F.lit("L"), name("from_start", "from_end"), F.lit("+"), name("to_start", "to_end"), F.lit("+"), F.lit("0M")).alias("line"))
    return s.unionByName(link)


def gene_class(gene_type: Column) -> Column:
    return F.when(gene_type.contains("pseudogene"), "pseu").otherwise("gene")


def classes(rows: DataFrame) -> DataFrame:
    """(seqid, gene_uid, class, is_pc) of placed rows; is_pc parts the graph of protein-coding genes from the rest."""
    out = rows.where("type = 'gene'").groupBy("seqid", "gene_uid").agg(F.max_by("gene_type", "line_no").alias("t"))
    return out.select("seqid", "gene_uid", gene_class(F.col("t")).alias("class"), (F.col("t") == "protein_coding").alias("is_pc"))


def path_records(nodes: DataFrame, kinds: DataFrame) -> DataFrame:
    """P lines: a transcript's number within its gene and its segments by start, without orientation and CIGAR. kinds: see ``classes``."""
    own = ["seqid", "gene_uid", "gene_name", "path_num"]
    steps = nodes.select("seqid", "gene_uid", "gene_name", F.explode("paths").alias("path_num"), "start", "end").distinct()
    rows = steps.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("x")).join(kinds, ["seqid", "gene_uid"])
    # The name keeps the first two parts between underscores of the exons' ids, whatever the sequence is called.
    head = F.substring_index(F.concat("seqid", F.lit("_"), "class", F.lit("-"), "gene_name", F.lit("_exon")), "_", 2)
    names = F.array_join(F.transform("x", lambda e: F.concat("seqid", F.lit(":"), "gene_name", F.lit(":"), e["start"], F.lit("-"), e["end"])), ",")
    return rows.select("seqid", "gene_uid", F.lit("P").alias("kind"), F.concat_ws("\t", F.lit("P"), F.concat(head, F.lit("_"), "path_num"), names).alias("line"))
