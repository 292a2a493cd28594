"""Line-oriented sources as typed DataFrames. Lines that can't be read are kept apart, not fatal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import ordered

GAF_FIELDS = ["read_id string", "read_len bigint", "read_start bigint", "read_end bigint", "strand string", "path string", "ref_len bigint", "ref_start bigint", "ref_end bigint", "matches bigint", "block_len bigint", "mapq bigint"]
#: The names of a gene table's fields in its first line.
GENE_FIELDS = ["Gene_Name", "Strand", "Type", "Start", "End", "Fexons", "Bexons"]
SAM_FIELDS = ["query string", "flag bigint", "chrom string", "start bigint", "mapq bigint", "cigar string"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value): numbers grow in file order and have gaps between splits."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def gff(rows: DataFrame) -> DataFrame:
    """Gene, transcript and exon rows of (line_no, value), with their attributes as a map."""
    part = F.split("value", "\t")
    at = lambda i: F.get(F.col("f"), i)
    out = rows.where(~F.col("value").startswith("#")).select("line_no", part.alias("f")).where((F.size("f") >= 9) & at(2).isin("gene", "transcript", "exon"))
    out = out.select("line_no", at(0).alias("seqid"), at(2).alias("type"), at(3).try_cast("bigint").alias("start"), at(4).try_cast("bigint").alias("end"), at(6).alias("strand"), E.attribute_map(at(8)).alias("attributes"))
    return out.where("start is not null and end is not null")


def regions(rows: DataFrame) -> DataFrame:
    """(line_no, region_id): how many ##sequence-region lines stand at or before each line of one file."""
    return ordered.running_total(rows, "line_no", F.col("value").startswith("##sequence-region").cast("int"), "region_id")


def gaf(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, rejected lines): a record needs 12 fields, whole numbers, and a ':' in its path's first item."""
    # Exploded, as a filter on the fields would else be pushed below the split, which would be done again for each of its conditions.
    f = rows.select("*", F.explode(F.array(F.split("value", "\t"))).alias("f"))
    fields = [F.get("f", i).try_cast(x.split()[1]).alias(x.split()[0]) for i, x in enumerate(GAF_FIELDS)]
    tags = E.tag_map(F.col("f"))
    tag = lambda k, kind, default: F.coalesce(F.try_element_at("tags", F.lit(k)).try_cast(kind), F.lit(default).cast(kind)).alias(k)
    out = f.select("line_no", "value", *fields, tags.alias("tags")).select("*", tag("s1", "bigint", 0), tag("dv", "double", 1.0), tag("NM", "bigint", 0), tag("s2", "bigint", 0), tag("cg", "string", " "), tag("tp", "string", "0")).drop("tags")
    fine = F.lit(True)
    for x in GAF_FIELDS:
        fine = fine & F.col(x.split()[0]).isNotNull()
    fine = fine & F.element_at(E.path_items("path"), 1).contains(":")
    return out.where(fine).drop("value").withColumn("items", E.path_items("path")), out.where(~F.coalesce(fine, F.lit(False))).select("line_no", "value")


def before_first(good: DataFrame, bad: DataFrame) -> DataFrame:
    """The rows of good whose line_no is smaller than any of bad's: what a reader has that stops at the first line it can't read."""
    first = bad.agg(F.min("line_no")).first()[0]
    return good if first is None else good.where(F.col("line_no") < first)


def sam(rows: DataFrame) -> DataFrame:
    """Alignments of (line_no, value) with flags, CIGAR metrics and end."""
    f = rows.where(~F.col("value").startswith("@")).select("line_no", F.split("value", "\t").alias("f")).where(F.size("f") >= 11)
    out = f.select("line_no", *(F.get("f", i).try_cast(x.split()[1]).alias(x.split()[0]) for i, x in enumerate(SAM_FIELDS)), F.get("f", 9).alias("seq"), sam_tags(F.col("f")).alias("tags"))
    out = out.withColumns(E.flag_bits(F.col("flag"))).withColumns(E.cigar_metrics("cigar"))
    return out.withColumn("end", E.sam_end(F.col("start"), F.col("r_len")))


def sam_tags(fields):
    """Tags as text; values keep their colons."""
    found = F.filter(F.slice(fields, 12, F.greatest(F.size(fields), F.lit(1))), lambda x: x.rlike("^[^:]*:[^:]*:"))
    return F.map_from_entries(F.transform(found, lambda x: F.struct(F.regexp_extract(x, "^([^:]*):", 1).alias("key"), F.regexp_extract(x, "^[^:]*:[^:]*:(.*)$", 1).alias("value"))))


def gene_table(spark: SparkSession, path: str) -> DataFrame:
    """The written gene table: key gene_chrom is split at the first and the last underscore; boundaries keep their order."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path, schema="key string, strand string, type string, start bigint, end bigint, f_exons string, b_exons string")
    exons = lambda x: F.transform(F.filter(F.split(F.coalesce(x, F.lit("")), ";"), lambda v: v != ""), lambda v: v.cast("bigint"))
    return raw.select(F.regexp_extract("key", "^([^_]*)", 1).alias("gene"), F.regexp_extract("key", "([^_]*)$", 1).alias("chrom"), "strand", "type", "start", "end", exons("f_exons").alias("f_exons"), exons("b_exons").alias("b_exons"))


def gene_lines(genes: DataFrame) -> DataFrame:
    """value: the lines of a gene table that ``gene_table`` reads, in one part, the names of the fields first."""
    join = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ";")
    rows = genes.select(F.lit(1).alias("nth"), F.concat_ws("\t", F.concat_ws("_", "gene", "chrom"), "strand", "type", F.col("start").cast("string"), F.col("end").cast("string"), join("f_exons"), join("b_exons")).alias("value"))
    head = genes.sparkSession.createDataFrame([(0, "\t".join(GENE_FIELDS))], "nth int, value string")
    return head.unionByName(rows).coalesce(1).sortWithinPartitions("nth", "value").select("value")


def paf(rows: DataFrame) -> DataFrame:
    """(read_id, gene, q_st, q_en, blen, ord) of alignments, in PAF, of reads to sequences named chrom:gene:start-end; other lines are left out."""
    f = rows.select("line_no", F.split("value", "\t").alias("f")).where(F.size("f") >= 12)
    number = lambda i: F.get("f", F.lit(i)).try_cast("bigint")
    out = f.select(F.get("f", 0).alias("read_id"), F.get(F.split(F.get("f", 5), ":"), 1).alias("gene"), number(2).alias("q_st"), number(3).alias("q_en"), number(10).alias("blen"), F.col("line_no").alias("ord"))
    return out.where("gene is not null and q_st is not null and q_en is not null and blen is not null")


def annotation_library(rows: DataFrame) -> DataFrame:
    """(left_gene, right_gene, tags) of three-field lines with '--'; '.' means no tags, the last of a repeated pair wins."""
    f = rows.select("line_no", F.split(F.trim("value"), "\t").alias("f")).where((F.size("f") == 3) & F.get("f", 0).contains("--"))
    tags = F.when(F.get("f", 1) == ".", F.array().cast("array<string>")).otherwise(F.from_json(F.get("f", 1), "array<string>"))
    return f.select(F.get("f", 0).alias("pair"), tags.alias("tags"), "line_no").groupBy("pair").agg(F.max_by("tags", "line_no").alias("tags")).select(F.get(F.split("pair", "--"), 0).alias("left_gene"), F.get(F.split("pair", "--"), 1).alias("right_gene"), "tags")


def truth_set(spark: SparkSession, path: str) -> DataFrame:
    """(id, gene1, gene2, gene1bp, gene2bp) of a table with names in its first line; lines may end either way. Rows without both genes and places are left out."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path, schema="gene1 string, gene2 string, gene1bp bigint, gene2bp bigint")
    full = rows.where("gene1 is not null and gene2 is not null and gene1bp is not null and gene2bp is not null")
    return full.select(F.monotonically_increasing_id().alias("id"), "gene1", "gene2", "gene1bp", "gene2bp")


def reported(rows: DataFrame) -> DataFrame:
    """(id, up_gene, lo_gene, up_bp, lo_bp, support, level) of a report's lines (line_no, value); its first line and lines that can't be read are left out."""
    f = rows.where(~F.col("value").startswith("#")).select("line_no", F.split("value", "\t").alias("f")).where(F.size("f") == 8)
    point = lambda side: F.regexp_extract(F.get("f", 2), r"^[^;]*:(\d+); .*:(\d+)$", side).try_cast("bigint")
    out = f.select(F.col("line_no").alias("id"), F.get("f", 0).alias("up_gene"), F.get("f", 1).alias("lo_gene"), point(1).alias("up_bp"), point(2).alias("lo_bp"), F.get("f", 5).try_cast("bigint").alias("support"), F.regexp_extract(F.get("f", 6), r"^flag = (\d+)", 1).try_cast("int").alias("level"))
    return out.where("up_bp is not null and lo_bp is not null")
