"""Ranges of sequences: gene regions with a flank, intervals that overlapping regions make, and the letters of ranges, cut from pieces.

Places are 1-based and closed. Pieces are (seq_id, at, part) as ``sequence_files.fasta_pieces`` gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..params import FusionParams
from ..sources.sequence_files import PIECE

#: Letters in a line of written FASTA.
LINE = 60


def gene_regions(genes: DataFrame, extension: int = FusionParams().gene_extension) -> DataFrame:
    """(seq_id, gene, from, to, header) of genes (gene, chrom, start, end) with a flank on either side that starts no earlier than the sequence.

    The header names the region as asked for, even where it goes beyond the sequence's end. Rows without a gene or chrom, or without places, are left out.
    """
    low, high = F.greatest(F.col("start") - extension, F.lit(1).cast("bigint")), F.col("end") + extension
    rows = genes.where("gene is not null and chrom is not null and start is not null and end is not null")
    out = rows.select(F.col("chrom").alias("seq_id"), "gene", low.alias("from"), high.alias("to")).distinct()
    return out.withColumn("header", F.concat_ws("", "seq_id", F.lit(":"), "gene", F.lit(":"), F.col("from").cast("string"), F.lit("-"), F.col("to").cast("string")))


def merged(regions: DataFrame) -> DataFrame:
    """(seq_id, from, to, n): the intervals that overlapping or adjacent regions (seq_id, from, to) of a sequence make together, and how many each holds."""
    along = Window.partitionBy("seq_id").orderBy("from", "to")
    reach = F.max("to").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parted = regions.select("seq_id", "from", "to").withColumn("new", F.coalesce((F.col("from") > reach + 1).cast("int"), F.lit(1)))
    numbered = parted.withColumn("k", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("seq_id", "k").agg(F.min("from").alias("from"), F.max("to").alias("to"), F.count("*").alias("n")).drop("k")


def bins(low: Column, high: Column, piece: int) -> Column:
    """The numbers of the pieces that a range touches."""
    return F.explode(F.sequence(F.floor((low - 1) / piece), F.floor((high - 1) / piece))).alias("bin")


def cut(ranges: DataFrame, pieces: DataFrame, piece: int = PIECE) -> DataFrame:
    """(seq_id, from, to, seq) and any other columns of distinct ranges with at least one letter; a range beyond its sequence's end has the letters that there are.

    Ranges that begin beyond their sequence's end go first, by a table of a row a sequence. Then an equi-join by piece number. A piece has one
    number, as none crosses a multiple of ``piece``, so a place is never found twice. Only pieces that ranges touch take part: they are looked up
    by numbers without text, which Spark broadcasts if they are few.
    """
    numbered = pieces.withColumn("bin", F.floor((F.col("at") - 1) / piece))
    ends = pieces.groupBy("seq_id").agg(F.max(F.col("at") + F.length("part") - 1).alias("end"))
    keys = ["seq_id", "from", "to", *(c for c in ranges.columns if c not in ("seq_id", "from", "to"))]
    asked = ranges.withColumn("from", F.col("from").cast("bigint")).withColumn("to", F.col("to").cast("bigint")).select(*keys).where("from <= to")
    asked = asked.join(ends, "seq_id").where(F.col("from") <= F.col("end")).distinct()
    binned = asked.select(*keys, bins(F.col("from"), F.least("to", "end"), piece))
    near = numbered.join(binned.select("seq_id", "bin").distinct(), ["seq_id", "bin"], "left_semi")
    joined = binned.join(near, ["seq_id", "bin"])
    low, high = F.greatest("from", "at"), F.least(F.col("to"), F.col("at") + F.length("part") - 1)
    letters = F.substring("part", (low - F.col("at") + 1).cast("int"), (high - low + 1).cast("int"))
    parts = joined.where(low <= high).select(*keys, F.struct("at", letters.alias("part")).alias("p"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "").alias("seq"))


def region_sequences(regions: DataFrame, pieces: DataFrame, piece: int = PIECE) -> DataFrame:
    """The rows of ``gene_regions`` with their letters as seq; regions of sequences that aren't there are left out."""
    return cut(regions, pieces, piece)


def fasta(rows: DataFrame, name: str = "header", seq: str = "seq", line: int = LINE) -> DataFrame:
    """value: a record each, its letters in lines of ``line``; written with ``write.text`` it is a FASTA file."""
    wrapped = F.rtrim(F.regexp_replace(seq, f"(.{{{line}}})", "$1\n"), F.lit("\n"))
    return rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), wrapped).alias("value"))
