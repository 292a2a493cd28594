"""Per-read steps from alignment records to candidate pairs. Records have read_id, ord, gene, chrom, sign, read_start, read_end,
block_len, mapq and items; one shuffle by read_id brings a read's records together, and everything after it is array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr as E
from ..functions import ordered
from ..params import FusionParams

DEFAULT = FusionParams()


def grouped(records: DataFrame) -> DataFrame:
    """(read_id, recs): records of reads with more than one, sorted by start, then order."""
    rest = [x for x in records.columns if x not in ("read_id", "read_start", "ord")]
    out = records.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("read_start", "ord", *rest))).alias("recs"))
    return out.where(F.size("recs") > 1)


def consecutive(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """run_id: counts the changes of key along the order, whose first column is a whole number."""
    return ordered.runs(rows, key, order)


def pairs_of(recs: Column, test) -> Column:
    """Whether test holds for some two records in order."""
    return F.exists(recs, lambda a: F.exists(recs, lambda b: (a["ord"] < b["ord"]) & test(a, b)))


def overlapping(recs: Column, least: int = DEFAULT.overlap_reject) -> Column:
    return pairs_of(recs, lambda a, b: F.least(a["read_end"], b["read_end"]) - F.greatest(a["read_start"], b["read_start"]) >= least)


def alike(recs: Column) -> Column:
    """All records share a gene, or every two main genes have similar names."""
    sets = F.transform(recs, lambda r: F.array_distinct(F.flatten(F.transform(r["items"], E.item_genes))))
    common = F.aggregate(F.slice(sets, 2, F.greatest(F.size(sets), F.lit(1))), F.get(sets, 0), F.array_intersect)
    return (F.size(common) > 0) | ~pairs_of(recs, lambda a, b: ~F.coalesce(E.similar_genes(a["gene"], b["gene"]), F.lit(False)))


def merged(recs: Column, floor: int = DEFAULT.merge_gap_floor) -> Column:
    """A left fold: a record joins the last one if gene, chrom and sign agree, the gap is at least ``floor`` and no segment is shared."""
    fields = ["read_start", "read_end", "gene", "chrom", "sign", "block_len", "mapq", "items", "ord"]
    kind = "array<struct<read_start:bigint,read_end:bigint,gene:string,chrom:string,sign:string,block_len:bigint,mapq:bigint,items:array<string>,ord:bigint>>"
    same = F.transform(recs, lambda r: F.struct(*(r[x].alias(x) for x in fields))).cast(kind)

    def step(done: Column, r: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        fits = (last["gene"] == r["gene"]) & (last["chrom"] == r["chrom"]) & (last["sign"] == r["sign"]) & (r["read_start"] - last["read_end"] >= floor) & ~F.arrays_overlap(last["items"], r["items"])
        joined = F.struct(last["read_start"].alias("read_start"), r["read_end"].alias("read_end"), last["gene"].alias("gene"), last["chrom"].alias("chrom"), last["sign"].alias("sign"), (last["block_len"] + r["block_len"]).alias("block_len"), F.greatest(last["mapq"], r["mapq"]).alias("mapq"), F.concat(last["items"], r["items"]).alias("items"), last["ord"].alias("ord"))
        return F.when(F.coalesce(fits, F.lit(False)), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(r)))

    return F.aggregate(same, F.array().cast(kind), step)


def routed(reads: DataFrame, genes: DataFrame, params: FusionParams = DEFAULT) -> DataFrame:
    """Pairs (read_id, up, lo) of merged records: of two, of the first two of a read with two genes, or A-B and else B-C of three genes.

    read_length is where a pair's part of the read ends: the cut of a shortened read, the lower record's end of three, else the column read_len of reads, if they have it.
    genes: gene, chrom, strand, type; it is small, and Spark broadcasts it where its size allows.
    """
    m = F.col("m")
    names = F.array_distinct(F.transform(m, lambda r: r["gene"]))
    cut = F.when((F.size(m) > 2) & (F.size(names) <= 2) & (F.get(m, 0)["gene"] != F.get(m, 1)["gene"]), F.slice(m, 1, 2)).otherwise(m)
    base = reads.withColumn("m", merged(F.col("recs"), params.merge_gap_floor)).where(~F.exists("m", lambda r: r["block_len"] <= params.min_block_len)).withColumn("cut_at", truncation(m)).withColumn("m", cut)
    whole = F.col("read_len") if "read_len" in reads.columns else F.lit(None)
    length = F.when(F.col("slot") > 0, F.col("lo.read_end")).otherwise(F.coalesce("cut_at", whole.cast("bigint")))
    slots = F.when(F.size(m) == 2, F.array(F.struct(F.lit(0).alias("slot"), F.get(m, 0).alias("up"), F.get(m, 1).alias("lo")))).when(
        (F.size(m) == 3) & (F.size(names) == 3), F.array(*(F.struct(F.lit(i).alias("slot"), F.get(m, i - 1).alias("up"), F.get(m, i).alias("lo")) for i in (1, 2)))
    )
    rows = base.select("read_id", "cut_at", *(["read_len"] if "read_len" in reads.columns else []), F.explode(slots).alias("p")).select("*", "p.*").withColumn("read_length", length).drop("p", "cut_at").where(F.col("up.gene") != F.col("lo.gene"))
    g = genes.select("gene", "chrom", "strand", "type")
    for side in ("up", "lo"):
        rows = rows.join(g.select(F.col("gene").alias(f"{side}_g"), F.col("chrom").alias(f"{side}_c"), F.col("strand").alias(f"{side}_strand"), F.col("type").alias(f"{side}_type")), (F.col(f"{side}.gene") == F.col(f"{side}_g")) & (F.col(f"{side}.chrom") == F.col(f"{side}_c")))
    gap = F.col("lo.read_start") - F.col("up.read_end")
    coding = (F.col("up_type") == "protein_coding") & (F.col("lo_type") == "protein_coding") if params.only_protein_coding else F.lit(True)
    valid = coding & E.same_direction(F.col("up_strand"), F.col("up.sign"), F.col("lo_strand"), F.col("lo.sign"))
    fits = F.when(F.col("slot") == 0, gap <= params.max_gap_length).otherwise((gap > -params.three_gene_gap) & (gap < params.three_gene_gap))
    good = rows.where(fits).withColumn("valid", valid)
    # With a good first gap the second pair counts only if the first is valid.
    first = Window.partitionBy("read_id").orderBy("slot")
    good = good.withColumn("before", F.lag("valid").over(first)).where("valid and (slot < 2 or before is null or before)")
    return good.select("read_id", "slot", "up", "lo", "read_length")


def truncation(m: Column) -> Column:
    """Where a read of more than two records but two genes is cut: midway between its second and third record; else null."""
    names = F.array_distinct(F.transform(m, lambda r: r["gene"]))
    cut = (F.size(m) > 2) & (F.size(names) <= 2) & (F.get(m, 0)["gene"] != F.get(m, 1)["gene"])
    return F.when(cut, F.floor((F.get(m, 1)["read_end"] + F.get(m, 2)["read_start"]) / 2).cast("bigint"))


def realigned(pairs: DataFrame, hits: DataFrame, params: FusionParams = DEFAULT) -> DataFrame:
    """The pairs that a second alignment of their reads confirms, with how many of the two genes it hit.

    pairs: id, read_id, up_gene, lo_gene, up_start, up_end, lo_start, lo_end, read_length, places on the read; hits: id, if each pair has its
    own, else read_id, gene, q_st, q_en, blen, ord. With hits of both genes, the gap from the last end in the upper to the first start in the lower must be small. With
    hits of one gene, the pair's own gap must be, and the longest hit must leave a clip about as long as the other gene's part. Hits of other genes don't matter.
    """
    upper, lower = F.col("gene") == F.col("up_gene"), F.col("gene") == F.col("lo_gene")
    best = F.max_by(F.struct("gene", "q_st", "q_en"), F.struct("blen", -F.col("ord")))
    own = ["id", "read_id", "up_gene", "lo_gene", "up_start", "up_end", "lo_start", "lo_end", "read_length"]
    key = "id" if "id" in hits.columns else "read_id"
    found = pairs.join(hits.select(key, "gene", "q_st", "q_en", "blen", "ord"), key).where(upper | lower).groupBy(*own).agg(F.max(F.when(upper, F.col("q_en"))).alias("e"), F.min(F.when(lower, F.col("q_st"))).alias("s"), best.alias("b"))
    both = F.col("e").isNotNull() & F.col("s").isNotNull()
    two = (F.col("s") - F.col("e")).between(params.min_gap, params.max_gap_two_alignments)
    on_upper = F.col("b.gene") == F.col("up_gene")
    clip = F.when(on_upper, F.col("read_length") - F.col("b.q_en")).otherwise(F.col("b.q_st"))
    missing = F.when(on_upper, F.col("lo_end") - F.col("lo_start")).otherwise(F.col("up_end") - F.col("up_start"))
    whole = F.abs(F.col("read_length") - (F.col("b.q_en") - F.col("b.q_st"))) <= params.min_soft_clip
    one = (F.col("lo_start") - F.col("up_end")).between(params.min_gap, params.max_gap_one_alignment) & ~whole & (clip >= params.min_soft_clip) & (F.abs(clip - missing) <= params.min_soft_clip)
    return found.where(F.when(both, two).otherwise(one)).select("id", "read_id", "up_gene", "lo_gene", F.when(both, 2).otherwise(1).alias("n_hit"))


def supported(pairs: DataFrame, least: int = DEFAULT.min_supporting_reads) -> DataFrame:
    """Unordered pairs of genes with at least ``least`` reads."""
    return pairs.groupBy(F.least("up_gene", "lo_gene").alias("gene_a"), F.greatest("up_gene", "lo_gene").alias("gene_b")).agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)
