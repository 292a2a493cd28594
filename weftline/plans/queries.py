"""Queries over the driver's tables, each with the SQL that DuckDB answers alike where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import expr as E
from ..operators import chains, cluster, consensus, evidence, graph, reads, regions, report
from ..sources import sequence_files, text
from ..streaming import reads as stream
from . import run, scratch
from .lens import oracle, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Pairs: every two consecutive records of a read, of different genes.
PAIRS = "SELECT a.read_id, a.ord, a.gene AS up_gene, b.gene AS lo_gene, a.chrom AS up_chrom, b.chrom AS lo_chrom, a.sign AS up_sign, b.sign AS lo_sign, a.bp AS up_bp, b.bp AS lo_bp, a.item AS up_path, b.item AS lo_path, a.mapq AS up_mapq, b.mapq AS lo_mapq, b.read_start - a.read_end AS gap, a.seg_start AS up_start, a.seg_end AS up_end, b.seg_start AS lo_start, b.seg_end AS lo_end FROM aln a JOIN aln b ON a.read_id = b.read_id AND b.rn = a.rn + 1 WHERE a.gene <> b.gene"
WEIGHT = "CASE WHEN {q} >= 30 THEN 10 + {q} * 0.15 WHEN {q} >= 10 THEN floor({q} / 10.0) * 3.5 ELSE {q} * 0.2 END"
SCORE = f"sqrt({WEIGHT.format(q='up_mapq')} + {WEIGHT.format(q='lo_mapq')}) * 0.5 * (1 + ln(1 + 2)) * CASE WHEN up_mapq >= 30 AND lo_mapq >= 30 THEN 1.5 WHEN up_mapq >= 10 AND lo_mapq >= 10 THEN 1.2 ELSE 0.8 END"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = oracle(sql)
        return f

    return keep


def records(aln: DataFrame) -> DataFrame:
    return aln.select("read_id", "ord", "gene", "chrom", "sign", "read_start", "read_end", "block_len", "mapq", F.array("item").alias("items"))


def pairs(aln: DataFrame) -> DataFrame:
    """Every two consecutive records of a read, of different genes: one shuffle by read, no self-join."""
    sides = {"gene": "gene", "chrom": "chrom", "sign": "sign", "bp": "bp", "item": "path", "mapq": "mapq", "seg_start": "start", "seg_end": "end"}
    following = F.lead(F.struct(*sides, "read_start")).over(Window.partitionBy("read_id").orderBy("rn"))
    out = aln.withColumn("after", following).where(F.col("gene") != F.col("after.gene"))
    return out.select("read_id", "ord", *(F.col(c).alias(f"up_{name}") for c, name in sides.items()), *(F.col(f"after.{c}").alias(f"lo_{name}") for c, name in sides.items()), (F.col("after.read_start") - F.col("read_end")).alias("gap"))


def candidates(aln: DataFrame) -> DataFrame:
    return pairs(aln).withColumn("score", E.pair_score(F.col("up_mapq"), F.col("lo_mapq"), F.lit(1), F.lit(1)))


def led(aln: DataFrame) -> DataFrame:
    """Candidates with their leaders, from a written table, as the commands have it."""
    folder = scratch.folder(aln.sparkSession)
    return cluster.leaders(cluster.written(candidates(aln), folder, "candidates"), 300, folder)


def clustered(aln: DataFrame) -> DataFrame:
    return cluster.path_groups(led(aln))


# Sources


@query("SELECT ord, read_id, read_start, read_end, mapq, block_len, item, sign, mapq + 1 AS s1, 'P' AS tp FROM aln")
def scan_gaf_parse(spark, d):
    good, _ = text.gaf(gaf_lines(tables(spark, d)[0]))
    return good.select(F.col("line_no").alias("ord"), F.col("read_id").cast("bigint").alias("read_id"), "read_start", "read_end", "mapq", "block_len", F.get("items", 0).alias("item"), F.substring("path", 1, 1).alias("sign"), "s1", "tp")


def gaf_lines(aln: DataFrame) -> DataFrame:
    """(line_no, value): the alignments as GAF lines, numbered by ord."""
    line = F.concat_ws("\t", F.col("read_id"), F.lit(1000), "read_start", "read_end", F.lit("+"), F.concat("sign", "item"), F.lit(401), F.lit(0), F.lit(401), "block_len", "block_len", "mapq", F.concat(F.lit("s1:i:"), F.col("mapq") + 1), F.lit("tp:A:P"))
    return aln.select(F.col("ord").alias("line_no"), line.alias("value"))


@query("SELECT ord, read_id FROM aln WHERE ord < (SELECT min(ord) FROM aln WHERE ord > (SELECT max(ord) FROM aln) / 2 AND ord % 7 = 3)")
def gaf_until_error(spark, d):
    aln, _ = tables(spark, d)
    most = aln.agg(F.max("ord")).first()[0]
    bad = (F.col("line_no") > most / 2) & (F.col("line_no") % 7 == 3)
    rows = gaf_lines(aln).withColumn("value", F.when(bad, F.regexp_replace("value", "\t", " ")).otherwise(F.col("value")))
    return text.before_first(*text.gaf(rows)).select(F.col("line_no").alias("ord"), F.col("read_id").cast("bigint").alias("read_id"))


@query("SELECT ord, bp AS start_pos, bp + 60 + qty + exon - 1 AS end_pos, exon % 2 = 1 AS is_reverse, exon >= 2 AS is_secondary, mapq, 'a:b' AS tag FROM aln")
def scan_sam_parse(spark, d):
    aln, _ = tables(spark, d)
    flag = F.when(F.col("exon") % 2 == 1, 16).otherwise(0) + F.when(F.col("exon") >= 2, 256).otherwise(0)
    cigar = F.concat(F.lit("7S"), F.col("block_len"), F.lit("M"), F.col("exon"), F.lit("D5S"))
    line = F.concat_ws("\t", F.col("read_id"), flag, "chrom", "bp", "mapq", cigar, F.lit("*"), F.lit(0), F.lit(0), F.lit("*"), F.lit("*"), F.lit("XX:Z:a:b"))
    out = text.sam(aln.select(F.col("ord").alias("line_no"), line.alias("value")))
    return out.select(F.col("line_no").alias("ord"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "is_reverse", "is_secondary", "mapq", F.try_element_at("tags", F.lit("XX")).alias("tag"))


@query("SELECT gid, chrom, start_pos, end_pos, strand, gene, type AS gene_type FROM genes")
def scan_gff_parse(spark, d):
    _, genes = tables(spark, d)
    line = F.concat_ws("\t", "chrom", F.lit("T"), F.lit("gene"), "start_pos", "end_pos", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=g;gene_name="), "gene", F.lit(";gene_type="), "type"))
    out = text.gff(genes.select(F.col("gid").alias("line_no"), line.alias("value")))
    return out.select(F.col("line_no").alias("gid"), F.col("seqid").alias("chrom"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "strand", F.try_element_at("attributes", F.lit("gene_name")).alias("gene"), F.try_element_at("attributes", F.lit("gene_type")).alias("gene_type"))


@query("SELECT event_id, event_type AS kind, cast(user_id AS varchar) AS user_text, 2 AS n FROM events")
def attr_map_parse(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    m = E.attribute_map(F.concat(F.lit("kind=x;junk; kind = "), "event_type", F.lit(";user="), F.col("user_id")))
    return ev.select("event_id", F.try_element_at(m, F.lit("kind")).alias("kind"), F.try_element_at(m, F.lit("user")).alias("user_text"), F.size(m).alias("n"))


@query("SELECT ord, cast(qty AS varchar) AS nm, 'A' AS cut FROM aln")
def tag_map_parse(spark, d):
    aln, _ = tables(spark, d)
    m = E.tag_map(F.array(F.concat(F.lit("NM:i:"), F.col("qty")), F.lit("cs:Z:A:B"), F.lit("bad")), 1)
    return aln.select("ord", F.try_element_at(m, F.lit("NM")).alias("nm"), F.try_element_at(m, F.lit("cs")).alias("cut"))


@query("SELECT ord, (qty % 20 + 1) + (50 + qty) + 20 + (mapq % 10 + 1) AS q_len, 50 + qty + exon + 1 + 20 AS r_len, qty % 20 + 1 AS q_start, (qty % 20 + 1) + (50 + qty) + 20 AS q_end, qty % 20 + 1 AS soft_start, mapq % 10 + 1 AS soft_end, 70 + qty AS core, 5 AS hard_start, 0 AS hard_end FROM aln")
def cigar_metrics(spark, d):
    aln, _ = tables(spark, d)
    cigar = F.concat(F.lit("5H"), F.col("qty") % 20 + 1, F.lit("S"), F.col("qty") + 50, F.lit("M"), F.col("exon") + 1, F.lit("D20M"), F.col("mapq") % 10 + 1, F.lit("S"))
    return aln.select("ord", cigar.alias("cigar")).select("ord", *(v.cast("int" if k.startswith("hard") else "bigint").alias(k) for k, v in E.cigar_metrics("cigar").items()))


@query("SELECT ord, (ord % 4096 & 4) = 0 AS is_mapped, (ord % 4096 & 256) <> 0 AS is_secondary, (ord % 4096 & 2048) <> 0 AS is_supplementary, (ord % 4096 & 16) <> 0 AS is_reverse, (ord % 4096 & 2304) = 0 AS is_primary FROM aln")
def sam_flag_bits(spark, d):
    aln, _ = tables(spark, d)
    return aln.select("ord", *(v.alias(k) for k, v in E.flag_bits((F.col("ord") % 4096)).items()))


# Paths and breakpoints

TWO = "FROM (SELECT read_id, ord, sign, item, lead(item) OVER (PARTITION BY read_id ORDER BY rn) AS item_2, seg_start, seg_end, lead(seg_start) OVER (PARTITION BY read_id ORDER BY rn) AS start_2, lead(seg_end) OVER (PARTITION BY read_id ORDER BY rn) AS end_2, qty, chrom, gene FROM aln) t WHERE item_2 IS NOT NULL"


def two_items(aln: DataFrame) -> DataFrame:
    aln.createOrReplaceTempView("weftline_aln")
    return aln.sparkSession.sql(f"SELECT * {TWO.replace('FROM aln', 'FROM weftline_aln')}").withColumn("path", F.concat("sign", "item", "sign", "item_2"))


@query(f"SELECT ord, item AS first_item, item_2 AS last_item, 2 AS n {TWO}")
def path_tokenize(spark, d):
    p = E.path_items("path")
    return two_items(tables(spark, d)[0]).select("ord", F.get(p, 0).alias("first_item"), F.element_at(p, -1).alias("last_item"), F.size(p).alias("n"))


@query("SELECT ord, gene, concat(gene, ',X') AS both_genes, 0 AS none FROM aln")
def path_genes(spark, d):
    aln, _ = tables(spark, d)
    return aln.select("ord", F.array_join(E.item_genes(F.col("item")), ",").alias("gene"), F.array_join(E.item_genes(F.concat(F.lit("c:"), "gene", F.lit("--X:1-2"))), ",").alias("both_genes"), F.size(E.item_genes(F.lit("chr1:10-20"))).alias("none"))


POS = "concat(split_part({0}, ':', 1), ':', split_part({0}, ':', 3))"


@query(f"SELECT ord, CASE WHEN sign = '<' THEN concat({POS.format('item_2')}, ',', {POS.format('item')}) ELSE concat({POS.format('item')}, ',', {POS.format('item_2')}) END AS path {TWO}")
def path_normalize(spark, d):
    return two_items(tables(spark, d)[0]).select("ord", F.array_join(E.normal_path("path"), ",").alias("path"))


@query(f"SELECT ord, CASE WHEN sign = '>' THEN end_2 ELSE start_2 END AS upper_bp, CASE WHEN sign = '>' THEN seg_start ELSE seg_end END AS lower_bp {TWO}")
def bp_plain(spark, d):
    return two_items(tables(spark, d)[0]).select("ord", E.breakpoint("path", True).alias("upper_bp"), E.breakpoint("path", False).alias("lower_bp"))


@query(f"SELECT ord, CASE WHEN qty + 1 <= 20 THEN CASE WHEN sign = '>' THEN end_2 ELSE start_2 END WHEN sign = '>' THEN end_2 - qty - 1 ELSE start_2 + qty + 1 END AS upper_bp, CASE WHEN qty <= 20 THEN CASE WHEN sign = '>' THEN seg_start ELSE seg_end END WHEN sign = '>' THEN seg_start + qty ELSE seg_end - qty END AS lower_bp {TWO}")
def bp_corrected(spark, d):
    at = lambda upper: E.corrected_breakpoint("path", F.lit(802).cast("bigint"), F.col("qty"), 802 - F.col("qty"), upper)
    return two_items(tables(spark, d)[0]).select("ord", at(True).alias("upper_bp"), at(False).alias("lower_bp"))


@query("SELECT ord, CASE WHEN exon % 2 = 1 THEN bp ELSE bp + block_len END AS upper_bp, CASE WHEN exon % 2 = 1 THEN bp + block_len ELSE bp END AS lower_bp FROM aln")
def bp_genome(spark, d):
    aln, _ = tables(spark, d)
    at = lambda upper: E.genome_breakpoint(F.col("bp"), F.col("bp") + F.col("block_len"), F.col("exon") % 2 == 1, upper)
    return aln.select("ord", at(True).alias("upper_bp"), at(False).alias("lower_bp"))


@query(f"SELECT ord, CASE WHEN sign = '>' THEN seg_start ELSE start_2 END AS low, CASE WHEN sign = '>' THEN end_2 ELSE seg_end END AS high {TWO}")
def node_extent(spark, d):
    low, high = E.extent("path")
    return two_items(tables(spark, d)[0]).select("ord", low.alias("low"), high.alias("high"))


@query(f"SELECT ord, round({WEIGHT.format(q='mapq')}, 6) AS weight FROM aln")
def mapq_weight(spark, d):
    return tables(spark, d)[0].select("ord", F.round(E.quality_weight(F.col("mapq")), 6).alias("weight"))


@query(f"SELECT read_id, round({SCORE}, 6) AS score FROM ({PAIRS}) p")
def pair_score(spark, d):
    return candidates(tables(spark, d)[0]).select("read_id", F.round("score", 6).alias("score"))


# Reads


@query("SELECT read_id, count(*) AS n, min(read_start) AS first_start, max(read_end) AS last_end FROM aln GROUP BY read_id HAVING count(*) > 1")
def multi_aln_reads(spark, d):
    g = reads.grouped(records(tables(spark, d)[0]))
    return g.select("read_id", F.size("recs").cast("bigint").alias("n"), F.get("recs", 0)["read_start"].alias("first_start"), F.array_max(F.transform("recs", lambda r: r["read_end"])).alias("last_end"))


@query("SELECT read_id, count(*) AS n, min(read_start) AS first_start, max(read_end) AS last_end FROM aln GROUP BY read_id HAVING count(*) > 1")
def multi_aln_reads_stream(spark, d):
    place = scratch.folder(spark)
    gaf_lines(tables(spark, d)[0]).select("value").repartition(4).write.text(f"{place}/gaf")
    stream.follow(spark, f"{place}/gaf", f"{place}/groups", f"{place}/checkpoint", files_a_batch=2).awaitTermination()
    recs = stream.latest(spark, f"{place}/groups")
    return recs.select(F.col("read_id").cast("bigint").alias("read_id"), "n", F.get("recs", 0)["read_start"].alias("first_start"), F.array_max(F.transform("recs", lambda r: r["read_end"])).alias("last_end"))


@query("SELECT run_id, min(event_id) AS first_event, count(*) AS n, min(event_type) AS event_type FROM (SELECT *, cast(sum(c) OVER (ORDER BY event_id) AS bigint) AS run_id FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS c FROM events) x) y GROUP BY run_id")
def consecutive_runs(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type")
    return reads.consecutive(ev, "event_type", ["event_id"]).groupBy("run_id").agg(F.min("event_id").alias("first_event"), F.count(F.lit(1)).alias("n"), F.min("event_type").alias("event_type"))


def read_ids(test):
    return lambda spark, d: reads.grouped(records(tables(spark, d)[0])).where(test(F.col("recs"))).select("read_id")


def read_query(name: str, test, sql: str) -> None:
    QUERIES[name] = read_ids(test)
    ORACLES[name] = oracle(f"SELECT read_id FROM (SELECT read_id, count(*) AS n FROM aln GROUP BY read_id) r WHERE n > 1 AND {sql}")


OTHER = "EXISTS (SELECT 1 FROM aln a JOIN aln b ON a.read_id = b.read_id AND a.ord < b.ord WHERE a.read_id = r.read_id AND {0})"
read_query("chrom_skip", lambda x: ~F.exists(x, lambda r: F.get(r["items"], 0).startswith("chr3")), "NOT EXISTS (SELECT 1 FROM aln a WHERE a.read_id = r.read_id AND a.chrom = 'chr3')")
read_query("inread_overlap_drop", lambda x: ~reads.overlapping(x, 1), "NOT " + OTHER.format("least(a.read_end, b.read_end) - greatest(a.read_start, b.read_start) >= 1"))
read_query("similar_gene_drop", lambda x: ~reads.alike(x), OTHER.format("a.gene <> b.gene"))
read_query("short_block_drop", lambda x: ~F.exists(x, lambda r: r["block_len"] <= 65), "NOT EXISTS (SELECT 1 FROM aln a WHERE a.read_id = r.read_id AND a.block_len <= 65)")
read_query("gap_filter", lambda x: F.element_at(x, -1)["read_start"] - F.get(x, 0)["read_end"] <= 200, "(SELECT max(read_start) - min(read_end) FROM aln a WHERE a.read_id = r.read_id) <= 200")


@query("SELECT read_id, count(*) AS n, cast(sum(block_len) AS bigint) AS total FROM aln GROUP BY read_id HAVING count(*) > 1")
def merge_keeps_length(spark, d):
    m = reads.grouped(records(tables(spark, d)[0])).select("read_id", F.size("recs").cast("bigint").alias("n"), reads.merged(F.col("recs"), -5).alias("m"))
    return m.select("read_id", "n", F.aggregate("m", F.lit(0).cast("bigint"), lambda s, r: s + r["block_len"]).alias("total"))


STRUCT = "{'read_start': read_start, 'read_end': read_end, 'gene': gene, 'chrom': chrom, 'sign': sign, 'block_len': block_len, 'items': [item], 'ord': ord}"
JOINED = "{'read_start': a[-1].read_start, 'read_end': x[1].read_end, 'gene': a[-1].gene, 'chrom': a[-1].chrom, 'sign': a[-1].sign, 'block_len': a[-1].block_len + x[1].block_len, 'items': list_concat(a[-1].items, x[1].items), 'ord': a[-1].ord}"
#: All records of each read with several, merged by a left fold.
MERGED = f"SELECT read_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN a[-1].gene = x[1].gene AND a[-1].chrom = x[1].chrom AND a[-1].sign = x[1].sign AND x[1].read_start - a[-1].read_end >= {{floor}} AND NOT list_has_any(a[-1].items, x[1].items) THEN list_concat(a[1:len(a) - 1], [{JOINED}]) ELSE list_concat(a, x) END) AS m FROM (SELECT read_id, list({STRUCT} ORDER BY read_start, ord) AS xs FROM aln GROUP BY read_id HAVING count(*) > 1) q".replace("{floor}", "{0}")


@query(f"SELECT read_id, cast(len(m) AS bigint) AS n_merged FROM ({MERGED.replace('{0}', '-60')}) x")
def merge_fragments(spark, d):
    g = reads.grouped(records(tables(spark, d)[0]))
    return g.select("read_id", F.size(reads.merged(F.col("recs"), -60)).cast("bigint").alias("n_merged"))


VALID = "g.type = 'protein_coding' AND h.type = 'protein_coding' AND ((g.strand = '+') = (up_sign = '>')) = ((h.strand = '+') = (lo_sign = '>'))"


@query(f"SELECT read_id, up_gene, lo_gene, {VALID} AS valid FROM ({PAIRS}) p JOIN genes g ON g.gene = up_gene AND g.chrom = up_chrom JOIN genes h ON h.gene = lo_gene AND h.chrom = lo_chrom")
def pair_validity(spark, d):
    aln, genes = tables(spark, d)
    p = pairs(aln)
    for side in ("up", "lo"):
        p = p.join(genes.select(F.col("gene").alias(f"{side}_gene"), F.col("chrom").alias(f"{side}_chrom"), F.col("strand").alias(f"{side}_strand"), F.col("type").alias(f"{side}_type")), [f"{side}_gene", f"{side}_chrom"])
    coding = (F.col("up_type") == "protein_coding") & (F.col("lo_type") == "protein_coding")
    return p.select("read_id", "up_gene", "lo_gene", (coding & E.same_direction(F.col("up_strand"), F.col("up_sign"), F.col("lo_strand"), F.col("lo_sign"))).alias("valid"))


GENES_OF = "list_distinct(list_transform(m, lambda r: r.gene))"
CUT = f"SELECT read_id, CASE WHEN len(m) > 2 AND len({GENES_OF}) <= 2 AND m[1].gene <> m[2].gene THEN m[1:2] ELSE m END AS m FROM ({MERGED.replace('{0}', '-5')}) x WHERE len(list_filter(m, lambda r: r.block_len <= 30)) = 0"
SLOTS = f"SELECT read_id, 0 AS slot, m[1] AS u, m[2] AS l FROM ({CUT}) c WHERE len(m) = 2 UNION ALL SELECT read_id, unnest([1, 2]), unnest([m[1], m[2]]), unnest([m[2], m[3]]) FROM ({CUT}) c WHERE len(m) = 3 AND len({GENES_OF}) = 3"
FIT = f"SELECT *, u.gene AS up_gene, l.gene AS lo_gene, u.sign AS up_sign, l.sign AS lo_sign FROM ({SLOTS}) s WHERE u.gene <> l.gene AND CASE WHEN slot = 0 THEN l.read_start - u.read_end <= 200 ELSE l.read_start - u.read_end > -15 AND l.read_start - u.read_end < 15 END"
CHECKED = f"SELECT read_id, slot, up_gene, lo_gene, {VALID} AS valid FROM ({FIT}) f JOIN genes g ON g.gene = up_gene AND g.chrom = u.chrom JOIN genes h ON h.gene = lo_gene AND h.chrom = l.chrom"
ROUTED = f"SELECT * FROM ({CHECKED}) c WHERE valid AND (slot < 2 OR NOT EXISTS (SELECT 1 FROM ({CHECKED}) e WHERE e.read_id = c.read_id AND e.slot = 1 AND NOT e.valid))"


def routed(spark, d) -> DataFrame:
    aln, genes = tables(spark, d)
    return reads.routed(reads.grouped(records(aln)), genes).select("read_id", F.col("slot").cast("bigint").alias("slot"), F.col("up.gene").alias("up_gene"), F.col("lo.gene").alias("lo_gene"))


@query(f"SELECT read_id, cast(slot AS bigint) AS slot, up_gene, lo_gene FROM ({ROUTED}) r")
def pair_route(spark, d):
    return routed(spark, d)


@query(f"SELECT read_id, cast(slot AS bigint) AS slot, up_gene, lo_gene FROM ({ROUTED}) r WHERE slot > 0")
def three_gene_split(spark, d):
    return routed(spark, d).where("slot > 0")


@query(f"SELECT read_id, cast(floor((m[2].read_end + m[3].read_start) / 2) AS bigint) AS cut_at FROM ({MERGED.replace('{0}', '-5')}) x WHERE len(m) > 2 AND len({GENES_OF}) <= 2 AND m[1].gene <> m[2].gene")
def two_gene_truncate(spark, d):
    m = reads.grouped(records(tables(spark, d)[0])).select("read_id", reads.merged(F.col("recs")).alias("m"))
    return m.select("read_id", reads.truncation(F.col("m")).alias("cut_at")).where("cut_at is not null")


@query(f"SELECT least(up_gene, lo_gene) AS gene_a, greatest(up_gene, lo_gene) AS gene_b, count(*) AS support FROM ({PAIRS}) p GROUP BY 1, 2 HAVING count(*) >= 2")
def pair_support(spark, d):
    return reads.supported(pairs(tables(spark, d)[0]))


@query(f"SELECT DISTINCT g AS gene, c AS chrom FROM (SELECT up_gene AS g, up_chrom AS c FROM ({PAIRS}) p UNION ALL SELECT lo_gene, lo_chrom FROM ({PAIRS}) q) x")
def gene_set_supported(spark, d):
    p = pairs(tables(spark, d)[0])
    good = reads.supported(p)
    q = p.join(good.select("gene_a", "gene_b"), (F.least("up_gene", "lo_gene") == F.col("gene_a")) & (F.greatest("up_gene", "lo_gene") == F.col("gene_b")), "left_semi")
    return q.select(F.col("up_gene").alias("gene"), F.col("up_chrom").alias("chrom")).unionByName(q.select(F.col("lo_gene").alias("gene"), F.col("lo_chrom").alias("chrom"))).distinct()


#: Neighbouring records of a read as pairs, and hits of a second alignment for two thirds of the records.
NEIGHBOURS = "SELECT a.ord AS id, a.read_id, a.gene AS up_gene, b.gene AS lo_gene, a.read_start AS up_start, a.read_end AS up_end, b.read_start AS lo_start, b.read_end AS lo_end, b.read_end + a.qty % 9 AS read_length FROM aln a JOIN aln b ON b.read_id = a.read_id AND b.rn = a.rn + 1 WHERE a.gene <> b.gene"
HITS = "SELECT read_id, gene, read_start + qty % 5 AS q_st, read_end - qty % 4 AS q_en, block_len AS blen, ord FROM aln WHERE qty % 3 <> 0"
HIT = f"SELECT p.*, h.* EXCLUDE (read_id) FROM ({NEIGHBOURS}) p JOIN ({HITS}) h ON h.read_id = p.read_id AND h.gene IN (up_gene, lo_gene)"
TOLD = f"SELECT id, read_id, any_value(up_gene) AS up_gene, any_value(lo_gene) AS lo_gene, max(q_en) FILTER (gene = up_gene) AS e, min(q_st) FILTER (gene = lo_gene) AS s, any_value(lo_start - up_end) AS gap, arg_max(abs(read_length - (q_en - q_st)), {{'b': blen, 'o': -ord}}) AS left_over, arg_max(CASE WHEN gene = up_gene THEN read_length - q_en ELSE q_st END, {{'b': blen, 'o': -ord}}) AS clip, arg_max(CASE WHEN gene = up_gene THEN lo_end - lo_start ELSE up_end - up_start END, {{'b': blen, 'o': -ord}}) AS missing FROM ({HIT}) x GROUP BY id, read_id"


def second_alignment(spark, d) -> DataFrame:
    aln, _ = tables(spark, d)
    rest = [F.col(c).alias(f"lo_{n}") for c, n in (("gene", "gene"), ("read_start", "start"), ("read_end", "end"))]
    lower = aln.select("read_id", (F.col("rn") - 1).alias("rn"), *rest)
    p = aln.join(lower, ["read_id", "rn"]).where("gene <> lo_gene").select(F.col("ord").alias("id"), "read_id", F.col("gene").alias("up_gene"), "lo_gene", F.col("read_start").alias("up_start"), F.col("read_end").alias("up_end"), "lo_start", "lo_end", (F.col("lo_end") + F.col("qty") % 9).alias("read_length"))
    hits = aln.where("qty % 3 <> 0").select("read_id", "gene", (F.col("read_start") + F.col("qty") % 5).alias("q_st"), (F.col("read_end") - F.col("qty") % 4).alias("q_en"), F.col("block_len").alias("blen"), "ord")
    return reads.realigned(p, hits)


@query(f"SELECT id, read_id, up_gene, lo_gene FROM ({TOLD}) t WHERE e IS NOT NULL AND s IS NOT NULL AND s - e BETWEEN -15 AND 15")
def realign_two(spark, d):
    return second_alignment(spark, d).where("n_hit = 2").drop("n_hit")


@query(f"SELECT id, read_id, up_gene, lo_gene FROM ({TOLD}) t WHERE (e IS NULL OR s IS NULL) AND gap BETWEEN -15 AND 30 AND left_over > 30 AND clip >= 30 AND abs(clip - missing) <= 30")
def realign_one(spark, d):
    return second_alignment(spark, d).where("n_hit = 1").drop("n_hit")


@query(f"SELECT read_id, up_gene, lo_gene, up_bp, lo_bp FROM ({PAIRS}) p")
def pair_upper_lower(spark, d):
    return pairs(tables(spark, d)[0]).select("read_id", "up_gene", "lo_gene", "up_bp", "lo_bp")


# Clusters

FOLD = f"SELECT up_gene, lo_gene, up_chrom, lo_chrom, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda l: abs(l.up_bp - x[1].up_bp) <= 300 AND abs(l.lo_bp - x[1].lo_bp) <= 300)) > 0 THEN a ELSE list_concat(a, x) END)) AS l FROM (SELECT up_gene, lo_gene, up_chrom, lo_chrom, list({{'ord': ord, 'up_bp': up_bp, 'lo_bp': lo_bp}} ORDER BY ord) AS xs FROM ({PAIRS}) p GROUP BY ALL) q"
TAGGED = f"SELECT p.*, round({SCORE}, 6) AS score, (SELECT min(h.l.ord) FROM ({FOLD}) h WHERE h.up_gene = p.up_gene AND h.lo_gene = p.lo_gene AND abs(h.l.up_bp - p.up_bp) <= 300 AND abs(h.l.lo_bp - p.lo_bp) <= 300) AS leader FROM ({PAIRS}) p"
GROUPED = f"SELECT *, dense_rank() OVER (PARTITION BY up_gene, lo_gene ORDER BY leader) - 1 AS bp_group FROM ({TAGGED}) t"
PATHED = f"SELECT *, dense_rank() OVER (PARTITION BY up_gene, lo_gene, bp_group ORDER BY f) - 1 AS path_group FROM (SELECT *, min(ord) OVER (PARTITION BY up_gene, lo_gene, bp_group, up_path, lo_path) AS f FROM ({GROUPED}) g) h"


@query(f"SELECT ord, up_gene, lo_gene, leader, bp_group FROM ({GROUPED}) g")
def leader_cluster(spark, d):
    return led(tables(spark, d)[0]).select("ord", "up_gene", "lo_gene", "leader", F.col("bp_group").cast("bigint").alias("bp_group"))


@query(f"SELECT ord, bp_group, path_group FROM ({PATHED}) g")
def path_subgroups(spark, d):
    return clustered(tables(spark, d)[0]).select("ord", F.col("bp_group").cast("bigint").alias("bp_group"), F.col("path_group").cast("bigint").alias("path_group"))


@query(f"SELECT up_gene, lo_gene, bp_group, arg_max(up_bp, {{'n': n, 'f': -f}}) AS up_bp_mode FROM (SELECT up_gene, lo_gene, bp_group, up_bp, count(*) AS n, min(ord) AS f FROM ({GROUPED}) g GROUP BY ALL) x GROUP BY ALL")
def bp_mode(spark, d):
    m = cluster.modes(clustered(tables(spark, d)[0]))
    return m.select("up_gene", "lo_gene", F.col("bp_group").cast("bigint").alias("bp_group"), "up_bp_mode")


@query(f"SELECT up_gene, lo_gene, bp_group, path_group, arg_max(ord, {{'s': score, 'o': -ord}}) AS best FROM ({PATHED}) g GROUP BY ALL")
def best_member(spark, d):
    rows = clustered(tables(spark, d)[0]).withColumn("score", F.round("score", 6))
    return cluster.stats(rows).select("up_gene", "lo_gene", F.col("bp_group").cast("bigint").alias("bp_group"), F.col("path_group").cast("bigint").alias("path_group"), "best")


@query(f"SELECT up_gene, lo_gene, bp_group, path_group, cast(sum(cast(score AS decimal(18, 6))) AS double) AS score, count(DISTINCT read_id) AS n_reads FROM ({PATHED}) g GROUP BY ALL")
def group_stats(spark, d):
    rows = clustered(tables(spark, d)[0]).withColumn("score", F.round("score", 6).cast("decimal(18,6)"))
    return cluster.stats(rows).select("up_gene", "lo_gene", F.col("bp_group").cast("bigint").alias("bp_group"), F.col("path_group").cast("bigint").alias("path_group"), F.col("score").cast("double").alias("score"), "n_reads")


# Graph: each gene has two transcripts, of exons 0, 1, 2, 3 and of exons 0, 2


def annotation(spark, d) -> DataFrame:
    _, genes = tables(spark, d)
    kinds = [("gene", -1)] + [(k, e) for t in ([0, 1, 2, 3], [0, 2]) for k, e in [("transcript", -1), *(("exon", e) for e in t)]]
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(k).alias("type"), F.lit(e).alias("e")) for i, (k, e) in enumerate(kinds)))).alias("s")
    out = genes.select("*", steps)
    exon = F.col("s.e") >= 0
    out = out.select((F.col("gid") * 100 + F.col("s.i")).alias("line_no"), F.col("chrom").alias("seqid"), F.col("s.type").alias("kind"), F.when(exon, F.col("start_pos") + 1000 * F.col("s.e")).otherwise(F.col("start_pos")).alias("start"), F.when(exon, F.col("start_pos") + 1000 * F.col("s.e") + 400).otherwise(F.col("end_pos")).alias("end"), "strand", F.col("gene").alias("gene_name"), F.col("type").alias("gene_type"))
    return graph.placed(out.withColumnRenamed("kind", "type"))


EXONS = "SELECT chrom AS seqid, gene AS gene_name, start_pos + 1000 * e AS start_pos, start_pos + 1000 * e + 400 AS end_pos, e FROM genes, (SELECT unnest([0, 1, 2, 3]) AS e) x"


@query("SELECT gene AS gene_name, cast(6 AS bigint) AS n_exon_rows, cast(2 AS bigint) AS n_paths FROM genes")
def gff_path_num(spark, d):
    a = annotation(spark, d)
    return a.groupBy("gene_name").agg(F.count(F.when(F.col("type") == "exon", 1)).alias("n_exon_rows"), F.max("path_num").alias("n_paths"))


@query(f"SELECT seqid, gene_name, start_pos, end_pos, CASE WHEN e IN (0, 2) THEN '1,2' ELSE '1' END AS paths, e IN (0, 2) AS repeat FROM ({EXONS}) x")
def exon_nodes(spark, d):
    n = graph.exon_nodes(annotation(spark, d))
    return n.select("seqid", "gene_name", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.array_join(F.transform("paths", lambda p: p.cast("string")), ",").alias("paths"), "repeat")


@query("SELECT chrom AS seqid, start_pos + 1000 * a AS from_start, start_pos + 1000 * b AS to_start FROM genes, (VALUES (0, 1), (1, 2), (2, 3), (0, 2)) v(a, b)")
def exon_edges(spark, d):
    return graph.exon_edges(annotation(spark, d)).select("seqid", "from_start", "to_start")


@query("SELECT gene AS gene_name, p AS path_num, CASE WHEN p = 1 THEN concat(start_pos, ',', start_pos + 1000, ',', start_pos + 2000, ',', start_pos + 3000) ELSE concat(start_pos, ',', start_pos + 2000) END AS starts FROM genes, (SELECT unnest([cast(1 AS bigint), 2]) AS p) x")
def transcript_paths(spark, d):
    n = graph.exon_nodes(annotation(spark, d))
    names = n.select("seqid", "gene_uid", "gene_name").distinct()
    return graph.transcript_paths(n).join(names, ["seqid", "gene_uid"]).select("gene_name", "path_num", F.array_join(F.transform("starts", lambda p: p.cast("string")), ",").alias("starts"))


@query("SELECT gene AS gene_name, chrom, strand, type AS gene_type, start_pos, end_pos, array_to_string(list_sort([cast(start_pos + 1000 * e AS varchar) for e in [0, 1, 2, 3]]), ';') AS f_exons, array_to_string(list_sort([cast(start_pos + 1000 * e + 400 AS varchar) for e in [0, 1, 2, 3]]), ';') AS b_exons FROM genes")
def gene_positions(spark, d):
    return graph.gene_positions(annotation(spark, d)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query(f"SELECT 'S' AS kind, concat('S', chr(9), seqid, ':', gene_name, ':', start_pos, '-', end_pos, chr(9), '*') AS line FROM ({EXONS}) x UNION ALL SELECT 'L', concat('L', chr(9), chrom, ':', gene, ':', start_pos + 1000 * a, '-', start_pos + 1000 * a + 400, chr(9), '+', chr(9), chrom, ':', gene, ':', start_pos + 1000 * b, '-', start_pos + 1000 * b + 400, chr(9), '+', chr(9), '0M') FROM genes, (VALUES (0, 1), (1, 2), (2, 3), (0, 2)) v(a, b)")
def gfa_union(spark, d):
    a = annotation(spark, d)
    return graph.gfa_records(graph.exon_nodes(a), graph.exon_edges(a)).select("kind", "line")


STEP = "chrom, ':', gene, ':', start_pos + 1000 * {0}, '-', start_pos + 1000 * {0} + 400"


@query(f"SELECT type = 'protein_coding' AS is_pc, concat('P', chr(9), chrom, '_gene-', gene, '_1', chr(9), {STEP.format(0)}, ',', {STEP.format(1)}, ',', {STEP.format(2)}, ',', {STEP.format(3)}) AS line FROM genes UNION ALL SELECT type = 'protein_coding', concat('P', chr(9), chrom, '_gene-', gene, '_2', chr(9), {STEP.format(0)}, ',', {STEP.format(2)}) FROM genes")
def gfa_paths(spark, d):
    a = annotation(spark, d)
    kinds = graph.classes(a)
    return graph.path_records(graph.exon_nodes(a), kinds).join(kinds, ["seqid", "gene_uid"]).select("is_pc", "line")


#: A genome of the documents' letters: a sequence a document, which names it.
LETTERS = "SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g') AS s FROM documents"


def genome(spark, d, piece: int) -> DataFrame:
    """The pieces of a FASTA file with index, written from the documents; every second sequence is one line, the others have lines of 60."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "").alias("s"))
    wrapped = F.when(F.col("doc_id") % 2 == 0, F.regexp_replace("s", "(.{60})", "$1\n")).otherwise(F.col("s"))
    place = scratch.folder(spark)
    rows.select(F.concat(F.lit(">"), "doc_id", F.lit(" document\n"), wrapped).alias("value")).write.text(f"{place}/genome.fa")
    sequence_files.write_index(spark, f"{place}/genome.fa", f"{place}/index", 1 << 20)
    return sequence_files.fasta_pieces(spark, f"{place}/genome.fa", f"{place}/index", piece)


EXONS = "SELECT doc_id, k AS gene_uid, doc_id % 50 + 1 + 300 * k AS a, doc_id % 50 + 1 + 300 * k + 30 + 50 * k AS b FROM documents, (SELECT unnest([0, 1, 2]) AS k) x"


@query(f"SELECT e.doc_id, gene_uid, a AS exon_start, b AS exon_end, substr(s, a, b - a + 1) AS seq FROM ({EXONS}) e JOIN ({LETTERS}) l ON l.doc_id = e.doc_id WHERE length(s) >= a")
def exon_sequence(spark, d):
    k = F.explode(F.array(*(F.lit(i).cast("bigint") for i in range(3)))).alias("gene_uid")
    nodes = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", k)
    first = F.col("doc_id") % 50 + 1 + 300 * F.col("gene_uid")
    nodes = nodes.select(F.col("doc_id").cast("string").alias("seqid"), "gene_uid", first.alias("start"), (first + 30 + 50 * F.col("gene_uid")).alias("end"))
    return run.exon_sequences(nodes, genome(spark, d, 64), 64).select(F.col("seqid").cast("bigint").alias("doc_id"), "gene_uid", F.col("start").alias("exon_start"), F.col("end").alias("exon_end"), "seq")


#: Genes on the documents' letters, with names that repeat and ranges that overlap.
PLACED = "SELECT concat('G', l_partkey % 9) AS gene, cast(l_orderkey % (SELECT count(*) FROM documents) AS varchar) AS chrom, (l_orderkey * 37 + l_suppkey * 101) % 12000 + 1 AS a, (l_orderkey * 37 + l_suppkey * 101) % 12000 + l_linenumber * 60 AS b FROM lineitem"
REGIONS = f"SELECT DISTINCT chrom AS seq_id, gene, greatest(a - 100, 1) AS low, b + 100 AS high, concat(chrom, ':', gene, ':', greatest(a - 100, 1), '-', b + 100) AS header FROM ({PLACED}) p"


def regions_of(spark, d) -> DataFrame:
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    low = (F.col("l_orderkey") * 37 + F.col("l_suppkey") * 101) % 12000
    genes = spark.read.parquet(f"{d}/lineitem.parquet").select(F.concat(F.lit("G"), F.col("l_partkey") % 9).alias("gene"), (F.col("l_orderkey") % n).cast("string").alias("chrom"), (low + 1).cast("bigint").alias("start"), (low + F.col("l_linenumber") * 60).cast("bigint").alias("end"))
    return regions.gene_regions(genes)


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({"from": "low", "to": "high"})


@query(REGIONS)
def gene_regions(spark, d):
    return named(regions_of(spark, d))


@query(f"SELECT seq_id, min(low) AS low, max(high) AS high, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY seq_id ORDER BY low, high, gene ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN low > 1 + max(high) OVER (PARTITION BY seq_id ORDER BY low, high, gene ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM ({REGIONS}) r) x) y GROUP BY seq_id, k")
def merged_regions(spark, d):
    return named(regions.merged(regions_of(spark, d)))


@query(f"SELECT header, substr(s, low, high - low + 1) AS seq FROM ({REGIONS}) r JOIN ({LETTERS}) l ON cast(l.doc_id AS varchar) = r.seq_id WHERE length(s) >= low")
def region_slice(spark, d):
    return regions.region_sequences(regions_of(spark, d), genome(spark, d, 256), 256).select("header", "seq")


@query("SELECT doc_id, substr(text, 1, cast(n_chars // 2 AS int)) AS upper, substr(text, cast(n_chars // 3 + 1 AS int)) AS lower FROM documents")
def consensus_split(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.select("doc_id", F.col("text").alias("seq"), F.expr("n_chars div 2").alias("upper_end"), F.expr("n_chars div 3").alias("lower_start"))
    return consensus.split_sequences(rows).select("doc_id", "upper", "lower")


# Refinement and report


@query("SELECT ord, b AS boundary FROM (SELECT ord, b, row_number() OVER (PARTITION BY ord ORDER BY abs(b - bp), cast(b AS varchar)) AS k FROM (SELECT a.ord, a.bp, g.start_pos + 1000 * e AS b FROM aln a JOIN genes g ON g.gene = a.gene AND g.chrom = a.chrom, (SELECT unnest([0, 1, 2, 3]) AS e) x) y WHERE abs(b - bp) <= 30) z WHERE k = 1")
def nearest_boundary(spark, d):
    aln, genes = tables(spark, d)
    bounds = F.transform(F.array_sort(F.transform(F.array(*map(F.lit, range(4))), lambda e: (F.col("start_pos") + 1000 * e).cast("string"))), lambda s: s.cast("bigint"))
    j = aln.join(genes.select("gene", "chrom", bounds.alias("bounds")), ["gene", "chrom"])
    return j.select("ord", E.nearest_boundary(F.col("bp"), F.col("bounds"), 30).alias("boundary")).where("boundary is not null")


@query("SELECT a.ord AS id, count(*) AS n_hits, arg_max(h.bp, h.ord) AS hit_start FROM aln a JOIN aln h ON h.read_id = a.read_id AND h.chrom = a.chrom AND (abs(h.bp - a.bp) <= 500 OR abs(h.bp + h.block_len - a.bp - a.block_len) <= 500) GROUP BY a.ord")
def near_hits(spark, d):
    aln, _ = tables(spark, d)
    c = aln.select(F.col("ord").alias("c_ord"), F.col("read_id"), "chrom", F.col("bp").alias("start"), (F.col("bp") + F.col("block_len")).alias("end"))
    hits = aln.select("read_id", F.col("ord"), "chrom", F.col("bp").alias("start"), (F.col("bp") + F.col("block_len")).alias("end"))
    keyed = hits.join(aln.select("read_id", F.col("ord").alias("id")), "read_id").drop("read_id")
    return report.near_hits(c.withColumnRenamed("c_ord", "id").drop("read_id"), keyed).select("id", "n_hits", "hit_start")


@query(f"SELECT p.ord, count(*) AS n_between FROM ({PAIRS}) p JOIN genes u ON u.gene = up_gene JOIN genes v ON v.gene = lo_gene JOIN genes g ON g.chrom = up_chrom AND g.start_pos > least(u.start_pos, v.start_pos) AND g.end_pos < greatest(u.end_pos, v.end_pos) WHERE up_chrom = lo_chrom AND g.type = 'protein_coding' AND g.gene NOT IN (up_gene, lo_gene) AND (u.strand <> v.strand OR g.strand = u.strand) GROUP BY p.ord")
def genes_between(spark, d):
    aln, genes = tables(spark, d)
    p = pairs(aln).where("up_chrom = lo_chrom")
    for s in ("up", "lo"):
        p = p.join(genes.select(F.col("gene").alias(f"{s}_gene"), F.col("start_pos").alias(f"{s}_s"), F.col("end_pos").alias(f"{s}_e"), F.col("strand").alias(f"{s}_strand")), f"{s}_gene")
    c = p.select(F.col("ord").alias("id"), F.col("up_chrom").alias("chrom"), F.least("up_s", "lo_s").alias("low"), F.greatest("up_e", "lo_e").alias("high"), F.when(F.col("up_strand") == F.col("lo_strand"), F.col("up_strand")).alias("strand"), "up_gene", "lo_gene")
    g = genes.withColumnsRenamed({"start_pos": "start", "end_pos": "end"})
    return report.genes_between(c, g, 100_000).groupBy(F.col("id").alias("ord")).agg(F.count(F.lit(1)).alias("n_between"))


@query("SELECT a.ord, a.seg_start >= g.start_pos AND a.seg_end <= g.end_pos AS inside FROM aln a JOIN genes g ON g.gene = a.gene AND g.chrom = a.chrom")
def segment_in_overlap(spark, d):
    aln, genes = tables(spark, d)
    j = aln.join(genes.select("gene", "chrom", "start_pos", "end_pos"), ["gene", "chrom"])
    return j.select("ord", F.forall(F.array("item"), lambda i: (E.item_start(i) >= F.col("start_pos")) & (E.item_end(i) <= F.col("end_pos"))).alias("inside"))


#: Genes with ranges widened by their number, so that some of a chromosome's neighbours overlap and some don't.
WIDE = "SELECT gene, chrom, start_pos - gid % 4 * 60000 AS s, end_pos + gid % 4 * 98000 AS e FROM genes"
NAMED = "CASE ord % 10 WHEN 0 THEN concat(lo_gene, '-AS1') WHEN 1 THEN substr(lo_gene, 2, 4) ELSE up_gene END"
INSIDE = "up_chrom = lo_chrom AND greatest(u.s, v.s) < least(u.e, v.e) AND lo_start >= greatest(u.s, v.s) AND lo_end <= least(u.e, v.e)"


@query(f"SELECT ord, contains({NAMED}, lo_gene) OR contains(lo_gene, {NAMED}) OR ({INSIDE}) AS matches FROM ({PAIRS}) p JOIN ({WIDE}) u ON u.gene = up_gene AND u.chrom = up_chrom JOIN ({WIDE}) v ON v.gene = lo_gene AND v.chrom = lo_chrom")
def gene_overlap(spark, d):
    """Whether the lower record, taken for a second alignment, matches the upper gene by name or by the two genes' overlap."""
    aln, genes = tables(spark, d)
    number = F.col("gid") % 4
    wide = genes.select("gene", "chrom", F.struct((F.col("start_pos") - number * 60000).alias("start"), (F.col("end_pos") + number * 98000).alias("end")).alias("range"))
    rows = pairs(aln)
    for s in ("up", "lo"):
        rows = rows.join(wide.select(F.col("gene").alias(f"{s}_gene"), F.col("chrom").alias(f"{s}_chrom"), F.col("range").alias(f"{s}_range")), [f"{s}_gene", f"{s}_chrom"])
    hit = F.struct(F.array("lo_path").alias("items"), F.col("lo_chrom").alias("hit_chrom"), F.col("lo_gene").alias("hit_gene"))
    return rows.select("ord", evidence.gene_matches(F.expr(NAMED), hit, F.col("up_range"), F.col("lo_range"), F.col("up_chrom")).alias("matches"))


LIB = "SELECT a.gene AS left_gene, b.gene AS right_gene, CASE WHEN (a.gid + b.gid) % 3 = 0 THEN ['BodyMap', 'X'] ELSE ['X'] END AS tags FROM genes a, genes b WHERE a.gid < b.gid AND (a.gid + b.gid) % 4 <> 0"


@query(f"SELECT DISTINCT p.up_gene, p.lo_gene, CASE WHEN coalesce(x.tags, y.tags) IS NULL THEN NULL WHEN list_contains(coalesce(x.tags, y.tags), 'BodyMap') THEN 'NORMAL_FUSION' ELSE 'PASS' END AS state FROM ({PAIRS}) p LEFT JOIN ({LIB}) x ON x.left_gene = up_gene AND x.right_gene = lo_gene LEFT JOIN ({LIB}) y ON y.left_gene = lo_gene AND y.right_gene = up_gene")
def annotation_check(spark, d):
    aln, genes = tables(spark, d)
    p = pairs(aln).select("up_gene", "lo_gene").distinct()
    return report.annotation_state(p, library(genes)).select("up_gene", "lo_gene", "state")


def library(genes: DataFrame) -> DataFrame:
    a, b = genes.select(F.col("gid").alias("i"), F.col("gene").alias("left_gene")), genes.select(F.col("gid").alias("j"), F.col("gene").alias("right_gene"))
    tags = F.when((F.col("i") + F.col("j")) % 3 == 0, F.array(F.lit("BodyMap"), F.lit("X"))).otherwise(F.array(F.lit("X")))
    return a.join(b, (F.col("i") < F.col("j")) & ((F.col("i") + F.col("j")) % 4 != 0)).select("left_gene", "right_gene", tags.alias("tags"))


LEVEL = "CASE WHEN up_mapq = 0 THEN NULL WHEN lo_mapq = 0 THEN 3 WHEN raw IN (1, 2) OR coding THEN raw ELSE greatest(3, raw - 1) END"
RAW = "CASE WHEN m AND normal THEN 2 WHEN m AND g THEN CASE WHEN exact THEN 5 ELSE 4 END WHEN m AND NOT same_chrom THEN 3 WHEN m AND dist > 100000 THEN 5 WHEN m AND other THEN 5 WHEN m AND any_between THEN CASE WHEN dist > 50000 THEN 4 ELSE 2 END WHEN m THEN 2 WHEN g THEN 3 ELSE 1 END"
FACTS = f"SELECT *, up_mapq >= 12 AS m, lo_mapq >= 30 AS g, up_chrom = lo_chrom AS same_chrom, abs(up_bp - lo_bp) AS dist, up_bp % 7 = 0 AS normal, up_bp % 2 = 0 AS exact, up_bp % 3 = 0 AS other, up_bp % 5 <> 0 AS any_between, up_gene <> 'GENEE' AND lo_gene <> 'GENEE' AS coding FROM ({PAIRS}) p"


def leveled(aln: DataFrame) -> DataFrame:
    p = pairs(aln)
    c = F.col
    value = report.level(c("up_mapq") >= 12, c("lo_mapq") >= 30, F.lit(True), c("up_mapq") != 0, c("lo_mapq") != 0, c("up_bp") % 7 == 0, c("up_bp") % 2 == 0, c("up_chrom") == c("lo_chrom"), F.abs(c("up_bp") - c("lo_bp")), c("up_bp") % 3 == 0, c("up_bp") % 5 != 0, (c("up_gene") != "GENEE") & (c("lo_gene") != "GENEE"))
    return p.withColumn("level", value)


@query(f"SELECT ord, {LEVEL} AS level FROM (SELECT *, {RAW} AS raw FROM ({FACTS}) f) x")
def confidence_level(spark, d):
    return leveled(tables(spark, d)[0]).select("ord", "level")


LEVELED = f"SELECT *, [read_id] AS reads FROM (SELECT *, {LEVEL} AS level FROM (SELECT *, {RAW} AS raw FROM ({FACTS}) f) x) y WHERE level BETWEEN 2 AND 5"
WON = f"SELECT ga, gb, arg_max(f, {{'l': level, 'n': n, 'o': -f}}) AS ord, max(level) AS level FROM (SELECT least(up_gene, lo_gene) AS ga, greatest(up_gene, lo_gene) AS gb, level, CASE WHEN level = 5 THEN up_bp END AS g1, CASE WHEN level = 5 THEN lo_bp ELSE -ord END AS g2, count(DISTINCT read_id) AS n, min(ord) AS f FROM ({LEVELED}) z GROUP BY ALL) w GROUP BY ga, gb"
COLLAPSED = f"SELECT w.ord, l.up_gene, l.up_chrom, l.lo_gene, l.lo_chrom, l.up_bp, l.lo_bp, l.up_sign, l.up_start, l.up_end, l.lo_sign, l.lo_start, l.lo_end, w.level, (SELECT list_sort(list(DISTINCT read_id)) FROM ({LEVELED}) r WHERE least(r.up_gene, r.lo_gene) = ga AND greatest(r.up_gene, r.lo_gene) = gb) AS reads FROM ({WON}) w JOIN ({LEVELED}) l ON l.ord = w.ord"


def collapsed(aln: DataFrame) -> DataFrame:
    return report.collapsed(leveled(aln).select("ord", "up_gene", "up_chrom", "lo_gene", "lo_chrom", "up_bp", "lo_bp", *(f"{x}_{y}" for x in ("up", "lo") for y in ("sign", "start", "end")), "level", F.array("read_id").alias("reads")))


@query(f"SELECT ord, up_gene, lo_gene, up_bp, lo_bp, level, cast(len(reads) AS bigint) AS n_reads FROM ({COLLAPSED}) c")
def collapse_pairs(spark, d):
    return collapsed(tables(spark, d)[0]).select("ord", "up_gene", "lo_gene", "up_bp", "lo_bp", "level", F.size("reads").cast("bigint").alias("n_reads"))


@query(f"SELECT min(ord) AS ord, up_gene, lo_gene, up_bp, lo_bp, count(DISTINCT read_id) AS n_reads FROM ({LEVELED}) l WHERE level = 5 GROUP BY up_gene, lo_gene, up_bp, lo_bp")
def isoform_collapse(spark, d):
    rows = leveled(tables(spark, d)[0]).select("ord", "up_gene", "up_chrom", "lo_gene", "lo_chrom", "up_bp", "lo_bp", "level", F.array("read_id").alias("reads"))
    return report.isoforms(rows).select("ord", "up_gene", "lo_gene", "up_bp", "lo_bp", F.size("all_reads").cast("bigint").alias("n_reads"))


TEXTS = " ".join(f"WHEN {k} THEN '{v}'" for k, v in E.LEVEL_TEXT.items())


@query(f"SELECT up_gene AS gene1, lo_gene AS gene2, concat(up_chrom, ':', up_bp, '; ', lo_chrom, ':', lo_bp) AS break_points, concat(up_chrom, up_sign, ': ', up_start, ', ', up_end) AS region1, concat(lo_chrom, lo_sign, ': ', lo_start, ', ', lo_end) AS region2, cast(len(reads) AS bigint) AS support_num, concat('flag = ', level, ': ', CASE level {TEXTS} END) AS rank_class, array_to_string(reads, ';') AS supporting_reads FROM ({COLLAPSED}) c WHERE len(reads) >= 2")
def final_report(spark, d):
    return report.report(collapsed(tables(spark, d)[0]))


#: Sequences of 64 letters for paths. In groups of three and more the second member has one letter changed, in groups of five and more the
#: third lacks one and the fourth has one more; the consensus undoes it all.
def letters_of(path: str) -> str:
    return f"translate(concat(md5(concat({path}, '1')), md5(concat({path}, '2'))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"SELECT min(ord) AS candidate, {letters_of('up_path')} AS upper, {letters_of('lo_path')} AS lower FROM ({GROUPED}) s GROUP BY up_gene, lo_gene, bp_group, up_path, lo_path")
def poa_consensus(spark, d):
    rows = clustered(tables(spark, d)[0])
    own = Window.partitionBy("up_gene", "lo_gene", "bp_group", "path_group")
    rows = rows.withColumn("candidate", F.min("ord").over(own)).withColumn("n", F.count(F.lit(1)).over(own)).withColumn("k", F.row_number().over(own.orderBy("ord")))
    up, lo, at = F.expr(letters_of("up_path")), F.expr(letters_of("lo_path")), F.col("ord") % 64 + 1
    changed = lambda x: F.overlay(x, F.lit("N"), at)
    for seq, odd, least, made in (("upper", 2, 3, changed(up)), ("lower", 2, 3, changed(lo))):
        rows = rows.withColumn(seq, F.when((F.col("n") >= least) & (F.col("k") == odd), made).otherwise(up if seq == "upper" else lo))
    many = F.col("n") >= 5
    rows = rows.withColumn("upper", F.when(many & (F.col("k") == 3), F.overlay("upper", F.lit(""), at, F.lit(1))).when(many & (F.col("k") == 4), F.overlay("upper", F.lit("ACG"), at, F.lit(0))).otherwise(F.col("upper")))
    reads_ = rows.select("candidate", "ord", F.concat("upper", "lower").alias("seq"), F.length("upper").alias("upper_end"), F.length("upper").alias("lower_start"))
    return consensus.consensus(consensus.split_sequences(reads_).select("candidate", "ord", "upper", "lower"), scratch.folder(spark))


TRUTH = "SELECT a.gene AS gene1, b.gene AS gene2, a.start_pos + 1000 AS gene1bp, b.start_pos + 1000 AS gene2bp FROM genes a, genes b WHERE a.gid < b.gid"


@query(f"SELECT t.*, count(c.ord) > 0 AS called, coalesce(bool_or(abs(CASE WHEN up_gene = gene1 THEN up_bp ELSE lo_bp END - gene1bp) <= 1100 AND abs(CASE WHEN up_gene = gene1 THEN lo_bp ELSE up_bp END - gene2bp) <= 1100), false) AS placed FROM ({TRUTH}) t LEFT JOIN ({COLLAPSED}) c ON least(up_gene, lo_gene) = least(gene1, gene2) AND greatest(up_gene, lo_gene) = greatest(gene1, gene2) GROUP BY ALL")
def truth_scoring(spark, d):
    aln, genes = tables(spark, d)
    return report.scored(collapsed(aln), truth_rows(genes).drop("id"), 1100)


def truth_rows(genes: DataFrame) -> DataFrame:
    g = genes.select("gid", "gene", (F.col("start_pos") + 1000).alias("bp"))
    truth = g.select("gid", F.col("gene").alias("gene1"), F.col("bp").alias("gene1bp")).join(g.select(F.col("gid").alias("h"), F.col("gene").alias("gene2"), F.col("bp").alias("gene2bp")), F.col("gid") < F.col("h"))
    return truth.withColumn("id", F.col("gid") * 100 + F.col("h")).drop("gid", "h")


@query(f"SELECT count(DISTINCT c.ord) AS calls, (SELECT count(*) FROM ({TRUTH}) t) AS truths, count(*) FILTER (abs(u - gene1bp) <= 1100 AND abs(v - gene2bp) <= 1100) AS matches, count(gene1) AS pairs_found, count(*) FILTER (abs(u - gene1bp) <= 1100 AND abs(v - gene2bp) <= 1100) / count(DISTINCT c.ord) AS precision, count(*) FILTER (abs(u - gene1bp) <= 1100 AND abs(v - gene2bp) <= 1100) / (SELECT count(*) FROM ({TRUTH}) t) AS recall FROM (SELECT *, CASE WHEN up_gene = least(up_gene, lo_gene) THEN up_bp ELSE lo_bp END AS u, CASE WHEN up_gene = least(up_gene, lo_gene) THEN lo_bp ELSE up_bp END AS v FROM ({COLLAPSED}) k) c LEFT JOIN ({TRUTH}) t ON least(up_gene, lo_gene) = gene1 AND greatest(up_gene, lo_gene) = gene2")
def truth_accuracy(spark, d):
    aln, genes = tables(spark, d)
    return report.accuracy(collapsed(aln).withColumnRenamed("ord", "id"), truth_rows(genes), 1100)


@query()
def minimizer_align(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("read_id"), F.col("text").alias("seq"))
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("ref_id"), F.col("text").alias("seq"))
    return chains.align(docs, items, k=16, w=8, dna=False)
