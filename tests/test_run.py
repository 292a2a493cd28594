"""From lines of files to the report, on a worked example."""

import random

from weftline.operators import graph
from weftline.plans import run
from weftline.sources import text

GFF = """##sequence-region chr1 1 1000
chr1 T gene 101 400 . + . ID=g1;gene_id=g1;gene_type=protein_coding;gene_name=GA
chr1 T transcript 101 400 . + . ID=t1;gene_id=g1;gene_name=GA
chr1 T exon 101 150 . + . ID=e1;gene_id=g1;gene_name=GA
chr1 T exon 201 250 . + . ID=e2;gene_id=g1;gene_name=GA
chr1 T exon 351 400 . + . ID=e3;gene_id=g1;gene_name=GA
chr1 T transcript 101 400 . + . ID=t2;gene_id=g1;gene_name=GA
chr1 T exon 101 150 . + . ID=e4;gene_id=g1;gene_name=GA
chr1 T exon 351 400 . + . ID=e5;gene_id=g1;gene_name=GA
chr1 T exon 500 510 . + . ID=lost;gene_name=GX
##sequence-region chr2 1 1000
chr2 T gene 101 400 . - . ID=g2;gene_id=g2;gene_type=protein_coding;gene_name=GB
chr2 T transcript 101 400 . - . ID=t3;gene_id=g2;gene_name=GB
chr2 T exon 351 400 . - . ID=e6;gene_id=g2;gene_name=GB
chr2 T exon 201 250 . - . ID=e7;gene_id=g2;gene_name=GB
chr2 T exon 101 150 . - . ID=e8;gene_id=g2;gene_name=GB"""
GAF = [
    ("r1", 200, 0, 100, ">chr1:GA:101-150>chr1:GA:201-250", 100, 0, 100, 100),
    ("r1", 200, 100, 200, "<chr2:GB:351-400<chr2:GB:201-250", 100, 0, 100, 100),
    ("r2", 150, 0, 100, ">chr1:GA:101-150>chr1:GA:201-250", 100, 0, 100, 100),
    ("r2", 150, 100, 150, "<chr2:GB:351-400", 50, 0, 50, 50),
    ("r3", 100, 0, 50, ">chrM:GM:1-50", 50, 0, 50, 50),
    ("r3", 100, 50, 100, ">chr1:GA:101-150", 50, 0, 50, 50),
    ("r4", 100, 0, 100, ">chr1:GA:101-150", 50, 0, 50, 50),
    ("r5", 100, 0, 60, ">chr1:GA:101-150", 50, 0, 50, 50),
    ("r5", 100, 45, 100, "<chr2:GB:351-400", 50, 0, 50, 50),
]
PICK = random.Random(7)
GENOME = {c: "".join(PICK.choices("ACGT", k=1000)) for c in ("chr1", "chr2")}


def letters(chrom, start, end, back=False):
    part = GENOME[chrom][start - 1 : end]
    return part[::-1].translate(str.maketrans("ACGT", "TGCA")) if back else part


#: The reads as their alignments say: forward exons of GA, then backward ones of GB.
READS = {
    "r1": letters("chr1", 101, 150) + letters("chr1", 201, 250) + letters("chr2", 351, 400, True) + letters("chr2", 201, 250, True),
    "r2": letters("chr1", 101, 150) + letters("chr1", 201, 250) + letters("chr2", 351, 400, True),
}


def lines(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "line_no long, value string")


def gaf_line(name, size, start, end, path, ref, a, b, block, mapq=60):
    return "\t".join(map(str, (name, size, start, end, "+", path, ref, a, b, block, block, mapq, "tp:A:P")))


def sam_line(name, flag, chrom, pos, mapq, cigar):
    return "\t".join(map(str, (name, flag, chrom, pos, mapq, cigar, "*", 0, 0, "*", "*")))


def built(spark, folder, piece=64):
    pieces = [(k, i + 1, v[i : i + piece]) for k, v in GENOME.items() for i in range(0, len(v), piece)]
    gff = lines(spark, [x.replace(" ", "\t") if not x.startswith("#") else x for x in GFF.split("\n")])
    return run.build_graph(gff, spark.createDataFrame(pieces, "seq_id string, at long, part string"), folder, piece)


def test_graph(spark, tmp_path):
    g = built(spark, f"file://{tmp_path}")
    nodes = {(r.gene_name, r.start): (r.end, r.paths, r["repeat"]) for r in g["nodes"].collect()}
    assert nodes[("GA", 101)] == (150, [1, 2], True) and nodes[("GA", 201)] == (250, [1], False) and len(nodes) == 6
    genes = {r.gene: r for r in g["genes"].collect()}
    assert (genes["GA"].f_exons, genes["GA"].b_exons, genes["GB"].strand) == ([101, 201, 351], [150, 250, 400], "-")
    seqs = {r.line.split("\t")[1]: r.line.split("\t")[2] for r in g["gfa"].where("kind = 'S'").collect()}
    for name, seq in seqs.items():
        chrom, _, span = name.split(":")
        a, b = map(int, span.split("-"))
        assert seq == GENOME[chrom][a - 1 : b]


def test_missing_sequences(spark, tmp_path):
    """Exons of a sequence that the genome lacks, or beyond its end, have segments without letters."""
    nodes = spark.createDataFrame([("chr1", 1, "GA", 10, 20), ("chrX", 1, "GX", 10, 20), ("chr1", 2, "GE", 995, 1200), ("chr1", 3, "GF", 1001, 1010)], "seqid string, gene_uid long, gene_name string, start long, end long")
    pieces = spark.createDataFrame([("chr1", i + 1, GENOME["chr1"][i : i + 7]) for i in range(0, 1000, 7)], "seq_id string, at long, part string")
    found = run.exon_sequences(nodes, pieces, 7)
    got = {r.gene_uid: r.seq for r in found.where("seqid = 'chr1'").collect()}
    assert got == {1: GENOME["chr1"][9:20], 2: GENOME["chr1"][994:]}
    edges = spark.createDataFrame([], "seqid string, gene_uid long, from_start long, from_end long, to_start long, to_end long")
    assert sorted(r.line.split("\t")[2] == "*" for r in graph.gfa_records(nodes, edges, found).collect()) == [False, False, True, True]


def test_detect(spark, tmp_path):
    folder = f"file://{tmp_path}"
    genes = built(spark, folder)["genes"]
    found = run.candidates(lines(spark, [gaf_line(*x) for x in GAF]), genes, folder)
    rows = {r.read_id: r for r in found.collect()}
    assert sorted(rows) == ["r1", "r2"]
    assert all((r.up_bp, r.lo_bp, r.bp_group) == (250, 400, 0) for r in rows.values())
    assert (rows["r1"].path_group, rows["r2"].path_group) == (0, 1)
    assert (rows["r1"].lo_path, round(rows["r1"].score, 6), round(rows["r2"].score, 6)) == ("chr2:201-250,chr2:351-400", 12.064242, 11.03258)
    names = [r.name for r in run.fusion_candidates(found).collect()]
    assert sorted(names) == ["GA_GB_group0_path0", "GA_GB_group0_path1"]

    seqs = spark.createDataFrame([("r1", "A" * 100 + "C" * 100), ("r2", "A" * 100 + "C" * 50)], "seq_id string, seq string")
    fasta = dict(r.value[1:].split("\n") for r in run.consensus_fasta(found, seqs, folder).collect())
    assert fasta["GA_GB_group0_path0_0_upper"] == "A" * 100 and fasta["GA_GB_group0_path1_0_full"] == "A" * 100 + "C" * 50

    upper = [gaf_line(f"{n}_0_upper", 100, 0, 100, ">chr1:GA:101-150>chr1:GA:201-250", 100, 0, 100, 100) for n in names]
    lower = [gaf_line(f"{n}_0_lower", 50, 0, 50, "<chr2:GB:351-400", 50, 0, 50, 50) for n in names]
    sam = [sam_line(f"{n}_0_full", flag, *at) for n in names for flag, at in ((0, ("chr1", 101, 60, "50M50N50M50S")), (2064, ("chr2", 351, 60, "50M100S")))]
    library = spark.createDataFrame([("GA", "GZ", ["BodyMap"])], "left_gene string, right_gene string, tags array<string>")

    def report(gaf, sam_, lib=library):
        return [tuple(r) for r in run.detect(found, genes, lib, lines(spark, gaf), lines(spark, sam_), folder).collect()]

    row = lambda point, flag: [("GA", "GB", point, "chr1>: 101, 400", "chr2<: 101, 400", 2, flag, "r1;r2")]
    # The lower side is read backward: its genome breakpoint is the alignment's end where it is reversed.
    assert report(upper + lower, sam) == row("chr1:250; chr2:400", "flag = 5: High Confidence Fusion")
    assert report(upper + lower, sam[::2]) == row("chr1:250; chr2:400", "flag = 3: Low Confidence Fusion")
    assert report(upper + lower, []) == row("chr1:250; chr2:400", "flag = 3: Low Confidence Fusion")
    assert report(upper, sam) == []
    swapped = [x.replace("<chr2", ">chr2") for x in lower]
    assert report(upper + swapped, sam) == row("chr1:250; chr2:400", "flag = 3: Low Confidence Fusion")
    assert report(upper + swapped, sam[::2]) == []
    normal = spark.createDataFrame([("GB", "GA", ["BodyMap"])], library.schema)
    assert report(upper + lower, sam, normal) == row("chr1:250; chr2:400", "flag = 2: Potential Artifacts / Read-through")


def test_lines(spark):
    rows = lines(spark, ["##sequence-region a", "x", "##sequence-region b", "y"])
    assert [r.region_id for r in text.regions(rows).orderBy("line_no").collect()] == [1, 1, 2, 2]
    paf = ["\t".join(map(str, x)) for x in [("r", 200, 3, 90, "+", "chr1:GA:1-500", 500, 1, 88, 80, 87, 60, "tp:A:P"), ("r", 200, "x", 90, "+", "chr1:GA:1-500", 500, 1, 88, 80, 87, 60), ("short",)]]
    assert [tuple(r) for r in text.paf(lines(spark, paf)).collect()] == [("r", "GA", 3, 90, 87, 0)]


def test_support_and_read_length(spark, tmp_path):
    """Hits count only on genes of supported pairs; a whole read's length is its own, a shortened one's its cut."""
    from weftline.operators import reads
    from weftline.params import FusionParams

    folder = f"file://{tmp_path}"
    genes = built(spark, folder)["genes"]
    alone = lines(spark, [gaf_line(*x) for x in GAF[:2]])
    assert [r.read_id for r in run.candidates(alone, genes, folder).collect()] == ["r1"]
    assert run.candidates(alone, genes, folder, params=FusionParams(strict_support=True)).count() == 0
    hits = spark.createDataFrame([(r, g, a, b, 100, i) for i, (r, g, a, b) in enumerate([("r1", "GA", 0, 100), ("r1", "GB", 100, 200), ("r2", "GA", 0, 100)])], "read_id string, gene string, q_st long, q_en long, blen long, ord long")
    assert run.candidates(alone, genes, folder, hits).count() == 0
    both = lines(spark, [gaf_line(*x) for x in GAF])
    assert sorted(r.read_id for r in run.candidates(both, genes, folder, hits).collect()) == ["r1", "r2"]
    rec = lambda at, ord_, gene, chrom, sign, item: (at, ord_, at + 50, gene, chrom, sign, 50, 60, [item])
    kind = "read_id string, recs array<struct<read_start:bigint,ord:bigint,read_end:bigint,gene:string,chrom:string,sign:string,block_len:bigint,mapq:bigint,items:array<string>>>, read_len long"
    a, b = rec(0, 0, "GA", "chr1", ">", "chr1:GA:101-150"), rec(50, 1, "GB", "chr2", "<", "chr2:GB:351-400")
    rows = spark.createDataFrame([("x", [a, b], 120), ("y", [a, b, rec(107, 2, "GA", "chr1", ">", "chr1:GA:201-250")], 200)], kind)
    assert {r.read_id: r.read_length for r in reads.routed(rows, genes).collect()} == {"x": 120, "y": 103}


def test_commands(spark, tmp_path):
    """Files in, report out; the graph's P lines and its part of protein-coding genes."""
    from weftline.__main__ import main

    ref, out = f"file://{tmp_path}/ref", f"file://{tmp_path}/out"

    def file(name, values):
        (tmp_path / name).write_text("\n".join(values) + "\n")
        return f"file://{tmp_path}/{name}"

    gff = [x.replace(" ", "\t") if not x.startswith("#") else x for x in GFF.split("\n")] + ["\t".join(["chr2", "T", k, "600", "650", ".", "+", ".", "gene_id=g3;gene_type=processed_pseudogene;gene_name=GP"]) for k in ("gene", "transcript", "exon")]
    genome = [x for k, v in GENOME.items() for x in (f">{k}", v)]
    genome_file = file("g.fa", genome)
    main(["graph", file("a.gff", gff), genome_file, "-o", ref], spark)
    p = {r.line for r in spark.read.parquet(f"{ref}/gfa").where("kind = 'P'").collect()}
    assert p == {"P\tchr1_gene-GA_1\tchr1:GA:101-150,chr1:GA:201-250,chr1:GA:351-400", "P\tchr1_gene-GA_2\tchr1:GA:101-150,chr1:GA:351-400", "P\tchr2_gene-GB_1\tchr2:GB:101-150,chr2:GB:201-250,chr2:GB:351-400", "P\tchr2_pseu-GP_1\tchr2:GP:600-650"}
    counts = [spark.read.text(f"{ref}/{x}").count() for x in ("only_pc_gfa", "comprehensive_gfa")]
    assert counts == [11, 12]
    text_rows = lambda folder: [r.value for r in spark.read.text(f"{folder}").collect()]
    assert text_rows(f"{ref}/gene_pos")[:2] == ["Gene_Name\tStrand\tType\tStart\tEnd\tFexons\tBexons", "GA_chr1\t+\tprotein_coding\t101\t400\t101;201;351\t150;250;400"]
    # r6 to r8 say what r1 says. r6's sequence has GA, and leaves as much as GB's part should have; the others have neither gene.
    told = [gaf_line("r" + str(n), *x[1:]) for n in (6, 7, 8) for x in GAF[:2]]
    false = {"r6": letters("chr1", 101, 150) + letters("chr1", 201, 250) + "".join(PICK.choices("ACGT", k=20)), "r7": "".join(PICK.choices("ACGT", k=200)), "r8": letters("chr2", 600, 800)}
    odd = ["not a record", gaf_line("r9", 90, 0, 40, ">chr1:GA:101-150", 50, 0, 40, 40), gaf_line("r9", 90, 40, 90, ">chr5:GU:1-50", 50, 0, 50, 50)]
    gaf = file("r.gaf", [gaf_line(*x) for x in GAF] + told + odd)
    reads = file("r.fa", [x for n, seq in {**READS, **false}.items() for x in (f">{n} read", seq)])
    main(["candidates", gaf, reads, ref, genome_file, "-o", out], spark)
    assert sorted(r.read_id for r in spark.read.parquet(f"{out}/clustered").collect()) == ["r1", "r2", "r6"]
    assert sorted(x.split("\n")[0] for x in text_rows(f"{out}/total_reference") if x.startswith(">")) == [">chr1:GA:1-500", ">chr2:GB:1-500"]
    sequences = dict(x.split("-500") for x in "".join(text_rows(f"{out}/total_reference")).split(">")[1:])
    assert sequences == {"chr1:GA:1": letters("chr1", 1, 500), "chr2:GB:1": letters("chr2", 1, 500)}
    counts = {r.step: r.n for r in spark.read.parquet(f"{out}/counts").collect()}
    assert counts == {"lines": 18, "records": 17, "reads of several records": 8, "reads of two genes": 6, "pairs": 5, "confirmed pairs": 3, "clustered pairs": 3, "rejected lines": 1, "records of unknown genes": 1}
    assert [r.value for r in spark.read.parquet(f"{out}/rejected_lines").collect()] == ["not a record"]
    assert [tuple(r) for r in spark.read.parquet(f"{out}/unknown_genes").collect()] == [("GU", "chr5", 1)]

    paf = file("r.paf", ["\t".join(map(str, (r, 200, a, b, "+", n, 500, 0, 100, 100, 100, 60))) for r in ("r1", "r8") for n, a, b in (("chr1:GA:1-500", 0, 100), ("chr2:GB:1-500", 103, 200))])
    main(["candidates", gaf, reads, ref, genome_file, "-o", f"{out}/by_paf", "--hits", paf], spark)
    assert sorted(r.read_id for r in spark.read.parquet(f"{out}/by_paf/clustered").collect()) == ["r1", "r8"]

    names = [x[1:].removesuffix("_0_full") for x in text_rows(f"{out}/consensus_fasta") if x.endswith("_full")]
    upper = [gaf_line(f"{n}_0_upper", 100, 0, 100, ">chr1:GA:101-150>chr1:GA:201-250", 100, 0, 100, 100) for n in names]
    lower = [gaf_line(f"{n}_0_lower", 50, 0, 50, "<chr2:GB:351-400", 50, 0, 50, 50) for n in names]
    sam = [sam_line(f"{n}_0_full", f, *at) for n in names for f, at in ((0, ("chr1", 101, 60, "50M50N50M50S")), (2064, ("chr2", 351, 60, "50M100S")))]
    detect = ["detect", file("c.gaf", upper + lower), file("c.sam", sam), ref, "-o", out]
    head = "#gene1 name\tgene2 name\tbreak points\tgene1 position\tgene2 position\tsupport num\trank class\tsupporting reads information"
    row = "GA\tGB\tchr1:250; chr2:400\tchr1>: 101, 400\tchr2<: 101, 400\t3\tflag = {}\tr1;r2;r6"
    main(detect, spark)
    assert text_rows(f"{out}/report") == [head, row.format("5: High Confidence Fusion")]
    main([*detect, "--library", file("lib", ["GA--GB\t[\"BodyMap\"]\tx"])], spark)
    assert text_rows(f"{out}/report") == [head, row.format("2: Potential Artifacts / Read-through")]
