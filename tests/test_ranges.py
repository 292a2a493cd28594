"""Ranges as blocks of bins, genes between and genes that overlap, against plain loops."""

import random

from pyspark.sql import functions as F

from weftline.operators import evidence, report


def test_blocks_part_each_range(spark):
    pick = random.Random(1)
    rows = [(a := pick.choice([0, 1, pick.randrange(40), pick.randrange(5000)]), a + pick.choice([0, 1, pick.randrange(9), pick.randrange(3000)])) for _ in range(300)] + [(5, 4)]
    table = spark.createDataFrame(rows, "a long, b long")
    for levels in (1, 3, 12):
        for r in table.select("a", "b", report.blocks(F.col("a"), F.col("b"), levels).alias("x")).collect():
            bins = [n for level, node in r.x for n in range(node << level, (node + 1) << level)]
            assert sorted(bins) == list(range(r.a, r.b + 1))
            assert sum(level < levels for level, _ in r.x) <= 2 * levels


def test_genes_between(spark):
    pick = random.Random(2)
    genes = [(f"g{i}", pick.choice(["c1", "c2"]), s := pick.choice([pick.randrange(2_000_000), pick.randrange(300_000_000)]), s + pick.choice([500, 400_000]), pick.choice("+-"), pick.choice(["protein_coding", "protein_coding", "lncRNA"])) for i in range(400)]
    rows = [(i, pick.choice(["c1", "c2", "c3"]), a := pick.choice([pick.randrange(2_000_000), pick.randrange(250_000_000)]), a + pick.choice([-5, 0, 100_000, 5_000_000, 300_000_000]), pick.choice(["+", "-", None]), f"g{pick.randrange(400)}", f"g{pick.randrange(400)}") for i in range(80)]
    want = sorted((r[0], g[0]) for r in rows for g in genes if g[5] == "protein_coding" and g[1] == r[1] and g[2] > r[2] and g[3] < r[3] and r[4] in (None, g[4]) and g[0] not in r[5:])
    found = report.genes_between(spark.createDataFrame(rows, "id long, chrom string, low long, high long, strand string, up_gene string, lo_gene string"), spark.createDataFrame(genes, "gene string, chrom string, start long, end long, strand string, type string"))
    assert sorted((r.id, r.between) for r in found.collect()) == want


def test_gene_matches(spark):
    """A hit in another gene counts where the two genes overlap and the path lies inside the overlap, in that gene."""
    kind = "name string, chrom string, g struct<start:long,end:long>, hit struct<hit_chrom:string,hit_gene:string,items:array<string>>, seen struct<start:long,end:long>"
    row = lambda name, start, end, gene, a, b, items, chrom="c", known=True: (name, "c", (start, end), (chrom, gene, items), (a, b) if known else None)
    inside = ["c:B:150-180", "c:B:185-200"]
    rows = [
        (row("A", 100, 200, "A", 100, 200, ["c:A:1-2"]), True),
        (row("AB", 100, 200, "B", 900, 950, ["c:B:900-910"]), True),  # one name holds the other
        (row("A", 100, 200, "BA", 900, 950, ["c:BA:900-910"]), True),
        (row("A", 100, 200, "B", 150, 300, inside), True),
        (row("A", 100, 200, "B", 150, 300, [*inside, "c:B:201-210"]), False),  # beyond the first gene
        (row("A", 100, 200, "B", 150, 300, ["c:B:149-160"]), False),
        (row("A", 100, 200, "B", 150, 300, [inside[0], "c:C:185-200"]), False),  # another gene on the way
        (row("A", 100, 200, "B", 200, 300, ["c:B:200-200"]), False),  # the two touch, no more
        (row("A", 100, 200, "B", 250, 300, ["c:B:250-260"]), False),
        (row("A", 100, 200, "B", 150, 300, ["d:B:150-160"], "d"), False),
        (row("A", 100, 200, "B", 0, 0, inside, known=False), False),  # nothing is known of it
    ]
    got = spark.createDataFrame([r for r, _ in rows], kind).select(evidence.gene_matches(F.col("name"), F.col("hit"), F.col("g"), F.col("seen"), F.col("chrom")).alias("m")).collect()
    assert [r.m for r in got] == [w for _, w in rows]
