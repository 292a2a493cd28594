"""Hand-worked cases of the scalar rules."""

import pytest
from pyspark.sql import functions as F

from weftline.functions import expr as E
from weftline.operators import reads


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("cigar", "want"),
    [("10S50M3D20M5S", (85, 73, 10, 80, 10, 5, 70, 0, 0)), ("5H10S50M", (60, 50, 10, 60, 10, 0, 50, 5, 0)), ("100M2000N50M", (150, 2150, 0, 150, 0, 0, 150, 0, 0)), ("20S", (20, 0, 20, 20, 20, 0, 0, 0, 0)), ("7H", (0, 0, 0, 0, 0, 0, 0, 7, 0)), ("*", (0,) * 9)],
)
def test_cigar(spark, cigar, want):
    m = E.cigar_metrics(F.lit(cigar))
    got = one(spark, F.struct(*(m[k].alias(k) for k in ("q_len", "r_len", "q_start", "q_end", "soft_start", "soft_end", "core", "hard_start", "hard_end"))))
    assert tuple(got) == want


@pytest.mark.parametrize(("q", "w"), [(60, 19.0), (30, 14.5), (29, 7.0), (20, 7.0), (10, 3.5), (9, 1.8), (0, 0.0)])
def test_weight(spark, q, w):
    assert one(spark, E.quality_weight(F.lit(q))) == pytest.approx(w)


@pytest.mark.parametrize(("a", "b", "i", "j", "s"), [(60, 60, 1, 1, 9.702536), (60, 12, 2, 3, 7.945487), (5, 60, 1, 1, 3.754112), (0, 0, 1, 1, 0.0), (30, 29, 4, 2, 8.195774)])
def test_score(spark, a, b, i, j, s):
    assert round(one(spark, E.pair_score(*map(F.lit, (a, b, i, j)))), 6) == pytest.approx(s)


@pytest.mark.parametrize(("at", "bounds", "want"), [(405, [400, 410], 400), (999, [1000, 998], 1000), (500, [400, 600], None)])
def test_nearest(spark, at, bounds, want):
    assert one(spark, E.nearest_boundary(F.lit(at), F.array(*map(F.lit, bounds)), 30)) == want


@pytest.mark.parametrize(("a", "b", "want"), [("TMPRSS2", "TMPRSS", True), ("F2", "F2R", False), ("ENSG1", "ENSG1", False)])
def test_similar(spark, a, b, want):
    assert one(spark, E.similar_genes(F.lit(a), F.lit(b))) is want


def test_paths(spark):
    assert one(spark, E.path_items(F.lit(">a<b"))) == ["a<b"]
    assert one(spark, E.item_genes(F.lit("chr1:A--B:1-2"))) == ["A", "B"]
    assert one(spark, E.item_genes(F.lit("chr1:10-20"))) == []
    assert one(spark, E.normal_path(F.lit("<chr2:GB:351-400<chr2:GB:201-250"))) == ["chr2:201-250", "chr2:351-400"]


def test_merge_and_overlap(spark):
    kind = "struct<read_start:bigint,ord:bigint,gene:string,chrom:string,sign:string,read_end:bigint,block_len:bigint,mapq:bigint,items:array<string>>"
    rows = [(0, 1, "A", "c", ">", 50, 50, 10, ["x"]), (60, 2, "A", "c", ">", 100, 40, 60, ["y"])]
    df = spark.createDataFrame([(rows,)], f"recs array<{kind}>")
    got = df.select(reads.merged(F.col("recs")).alias("m")).first()["m"]
    assert [(r.read_start, r.read_end, r.block_len, r.mapq) for r in got] == [(0, 100, 90, 60)]
    for start, want in ((46, False), (45, True)):
        r2 = [(0, 1, "A", "c", ">", 60, 50, 10, ["x"]), (start, 2, "A", "c", ">", 100, 40, 60, ["y"])]
        assert spark.createDataFrame([(r2,)], f"recs array<{kind}>").select(reads.overlapping(F.col("recs")).alias("o")).first()["o"] is want


def test_gaf_lines_are_split_once(spark):
    """The filter on a record's fields must not split the line again for each field."""
    from weftline.sources import text

    made = spark.range(3).selectExpr("id AS line_no", "concat_ws('\t', 'r', id, '0', '9', '+', '>chr1:G:1-9', '9', '0', '9', '9', '9', '60') AS value")
    good, bad = text.gaf(made.unionByName(spark.createDataFrame([(7, None), (8, "x\ty")], "line_no bigint, value string")))
    assert sorted(r.line_no for r in good.collect()) == [0, 1, 2] and sorted(r.line_no for r in bad.collect()) == [7, 8]
    plan = text.gaf(made)[0].select("read_id", "read_start", "s1")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("concat_ws(") == 1
