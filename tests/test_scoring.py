"""Reports against truth sets: one-to-one matches as a plain loop makes them, and the files."""

import random

import pytest

from weftline.operators import report as R
from weftline.sources import text


def brute(calls, truth, tolerance):
    options = []
    for i, a, b, x, y in calls:
        for k, c, d, u, v in truth:
            ways = [w for w, fits in (((x - u, y - v), (a, b) == (c, d)), ((y - u, x - v), (b, a) == (c, d))) if fits]
            near = [abs(p) + abs(q) for p, q in ways if abs(p) <= tolerance and abs(q) <= tolerance]
            if near:
                options.append((min(near), k, i))
    out = []
    for d, k, i in sorted(options):
        if all(i != x and k != y for x, y, _ in out):
            out.append((i, k, d))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_matches_as_a_loop(spark, seed):
    pick = random.Random(seed)
    row = lambda i: (i, pick.choice("ABC"), pick.choice("ABCD"), pick.randrange(60), pick.randrange(60))
    calls, truth = [row(i) for i in range(60)], [row(i) for i in range(50)]
    called = spark.createDataFrame(calls, "id long, up_gene string, lo_gene string, up_bp long, lo_bp long")
    known = spark.createDataFrame(truth, "id long, gene1 string, gene2 string, gene1bp long, gene2bp long")
    want = brute(calls, truth, 15)
    assert sorted(map(tuple, R.matched(called, known, 15).select("call", "truth", "distance").collect())) == want
    pairs = {frozenset(c[1:3]) for c in calls}
    got = R.accuracy(called, known, 15).first()
    assert tuple(got) == (60, 50, len(want), sum(frozenset(t[1:3]) in pairs for t in truth), len(want) / 60, len(want) / 50)
    none = R.accuracy(called.limit(0), known.limit(0), 15).first()
    assert tuple(none) == (0, 0, 0, 0, None, None)


def test_files(spark, tmp_path):
    from weftline.__main__ import main

    rows = ["gene1\tgene2\tgene1bp\tgene2bp", "AAA\tBBB\t1000\t2000", "CCC\tDDD\t500\t900", "EEE\tFFF\t10\t20", "\t\t", "GGG\tHHH\tx\t1"]
    report = ["#gene1 name\tgene2 name\tbreak points\tgene1 position\tgene2 position\tsupport num\trank class\tsupporting reads information"]
    line = lambda a, x, b, y, k: f"{a}\t{b}\tchr1:{x}; HLA:chr2:{y}\tchr1>: 1, 2\tchr2<: 3, 4\t7\tflag = {k}: text\tr1;r2"
    report += [line("BBB", 2050, "AAA", 990, 5), line("CCC", 500, "DDD", 1500, 3), line("XXX", 1, "YYY", 2, 4), "cut\tshort"]
    (tmp_path / "report.txt").write_text("\n".join(report) + "\n")
    for end in ("\n", "\r\n"):
        (tmp_path / "truth.csv").write_text(end.join(rows) + end, newline="")
        assert [tuple(r)[1:] for r in text.truth_set(spark, f"file://{tmp_path}/truth.csv").collect()] == [("AAA", "BBB", 1000, 2000), ("CCC", "DDD", 500, 900), ("EEE", "FFF", 10, 20)]
    main(["score", f"file://{tmp_path}/report.txt", f"file://{tmp_path}/truth.csv", "-o", f"file://{tmp_path}/out", "--tolerance", "60"], spark)
    got = spark.read.parquet(f"file://{tmp_path}/out/accuracy").first()
    assert tuple(got) == (3, 3, 1, 2, 1 / 3, 1 / 3)
    match = spark.read.option("sep", "\t").option("header", True).csv(f"file://{tmp_path}/out/matches").collect()
    assert [(r.gene1, r.up_gene, r.distance, r.level, r.support) for r in match] == [("AAA", "BBB", "60", "5", "7")]
