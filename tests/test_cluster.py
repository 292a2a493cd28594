"""Breakpoint clusters: folds, and rounds over a grid, against a plain loop."""

import random

import pytest

from weftline.operators import cluster as C


def brute(rows, distance):
    """read ord -> (leader, group) by the rule, one row after the other."""
    out, heads = {}, {}
    for up, lo, uc, lc, a, b, ord_ in sorted(rows, key=lambda r: r[-1]):
        own = heads.setdefault((up, lo), [])
        for n, (uc2, lc2, x, y, first) in enumerate(own):
            if (uc, lc) == (uc2, lc2) and abs(a - x) <= distance and abs(b - y) <= distance:
                out[ord_] = (first, n)
                break
        else:
            out[ord_] = (ord_, len(own))
            own.append((uc, lc, a, b, ord_))
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 10_000), (2, 0), (3, 40)])
def test_leaders_as_a_loop(spark, tmp_path, seed, most):
    pick, rows = random.Random(seed), []
    for i in range(1200):
        wide = pick.choice([60, 600, 3000])
        rows.append((pick.choice("AB"), "C", "c1", pick.choice(["c2", "c3"]), pick.randrange(-wide, wide), pick.randrange(wide), i * 3))
    rows += [(*pick.choice(rows)[:6], 5000 + i) for i in range(300)]  # equal points
    pick.shuffle(rows)
    table = spark.createDataFrame(rows, "up_gene string, lo_gene string, up_chrom string, lo_chrom string, up_bp long, lo_bp long, ord long")
    got = {r.ord: (r.leader, r.bp_group) for r in C.leaders(table, 30, f"file://{tmp_path}", most).collect()}
    assert got == brute(rows, 30)
    assert C.leaders(table.limit(0), 30, f"file://{tmp_path}/none", most).count() == 0


def test_order_along_the_places(spark, tmp_path):
    """The worst case for rounds: each point is near the one before it."""
    rows = [("A", "B", "c", "c", 20 * i, 20 * i, i) for i in range(14)]
    table = spark.createDataFrame(rows, "up_gene string, lo_gene string, up_chrom string, lo_chrom string, up_bp long, lo_bp long, ord long")
    got = {r.ord: (r.leader, r.bp_group) for r in C.leaders(table, 30, f"file://{tmp_path}", 0).collect()}
    assert got == brute(rows, 30)
