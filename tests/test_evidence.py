"""Confidence levels from assembled facts: a worked case for each branch of the rule, each on a chromosome of its own."""

import pytest

from weftline.operators import evidence

CODING, OTHER = "protein_coding", "lncRNA"
#: name: (upper gene, lower gene, further genes, hit of the upper side, genome hits, level); genes are (name, start, end, type).
#: The genome hit of a side is (start, end); None: the side has none.
NEAR_A, NEAR_B = ("A", 1_001, 2_000, CODING), ("B", 32_001, 33_000, CODING)
MIDDLE_B, FAR_B = ("B", 62_001, 63_000, CODING), ("B", 202_001, 203_000, CODING)
CASES = {
    "both checks, exact": (NEAR_A, NEAR_B, [], None, [(1_001, 2_000), (32_001, 33_000)], 5),
    "both checks, genome end 200 off": (NEAR_A, NEAR_B, [], None, [(1_001, 2_200), (32_001, 33_000)], 4),
    "both checks, a gene that doesn't code": (NEAR_A, ("B", 32_001, 33_000, OTHER), [], None, [(1_001, 2_000), (32_001, 33_000)], 4),
    "one genome hit, far apart": (NEAR_A, FAR_B, [], None, [(1_001, 2_000), None], 5),
    "no genome hit at all": (NEAR_A, FAR_B, [], None, [None, None], 3),
    "another gene between": (NEAR_A, NEAR_B, [("C", 5_000, 6_000, CODING)], None, [(1_001, 2_000), None], 5),
    "unnamed gene between, middle distance": (NEAR_A, MIDDLE_B, [("ENSG00000000001", 5_000, 6_000, CODING)], None, [(1_001, 2_000), None], 4),
    "unnamed gene between, near": (NEAR_A, NEAR_B, [("ENSG00000000001", 5_000, 6_000, CODING)], None, [(1_001, 2_000), None], 2),
    "read-through gene between, middle distance": (NEAR_A, MIDDLE_B, [("A-B", 5_000, 6_000, CODING)], None, [(1_001, 2_000), None], 4),
    "gene that doesn't code between": (NEAR_A, MIDDLE_B, [("C", 5_000, 6_000, OTHER)], None, [(1_001, 2_000), None], 2),
    "gene that only begins between": (NEAR_A, MIDDLE_B, [("C", 60_000, 70_000, CODING)], None, [(1_001, 2_000), None], 2),
    "none between": (NEAR_A, NEAR_B, [], None, [(1_001, 2_000), None], 2),
    "hit's gene overlaps and holds the path": (NEAR_A, NEAR_B, [("O", 900, 2_500, CODING)], "O:1500-2000", [(1_500, 2_000), (32_001, 33_000)], 5),
    "hit's gene overlaps, path begins outside": (NEAR_A, NEAR_B, [("O", 900, 2_500, CODING)], "O:950-2000", [(950, 2_000), None], 1),
    "hit's name holds the gene's": (NEAR_A, NEAR_B, [("A-AS1", 900, 2_500, CODING)], "A-AS1:950-2000", [(950, 2_000), (32_001, 33_000)], 5),
    "hit's end is no exon's end": (NEAR_A, NEAR_B, [], "A:1001-1900", [(1_001, 1_900), None], 1),
    "hit's end is no exon's end, both on the genome": (NEAR_A, NEAR_B, [], "A:1001-1900", [(1_001, 1_900), (32_001, 33_000)], 3),
}


@pytest.fixture(scope="module")
def levels(spark):
    genes, found, graph, genome = [], [], [], []
    for i, (up, lo, more, hit, places, _) in enumerate(CASES.values()):
        chrom = f"chr{i}"
        genes += [(n, chrom, "+", t, a, b, [a], [b]) for n, a, b, t in (up, lo, *more)]
        found.append((i, up[0], chrom, ">", up[2], f"{chrom}:A:1-2", lo[0], chrom, ">", lo[1], f"{chrom}:B:1-2", ["r"]))
        for n, (side, item) in enumerate((("upper", hit or f"{up[0]}:{up[1]}-{up[2]}"), ("lower", f"{lo[0]}:{lo[1]}-{lo[2]}"))):
            graph.append((i, side, n, f">{chrom}:{item}", [f"{chrom}:{item}"], 500, 0, 500))
        genome += [(i, n, chrom, p[0], p[1], False, False, 60) for n, p in enumerate(places) if p]
    frames = (
        spark.createDataFrame(found, "ord long, up_gene string, up_chrom string, up_sign string, up_bp long, up_path string, lo_gene string, lo_chrom string, lo_sign string, lo_bp long, lo_path string, reads array<string>"),
        spark.createDataFrame(graph, "id long, side string, line_no long, path string, items array<string>, ref_len long, ref_start long, ref_end long"),
        spark.createDataFrame(genome, "id long, line_no long, chrom string, start long, end long, is_reverse boolean, is_secondary boolean, mapq int"),
        spark.createDataFrame(genes, "gene string, chrom string, strand string, type string, start long, end long, f_exons array<long>, b_exons array<long>"),
        spark.createDataFrame([], "left_gene string, right_gene string, tags array<string>"),
    )
    rows = evidence.leveled(*frames).collect()
    assert len(rows) == len(CASES)
    return {r.ord: r for r in rows}


@pytest.mark.parametrize("name", CASES)
def test_level(levels, name):
    assert levels[list(CASES).index(name)].level == CASES[name][-1]


def test_breakpoints(levels):
    """Snapped to exon ends where the graph check holds, else to the genome's where that holds, else the candidate's own."""
    names = list(CASES)
    at = lambda name: (levels[names.index(name)].up_bp, levels[names.index(name)].lo_bp)
    assert at("both checks, genome end 200 off") == (2_000, 32_001)
    assert at("hit's end is no exon's end, both on the genome") == (2_000, 32_001)
    assert at("no genome hit at all") == (2_000, 202_001)
