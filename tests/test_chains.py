"""Regions, and the second alignment: minimisers, chains and hits against brute force and planted reads."""

import itertools
import random

import numpy as np
import pytest

from weftline.operators import chains as C
from weftline.operators import regions as R

BACK = str.maketrans("ACGT", "TGCA")


def dna(seed, n):
    return "".join(random.Random(seed).choices("ACGT", k=n))


def test_minimizers():
    text = dna(1, 500)
    for k, w in ((5, 1), (16, 5), (7, 10)):
        at, found, reverse = C.picked(text.encode(), k, w)
        every, hashes, _ = C.picked(text.encode(), k, 1)
        value = dict(zip(every.tolist(), hashes.tolist()))
        want = {i for s in range(len(text) - k - w + 2) for i in range(s, s + w) if i in value and value[i] == min(value.get(j, 2**64) for j in range(s, s + w))}
        assert at.tolist() == sorted(want) and [value[i] for i in at.tolist()] == found.tolist()
        back_at, back_found, back_reverse = C.picked(text[::-1].translate(BACK).lower().encode(), k, w)
        assert sorted(zip((len(text) - k - back_at).tolist(), back_found.tolist(), (~back_reverse).tolist())) == sorted(zip(at.tolist(), found.tolist(), reverse.tolist()))
    assert len(C.picked(b"ACGTNACGTN", 5, 1)[0]) == 0 and len(C.picked(b"ACG", 5, 1)[0]) == 0
    assert len(C.picked("some text, not letters of DNA".encode(), 5, 3, dna=False)[0]) > 3


@pytest.mark.parametrize("seed", range(8))
def test_best_chain_is_best_of_all(seed):
    """Against every subset of the anchors."""
    pick, k = np.random.default_rng(seed), 6
    q, r = pick.integers(0, 60, 11), pick.integers(0, [60, 400][seed % 2], 11)
    best = 0.0
    for n in range(1, 12):
        for own in itertools.combinations(range(11), n):
            own = sorted(own, key=lambda i: (r[i], q[i]))
            dq, dr = np.diff(q[own]), np.diff(r[own])
            if (dq > 0).all() and (dr > 0).all() and (dq <= 25).all() and (dr <= 150).all():
                best = max(best, k + float(C.step(dq, dr, k).sum()))
    got = C.best_chains(q, r, k, 25, 150, 0, 1)
    assert got[0][0] == pytest.approx(best) and sum(x[1] for x in got) <= 11


@pytest.mark.parametrize("seed", range(4))
def test_scores_without_windows(seed):
    pick, k = np.random.default_rng(seed), 16
    q, r = pick.integers(0, 3000, 300), np.sort(pick.integers(0, 300_000, 300))
    order = np.lexsort((q, r))
    q, r = q[order], r[order]
    got, _ = C.chained(q, r, k)
    want = []
    for i in range(300):
        options = [want[j] + float(C.step(q[i] - q[j], r[i] - r[j], k)) for j in range(i) if 0 < q[i] - q[j] <= C.READ_GAP and 0 < r[i] - r[j] <= C.REFERENCE_GAP]
        want.append(max([float(k), *options]))
    assert got.tolist() == pytest.approx(want)


def test_masked_chains():
    rows = [(100.0, "a", 0, 100), (85.0, "b", 10, 90), (70.0, "c", 20, 80), (60.0, "d", 95, 200), (30.0, "e", 150, 199)]
    assert [x[1] for x in C.kept(rows)] == ["a", "b", "d"]


def noisy(seq, seed, rate):
    pick, out = random.Random(seed), []
    for x in seq:
        roll = pick.random()
        if roll < rate / 3:
            continue
        out.append(pick.choice("ACGT") if roll < 2 * rate / 3 else x)
        if roll > 1 - rate / 3:
            out.append(pick.choice("ACGT"))
    return "".join(out)


def test_hits_of_planted_reads(spark):
    """Spliced reads of two genes, on either strand and with errors: hits end near the planted places."""
    gene = {"A": dna(1, 30_000), "B": dna(2, 30_000), "C": dna(3, 5000)}
    exon = lambda g, *spans: "".join(gene[g][a:b] for a, b in spans)
    a, b = exon("A", (1000, 1400), (9000, 9300), (20_000, 20_300)), exon("B", (500, 900), (25_000, 25_400))[::-1].translate(BACK)
    rows = [("clean", a + b), ("noisy", noisy(a, 5, 0.05) + noisy(b, 6, 0.05)), ("alone", a), ("none", dna(9, 800)), ("null", None), ("short", "ACGT"), ("other", gene["C"][:1000])]
    reads = spark.createDataFrame(rows, "read_id string, seq string")
    references = spark.createDataFrame(list(gene.items()), "ref_id string, seq string")
    got = {}
    for r in C.align(reads, references).collect():
        got.setdefault((r.id, r.ref_id), []).append(r)
    assert set(got) == {("clean", "A"), ("clean", "B"), ("noisy", "A"), ("noisy", "B"), ("alone", "A"), ("other", "C")}
    assert all(len(x) == 1 for x in got.values())
    for name, split in (("clean", len(a)), ("noisy", len(noisy(a, 5, 0.05)))):
        up, lo = got[name, "A"][0], got[name, "B"][0]
        assert (up.reverse, lo.reverse) == (False, True)
        slack = 5 if name == "clean" else 40
        assert up.q_st <= slack and abs(up.q_en - split) <= slack and abs(lo.q_st - split) <= slack
        assert abs(up.r_st - 1000) <= slack and abs(up.r_en - 20_300) <= slack and abs(lo.r_st - 500) <= slack and abs(lo.r_en - 25_400) <= slack
        assert up.blen == up.q_en - up.q_st
    # Only what is asked for, and reads cut where it says.
    asked = spark.createDataFrame([(1, "clean", "B", None), (2, "clean", "A", 500), (3, "other", "A", None)], "id long, read_id string, ref_id string, read_length long")
    cut = {(r.id, r.ref_id): r for r in C.align(reads, references, asked).collect()}
    assert set(cut) == {(1, "B"), (2, "A")} and cut[2, "A"].q_en <= 500


def test_hot_minimizers(spark):
    rows = [(h, i) for h in range(20_000) for i in range(1 if h else 500)] + [(-1, i) for i in range(9)]
    found = C.without_hot(spark.createDataFrame(rows, "hash long, at long"))
    counts = {r["hash"]: r["count"] for r in found.groupBy("hash").count().collect()}
    assert 0 not in counts and counts[-1] == 9 and len(counts) == 20_000
    assert C.without_hot(spark.createDataFrame([], "hash long, at long")).count() == 0


def brute_merged(rows):
    out = []
    for s, a, b in sorted(rows):
        if out and out[-1][0] == s and a <= out[-1][2] + 1:
            out[-1] = (s, out[-1][1], max(out[-1][2], b), out[-1][3] + 1)
        else:
            out.append((s, a, b, 1))
    return out


def test_regions(spark):
    pick, piece = random.Random(4), 50
    genome = {"c1": dna(11, 3000), "c2": dna(12, 49), "c3": dna(13, 50)}
    rows = [(f"g{i}", pick.choice(["c1", "c2", "c3", "lost"]), a := pick.randint(1, 3000), a + pick.randint(0, 200)) for i in range(80)]
    rows += [(None, "c1", 1, 2), ("gn", None, 1, 2), ("gz", "c1", None, 2), rows[0]]
    genes = spark.createDataFrame([(*r, "x") for r in rows], "gene string, chrom string, start long, end long, seq string")
    named = R.gene_regions(genes, 20)
    got = {(r.gene, r.header): (r.seq_id, r["from"], r["to"]) for r in named.collect()}
    assert got == {(g, f"{c}:{g}:{max(1, a - 20)}-{b + 20}"): (c, max(1, a - 20), b + 20) for g, c, a, b in rows if None not in (g, c, a)}
    assert sorted(map(tuple, R.merged(named).select("seq_id", "from", "to", "n").collect())) == brute_merged(got.values())
    pieces = []
    for name, seq in genome.items():
        for i in range(0, len(seq), piece):
            cut = pick.randint(0, piece)  # a piece in two rows, as at the border of a reader's range
            pieces += [(name, i + 1 + a, x) for a, x in ((0, seq[i : i + cut]), (cut, seq[i + cut : i + piece])) if x]
    table = spark.createDataFrame(pieces, "seq_id string, at long, part string")
    found = {r.header: r.seq for r in R.region_sequences(named, table, piece).collect()}
    want = {h: genome[c][a - 1 : b] for (_, h), (c, a, b) in got.items() if genome.get(c, "")[a - 1 : b]}
    assert found == want
    lines = [r.value for r in R.fasta(R.region_sequences(named, table, piece)).collect()]
    assert {x.split("\n")[0][1:]: "".join(x.split("\n")[1:]) for x in lines} == want
    assert all(len(p) == R.LINE for x in lines for p in x.split("\n")[1:-1]) and not any(x.endswith("\n") for x in lines)
    assert R.cut(named.limit(0), table, piece).count() == 0 and R.cut(named, table.limit(0), piece).count() == 0


def test_ranges_far_beyond_a_sequence(spark):
    """A range asks for no more pieces than its sequence has."""
    from weftline.operators import regions as R

    pieces = spark.createDataFrame([("a", 1, "ACGT"), ("a", 5, "TT")], "seq_id string, at bigint, part string")
    ranges = spark.createDataFrame([("a", 3, 10**13), ("a", 7, 10**13), ("b", 1, 2)], "seq_id string, from bigint, to bigint")
    assert [tuple(r) for r in R.cut(ranges, pieces, 4).collect()] == [("a", 3, 10**13, "GTTT")]
