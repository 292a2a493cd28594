"""Consensus: the banded alignment against a full one, and known answers from noisy reads."""

import random
import time

import numpy as np
import pytest

from weftline.operators import consensus as C


def full_score(a, b):
    rows = [[j * C.GAP for j in range(len(a) + 1)]]
    for i in range(1, len(b) + 1):
        row = [i * C.GAP]
        for j in range(1, len(a) + 1):
            row.append(max(rows[-1][j - 1] + (C.MATCH if a[j - 1] == b[i - 1] else C.MISMATCH), rows[-1][j] + C.GAP, row[-1] + C.GAP))
        rows.append(row)
    return rows[-1][-1]


def noisy(seq, pick, rate):
    out = []
    for x in seq:
        roll = pick.random()
        if roll < rate / 3:
            continue
        out.append(pick.choice("ACGT") if roll < 2 * rate / 3 else x)
        if roll > 1 - rate / 3:
            out.append(pick.choice("ACGT"))
    return "".join(out)


@pytest.mark.parametrize("seed", range(5))
def test_scores_as_full_alignment(seed):
    pick = random.Random(seed)
    draft = "".join(pick.choices("ACGT", k=pick.randint(1, 60)))
    texts = ["".join(pick.choices("ACGT", k=pick.randint(1, 60))) for _ in range(20)] + [draft, noisy(draft * 2, pick, 0.2) or "A", "T", "é日"]
    scores, letters, behind = C.aligned([C.codes(draft)] * len(texts), [C.codes(t) for t in texts])
    assert scores.tolist() == [full_score(draft, t) for t in texts]
    for r, t in enumerate(texts):  # the alignment found has that score, and every letter of the text a place
        own = {(p, i): chr(x) for q, p, i, x in behind if q == r}
        row = [chr(x) if x else "" for x in letters[r]]
        cost = sum(C.GAP if not x else C.MATCH if x == d else C.MISMATCH for x, d in zip(row, draft)) + C.GAP * len(own)
        assert cost == scores[r]
        late = lambda p: "".join(x for (q, _), x in sorted(own.items()) if q == p)  # noqa: E731, B023
        assert late(0) + "".join(x + late(p) for p, x in enumerate(row, 1)) == t


def counted(groups, drafts, texts):
    return {tuple(key): n for *key, n in zip(*(x.tolist() if hasattr(x, "tolist") else x for x in C.votes(np.array(groups), drafts, texts)))}


def test_votes_add_up():
    """The votes of batches, whatever groups they hold, add up to those of each group alone."""
    pick = random.Random(3)
    drafts = ["".join(pick.choices("ACGT", k=k)) for k in (80, 1, 33)]
    rows = [(g, noisy(drafts[g], pick, 0.15) or "T") for g in (pick.randrange(3) for _ in range(60))]
    add = {}
    for a in range(0, 60, 7):
        part = rows[a : a + 7]
        for key, n in counted([g for g, _ in part], [drafts[g] for g, _ in part], [t for _, t in part]).items():
            add[key] = add.get(key, 0) + n
    alone, by_place = {}, {}
    for g in range(3):
        texts = [t for x, t in rows if x == g]
        alone |= counted([g] * len(texts), [drafts[g]] * len(texts), texts)
    assert add == alone
    for (g, place, late, symbol, own), n in add.items():
        if not late:
            assert own == (symbol == drafts[g][place - 1])
            by_place[g, place] = by_place.get((g, place), 0) + n
    assert by_place == {(g, p + 1): sum(x == g for x, _ in rows) for g in range(3) for p in range(len(drafts[g]))}


def test_known_answers(spark, tmp_path):
    pick = random.Random(5)
    truth, rows = {}, []
    for c, (reads, size) in enumerate([(1, 50), (2, 60), (3, 200), (25, 400), (150, 120)]):
        truth[c] = ["".join(pick.choices("ACGT", k=size)) for _ in range(2)]
        rows += [(c, k, *(x if reads < 3 else noisy(x, pick, 0.02 if reads < 10 else 0.1) for x in truth[c])) for k in range(reads)]
    rows += [(90, 0, None, "ACGT"), (91, 0, "", None), (92, 0, "GG", ""), (92, 1, "GG", "A"), rows[-1]]
    table = spark.createDataFrame(pick.sample(rows, len(rows)), "candidate long, ord long, upper string, lower string")
    got = {r.candidate: (r.upper, r.lower) for r in C.consensus(table, f"file://{tmp_path}/a").collect()}
    assert {k: got[k] for k in (90, 91, 92)} == {90: ("", "ACGT"), 91: ("", ""), 92: ("GG", "A")}
    for c, want in truth.items():
        for a, b in zip(got[c], want):
            lost = (C.MATCH * len(b) - full_score(b, a)) / 3
            assert lost <= (0 if c < 2 else 0.01 * len(b)), (c, lost)
    assert C.consensus(table.limit(0), f"file://{tmp_path}/b").count() == 0


def test_one_candidate_with_most_reads(spark, tmp_path):
    pick = random.Random(8)
    truth = ["".join(pick.choices("ACGT", k=40)) for _ in range(2)]
    rows = [(7, k, *(noisy(x, pick, 0.1) for x in truth)) for k in range(5000)] + [(8, k, "ACGT", "TTTT") for k in range(3)]
    began = time.time()
    got = {r.candidate: [r.upper, r.lower] for r in C.consensus(spark.createDataFrame(rows, "candidate long, ord long, upper string, lower string"), f"file://{tmp_path}").collect()}
    assert got == {7: truth, 8: ["ACGT", "TTTT"]}
    assert time.time() - began < 300


def test_long_sequences_in_a_band():
    pick = random.Random(9)
    truth = "".join(pick.choices("ACGT", k=3000))
    texts = [noisy(truth, pick, 0.1) for _ in range(6)] + [truth[400:]]
    scores, letters, _ = C.aligned([C.codes(truth)] * len(texts), [C.codes(t) for t in texts])
    assert (letters == C.codes(truth)).mean(axis=1).min() > 0.85
    assert (letters[-1][:400] == 0).mean() > 0.95 and scores[-1] == C.MATCH * 2600 + C.GAP * 400
    assert np.abs(scores[:-1] - C.MATCH * 3000).max() < 0.7 * C.MATCH * 3000


def test_repeated_texts_are_aligned_once(monkeypatch):
    """times counts as that many equal texts, and texts that equal their draft aren't aligned."""
    pick = random.Random(4)
    drafts = ["".join(pick.choices("ACGT", k=k)) for k in (60, 25)]
    rows = [(g, t) for g in (0, 1) for t in (drafts[g], noisy(drafts[g], pick, 0.1) or "T", drafts[g][3:])]
    times = [5, 2, 1, 3, 1, 4]
    once = {tuple(key): n for *key, n in zip(*(x.tolist() if hasattr(x, "tolist") else x for x in C.votes(np.array([g for g, _ in rows]), [drafts[g] for g, _ in rows], [t for _, t in rows], np.array(times))))}
    many = [row for row, k in zip(rows, times) for _ in range(k)]
    assert once == counted([g for g, _ in many], [drafts[g] for g, _ in many], [t for _, t in many])
    monkeypatch.setattr(C, "aligned", None)
    assert counted([0, 0, 1], [drafts[0], drafts[0], drafts[1]], [drafts[0], drafts[0], drafts[1]]) == {(g, p + 1, False, x, True): 2 - g for g in (0, 1) for p, x in enumerate(drafts[g])}
