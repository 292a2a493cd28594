"""The n-gram Jaccard join against brute force, with repeated rows in other partitions, ids with several texts and null ids."""

import random

import pytest

pytest.importorskip("weftline.llm")


def brute(rows, n, percent):
    """doc_id -> (set size, component); of an id with several texts the largest set counts."""
    sets = {}
    for d, t in rows:
        w = (t or "").lower().split()
        s = frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()
        if d is not None and len(s) >= len(sets.get(d, ())):
            sets[d] = s
    label = {d: d for d in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {d: (len(s), label[d]) for d, s in sets.items()}


def table(seed):
    pick, out = random.Random(seed), []
    words = [f"w{i}" for i in range(300)]
    for g in range(12):
        base = pick.choices(words, k=pick.choice([12, 30, 70, 100]))
        for _ in range(pick.choice([1, 3, 8])):  # copies with edits about the threshold, growing away from each other
            own = base[:]
            for _ in range(pick.randrange(4)):
                own[pick.randrange(len(own))] = pick.choice(words)
            out.append(" ".join(own[pick.randrange(2) :]))
            if pick.random() < 0.5:
                base = own
    a = pick.choices(words, k=100)
    out += [" ".join(a), " ".join(a[:70] + pick.choices(words, k=30)), None, "", " \n ", "one", "ONE", "one two"]
    return list(enumerate(out))


@pytest.mark.parametrize("n, percent, seed", [(4, 85, 1), (5, 80, 2), (1, 60, 3)])
def test_repeated_rows(spark, n, percent, seed):
    from weftline.llm import jaccard

    rows = table(seed)
    shorter = [(d, " ".join((t or "").split()[:-9])) for d, t in rows if t and len(t.split()) > 40][::3]
    whole = spark.createDataFrame([*rows, *shorter, (None, rows[0][1])], "doc_id long, text string")
    df = whole.unionByName(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).unionByName(whole)
    got = jaccard.joined(df, n=n, percent=percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute([*rows, *shorter], n, percent)
    assert len(got) == len(rows)


def test_blocks_allow_every_link():
    """Brute force over sizes and first shared positions: whatever can link lies in blocks that are joined."""
    from math import floor, log

    from weftline.llm import jaccard

    for percent in (60, 80, 85, 95):
        kept, width, step = set(jaccard.allowed(percent)), jaccard.block_width(percent), log(100 / percent)
        for a in range(1, 60):
            for b in range(1, 60):
                need = -(-(a + b) * percent // (100 + percent))
                for i in range(a - need + 1):
                    for j in range(b - need + 1):
                        bands = floor(log(b) / step) - floor(log(a) / step)
                        assert (floor(i / a / width + 1e-9), bands, floor(j / b / width + 1e-9)) in kept


def test_members_that_are_parts_of_their_leader(spark):
    """A set within its leader, which has more words: it links to a set that its leader does not."""
    from weftline.llm import jaccard

    words = [f"w{i}" for i in range(140)]
    texts = [" ".join(words[:106]), " ".join(words[:96]), " ".join(words[:90]), " ".join(words[100:140] + words[:66])]
    rows = list(enumerate(texts))
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string"), n=1, percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 1, 85)
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 0, 3: 3}


def test_copies_far_from_their_leader_make_few_pairs(spark, tmp_path):
    """Near copies of one text with too many edits to link: single sets that the common leader tells apart aren't compared with each other."""
    from weftline.llm import jaccard
    from weftline.llm.common import text_columns

    pick, rows = random.Random(5), [(0, " ".join(f"w{i}" for i in range(150)))]
    for d in range(1, 81):
        own = rows[0][1].split()
        # The first 40 without a link to the leader, the others with one; a few share an edit.
        for k, at in enumerate(pick.sample(range(0, 150, 5), 6 if d <= 40 else 3)):
            own[at] = f"own{d % 70}x{k}" if k else f"edit{d % 9}"
        rows.append((d, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.joined(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 4, 85)
    ids = text_columns(docs)
    table = jaccard.set_table(ids, 4)
    jaccard.linked_sets(jaccard.shared_sets(ids, table, 4, 85), 85, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/tops").count() < 200
