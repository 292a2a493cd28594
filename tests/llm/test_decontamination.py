"""Decontamination against all windows of all documents, with reordered, edited and short passages."""

import math
import random
from collections import Counter

import pytest

pytest.importorskip("weftline.llm")


def grams(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(docs, items, similarity=0.8):
    """Best similarity of each pair that leaks, with the first window that has it."""
    sets = {i: grams(t.split()) for i, t in items}
    df = Counter(x for s in sets.values() for x in s)
    weight = lambda x: max(4, round(16 * math.log((len(items) + 1) / df[x]) / math.log(len(items) + 1))) if x in df else 16
    out = {}
    for d, t in docs:
        w = t.split()
        for i, text in items:
            n = len(text.split())
            for at in range(max(1, len(w) - n + 1)):
                win = grams(w[at : at + n])
                value = sum(map(weight, win & sets[i])) / sum(map(weight, win | sets[i]))
                if value >= similarity and value > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (value, at)
    return {k: (round(v, 6), at) for k, (v, at) in out.items()}


def test_windows(spark):
    from weftline.llm import decontamination

    pick = random.Random(11)
    make = lambda n: [f"t{pick.randrange(5000)}" for _ in range(n)]
    a, b, common = make(50), make(50), make(40)
    edited = a + b
    edited[30] = "other"
    again = (make(8) * 9)[:70]
    items = [(1, a + b), (2, ["one", "short", "item"]), (3, again), *((10 + i, common + make(60)) for i in range(4))]
    docs = [make(40) + b + a + make(40), b + a, make(15) + edited + make(20), a[:45] + b[:40], make(20) + ["one", "short", "item"] + make(20), make(3) + again[3:] + again[:5] + make(9), make(30) + items[3][1] + make(7), make(12) + common + make(90), make(4), make(9) + items[4][1][50:] + items[4][1][:50] + make(9)]
    docs, items = ([(k, " ".join(w)) for k, w in x] for x in (enumerate(docs), items))
    expected = brute(docs, items)
    assert {(0, 1), (1, 1), (4, 2)} <= set(expected)
    got = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start) for r in got} == expected
