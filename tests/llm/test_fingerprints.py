"""Fingerprints against a plain I-Match over sets of words."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("weftline.llm")


def test_components(spark):
    from weftline.llm import imatch
    from weftline.llm.words import words

    pick = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    texts = [" ".join(pick.choices(vocabulary, k=pick.randint(1, 60))) + " the" for _ in range(60)]
    texts += ["the", "", None, texts[0].upper(), " ".join(reversed(texts[1].split()))]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.fingerprint for r in imatch.fingerprint(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    sets = [set((t or "").lower().split()) for t in texts]
    df = {w: sum(w in s for s in sets) for w in set().union(*sets)}
    band = {w for w, n in df.items() if imatch.BAND[0] <= math.log(len(texts) / n) / math.log(len(texts)) <= imatch.BAND[1]}
    kept = [(s & band) or s for s in sets]

    def value(w, seed):
        raw = np.frombuffer(w.encode(), np.uint8)
        h = words(raw, np.array([0, len(raw)]))[0]
        return int(imatch.mix(h ^ np.uint64((seed + 1) * imatch.BASE & (1 << 64) - 1))[0])

    draws = {w: [value(w, seed) for seed in range(imatch.SEEDS)] for w in df}
    lexicons = [lambda w: True, *(lambda w, s=s, d=d: draws[w][s] >> (64 - d) == 0 for s in range(imatch.SEEDS) for d in range(1, imatch.DENSITIES + 1))]
    parts = [[frozenset(filter(f, k)) for f in lexicons] for k in kept]
    for i in range(len(rows)):
        for j in range(i):
            for k in range(imatch.LEXICONS):  # equal components just when the terms in the lexicon are equal, 0 just for none
                a, b = got[i][4 * k : 4 * k + 4], got[j][4 * k : 4 * k + 4]
                assert (a == b) == (parts[i][k] == parts[j][k])
                assert (a == "0000") == (not parts[i][k])
    assert got[0] == got[63] and got[1] == got[64]


def test_likeness():
    from weftline.llm import imatch

    a = np.array([[1, 2, 0, 0], [0, 0, 0, 0], [5, 6, 7, 8]], np.uint16)
    b = np.array([[1, 3, 0, 4], [0, 0, 0, 0], [5, 6, 7, 8]], np.uint16)
    assert imatch.likeness(a, b).tolist() == [1 / 3, 1.0, 1.0]
