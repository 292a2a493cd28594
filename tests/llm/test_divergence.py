"""The divergence audit against a brute-force version over dense counts."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("weftline.llm")

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, smoothing, scale, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", [t.translate(lower) for t in TERM.findall(text or "")]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        holding, counts = Counter(), defaultdict(Counter)
        for x, source, terms in docs:
            if x == lang:
                holding.update(set(terms))
                counts[source].update(terms)
        kept = [t for t, k in holding.items() if k >= min_docs]
        whole = sum(counts.values(), Counter())
        shares = lambda c: {t: 1 + scale * (c[t] + smoothing) // (sum(c[k] for k in kept) + smoothing * len(kept)) for t in kept}  # noqa: E731, B023
        q, p = shares(whole), {s: shares(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def corpus(seed, n):
    pick = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)] + ["Été", "été", "日本", "ABC", "abc"]
    rows = []
    for _ in range(n):
        lang, source = pick.choice(["en", "fr", ""]), f"s{int(pick.integers(0, 40) ** 2 // 200)}"
        weight = pick.dirichlet(np.full(len(vocabulary), 0.1))
        rows.append((str(lang), source, "\t1".join(pick.choice(vocabulary, pick.integers(0, 60), p=weight))))
    return rows


@pytest.mark.parametrize(("min_docs", "smoothing", "scale", "top"), [(30, 5, 1_000_000_000, 50), (1, 1, 1000, 3), (3, 2, 7, 50), (10_000, 5, 1_000_000_000, 50)])
def test_as_brute_force(spark, min_docs, smoothing, scale, top):
    from weftline.llm import divergence as D

    rows = corpus(min_docs, 300)
    rows += [(None, "s0", "wab wab"), ("en", None, "wac"), ("fr", "silent", None), ("fr", "empty", ""), ("xx", "alone", "waa wab"), *rows[:20], ("en", "s1", "wab " * 200_000 + "waa" * 300_000)]
    table = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], "l string, s string, t string, n long, term string, share long").repartition(7)
    got = D.audit(table, min_docs, smoothing, scale, top, "l", "s", "t").collect()
    assert sorted(map(tuple, got)) == brute(rows, min_docs, smoothing, scale, top)


def test_long_texts_in_parts(spark, monkeypatch):
    from weftline.llm import divergence as D

    text = "Abc déf, ab " * 50
    for most in (1, 2, 5, 64, 10_000):
        parts = list(D.parts(np.frombuffer(text.encode(), np.uint8), most))
        assert b"".join(x.tobytes() for x in parts).decode() == text
        assert sorted(t for x in parts for t in TERM.findall(x.tobytes().decode())) == sorted(TERM.findall(text))


def test_no_rows(spark):
    from weftline.llm import divergence as D

    assert D.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
