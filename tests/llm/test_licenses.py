"""License scans against brute force: every block, every template, labels and score."""

import random
import re

import pytest

pytest.importorskip("weftline.llm")

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BETWEEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return BETWEEN.findall(text.translate(UPPER))


def blocks(w, span):
    half = span // 2
    return [(i, set(w[i : i + span])) for i in range(0, max(len(w) - half, 1), half)]


def found(text, templates, threshold=0.8, block=48):
    """{(span, block, template): (containment, shared)} by trying all."""
    out, w = {}, words(text)
    for k, (_, template) in enumerate(templates):
        t, span = words(template), block
        while span // 2 < len(t):
            span *= 2
        for i, here in blocks(w, span):
            both = here & set(t)
            if len(both) >= threshold * len(set(t)) - 1e-9:
                out[span, i, k] = (len(both) / len(set(t)), both)
    return out


def labels(text, templates, phrases):
    hits, w = found(text, templates), words(text)
    own = {label for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()}
    more = set()
    for (span, i, k), (c, both) in hits.items():
        better = [both2 for (s2, i2, _), (c2, both2) in hits.items() if (s2, i2) == (span, i) and c2 > c]
        if not both <= set().union(*better):
            more.add(templates[k][0])
    return ",".join(sorted(own | more)), 1.0 if own else max((c for c, _ in hits.values()), default=0.0)


def corpus():
    from weftline.llm import licenses

    pick = random.Random(11)
    fill = lambda n: " ".join(pick.choices([f"w{i}" for i in range(90)] + ["the", "of", "License", "and", "software", "été"], k=n))
    out = [None, "", " .. ", "license", "the of and", fill(30_000)]
    for _, t in licenses.TEMPLATES:
        parts = t.split(" ")
        out.append(t)
        for keep in (0.95, 0.88, 0.8, 0.7):  # edited: words lost, others put in, at any place of a text
            own = [x if pick.random() < keep else pick.choice(["", f"w{pick.randrange(90)}"]) for x in parts]
            out.append(f"{fill(pick.randint(0, 70))}\n{' '.join(own)}. {fill(pick.randint(0, 70))}")
    for _ in range(30):  # two notices in one text
        (_, a), (_, b) = pick.sample(licenses.TEMPLATES, 2)
        out.append(f"{fill(pick.randint(0, 20))} {a} {fill(pick.randint(0, 3))} {b.upper()}")
    return out + [out[6], out[6]]


def test_labels_and_score(spark):
    from weftline.llm import licenses

    texts = corpus()
    # The last two rows repeat an id: once with its text, once with another's.
    table = [(i if i < len(texts) - 2 else 6 + i % 2, t, "clash", 1.0, "clash") for i, t in enumerate(texts)] + [(None, licenses.TEMPLATES[0][1], "", 0.0, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string, labels string, score double, words string").repartition(5)
    got = sorted((r.doc_id, r.n_words, r.labels, r.score) for r in licenses.scan(docs).collect())
    want = sorted((d, len(words(t or "")), *labels(t or "", licenses.TEMPLATES, licenses.PHRASES)) for d, t, *_ in table if d is not None)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_every_block(spark):
    from pyspark.sql import functions as F
    from weftline.llm import licenses

    texts = [t or "" for t in corpus()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    for threshold in (0.8, 0.5):
        got = {(r.doc_id, r.span, r.block, r.template): (round(r.containment, 9), set(r.shared)) for r in licenses.template_join(rows, threshold=threshold).collect()}
        want = {(d, *k): (round(c, 9), both) for d, t in enumerate(texts) for k, (c, both) in found(t, licenses.TEMPLATES, threshold).items()}
        assert got == want


def test_second_notice(spark):
    """An edited notice beside a whole one is kept; the relatives of a whole one are not labelled."""
    from weftline.llm import licenses

    lesser = "licensed under the gnu lesser general public license"
    texts = [lesser, lesser + " and offered under the mozilla terms: subject to terms of the mozilla public license v 2 0", licenses.TEXTS[1][1], licenses.TEXTS[4][1] + " " + licenses.TEXTS[6][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == ["lgpl", "lgpl,mpl", "lgpl", "bsd,mit"]


def test_no_words(spark):
    from weftline.llm import licenses

    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="no words"):
        licenses.scan(docs, templates=[("x", " - ")])
    assert [r.labels for r in licenses.scan(docs, templates=[("x", "a")]).collect()] == ["x"]
