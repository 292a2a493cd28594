"""The block-max search against a scan of all cosines, with ties, copies and many blocks."""

import numpy as np
import pytest

pytest.importorskip("weftline.llm")


def unit(rows):
    return (rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))).astype(np.float32)


@pytest.mark.parametrize("n, seed", [(1, 0), (30, 1), (1500, 2)])
def test_nearest(n, seed):
    from weftline.llm import toxicity

    pick = np.random.default_rng(seed)

    def make(k):
        rows = np.zeros((k, toxicity.LEXICON + 1))
        for r in rows:
            r[pick.choice(40, pick.integers(0, 5), replace=False)] = pick.integers(1, 4)
            r[-1] = pick.integers(1, 3)
        return unit(rows)

    rows, labels, queries = make(n), pick.integers(0, 2, n), make(200)
    index = toxicity.Index(np.arange(n) * 7, labels, rows)
    assert index.n.sum() == n and index.ones.sum() == labels.sum()
    share, near, cosines = index.votes(queries)
    for q, s, ids, best in zip(queries, share, near, cosines, strict=True):
        every = rows.astype(float) @ q.astype(float)
        mark = np.sort(every)[::-1][min(toxicity.NEIGHBOURS, n) - 1]
        own = every >= mark - toxicity.TIE  # all that tie with the last one
        weight = 1 / (1 - np.minimum(every[own], 1) + toxicity.NEAR)
        assert abs(s - (weight * labels[own]).sum() / weight.sum()) < 1e-3
        assert abs(best[0] - every.max()) < 1e-4 and abs(every[ids[0] // 7] - best[0]) < 1e-4


def test_calibration():
    from weftline.llm import toxicity

    pick = np.random.default_rng(3)
    share = pick.uniform(0, 1, 20_000)
    labels = pick.uniform(0, 1, 20_000) < share**2 / (share**2 + 4 * (1 - share) ** 2)  # odds squared and a quarter as high
    index = toxicity.Index(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, toxicity.LEXICON + 1), np.float32))
    index.calibrate(share, labels.astype(float))
    found = index.calibrated(share)
    for low in np.arange(0, 1, 0.1):
        own = (found >= low) & (found < low + 0.1)
        assert abs(found[own].mean() - labels[own].mean()) < 0.04
    assert (np.diff(index.calibrated(np.linspace(0.01, 0.99, 50))) > 0).all()


def test_edges(spark):
    from weftline.llm import toxicity

    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "plain words", 5), (3, "plain words", 5), (None, "x", 5)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(3, 1), (77, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    got = toxicity.predictions(docs, labels).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 3, 3] and all(0 <= r.score <= 1 for r in got)
    assert toxicity.predictions(docs.limit(0), labels).count() == 0
    assert toxicity.kept(docs, toxicity.fit(docs, labels.limit(0).withColumnRenamed("toxic", "label"))).count() == 5


def test_rows_that_stand_for_several_examples():
    from weftline.llm import toxicity

    pick = np.random.default_rng(4)
    rows = np.zeros((60, toxicity.LEXICON + 1))
    rows[:, :30] = pick.integers(0, 3, (60, 30))
    rows[:, -1] = 1
    rows, labels, times, ids = unit(rows), pick.integers(0, 2, 60), pick.integers(1, 9, 60), np.arange(60) * 10
    each = np.repeat(np.arange(60), times)
    one, every = toxicity.Index(ids, labels, rows, times), toxicity.Index(ids[each], labels[each], rows[each])
    assert one.n.tolist() == every.n.tolist() and one.ones.tolist() == every.ones.tolist() and one.ids.tolist() == every.ids.tolist()
    share = one.votes(rows)[0]
    assert np.allclose(share, every.votes(rows)[0])
    one.calibrate(share, labels, times)
    every.calibrate(share[each], labels[each])
    assert abs(one.slope - every.slope) < 1e-6 and abs(one.shift - every.shift) < 1e-6


def test_fit_keeps_the_counts_of_buckets_off_the_driver(spark):
    """The lexicon is that of brute force, and fitting takes less of the driver's memory than one count of all buckets."""
    import tracemalloc

    from weftline.llm import toxicity

    pick, rows = np.random.default_rng(5), []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, " ".join([f"calm{x}" for x in pick.integers(0, 500, 20)] + [f"{x}wretch" for x in pick.choice(list("abcdef"), 2)] * bad), int(bad)))
    sample = spark.createDataFrame([*rows, (400, "awretch", 2)], "doc_id long, text string, label long").repartition(5)
    zeros, ones = (np.zeros(1 << toxicity.BITS, np.int64) for _ in range(2))
    for _, text, label in rows:
        found = toxicity.stems(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        next(found)
        (ones if label else zeros)[np.unique(np.concatenate([bucket for bucket, _ in found]))] += 1
    expected = (ones + zeros) * (100 / 400)
    lean = np.where(ones >= toxicity.LEAST, (ones - expected) / np.sqrt(expected + 1), 0)
    order = np.argsort(-lean, kind="stable")[: toxicity.LEXICON]
    assert toxicity.leaning(sample).tolist() == order[lean[order] >= toxicity.LEAN].tolist() and len(order[lean[order] >= toxicity.LEAN]) > 6
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, label long").drop("label"), spark.createDataFrame(rows, "doc_id long, text string, label long").drop("text")
    tracemalloc.start()
    try:
        toxicity.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 << toxicity.BITS
