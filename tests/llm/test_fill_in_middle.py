"""Chunked cuts against plain slicing, and op11's rows against a brute-force version."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("weftline.llm")

ALPHABET = list("abc é日𝄞́\n\t<>PSM") + ["<P>", " word"]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1024])
def test_cuts_by_chunks(chunk):
    from weftline.llm import middle as M

    pick = np.random.default_rng(chunk)
    texts = ["".join(pick.choice(ALPHABET, pick.integers(0, 60))) for _ in range(200)]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    split = {
        "code point": list,
        "line": lambda t: [x for x in t.replace("\n", "\n\0").split("\0") if x],
        "word": lambda t: word_units(t),
    }
    for unit, cut in split.items():
        got = M.Cutter(data, offsets, unit, chunk)
        units = [cut(t) for t in texts]
        assert got.units.tolist() == [len(u) for u in units]
        ranks = np.array([pick.integers(0, len(u) + 1) for u in units])
        assert (got.places(ranks) - offsets[:-1]).tolist() == [len("".join(u[:r]).encode()) for u, r in zip(units, ranks)]


def word_units(text):
    out = []
    for i, c in enumerate(text):
        if i == 0 or text[i - 1] in " \t\n\v\f\r" and c not in " \t\n\v\f\r":
            out.append("")
        out[-1] += c
    return out


def wanted(doc_id, text):
    text = text or ""
    n, h = len(text), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, digest(text), digest(text)
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc_id, n, form, a, b - a, digest(out), digest(text)


def test_rows_as_brute_force(spark, tmp_path):
    from weftline.llm.queries import QUERIES

    pick = np.random.default_rng(3)
    rows = [(i, "".join(pick.choice(ALPHABET[:-2], pick.integers(0, 200)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "no <S> mark"), (1003, "é" * 2_500_000), (1004, "ab<" * 9000), (5, rows[5][1]), (6, "another text"), (-7, "below zero")]
    docs = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows] + [(None, "lost", "x", "y", 1, 2)], "doc_id long, text string, form string, output string, n long, h1 long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_fim"](spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((wanted(*r) for r in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    docs.limit(0).write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert QUERIES["op11_fim"](spark, f"{tmp_path}/empty").count() == 0


def test_other_units_and_marks(spark):
    from pyspark.sql import functions as F

    from weftline.llm import middle as M

    marks = ("(pre)", "[suf|", "*mid*")
    rows = [(i, f"line {i}\nsecond of it, word {i % 7}\n\nend" * (i % 5)) for i in range(200)] + [(999, "a (pre) b")]
    for unit in M.UNITS:
        out = M.transformed(spark.createDataFrame(rows, "key long, body string"), unit, 0, 50, marks, "7:", "key", "body")
        got = {r.doc_id: r for r in out.withColumn("back", M.restored(F.col("output"), F.col("form"), marks)).collect()}
        assert all(got[i].back == t for i, t in rows)
        assert all((got[i].form == "plain") == (not t or "(pre)" in t) for i, t in rows)
