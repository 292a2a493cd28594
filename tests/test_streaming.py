"""The stream of GAF files against the batch answer."""

import random
import time

import pytest
from pyspark.sql import functions as F

from weftline.operators import reads
from weftline.streaming import reads as S


def line(pick, name, start):
    items = [f"chr{pick.randint(1, 3)}:G{pick.randint(1, 9)}:{pick.randint(1, 99)}-{pick.randint(100, 200)}" for _ in range(pick.randint(1, 3))]
    path = ">" + ">".join(items)
    return "\t".join(map(str, (name, 5000, start, start + 50, "+", path, 400, 0, 50, 50, 50, pick.randint(0, 60), "tp:A:P")))


def batch(spark, folder):
    """What the batch operators give for all files."""
    rows = S.records(spark.read.text(folder).select(F.lit(0).cast("bigint").alias("line_no"), "value")).withColumn("ord", F.lit(0).cast("bigint"))
    own = reads.grouped(rows).select("read_id", F.size("recs").cast("bigint").alias("n"), F.transform("recs", lambda r: F.struct(*(r[c].alias(c) for c in S.FIELDS))).alias("recs"))
    return sorted(map(repr, own.collect()))


def test_stream_as_batch(spark, tmp_path):
    pick, folder, out, check = random.Random(1), f"{tmp_path}/gaf", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    (tmp_path / "gaf").mkdir()
    starts = {f"r{i}": pick.sample(range(4000), pick.choice([1, 1, 2, 3, 6])) for i in range(40)}
    every = [line(pick, n, s) for n, x in starts.items() for s in x] + ["no record", "r1\ttoo\tshort"]
    pick.shuffle(every)
    parts = [every[i::5] for i in range(5)]

    def add(n):
        (tmp_path / "gaf" / f"{n}.gaf").write_text("\n".join(parts[n]) + "\n")

    def answer():
        S.follow(spark, f"file://{folder}", out, check, files_a_batch=1).awaitTermination(120)
        return sorted(map(repr, S.latest(spark, out).select("read_id", "n", "recs").collect()))

    for n in range(3):
        add(n)
    assert answer() == batch(spark, folder)
    assert answer() == batch(spark, folder)  # nothing new
    for n in (3, 4):
        add(n)
    got = answer()
    assert got == batch(spark, folder) and len(got) == sum(len(x) > 1 for x in starts.values())


def test_forgotten_reads(spark, tmp_path):
    """A read that is quiet for long enough begins anew."""
    pick, out = random.Random(2), f"file://{tmp_path}/out"
    (tmp_path / "gaf").mkdir()
    with pytest.raises(ValueError, match="once"):
        S.follow(spark, f"file://{tmp_path}/gaf", out, f"file://{tmp_path}/check", quiet_ms=1000)
    query = S.follow(spark, f"file://{tmp_path}/gaf", out, f"file://{tmp_path}/check", quiet_ms=1000, once=False)

    def seen(n, values, wanted):
        (tmp_path / "gaf" / f"{n}.gaf").write_text("\n".join(values) + "\n")
        for _ in range(120):
            found = {r.read_id for r in S.latest(spark, out).collect()} if (tmp_path / "out").exists() else set()
            if wanted in found:
                return found
            time.sleep(0.5)
        raise AssertionError(wanted)

    try:
        assert seen(0, [line(pick, "a", 0), line(pick, "a", 100), line(pick, "b", 0)], "a") == {"a"}
        time.sleep(8)
        assert seen(1, [line(pick, "b", 100), line(pick, "c", 0), line(pick, "c", 100)], "c") == {"a", "c"}
    finally:
        query.stop()


def test_groups_without_python(spark):
    """Reads that are kept for good are grouped by Spark's aggregate, not by a Python call a read; ties are in the order of all fields."""
    pick = random.Random(3)
    values = [line(pick, "r", s) for s in (7, 7, 2)]
    rows = S.records(spark.createDataFrame([(0, v) for v in values], "line_no bigint, value string"))
    got = S.grouped(rows)
    assert "InPandas" not in got._jdf.queryExecution().toString()
    (r,) = got.collect()
    assert (r.n, [x.read_start for x in r.recs]) == (3, [2, 7, 7]) and r.recs == sorted(r.recs)
