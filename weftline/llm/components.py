"""Connected components by alternating large-star and small-star steps, each written to the shared folder.

Every step is a grouped minimum and a join back, so a node with any number of neighbours is never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(id, component) of all ids in edges (a, b): the component is its smallest id. Loops and repeated edges do no harm."""
    cols = edges.columns
    now = edges.select(F.col(cols[0]).alias("a"), F.col(cols[1]).alias("b")).where("a <> b").distinct()
    now, before, turn = written(now, folder, f"{name}-0"), None, 0
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if not state["n"] or state == before:
            break
        before, turn = state, turn + 1
        # Large star: every larger neighbour of u meets the smallest of u and its neighbours.
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: u and its smaller neighbours meet the smallest of these; all edges of the large star point down.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(small, folder, f"{name}-{turn}")
    # At the end every edge points from an id to its component's smallest id.
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
