"""Running values along an order of the whole table, in two levels: rows are dealt into ranges of the order, each range is one
window partition, and only a row a range is brought together. No task ever sorts the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGE = "_range"


def ranged(rows: DataFrame, order: str) -> DataFrame:
    """Adds RANGE, which grows with the whole number ``order``; the bounds are quantiles, at most one a shuffle partition. Null orders are in the first range."""
    n = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bounds = rows.agg(F.percentile_approx(order, [i / n for i in range(1, n)], 10_000).alias("b")).first()["b"]
    inside = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < F.col(order))) if bounds else F.lit(0)
    return rows.withColumn(RANGE, F.greatest(inside, F.lit(0)))


def before(ranges: DataFrame, value: Column) -> DataFrame:
    """(RANGE, base): the sum of value over all smaller ranges. ranges has a row a range."""
    w = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(ranges.select(RANGE, F.coalesce(F.sum(value).over(w), F.lit(0)).alias("_base")))


def running_total(rows: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over all rows up to and with this one."""
    dealt = ranged(rows, order).withColumn("_value", value)
    base = before(dealt.groupBy(RANGE).agg(F.sum("_value").alias("n")), F.col("n"))
    w = Window.partitionBy(RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("_within", F.sum("_value").over(w)).join(base, RANGE).withColumn(name, F.col("_base") + F.col("_within")).drop(RANGE, "_value", "_within", "_base")


def runs(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds run_id: the number of changes of key up to and with this row; a null key always is one."""
    w = Window.partitionBy(RANGE).orderBy(*order)
    dealt = ranged(rows, order[0])
    ends = dealt.groupBy(RANGE).agg(F.max_by(F.struct(F.col(key).alias("k")), F.struct(*order)).alias("end"))
    last = F.broadcast(ends.select(RANGE, F.lag("end").over(Window.orderBy(RANGE)).alias("_last")))
    previous = F.coalesce(F.lag(F.struct(F.col(key).alias("k"))).over(w), F.col("_last"))["k"]
    marked = dealt.join(last, RANGE).withColumn("_changed", F.coalesce((F.col(key) != previous).cast("int"), F.lit(1))).drop("_last")
    base = before(marked.groupBy(RANGE).agg(F.sum("_changed").alias("n")), F.col("n"))
    return marked.withColumn("_within", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(base, RANGE).withColumn("run_id", F.col("_base") + F.col("_within")).drop(RANGE, "_changed", "_within", "_base")
