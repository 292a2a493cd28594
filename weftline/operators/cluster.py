"""Breakpoint clusters. Candidates have up_gene, lo_gene, ord, up_chrom, lo_chrom, up_bp, lo_bp, up_path, lo_path, score and read_id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PAIR = ["up_gene", "lo_gene"]


#: Points of a run that are folded one after the other; larger runs are worked on in rounds.
FOLDED = 2_000


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def leaders(candidates: DataFrame, distance: int, folder: str, most: int = FOLDED) -> DataFrame:
    """Adds leader (its ord) and bp_group: each row joins the first leader that is near, else it leads a new group.

    Order within a pair of genes is by ord. A leader has the same two chromosomes and an upper breakpoint within the distance,
    so points are led by pair, chromosomes and run of upper breakpoints without a wider gap; equal points are led once. Runs of up to
    ``most`` points are folded, larger ones led in rounds, with the same result. folder: for the tables of the steps.
    """
    keys = [*PAIR, "up_chrom", "lo_chrom"]
    points = candidates.groupBy(*keys, "up_bp", "lo_bp").agg(F.min("ord").alias("ord"))
    along = Window.partitionBy(*keys).orderBy("up_bp")
    points = points.withColumn("cut", (F.col("up_bp") - F.lag("up_bp").over(along) > distance).cast("int"))
    points = points.withColumn("run", F.coalesce(F.sum("cut").over(along), F.lit(0))).drop("cut")  # peers by range: equal breakpoints have one run
    points = written(points.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "run"))), folder, "points")
    led = folded(points.where(F.col("n") <= most), [*keys, "run"], distance)
    if (points.agg(F.max("n")).first()[0] or 0) > most:
        led = led.unionByName(in_rounds(points.where(F.col("n") > most).drop("n"), [*keys, "run"], distance, folder))
    led = led.drop("run")
    numbers = led.select(*PAIR, "leader").distinct().withColumn("bp_group", F.row_number().over(Window.partitionBy(*PAIR).orderBy("leader")) - 1)
    return candidates.join(led.join(numbers, [*PAIR, "leader"]), [*keys, "up_bp", "lo_bp"])


def folded(points: DataFrame, keys: list[str], distance: int) -> DataFrame:
    """keys, up_bp, lo_bp and leader: the leaders of a key's points by a fold over them in their order."""
    near = lambda a, b: (F.abs(a["up_bp"] - b["up_bp"]) <= distance) & (F.abs(a["lo_bp"] - b["lo_bp"]) <= distance)
    kind = "array<struct<ord:bigint,up_bp:bigint,lo_bp:bigint>>"
    rows = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "up_bp", "lo_bp"))).cast(kind).alias("xs"))
    heads = F.aggregate("xs", F.array().cast(kind), lambda done, x: F.when(F.exists(done, lambda d: near(d, x)), done).otherwise(F.concat(done, F.array(x))))
    each = rows.select(*keys, "xs", heads.alias("heads")).select(*keys, "heads", F.explode("xs").alias("x"))
    return each.select(*keys, "x.up_bp", "x.lo_bp", F.get(F.filter("heads", lambda d: near(d, F.col("x"))), 0)["ord"].alias("leader"))


def in_rounds(points: DataFrame, keys: list[str], distance: int, folder: str) -> DataFrame:
    """What ``folded`` gives, without bringing a key's points together.

    Points lie in cells of a grid so small that two of a cell are always near, so a cell has one leader at most. In a round a point leads if no
    earlier undecided point is near; only the first of a cell can, and only points of the nine cells around it are looked at. What is near a new leader is
    decided. Points whose order has nothing to do with their places take a few rounds; an order along the places takes many.
    """
    side = distance + 1
    cells = points.withColumn("x", F.floor(F.col("up_bp") / side)).withColumn("y", F.floor(F.col("lo_bp") / side))
    at = [*keys, "x", "y"]
    around = F.explode(F.array(*(F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c")

    def spread(heads: DataFrame) -> DataFrame:
        named = heads.select(*keys, "x", "y", F.col("ord").alias("head"), F.col("up_bp").alias("head_up"), F.col("lo_bp").alias("head_lo"))
        return named.select(*keys, around, "head", "head_up", "head_lo").select(*keys, "c.x", "c.y", "head", "head_up", "head_lo")

    close = (F.abs(F.col("up_bp") - F.col("head_up")) <= distance) & (F.abs(F.col("lo_bp") - F.col("head_lo")) <= distance)
    left, found, turn = written(cells.select(*at, "ord", "up_bp", "lo_bp"), folder, "undecided_0"), None, 0
    while not left.isEmpty():
        first = left.groupBy(*at).agg(F.min_by(F.struct("ord", "up_bp", "lo_bp"), "ord").alias("p")).select(*at, "p.*")
        late = left.join(spread(first), at).where(close & (F.col("ord") < F.col("head"))).select(F.col("head").alias("ord")).distinct()
        new = written(first.join(late, "ord", "left_anti"), folder, f"leaders_{turn}")
        found = new if found is None else found.unionByName(new)
        near = left.join(spread(new), at).where(close).select("ord").distinct()
        turn += 1
        left = written(left.join(near, "ord", "left_anti"), folder, f"undecided_{turn}")
    if found is None:
        return points.select(*keys, "up_bp", "lo_bp", F.col("ord").alias("leader"))
    met = cells.join(spread(found), at).where(close)
    return met.groupBy(*keys, "up_bp", "lo_bp").agg(F.min("head").alias("leader"))


def path_groups(rows: DataFrame) -> DataFrame:
    """Adds path_group: groups of equal paths in a breakpoint group, numbered by first row."""
    own = Window.partitionBy(*PAIR, "bp_group", "up_path", "lo_path")
    return rows.withColumn("first_ord", F.min("ord").over(own)).withColumn("path_group", F.dense_rank().over(Window.partitionBy(*PAIR, "bp_group").orderBy("first_ord")) - 1).drop("first_ord")


def modes(rows: DataFrame) -> DataFrame:
    """The most frequent breakpoints of each group; of equally frequent ones the first seen."""
    def one(col: str) -> DataFrame:
        counted = rows.groupBy(*PAIR, "bp_group", col).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
        return counted.groupBy(*PAIR, "bp_group").agg(F.max_by(col, F.struct("n", -F.col("first"))).alias(f"{col}_mode"))

    return one("up_bp").join(one("lo_bp"), [*PAIR, "bp_group"])


def stats(rows: DataFrame) -> DataFrame:
    """Each path group's total score, reads, best member and size."""
    return rows.groupBy(*PAIR, "bp_group", "path_group").agg(F.sum("score").alias("score"), F.count_distinct("read_id").alias("n_reads"), F.count(F.lit(1)).alias("n_members"), F.max_by("ord", F.struct("score", -F.col("ord"))).alias("best"), F.sort_array(F.collect_set("read_id")).alias("reads"))
