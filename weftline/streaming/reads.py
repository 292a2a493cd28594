"""Reads of several alignments from a growing folder of GAF files.

A read's records may come in any number of files and micro-batches. They are kept in state under the read's id, and each batch that brings a
read more of them gives its group anew; ``latest`` keeps the last of each read, which is what ``operators.reads.grouped`` gives for all files at once.
Lines that can't be read are left out, as there. Restarted with the same checkpoint, a stream goes on where it ended, and no line counts twice.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import expr as E
from ..sources import text

FIELDS = {"read_start": "bigint", "read_end": "bigint", "gene": "string", "chrom": "string", "sign": "string", "block_len": "bigint", "mapq": "bigint", "items": "array<string>"}
RECORDS = f"array<struct<{','.join(f'{k}:{v}' for k, v in FIELDS.items())}>>"


def lines(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """(line_no, value) of the folder's files as they come; line_no is 0 throughout, as a stream has no order of lines."""
    rows = spark.readStream.format("text")
    rows = rows.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else rows
    return rows.load(folder).select(F.lit(0).cast("bigint").alias("line_no"), "value")


def records(rows: DataFrame) -> DataFrame:
    """read_id and FIELDS of the lines that can be read."""
    good, _ = text.gaf(rows)
    first = F.get("items", 0)
    gene, chrom, sign = F.get(E.item_genes(first), 0), F.get(F.split(first, ":"), 0), F.substring("path", 1, 1)
    return good.select("read_id", "read_start", "read_end", gene.alias("gene"), chrom.alias("chrom"), sign.alias("sign"), "block_len", "mapq", "items")


def grouped(rows: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """(read_id, n, recs) of reads with more than one record so far, sorted by start, each time that they get one more.

    Without quiet_ms every read's records are kept for good, in Spark's own streaming aggregate. With it, in Python, a read that gets no record for so long is forgotten, which bounds the
    state; what comes later begins a new group.
    """
    if not quiet_ms:
        out = rows.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct(*FIELDS))).alias("recs")).where(F.size("recs") > 1)
        return out.select("read_id", F.size("recs").cast("bigint").alias("n"), F.col("recs").cast(RECORDS).alias("recs"))
    plain = F.to_json(F.struct(*FIELDS)).alias("rec")

    def step(key: tuple[str], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else []
        for part in parts:
            held += map(json.loads, part["rec"])
        held.sort(key=lambda r: (r["read_start"], json.dumps(r)))
        state.update((json.dumps(held),))
        state.setTimeoutDuration(quiet_ms)
        if len(held) > 1:
            yield pd.DataFrame({"read_id": [key[0]], "n": [len(held)], "recs": [json.dumps(held)]})

    out = rows.select("read_id", plain).groupBy("read_id").applyInPandasWithState(step, "read_id string, n bigint, recs string", "recs string", "update", GroupStateTimeout.ProcessingTimeTimeout)
    return out.withColumn("recs", F.from_json("recs", RECORDS))


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int | None = None, quiet_ms: int | None = None, once: bool = True) -> StreamingQuery:
    """Starts the stream from folder to the table out, a part a batch, written anew if a batch is repeated. once: it ends when it has read what is there; reads that are to
    be forgotten need a stream that goes on, as time must pass in it."""
    if once and quiet_ms:
        raise ValueError("quiet_ms is for a stream that goes on: once=False")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    stream = grouped(records(lines(spark, folder, files_a_batch)), quiet_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(keep)
    stream = stream.trigger(availableNow=True) if once else stream
    # Reads kept for good outgrow an executor's memory: unless the session names a state store, theirs is on disk.
    key = "spark.sql.streaming.stateStore.providerClass"
    store = spark.conf.get(key)
    if quiet_ms or not store.endswith(".HDFSBackedStateStoreProvider"):
        return stream.start()
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return stream.start()  # which keeps the settings of now
    finally:
        spark.conf.set(key, store)


def latest(spark: SparkSession, out: str) -> DataFrame:
    """(read_id, n, recs): of each read the largest group that ``follow`` has written to out."""
    rows = spark.read.schema(f"read_id string, n bigint, recs {RECORDS}, batch bigint").parquet(out)
    return rows.groupBy("read_id").agg(F.max("n").alias("n"), F.max_by("recs", F.struct("batch", "n")).alias("recs"))
