"""What the operators share: the folder for written tables, and Arrow batches in pieces of bounded size."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once in a Python worker; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """A new folder for intermediate tables under spark.checkpoint.dir. Where that is unset, a local session, whose
    executors are the driver, gets a temporary folder; a cluster has no folder that we could choose for it, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = getattr(spark, "_weftline_dir", None)
        if base is None:
            base = spark._weftline_dir = "file://" + tempfile.mkdtemp(prefix="weftline-")
    folder = f"{base.rstrip('/')}/weftline-{uuid.uuid4().hex}"
    atexit.register(drop, spark, folder)
    return folder


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Hadoop's file system API, if the session still runs."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session has ended; there is nothing to report to
        pass


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """The rows of df, written as Parquet and read back: its lineage is cut and lost executors cost no recomputation."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id, as a long, and the text (null: empty); rows without an id are left out, other columns pruned from the scan.

    Ids are whole numbers, or strings of them; with Spark's ANSI mode any other string is an error.
    """
    bounded_batches(df.sparkSession)
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES, unless the session asks for less: Spark's default holds 64 MB a batch, twice a task."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key, "64m").lower().removesuffix("b")
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    size = int(have[:-1]) * units[have[-1]] if have[-1] in units else int(have)
    if size > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 offsets, without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    if len(column) == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(doc ids, bytes, offsets) of (doc_id, text) batches, in pieces of about ``most`` bytes and whole texts."""
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(batch.column(1))
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield ids[at:to], data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
            at = to


def spans(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of whole items of together at most ``most``; a larger item is a run of its own. offsets: n + 1, ascending."""
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours, with the length at the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) over all rows."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    lengths, starts = lengths[lengths > 0], starts[lengths > 0]
    step = np.ones(total, np.int64)
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    step[heads] = starts
    step[heads[1:]] -= starts[:-1] + lengths[:-1] - 1
    return np.cumsum(step)
