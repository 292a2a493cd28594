"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, documents that leak a
benchmark item go, secrets are masked, and what is left is encoded and checked by decoding.

A stage takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents. Null and empty texts stay; rows without doc_id are left
out by the second stage. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, decontamination, jaccard, secrets, toxicity
from weftline.llm.common import shared_dir, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the cut; the labels are those of the input's folder."""
    labels = toxicity.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, toxicity.fit(docs, labels))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest id: five words and a similarity of 0.8."""
    groups = jaccard.joined(docs, n=5, percent=80)
    return docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi")


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark; n_chars follows the text."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    return bpe.digests(bpe.encoded(docs, texts=True))


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard", without_copies),
    ("decontamination", without_leaks),
    ("secrets", without_secrets),
    ("bpe", encoded),
]
#: SQL can't express the stages; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), folder, name)
    return docs
