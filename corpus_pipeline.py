"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

Toxic documents go; one document of each near-duplicate group stays; documents that hold a benchmark item
go; live-looking secrets are replaced in the texts; the texts become byte-level BPE ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import byte_bpe, decontamination, minhash, secret_scan, toxicity
from docketry.llm.common import fresh, materialize
from docketry.llm.queries import public_file


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on the labelled ones that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = fresh(docs, "_score", "_predicted")
    return toxicity.score(docs, model, names=tuple(names)).where(F.col(names[1]) == 0).drop(*names)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; values of secrets that look live are replaced. n_chars follows the new text."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids, and digests of the ids and of the bytes that they decode to."""
    ranks = public_file("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.decode(byte_bpe.encode(docs, ranks), ranks, digest=True)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("benchmark_decontamination", benchmark_out),
    ("secret_scan", secrets_masked),
    ("byte_bpe", token_ids),
]

#: SQL can express neither the classifier nor the grouping; tests/llm compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
