"""The queries of the training-data operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm import oracles
from docketry.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: The others take a tokenizer's or a model's files, a fitted classifier, images or edit distances; tests compare them with brute force.
ORACLES: dict[str, str] = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP, "op2_minhash_dedup": oracles.NEAR_DUPLICATES, "op3_tool_calls": oracles.TOOL_CALLS, "op5_secret_scan": oracles.SECRETS, "op11_ball_kmeans": oracles.kmeans(), "op13_filter_audit": oracles.FILTERS,
}

#: The word tokenizer closes a document with this id.
END_ID = 1


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import token_files

    stored = token_files.write_token_file(documents(spark, sf_dir), public_file("word_bpe_49k.json"), END_ID)
    return token_files.ids_checksum(token_files.read_token_file(stored))


@query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import byte_bpe

    ranks = public_file("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), ranks), ranks, digest=True)


@query
def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import progressive_jpeg

    return progressive_jpeg.digest(progressive_jpeg.decode_media(progressive_jpeg.store_texts(documents(spark, sf_dir))))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import secret_scan

    return secret_scan.digest(secret_scan.scan(documents(spark, sf_dir)))


#: Tools of the conversations' turns.
REPLY = {"reply": {"text": ("string", True, None), "n_chars": ("bigint", True, None)}}


@query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import tool_calls

    calls, results = tool_calls.turns_as_calls(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return tool_calls.link(calls, results, REPLY)


@query
def op8_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import piece_counts

    return piece_counts.count_pieces(documents(spark, sf_dir), public_file("piece_bpe_32k.model"))


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import toxicity

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import substring_dedup

    return substring_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import minhash

    return minhash.group_duplicates(documents(spark, sf_dir), shingle=4)


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import decontamination

    return decontamination.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import ball_kmeans

    return ball_kmeans.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 40)


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import language_id

    docs = documents(spark, sf_dir)
    found = language_id.predict(docs.select("doc_id", "text"), language_id.fit(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from docketry.llm import filter_audit

    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
