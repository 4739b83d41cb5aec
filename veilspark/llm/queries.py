"""The queries over the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import forest, hilbert, mixing, prefix_bpe, rans, tokens, toxicity, trees, warc, webp
from .common import documents


def vocabulary(name: str) -> str:
    """Where the public tokenizers' files are on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = documents(spark, sf_dir).select("doc_id", "source", "lang", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    laid = hilbert.shard(rows, ["source", "lang", "size"], 16, tie=("text_crc32", "doc_id"))
    return laid.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op3_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.digests(documents(spark, sf_dir))


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return prefix_bpe.encode_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("features")


def op6_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_counts(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op7_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.digests(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op8_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.withColumn("warc_sha256", F.sha2("warc", 256)).drop("warc")


def op9_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.linked(documents(spark, sf_dir))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return toxicity.rate(docs, machine).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_mixing, op2_hilbert, op3_webp, op4_prefix_bpe, op5_trees, op6_section_tokens, op7_rans, op8_warc_derivatives, op9_forest_join, op10_toxicity)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """None: each operator has a model, a codec, a tokenizer, a curve or an iteration that SQL can't express; tests hold them against brute force."""
    return {}
