"""A training corpus from raw documents, stage by stage; each stage's rows are written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import forest, mixing, prefix_bpe, toxicity, trees
from veilspark.llm.common import shared_dir
from veilspark.llm.queries import vocabulary
from veilspark.runtime import ship

#: A document is rejected from this probability of toxicity on, and below that probability of quality.
TOXIC, QUALITY = 0.5, 0.5
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: What a verdict carries beside the doc_id: each row is judged for itself, whatever its id.
REST = COLUMNS[1:]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows scored under TOXIC stay, each judged for itself. A null or empty text has the score of no words; equal rows share a verdict.

    Without labels of both kinds every row has one score. An empty table gives none; columns beyond those of documents are left out.
    """
    ship(spark)
    machine = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.rate(docs, machine, REST).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold the base rules and score QUALITY or more stay, each judged for itself. Null, empty and very short texts go.

    Repeated rows share a verdict; an empty table gives none; columns beyond those of documents are left out.
    """
    ship(spark)
    return trees.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY, carry=REST).where("kept").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, under its text's least doc_id (null last). Rows without id, or under a shared one, don't stand for each other.

    Null and empty texts are copies of each other; an empty table gives no rows; columns beyond those of documents are left out.
    """
    ship(spark)
    return forest.kept(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as the mix takes them, 0 to 2 times. A null source is one of its own; an empty table gives no rows.

    Columns beyond those of documents are left out.
    """
    ship(spark)
    return mixing.mixed(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row's text, and digests of them. A null or empty text has no ids; repeated rows repeat; an empty table gives none."""
    import public_tokenizers

    ship(spark)
    return prefix_bpe.encode_documents(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: No stage can be expressed in SQL: each has a model, a verified similarity search, an iteration or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{shared_dir(spark)}/veilspark/stage{k}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
