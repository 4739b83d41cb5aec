"""Sources and sinks: texts, tables, records, maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def inline(spark: SparkSession, *texts: str) -> DataFrame:
    """(doc_id, text) of texts given directly."""
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): each file a document, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("text"))


def table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column a string; quoted values may have line ends."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)


def write_table(df: DataFrame, path: str) -> None:
    flat = [F.to_json(c).alias(c) if kind.startswith(("map", "array", "struct")) else F.col(c) for c, kind in df.dtypes]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def write_texts(df: DataFrame, path: str, text: str = "sanitized") -> None:
    df.select(text).write.mode("overwrite").text(path, lineSep="\n")


def detections_json(detections: DataFrame) -> DataFrame:
    """One JSON string for each detection, confidence to two places."""
    columns = [F.round(c, 2).alias(c) if c == "confidence" else F.col(c) for c in detections.columns]
    return detections.select(F.to_json(F.struct(*columns)).alias("value"))


def write_detections(detections: DataFrame, path: str) -> None:
    detections_json(detections).write.mode("overwrite").text(path)


def labelled(spark: SparkSession, path: str, labels: dict[str, str]) -> DataFrame:
    """A corpus (text, gold array<struct<start,end,label>>) as (doc_id, text, start, end, label); labels that have no type here are left out."""
    names = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    rows = spark.read.parquet(path).withColumn("doc_id", F.monotonically_increasing_id())
    return rows.select("doc_id", "text", F.explode("gold").alias("g")).select("doc_id", "text", "g.start", "g.end", names[F.col("g.label")].alias("label")).where("label is not null")
