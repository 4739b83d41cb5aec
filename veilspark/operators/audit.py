"""Audit records and summaries; no values by default."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from .scrub import scrub


def audit(df: DataFrame, text: str = "text", config: Config | None = None, at: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One record for each row: the text's hash (16 digits), counts and placeholders; originals only if the options ask for them."""
    config = config or Config()
    rows = scrub(df, text, config)
    columns = [
        *keep,
        (F.lit(at).cast("timestamp") if at else F.current_timestamp()).alias("timestamp"),
        F.substring(F.sha2(F.col(text).cast("binary"), 256), 1, 16).alias("text_hash"),
        F.col("pii_count"),
        F.col("pii_summary").alias("pii_types"),
        F.array_sort(F.map_keys("placeholders")).alias("placeholders_used"),
    ]
    return rows.select(*columns, *([F.array_sort(F.map_values("placeholders")).alias("original_values")] if config.keep_originals else []))


def totals(records: DataFrame) -> DataFrame:
    """Counts by type over audit records."""
    return records.select(F.explode_outer("pii_types").alias("type", "n")).where("type is not null").groupBy("type").agg(F.sum("n").cast("long").alias("n"), F.count(F.lit(1)).alias("records"))


def export(records: DataFrame, path: str, format: str = "json") -> None:
    if format == "json":
        records.write.mode("append").json(path)
    elif format == "csv":
        flat = [F.to_json(c).alias(c) if kind.startswith(("map", "array", "struct")) else F.col(c) for c, kind in records.dtypes]
        records.select(*flat).write.mode("append").csv(path, header=True)
    else:
        raise ValueError(f"unknown format {format!r}: json or csv")
