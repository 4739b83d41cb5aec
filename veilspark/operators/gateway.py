"""Request tables: keys, sizes, levels, messages; what a proxy does around a model, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import LEVELS

MAX_CHARS = 100_000
# Stop reasons of one chat interface in the words of the other.
STOP_REASONS = {"stop": "end_turn", "length": "max_tokens", "tool_calls": "tool_use", "content_filter": "refusal"}


def first_failure(requests: DataFrame, status: Column) -> Column:
    """The status that a row has if that is a failure, else this one."""
    return F.when(F.col("status") != 200, F.col("status")).otherwise(status) if "status" in requests.columns else status


def authorised(requests: DataFrame, principals: DataFrame, api_key: str = "x_api_key", bearer: str = "authorization") -> DataFrame:
    """``requests`` with name, rpm, daily_token_quota and status (200 or 401); the key header comes first, then the bearer token."""
    given = F.coalesce(F.nullif(F.col(api_key), F.lit("")), F.nullif(F.regexp_extract(F.col(bearer), r"(?i)^Bearer\s+(.+)$", 1), F.lit("")))
    known = principals.select(F.col("key").alias("__key"), "name", "rpm", "daily_token_quota")
    return requests.withColumn("__given", given).join(known, F.col("__given") == F.col("__key"), "left").withColumn("status", F.when(F.col("__key").isNull(), 401).otherwise(200)).drop("__given", "__key")


def checked_size(requests: DataFrame, texts: Column, most: int = MAX_CHARS) -> DataFrame:
    """``requests`` with chars, and status 413 where the texts have over ``most`` characters together; an earlier failure stays."""
    chars = F.aggregate(F.transform(texts, lambda t: F.coalesce(F.length(t), F.lit(0))), F.lit(0).cast("long"), lambda a, n: a + n)
    return requests.withColumn("chars", chars).withColumn("status", first_failure(requests, F.when(F.col("chars") > most, 413).otherwise(200)))


def level_status(level: Column) -> Column:
    return F.when(level.isNull() | level.isin(*LEVELS), 200).otherwise(422)


def flattened(blocks: Column) -> Column:
    """The text of content blocks (type, text, content): texts and tool results, one after the other by line."""
    of = F.transform(blocks, lambda b: F.when(b["type"] == "text", b["text"]).when(b["type"] == "tool_result", b["content"]))
    return F.array_join(F.filter(of, lambda t: t.isNotNull()), "\n")


def stop_reason(reason: Column) -> Column:
    out = F.lit("end_turn")
    for a, b in STOP_REASONS.items():
        out = F.when(reason == a, b).otherwise(out)
    return out
