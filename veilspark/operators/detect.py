"""Detection: from text columns to arrays of spans."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import domain, normalcy, normalise, scoring
from ..functions.names import Gazetteer, name_spans
from ..functions.rules import Rule, active
from ..functions.spans import NONE, each, let, resolved, rule_spans

#: Orders of the layers after the rules, for ties.
PARSERS, KNOWN, NAMES, NER, SECOND, REVIEW = 1000, 1500, 2000, 2500, 3000, 5000


def known_rule(names: tuple[str, ...]) -> list[Rule]:
    if not names:
        return []
    return [Rule("known_name", "NAME", 0, r"\b(?:" + "|".join(re.escape(n) for n in names) + r")\b", True)]


def base_spans(text: Column, config: Config) -> Column:
    """Rules, parsers and known names: what runs on a text and on its normalised form."""
    return rule_spans(text, active(config))


def spans_frame(df: DataFrame, text: str = "text", config: Config | None = None, gazetteer: Gazetteer | None = None, ner: Callable[[Column], Column] | None = None, review: Callable[[Column, Column], Column] | None = None, out: str = "spans") -> DataFrame:
    """``df`` with an array of spans for a text column; no shuffle, one row in, one row out.

    Steps, in this order: rules; parsers; known names; name scorer; ``ner`` (text -> spans, off by default); check digits;
    context; allow-list; ``review`` (text, open regions -> spans, at least 0.3 sure) where the gate asks for it; second pass
    over the normalised text; least confidence; overlaps. A null or empty text has no spans.
    """
    config = config or Config()
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    parts = [base_spans(t, config)]
    if config.domain_parsers:
        parts.append(domain.parsed(t, PARSERS))
    if config.known_names:
        parts.append(rule_spans(t, known_rule(config.known_names), "known_name", 1.0, KNOWN))
    if config.name_scorer or gazetteer:
        parts.append(name_spans(t, gazetteer, NAMES))
    if ner:
        parts.append(ner(t))
    df = df.withColumn("__s", F.concat(*parts) if len(parts) > 1 else parts[0])
    if config.checksums:
        df = df.withColumn("__s", scoring.checked(F.col("__s"), config))
    if config.context:
        df = df.withColumn("__s", scoring.in_context(t, F.col("__s")))
    if config.allowlist:
        df = df.withColumn("__s", scoring.without_allowed(F.col("__s"), config))
    if review:
        df = df.withColumn("__r", normalcy.suspicious(t, config.suspicious_below, config.safe_rules)).withColumn("__o", normalcy.uncovered(F.col("__r"), F.col("__s")))
        gate = normalcy.needs_review(t, F.col("__r"), F.col("__o"), F.col("__s"), config)
        found = F.filter(review(t, F.when(gate, F.col("__o"))), lambda s: s["confidence"] >= 0.3)
        df = df.withColumn("__s", F.concat("__s", F.coalesce(found, F.expr(NONE)))).drop("__r", "__o")
    if config.second_pass:

        def second(plain: Column, known: Column) -> Column:
            again = [base_spans(plain, config)] + ([domain.parsed(plain, PARSERS)] if config.domain_parsers else [])
            new = normalise.unseen(F.concat(*again) if len(again) > 1 else again[0], known)
            return F.concat(known, F.when(plain != t, normalise.shifted(normalise.mapped_back(t, plain, new), SECOND)).otherwise(F.expr(NONE)))

        df = df.withColumn("__s", let(F.col("__s"), lambda known: let(normalise.normalised(t), lambda plain: second(plain, known))))
    if config.min_confidence > 0:
        df = df.withColumn("__s", F.filter("__s", lambda s: s["confidence"] >= config.min_confidence))
    return df.withColumn(out, resolved(F.col("__s"))).drop("__s")


def detect(df: DataFrame, text: str = "text", config: Config | None = None, keep: tuple[str, ...] = ("doc_id",), **layers) -> DataFrame:
    """One row for each span: the kept columns, then start, end, text, rule, type, level, layer, confidence."""
    rows = spans_frame(df.select(*keep, F.col(text).alias("__text")), "__text", config, out="__spans", **layers)
    return each(rows, F.col("__spans"), *keep).select(*keep, "s.start", "s.end", F.col("s.text").alias("match"), "s.rule", "s.type", "s.level", "s.layer", "s.confidence")


def summary(detections: DataFrame, *by: str) -> DataFrame:
    """Counts of detections by type (and more columns)."""
    return detections.groupBy(*by, "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def preflight(df: DataFrame, text: str = "text", config: Config | None = None) -> bool:
    """Whether any text has a detection; stops at the first."""
    return not spans_frame(df.select(text), text, config).where(F.size("spans") > 0).limit(1).isEmpty()
