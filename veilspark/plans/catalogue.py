"""The registered queries over the reference tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions import checksums, normalcy, normalise, scoring
from ..functions.rules import CATALOGUE
from ..functions.spans import each, rule_spans
from ..operators import evaluate, structured
from ..operators.audit import audit, totals
from ..operators.detect import detect, spans_frame, summary
from ..operators.scrub import restored, scrub, scrub_messages
from ..runtime import spread
from ..streaming.state import daily_quota, rate_limit
from . import sql

RULES = {r.name: r for r in CATALOGUE}
Query = Callable[[SparkSession, str], DataFrame]
#: Only rules and what follows from them: what SQL can follow too.
PLAIN = Config(level="aggressive", domain_parsers=False, second_pass=False, context=False)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A table whose texts are scanned, over all cores."""
    return spread(table(spark, sf_dir, name))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, redacted text and counts of the documents that have any e-mail address, IP address or card number."""
    rows = scrub(texts(spark, sf_dir).select("doc_id", "text"), config=Config(level="standard", second_pass=False, domain_parsers=False))
    wanted = F.filter(F.map_keys("pii_summary"), lambda t: t.isin("EMAIL", "IP", "CREDIT_CARD"))
    return rows.where(F.size(wanted) > 0).select("doc_id", "pii_count", F.to_json("pii_summary").alias("pii_summary"), "sanitized")


def _rule_query(rule: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spans = rule_spans(F.coalesce(F.col(text), F.lit("")), [RULES[rule]])
        return texts(spark, sf_dir, source).select(F.col(key).alias("doc_id"), F.posexplode_outer(spans).alias("n", "s")).where("s is not null").select("doc_id", F.col("n").cast("long").alias("n"), F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"), F.col("s.text").alias("match"))

    return run


def _values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _checksum(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _values(spark, list(enumerate(sql.CHECK_VALUES[name])), "id long, value string")
        return rows.select("id", "value", F.coalesce(checksums.CHECKS[name](F.col("value")), F.lit(False)).alias("valid"))

    return run


def rules_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, list(enumerate(sql.RULE_TEXTS)), "id long, text string")
    found = rule_spans(F.col("text"), [r for r in CATALOGUE if r.name in sql.FIXTURE_RULES])
    return each(rows, found, "id").groupBy("id", F.col("s.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n"), F.min("s.start").cast("long").alias("first_start"), F.max("s.end").cast("long").alias("last_end"))


def detect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every layer that needs no model, over whole texts."""
    return detect(texts(spark, sf_dir), config=Config(level="aggressive")).withColumn("confidence", F.round("confidence", 6))


def _doc_type_counts(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = sql.SCAN_RULES) -> DataFrame:
    spans = rule_spans(F.coalesce("text", F.lit("")), [RULES[n] for n in names])
    return each(texts(spark, sf_dir), spans, "doc_id", "lang", "source").select("doc_id", "lang", "source", "s.type", "s.start", "s.end", "s.text", "s.rule")


def pii_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_type_counts(spark, sf_dir).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


def pii_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_type_counts(spark, sf_dir).groupBy("lang", "type").agg(F.count(F.lit(1)).alias("n"))


def pii_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_type_counts(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("type").alias("types"))


def pii_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    spans = rule_spans(F.coalesce("text", F.lit("")), [RULES[n] for n in sql.SCAN_RULES])
    chars = F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return docs.select("lang", F.length("text").alias("n"), chars.alias("c")).groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("c") > 0).alias("docs_with_pii"), F.round(F.sum("c") / F.sum("n"), 9).alias("density"))


def context_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, sql.CONTEXT_ROWS, "id long, text string, start int, end int, type string, base double")
    return rows.select("id", F.round(scoring.context_score(F.col("text"), F.col("start"), F.col("end"), F.col("type"), F.col("base")), 6).alias("score"))


def allowlist_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_type_counts(spark, sf_dir)
    return rows.where(~scoring.allowed(F.col("text"), F.col("type"))).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def checksum_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_type_counts(spark, sf_dir, ("credit_card",))
    return rows.select(F.col("doc_id"), F.col("start").cast("long").alias("start"), F.col("text").alias("match"), checksums.luhn(F.col("text")).alias("valid"), F.when(checksums.luhn(F.col("text")), 1.0).otherwise(0.7).alias("confidence"))


def dedup_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(texts(spark, sf_dir), config=PLAIN).select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "match", "rule", "type", F.round("confidence", 6).alias("confidence"))


def scrub_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(F.regexp_replace("text", RULES["email"].java, "[EMAIL]"), 256).alias("sanitized_sha256"))


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scrub(texts(spark, sf_dir).select("doc_id", "text"), config=PLAIN)
    return rows.select("doc_id", (restored(F.col("sanitized"), F.col("placeholders")) == F.col("text")).alias("exact"), F.size("placeholders").cast("long").alias("n_placeholders"), F.col("pii_count").cast("long").alias("pii_count"))


def conversation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numbering for all documents of a source, in the order of their ids, as if they were turns."""
    docs = texts(spark, sf_dir).select("doc_id", "text", "source")
    return scrub_messages(docs, "source", "doc_id", config=Config(level="standard", domain_parsers=False, second_pass=False)).select("doc_id", "source", F.sha2("sanitized", 256).alias("sanitized_sha256"), F.coalesce(F.size("placeholders"), F.lit(0)).alias("n_placeholders"))


def scrub_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrub_messages(texts(spark, sf_dir, "conversations"), config=PLAIN).select("conv_id", "turn", "role", "sanitized")


def placeholder_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scrub import _numbered_in_scope

    rows = _doc_type_counts(spark, sf_dir, ("email", "ip_address")).select(F.col("source").alias("scope"), F.col("doc_id").alias("turn"), F.lit(0).alias("__row"), "start", "end", F.col("text").alias("value"), "type")
    return _numbered_in_scope(rows, "[{type}_{id}]").select("scope", "turn", F.col("start").cast("long").alias("start"), "value", "placeholder", "original")


def structured_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [c for t in sql.CLASSIFIED for c in table(spark, sf_dir, t).columns] + list(sql.COLUMN_NAMES)
    return _values(spark, [(n, structured.classify(n) or "-") for n in dict.fromkeys(names)], "column_name string, type string")


def structured_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = structured.scrub_table(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"), config=PLAIN)
    return rows.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", F.element_at("placeholders", F.lit("[NAME_1]")).alias("original"))


def normalcy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    w = each(docs, normalcy.windows(F.coalesce("text", F.lit(""))), "doc_id").withColumnRenamed("s", "w")
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), F.count_if(F.col("w.score") < 0.5).alias("suspicious"), F.round(F.min("w.score"), 6).alias("least"))


def suspicious_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    return each(docs, normalcy.suspicious(F.coalesce("text", F.lit(""))), "doc_id").select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spans_frame(texts(spark, sf_dir), config=PLAIN)
    regions = normalcy.suspicious(F.col("text"))
    rows = rows.withColumn("r", regions).withColumn("o", normalcy.uncovered(F.col("r"), F.col("spans")))
    return rows.select("doc_id", F.size("o").alias("open"), normalcy.needs_review(F.col("text"), F.col("r"), F.col("o"), F.col("spans"), PLAIN).alias("review"))


def homoglyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalise.plain_letters(F.col("text")), 256).alias("plain_sha256"))


def at_dot_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, list(enumerate(sql.OBFUSCATED)), "id long, text string")
    return rows.select("id", normalise.plain_signs(F.col("text")).alias("plain"))


def obfuscation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, list(enumerate(sql.OBFUSCATED)), "id long, text string")
    return rows.select("id", F.array_join(normalise.obfuscations(F.col("text")), ",").alias("kinds"), normalise.normalised(F.col("text")).alias("plain"))


def html_page_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_query("us_phone", "pages", "page_id", "html")(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start"))


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audit(texts(spark, sf_dir), config=PLAIN, at="2024-01-01")
    return rows.select("doc_id", "text_hash", "pii_count", F.to_json("pii_types").alias("pii_types"), F.array_join("placeholders_used", ",").alias("placeholders_used"))


def audit_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16).alias("text_hash"))


def audit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return totals(audit(texts(spark, sf_dir), config=PLAIN, at="2024-01-01"))


def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("tokens", F.floor(F.col("value")).cast("long"))
    return daily_quota(events, 100).select("id", "key", F.col("used_before").cast("long").alias("used_before"), "admitted", F.col("retry_after").cast("long").alias("retry_after"))


def rate_limit_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_limit(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), 2).select("id", "key", "admitted", "retry_after")


def rate_limit_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    own = Window.partitionBy("user_id").orderBy("at").rangeBetween(-60_000_000, 0)
    return table(spark, sf_dir, "events").withColumn("at", at).select("event_id", "user_id", F.count(F.lit(1)).over(own).alias("in_window"))


def name_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, list(enumerate(sql.NAME_TEXTS)), "id long, text string")
    return each(rows, rule_spans(F.col("text"), [RULES["name_heuristic"], RULES["name_contextual"]]), "id").select("id", F.col("s.rule").alias("rule"), F.col("s.text").alias("name"), F.col("s.start").cast("long").alias("start"))


def name_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(texts(spark, sf_dir), config=Config(level="minimal", name_scorer=True, second_pass=False, domain_parsers=False)).where("layer = 'name_scorer'").groupBy("match").agg(F.count(F.lit(1)).alias("n"))


def quality_vs_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _doc_type_counts(spark, sf_dir).select("doc_id").distinct().withColumn("has", F.lit(1))
    labels = table(spark, sf_dir, "labels")
    return labels.join(docs, "doc_id", "left").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.count("has").alias("with_pii"))


def eval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone spans of one rule as expected ones, of the others as found ones."""
    rows = _doc_type_counts(spark, sf_dir, ("us_phone", "intl_phone", "uk_phone", "france_phone"))
    out = evaluate.overlap_scores(rows.where("rule = 'us_phone'"), rows.where("rule <> 'us_phone'"))
    return out.select("tp", "fn", "fp", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1", "f2")])


def eval_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _values(spark, sql.STRICT_ROWS, "id long, expected array<string>, found array<string>")
    return rows.select("id", evaluate.strict_matches(F.col("expected"), F.col("found")).alias("strict"), evaluate.reused_matches(F.col("expected"), F.col("found")).alias("reused"))


def span_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _doc_type_counts(spark, sf_dir, ("us_phone", "credit_card"))
    return evaluate.only_in(rows.where("rule = 'us_phone'"), rows.where("rule = 'credit_card'")).select("doc_id", F.col("start").cast("long").alias("start"), F.col("text").alias("match"))


def compare_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    runs = {name: detect(docs, config=Config(level=name, domain_parsers=False, second_pass=False)) for name in ("minimal", "standard", "aggressive")}
    return evaluate.compare(runs)


def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scrub(texts(spark, sf_dir).select("doc_id", "text"), config=PLAIN)
    return rows.select("doc_id", evaluate.gone(F.col("sanitized"), F.map_values("placeholders")).alias("gone"), F.size("placeholders").alias("values"))


def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(detect(texts(spark, sf_dir), config=PLAIN, keep=("doc_id", "lang")), "lang")


def rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.rules import rules_frame

    return rules_frame(spark)


SCANS = ("email", "ip_address", "credit_card", "us_phone", "intl_phone", "uk_phone", "france_phone", "us_address", "us_zipcode", "date_generic", "iban", "month_name_date")


def queries() -> dict[str, Query]:
    own = (
        rules_fixture, detect_all, pii_by_type, pii_by_lang, pii_by_source, pii_density, context_score, allowlist_filter, checksum_adjusted, dedup_overlaps, scrub_email,
        restore_roundtrip, conversation_scope, scrub_conversations, placeholder_numbering, structured_classify, structured_customer, normalcy_windows, suspicious_merge,
        review_gate, homoglyphs, at_dot_normalise, obfuscation_labels, html_page_scan, audit_log, audit_hash, audit_summary, quota, rate_limit_exact, rate_limit_bound,
        name_titles, name_scorer, quality_vs_pii, eval_overlap, eval_strict, span_delta, compare_configs, leak_check, type_summary, rule_catalogue, flagship,
    )
    return {f.__name__: f for f in own} | {f"detect_{n}": _rule_query(n) for n in SCANS} | {f"checksum_{n}": _checksum(n) for n in checksums.CHECKS}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql(SCANS)
