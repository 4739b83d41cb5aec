"""Redaction with reversible placeholders, and restoration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Config
from ..functions.spans import each, let
from ..runtime import saved
from .detect import spans_frame


def placeholder(type: Column, id: Column, form: str) -> Column:
    """A placeholder of the given form, such as ``[{type}_{id}]``."""
    head, rest = form.split("{type}", 1) if form.index("{type}") < form.index("{id}") else form.split("{id}", 1)
    first_is_type = form.index("{type}") < form.index("{id}")
    middle, tail = rest.split("{id}" if first_is_type else "{type}", 1)
    a, b = (type, id.cast("string")) if first_is_type else (id.cast("string"), type)
    return F.concat(F.lit(head), a, F.lit(middle), b, F.lit(tail))


def numbers(spans: Column, form: str) -> Column:
    """(start, end, ord, placeholder, original) for each span, numbered by type in the given order; equal texts (case aside) share one, with the type that came first."""
    return let(spans, lambda s: _numbers(s, form))


def _numbers(spans: Column, form: str) -> Column:
    def of(keys: Column) -> Column:
        first = lambda key: F.element_at(spans, F.array_position(keys, key).cast("int"))
        firsts = F.transform(F.array_distinct(keys), lambda k: F.struct(k.alias("key"), first(k)["type"].alias("type")))

        def marks(firsts: Column) -> Column:
            kinds = F.array_distinct(F.transform(firsts, lambda f: f["type"]))
            by_type = F.transform(kinds, lambda t: F.struct(t.alias("type"), F.transform(F.filter(firsts, lambda f: f["type"] == t), lambda f: f["key"]).alias("keys")))

            def mark(s: Column, key: Column, groups: Column) -> Column:
                def named(f: Column) -> Column:
                    own = F.get(F.filter(groups, lambda g: g["type"] == f["type"]), F.lit(0))
                    return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["ord"].alias("ord"), placeholder(f["type"], F.array_position(own["keys"], key), form).alias("placeholder"), f["text"].alias("original"))

                return let(first(key), named)

            return let(by_type, lambda groups: F.transform(spans, lambda s, i: mark(s, F.get(keys, i), groups)))

        return let(firsts, marks)

    return let(F.transform(spans, lambda s: F.lower(s["text"])), of)


def numbered(spans: Column, form: str) -> Column:
    """(start, end, placeholder, original) for each span, by start: ids count up from the right."""
    return F.reverse(numbers(F.reverse(spans), form))


def rebuilt(text: Column, marks: Column) -> Column:
    """The text with each marked stretch replaced; marks are by start and don't overlap."""

    def of(marks: Column) -> Column:
        upto = lambda i: F.when(i > 0, F.get(marks, i - 1)["end"]).otherwise(F.lit(0))
        pieces = F.transform(marks, lambda m, i: F.concat(F.substr(text, upto(i) + 1, m["start"] - upto(i)), m["placeholder"]))
        rest = F.substr(text, F.element_at(marks, -1)["end"] + 1)
        return F.when(F.size(marks) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), rest))

    return let(marks, of)


def originals(marks: Column) -> Column:
    """Placeholder -> original."""
    return F.map_from_entries(F.array_distinct(F.transform(marks, lambda m: F.struct(m["placeholder"], m["original"]))))


def scrub(df: DataFrame, text: str = "text", config: Config | None = None, **layers) -> DataFrame:
    """``df`` with sanitized, placeholders (map), pii_count and pii_summary (map); a null text stays null. Every row has its own numbering."""
    config = config or Config()
    df = spans_frame(df, text, config, out="__spans", **layers)
    df = df.withColumn("__marks", numbered(F.col("__spans"), config.placeholder))
    counted = lambda types: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)))))
    tally = let(F.transform("__spans", lambda s: s["type"]), counted)
    return df.withColumns(
        {"sanitized": rebuilt(F.col(text), F.col("__marks")), "placeholders": originals(F.col("__marks")), "pii_count": F.size("__spans"), "pii_summary": tally}
    ).drop("__spans", "__marks")


def restored(text: Column, placeholders: Column, one_pass: bool = False, form: str = "[{type}_{id}]") -> Column:
    """Placeholders back to originals, longest first. ``one_pass`` replaces each placeholder of the input once, so originals that look like placeholders stay."""
    if one_pass:
        shape = _shape(form)
        pieces, marks = F.split(text, shape, -1), F.regexp_extract_all(text, F.lit(shape), F.lit(0))
        return F.array_join(F.flatten(F.zip_with(pieces, marks, lambda p, m: F.array(p, F.coalesce(F.try_element_at(placeholders, m), m, F.lit(""))))), "")
    entries = F.array_sort(F.map_entries(placeholders), lambda a, b: F.length(b["key"]) - F.length(a["key"]))
    return F.aggregate(entries, text, lambda acc, e: F.replace(acc, e["key"], e["value"]))


def _shape(form: str) -> str:
    return re.escape(form).replace(r"\{type\}", "[A-Z0-9_]+?").replace(r"\{id\}", r"[0-9]+")


def restore(df: DataFrame, text: str = "sanitized", placeholders: str = "placeholders", one_pass: bool = False) -> DataFrame:
    return df.withColumn("restored", restored(F.col(text), F.col(placeholders), one_pass))


def scrub_messages(df: DataFrame, scope: str = "conv_id", turn: str = "turn", text: str = "text", config: Config | None = None, **layers) -> DataFrame:
    """As ``scrub``, with one numbering for all turns of a conversation; adds sanitized and placeholders (those that the row has).

    Occurrences count by turn, and from the right in each; the first of equal texts gives type, id and original. A row is
    known by conversation, turn and its text's digest, so a lost and repeated task can't move marks to another text.
    Texts are scanned once: the occurrences are written to the shared folder, numbered there, and joined with the texts.
    A null text stays null. The whole map of a conversation, which may be long, is ``conversation_map``.
    """
    marks = marked_occurrences(df, scope, turn, text, config, **layers)
    by_row = marks.groupBy("scope", "turn", "digest").agg(F.array_sort(F.collect_list(F.struct("start", "end", "placeholder", "original"))).alias("__marks"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,placeholder:string,original:string>>)")
    out = df.withColumn("__digest", _digest(text)).join(by_row.select(*(F.col(c).alias(c if c in ("__marks", "digest") else f"__{c}") for c in by_row.columns)), _renamed(scope, turn), "left")
    out = out.withColumn("__marks", F.coalesce("__marks", none)).drop("__scope", "__turn", "digest", "__digest")
    return out.withColumns({"sanitized": rebuilt(F.col(text), F.col("__marks")), "placeholders": originals(F.col("__marks"))}).drop("__marks")


def _digest(text: str) -> Column:
    return F.sha2(F.col(text).cast("string"), 256)


def _renamed(scope: str, turn: str) -> Column:
    return F.col(scope).eqNullSafe(F.col("__scope")) & F.col(turn).eqNullSafe(F.col("__turn")) & (F.col("__digest") == F.col("digest"))


def marked_occurrences(df: DataFrame, scope: str = "conv_id", turn: str = "turn", text: str = "text", config: Config | None = None, **layers) -> DataFrame:
    """(scope, turn, digest, start, end, value, type, placeholder, original): each span of each different row, numbered by conversation."""
    config = config or Config()
    spans = spans_frame(df.select(F.col(scope).alias("scope"), F.col(turn).alias("turn"), F.col(text).alias("__t")), "__t", config, out="__spans", **layers)
    found = each(spans, F.col("__spans"), "scope", "turn", _digest("__t").alias("digest")).select("scope", "turn", "digest", "s.start", "s.end", F.col("s.text").alias("value"), "s.type")
    return _numbered_in_scope(saved(found.distinct()), config.placeholder)


def conversation_map(marks: DataFrame) -> DataFrame:
    """(scope, placeholder, original) of numbered occurrences: a conversation's map as rows, however long."""
    return marks.select("scope", "placeholder", "original").distinct()


def _numbered_in_scope(occurrences: DataFrame, form: str) -> DataFrame:
    """``occurrences`` (scope, turn, start, value, type, ...) with placeholder and original."""
    key = F.lower("value")
    firsts = occurrences.groupBy("scope", key.alias("key")).agg(F.min_by(F.struct("value", "type", "turn", "start"), F.struct("turn", -F.col("start"))).alias("f")).select("scope", "key", "f.*")
    ids = firsts.withColumn("id", F.row_number().over(Window.partitionBy("scope", "type").orderBy("turn", F.col("start").desc())))
    named = ids.select(F.col("scope").alias("s2"), "key", F.col("value").alias("original"), placeholder(F.col("type"), F.col("id"), form).alias("placeholder"))
    return occurrences.join(named, F.col("scope").eqNullSafe(F.col("s2")) & (key == F.col("key"))).drop("s2", "key")


def get_placeholder(placeholders: Column, original: Column) -> Column:
    """The placeholder of an original, case aside; null if it has none."""
    return F.get(F.filter(F.map_entries(placeholders), lambda e: F.lower(e["value"]) == F.lower(original)), F.lit(0))["key"]


def get_original(placeholders: Column, mark: Column) -> Column:
    return F.try_element_at(placeholders, mark)


def map_json(placeholders: Column, form: str = "[{type}_{id}]") -> Column:
    """A map as JSON, with the counters that further numbering goes on from."""
    shape = _marks_of(form)
    types = F.transform(F.map_keys(placeholders), lambda k: F.struct(F.regexp_extract(k, shape[0], shape[1]).alias("type"), F.regexp_extract(k, shape[0], shape[2]).cast("int").alias("id")))
    counters = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(types, lambda t: t["type"]))), lambda n: F.struct(n, F.array_max(F.transform(F.filter(types, lambda t: t["type"] == n), lambda t: t["id"])))))
    return F.to_json(F.struct(F.lit(form).alias("format"), placeholders.alias("mappings"), counters.alias("counters")))


def _marks_of(form: str) -> tuple[str, int, int]:
    """A regex of this form's placeholders, and the groups of type and id in it."""
    type_first = form.index("{type}") < form.index("{id}")
    shape = re.escape(form).replace(r"\{type\}", "([A-Z0-9_]+?)").replace(r"\{id\}", "([0-9]+)")
    return f"^{shape}$", 1 if type_first else 2, 2 if type_first else 1


SAVED_MAP = "format string, mappings map<string,string>, counters map<string,int>"


def from_map_json(text: Column) -> Column:
    return F.from_json(text, SAVED_MAP)["mappings"]


def counters_of(text: Column) -> Column:
    return F.from_json(text, SAVED_MAP)["counters"]


def scrub_on(df: DataFrame, saved_map: str, text: str = "text", config: Config | None = None, **layers) -> DataFrame:
    """As ``scrub``, going on from each row's saved map (JSON): known originals keep their placeholders, new ones count up from its counters.

    ``placeholders`` has the old and the new entries. A null or empty saved map starts anew.
    """
    config = config or Config()
    rows = spans_frame(df, text, config, out="__spans", **layers)
    known = F.coalesce(from_map_json(F.col(saved_map)), F.expr("cast(map() as map<string,string>)"))
    rows = rows.withColumn("__known", known).withColumn("__at", F.coalesce(counters_of(F.col(saved_map)), F.expr("cast(map() as map<string,int>)")))
    fresh = F.filter("__spans", lambda s: get_placeholder(F.col("__known"), s["text"]).isNull())
    rows = rows.withColumn("__new", numbered(fresh, "{type}\t{id}"))

    def moved(m: Column) -> Column:
        kind, id = F.substring_index(m["placeholder"], "\t", 1), F.substring_index(m["placeholder"], "\t", -1).cast("int")
        return F.struct(m["start"].alias("start"), m["end"].alias("end"), placeholder(kind, id + F.coalesce(F.try_element_at("__at", kind), F.lit(0)), config.placeholder).alias("placeholder"), m["original"].alias("original"))

    old = F.transform(F.filter("__spans", lambda s: get_placeholder(F.col("__known"), s["text"]).isNotNull()), lambda s: let(get_placeholder(F.col("__known"), s["text"]), lambda p: F.struct(s["start"].alias("start"), s["end"].alias("end"), p.alias("placeholder"), get_original(F.col("__known"), p).alias("original"))))
    marks = F.array_sort(F.concat(F.transform("__new", moved), old), lambda a, b: a["start"] - b["start"])
    rows = rows.withColumn("__marks", marks)
    # The last of equal keys counts: there are none but equal ones.
    every = F.map_from_entries(F.array_distinct(F.concat(F.map_entries("__known"), F.map_entries(originals(F.transform("__new", moved))))))
    return rows.withColumns({"sanitized": rebuilt(F.col(text), F.col("__marks")), "placeholders": every, "pii_count": F.size("__spans")}).drop("__spans", "__known", "__at", "__new", "__marks")


def leaks(df: DataFrame, sanitized: str = "sanitized", placeholders: str = "placeholders") -> DataFrame:
    """Rows in which an original still stands in the redacted text."""
    return df.where(F.exists(F.map_values(placeholders), lambda v: F.col(sanitized).contains(v)))
