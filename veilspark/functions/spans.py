"""Spans as column expressions: exact offsets in code points, overlap resolution, merging."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import LEVELS, Rule

SPAN = "struct<start:int,end:int,text:string,rule:string,type:string,level:int,layer:string,confidence:double,ord:int>"
FIELDS = ("start", "end", "text", "rule", "type", "level", "layer", "confidence", "ord")
NONE = f"cast(array() as array<{SPAN}>)"


def span(start: Column, end: Column, text: Column, rule: Column, type: Column, level: Column, layer: Column, confidence: Column, ord: Column) -> Column:
    kinds = ("int", "int", "string", "string", "string", "int", "string", "double", "int")
    return F.struct(*[c.cast(k).alias(n) for c, k, n in zip((start, end, text, rule, type, level, layer, confidence, ord), kinds, FIELDS, strict=True)])


def changed(s: Column, **fields: Column) -> Column:
    return F.struct(*[fields.get(n, s[n]).alias(n) for n in FIELDS])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def quoted(value: str | None) -> str:
    """A SQL literal."""
    return "cast(null as string)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


@lru_cache(maxsize=64)
def _scan(text: str, rules: tuple[Rule, ...], layer: str, confidence: float, first: int, prefix: str) -> str:
    """The SQL of ``rule_spans`` over a lambda variable; built as one string, as thousands of Column calls take seconds."""
    empty = "cast(array() as array<string>)"

    def matches(r: Rule) -> str:
        found = f"regexp_extract_all({text}, {quoted(r.java)}, 0)"
        may = ["digit_"] * r.needs_digit + [c for c in (r.possible(text, quoted),) if c]
        return f"if({' and '.join(may)}, {found}, {empty})" if may else found

    law = ", ".join(f"named_struct('regex', {quoted(r.java)}, 'grouped', {str(r.grouped).lower()}, 'rule', {quoted(prefix + r.name.removeprefix('custom:'))}, 'type', {quoted(r.type)}, 'level', {r.level}, 'lead', {quoted(r.lead and r.java.removesuffix(r.regex) + r.lead)})" for r in rules)
    hits = ", ".join(f"named_struct('k', {i}, 'm', {matches(r)})" for i, r in enumerate(rules))
    made = f"""named_struct('start', start_, 'end', start_ + length(p_.value), 'text', p_.value, 'rule', r_.rule, 'type', r_.type, 'level', r_.level,
        'layer', {quoted(layer)}, 'confidence', cast({confidence!r} as double), 'ord', h_.k + {first})"""
    # In order: digits or none, hits, a hit's rule, what splits and groups say, then gaps and matches added up.
    return f"""get(transform(array(0), once_ -> get(transform(array(rlike({text}, '\\\\p{{Nd}}')), digit_ -> coalesce(flatten(transform(filter(array({hits}), h_ -> size(h_.m) > 0), h_ ->
      get(transform(array(element_at(array({law}), h_.k + 1)), r_ ->
        get(transform(array(named_struct('gaps', split({text}, r_.regex, -1), 'vals', if(r_.grouped, regexp_extract_all({text}, r_.regex, 1), h_.m), 'lead', if(r_.lead is null, {empty}, regexp_extract_all({text}, r_.lead, 1)))), z_ ->
          aggregate(transform(h_.m, (w_, i_) -> named_struct('gap', length(get(z_.gaps, i_)), 'whole', length(w_), 'value', get(z_.vals, i_), 'lead', length(get(z_.lead, i_)))),
            named_struct('at', 0, 'out', {NONE}),
            (a_, p_) -> named_struct('at', a_.at + p_.gap + p_.whole, 'out', concat(a_.out, transform(array(coalesce(a_.at + p_.gap + p_.lead, a_.at + p_.gap + p_.whole - length(p_.value))), start_ -> {made}))),
            a_ -> a_.out)), 0)), 0))), {NONE})), 0)), 0)"""


def rule_spans(text: Column, rules: list[Rule], layer: str = "pattern", confidence: float = 1.0, first: int = 0, prefix: str = "") -> Column:
    """All matches of each rule, in rule order, as an array of spans.

    Each rule is matched once per text with its regex as a literal, and only on texts that meet the rule's cheap
    condition; only for rules that matched, the text is split by the regex too, and offsets are the running lengths of
    gaps and matches. In the catalogue's rules with a group the group ends the match, so its start is the match's end less
    its length; a user's rule may have a group elsewhere, whose start is found by the length of what stands before it.
    """
    if not rules:
        return F.expr(NONE)
    scan = _scan("THE_TEXT", tuple(rules), layer, confidence, first, prefix)
    # In the SQL's lambdas the variable of ``let`` goes by its own name.
    return let(text, lambda v: F.expr(scan.replace("THE_TEXT", str(v).removeprefix("Column<'").removesuffix("'>"))))


def _by_start(spans: Column) -> Column:
    return F.array_sort(spans, lambda a, b: a["start"] - b["start"])


def _best(spans: Column) -> Column:
    """Of a few spans that hang together: in order of rank, those that overlap none before them."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct((-s["confidence"]).alias("c"), (s["start"] - s["end"]).alias("l"), s["start"].alias("at"), s["ord"].alias("o"), s.alias("s"))))
    kept = F.aggregate(
        order,
        F.expr(NONE),
        lambda acc, x: F.when(F.exists(acc, lambda k: (x["s"]["start"] < k["end"]) & (x["s"]["end"] > k["start"])), acc).otherwise(F.concat(acc, F.array(x["s"]))),
    )
    return F.when(F.size(spans) < 2, spans).otherwise(_by_start(kept))


def resolved(spans: Column) -> Column:
    """Of overlapping spans the one of higher confidence, then the longer, the earlier, the earlier rule; by start.

    A sweep by start gathers stretches of spans that hang together; only inside one are spans held against each other.
    """

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["end"]
        return F.struct(
            F.when(apart, F.concat(acc["done"], _best(acc["open"]))).otherwise(acc["done"]).alias("done"),
            F.when(apart, F.array(s)).otherwise(F.concat(acc["open"], F.array(s))).alias("open"),
            F.greatest(acc["end"], s["end"]).alias("end"),
        )

    start = F.struct(F.expr(NONE).alias("done"), F.expr(NONE).alias("open"), F.lit(0).alias("end"))
    swept = lambda spans: F.aggregate(_by_start(spans), start, step, lambda acc: F.concat(acc["done"], _best(acc["open"])))
    # Named once, as in other places: a filter on the result repeats what it is made of wherever that is named.
    return let(spans, lambda s: F.when(F.size(s) < 2, s).otherwise(swept(s)))


def merged(spans: Column) -> Column:
    """Sorted (start, end) pairs; those that overlap or touch are one."""
    pair = "struct<start:int,end:int>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(s["start"] <= last["end"], joined).otherwise(F.concat(acc, F.array(s)))

    plain = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))))
    return F.aggregate(plain, F.expr(f"cast(array() as array<{pair}>)"), step)


LEVEL_NAMES = LEVELS


def each(df: DataFrame, items: Column, *keep: Column | str) -> DataFrame:
    """The kept columns and ``s``, an item of an array that has no null ones, in a row for each.

    By an outer explode: of a plain one the optimiser infers a filter on the array's size, which it moves below, to the
    scan, with all that makes the array, so that every text would be scanned twice.
    """
    return df.select(*keep, F.explode_outer(items).alias("s")).where("s is not null")
