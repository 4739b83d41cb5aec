"""Parsers for phones, e-mail addresses and dates: shapes, then checks of their own.

The libraries that such parsers usually stand on aren't needed: phone numbers are checked by country code and length,
addresses by the syntax rules, dates by shape. So results are approximations of a full parser's, with true offsets.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import MONTHS, Rule
from .spans import changed, rule_spans

PHONE = Rule("domain_phone", "PHONE", 1, r"(?<![\w.])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d{2,4}(?:[\s.-]?\d{2,4}){1,4}(?![\w])")
EMAIL = Rule("domain_email", "EMAIL", 1, r"[A-Za-z0-9À-ɏ._%+-]+@[A-Za-z0-9À-ɏ.-]+\.[A-Za-zÀ-ɏ]{2,}")
DATE = Rule("domain_date", "DOB", 1, rf"(?<!\d)(?:\d{{1,2}}[./-]\d{{1,2}}[./-](?:18|19|20)\d{{2}}|(?:18|19|20)\d{{2}}-\d{{1,2}}-\d{{1,2}}|\d{{1,2}}\.?\s+(?:{MONTHS})\.?,?\s+(?:18|19|20)\d{{2}}|(?:{MONTHS})\.?\s+\d{{1,2}},?\s+(?:18|19|20)\d{{2}})(?!\d)", True)
# National numbers' lengths by country code; other codes: 7 to 12.
LENGTHS = {"1": (10, 10), "33": (9, 9), "34": (9, 9), "39": (9, 11), "44": (9, 10), "46": (7, 10), "49": (7, 11), "31": (9, 9), "358": (7, 11), "61": (9, 9), "81": (9, 10), "91": (10, 10)}


def phone_confidence(value: Column) -> Column:
    """0.95 for a number of its country's length (no code: ten digits that a North American number can have), else null."""
    ds = F.regexp_replace(value, r"[^0-9]", "")
    out = F.when(F.length(ds).between(8, 15), 0.95)
    for code, (low, high) in sorted(LENGTHS.items(), key=lambda x: len(x[0])):
        out = F.when(ds.startswith(code), F.when((F.length(ds) - len(code)).between(low, high), 0.95)).otherwise(out)
    return F.when(value.startswith("+"), out).when(ds.rlike("^1?[2-9][0-9]{2}[2-9][0-9]{6}$"), 0.95)


def email_confidence(value: Column) -> Column:
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(domain, r"\.")
    good = (F.length(local) <= 64) & (F.length(value) <= 254) & ~local.rlike(r"^\.|\.$|\.\.") & F.forall(labels, lambda x: (F.length(x).between(1, 63)) & ~x.startswith("-") & ~x.endswith("-"))
    return F.when(good, 0.95).otherwise(0.5)


def parsed(text: Column, first: int = 1000) -> Column:
    """Spans of the three parsers, in this order."""
    phones = F.filter(F.transform(rule_spans(text, [PHONE], "domain_phone", 0.95, first), lambda s: changed(s, confidence=phone_confidence(s["text"]))), lambda s: s["confidence"].isNotNull())
    emails = F.transform(rule_spans(text, [EMAIL], "domain_email", 0.95, first + 1), lambda s: changed(s, confidence=email_confidence(s["text"])))
    dates = F.filter(rule_spans(text, [DATE], "domain_date", 0.6, first + 2), lambda s: F.length(s["text"]).between(6, 45))
    return F.concat(phones, emails, dates)
