"""Confidence from check digits and from the text around a span, and the allow-list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from .checksums import valid
from .spans import changed

# Words near a span that raise or lower its confidence, and strings that are never personal data.
WINDOW = 80
BOOSTERS = (
    ("SSN", r"\b(?:SSN|social\s*security|soc\s*sec)\b", 0.3),
    ("EMAIL", r"\b(?:email|e-mail|mail|contact)\b", 0.1),
    ("PHONE", r"\b(?:phone|tel|call|mobile|cell|fax|contact|reach)\b", 0.2),
    ("NAME", r"\b(?:patient|client|employee|name|contact|applicant|Mr|Mrs|Ms|Dr)\b", 0.2),
    ("ADDRESS", r"\b(?:address|lives?\s*at|residing|located|street|home)\b", 0.2),
    ("DOB", r"\b(?:DOB|born|birth|birthday|date\s*of\s*birth|age)\b", 0.3),
    ("CREDIT_CARD", r"\b(?:card|credit|visa|mastercard|amex|payment)\b", 0.2),
    ("IBAN", r"\b(?:IBAN|bank|account|transfer)\b", 0.2),
    ("PASSPORT", r"\b(?:passport|travel\s*document)\b", 0.3),
    ("IP", r"\b(?:IP|address|server|host|network)\b", 0.1),
    ("FI_HETU", r"\b(?:henkilötunnus|HETU|personal\s*(?:identity|ID)|sosiaaliturvatunnus)\b", 0.3),
    ("MRN", r"\b(?:MRN|medical\s*record|chart|patient\s*(?:ID|number))\b", 0.2),
    ("INSURANCE_ID", r"\b(?:insurance|policy|member|plan|group)\b", 0.2),
)
LABEL, LABEL_BOOST = r"(?::\s*|is\s+)$", 0.15
REDUCERS = (
    (r"(?iU)\b(?:example|test|sample|dummy|fake|placeholder|mock|lorem)\b", -0.3),
    (r"(?iU)\b(?:format|pattern|regex|e\.g\.|for\s*instance|such\s*as)\b", -0.2),
    (r"(?U)[=:]\s*['\"]", -0.2),
)
NEVER = ("0.0.0.0", "255.255.255.255", "000-00-0000", "000.000.000-00", "0000000000")
TEST_PHONE = r"(?U)555[.\-\s]?01\d{2}"
PLACEHOLDER_NAMES = ("foo bar", "test user", "example user", "fulano de tal", "fulana de tal")
LOCAL_DOMAINS = ("localhost", "invalid")
RESERVED_IPS = r"^(?:127\.|0\.|255\.)"


def checked(spans: Column, config: Config) -> Column:
    """Valid check digits: +0.1, at most 1; invalid ones: -0.3, at least 0.2. No span is dropped."""

    def of(s: Column) -> Column:
        ok = valid(s["rule"], s["text"], config.legacy_hetu)
        c = F.when(ok, F.least(s["confidence"] + 0.1, F.lit(1.0))).when(~ok, F.greatest(s["confidence"] - 0.3, F.lit(0.2))).otherwise(s["confidence"])
        return changed(s, confidence=c)

    return F.transform(spans, of)


def context_score(text: Column, start: Column, end: Column, type: Column, base: Column) -> Column:
    """``base`` raised by the type's words or a label before it, lowered by each kind of example or code around it."""
    at = F.greatest(F.lit(0), start - WINDOW)
    before = F.substr(text, at + 1, start - at)
    around = F.concat(before, F.substr(text, end + 1, F.lit(WINDOW)))
    boost = F.lit(0.0)
    for name, words, plus in BOOSTERS:
        boost = F.when((type == name) & around.rlike("(?iU)" + words), F.lit(plus)).otherwise(boost)
    score = base + boost + F.when(before.rlike("(?U)" + LABEL), F.lit(LABEL_BOOST)).otherwise(F.lit(0.0))
    for words, minus in REDUCERS:
        score = score + F.when(around.rlike(words), F.lit(minus)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def in_context(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: changed(s, confidence=context_score(text, s["start"], s["end"], s["type"], s["confidence"])))


def allowed(value: Column, type: Column, custom: tuple[str, ...] = ()) -> Column:
    """Whether a span is a known false positive."""
    plain = F.trim(F.lower(value))
    domain = F.trim(F.lower(F.element_at(F.split(value, "@"), -1)))
    out = F.trim(value).isin(*NEVER)
    if custom:
        out = out | plain.isin(*[c.lower().strip() for c in custom])
    return (
        out
        | ((type == "PHONE") & value.rlike(TEST_PHONE))
        | ((type == "NAME") & plain.isin(*PLACEHOLDER_NAMES))
        | ((type == "EMAIL") & value.contains("@") & domain.isin(*LOCAL_DOMAINS))
        | ((type == "IP") & value.rlike(RESERVED_IPS))
    )


def without_allowed(spans: Column, config: Config) -> Column:
    return F.filter(spans, lambda s: ~allowed(s["text"], s["type"], config.custom_allowed))
