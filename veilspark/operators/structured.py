"""Tables: columns classified by their names, whole values replaced."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.spans import NONE, changed, span
from .detect import spans_frame
from .scrub import numbers, originals, rebuilt

# Parts of column names and their types, the first that fits counts; and names that are never personal.
COLUMNS = (
    (r"(?:full_?)?name|patient|client|employee|contact|person|applicant", "NAME"),
    (r"first_?name|given_?name|forename", "NAME"),
    (r"last_?name|surname|family_?name", "NAME"),
    (r"emergency.+name|next.+kin|guardian|spouse", "NAME"),
    (r"d[._]?o[._]?b|date.+birth|birth.?date|birthday|born", "DOB"),
    (r"e?mail|email.+addr", "EMAIL"),
    (r"phone|tel|mobile|cell|fax", "PHONE"),
    (r"address|addr|street|residence|location|home", "ADDRESS"),
    (r"zip|postal|postcode", "ZIPCODE"),
    (r"ssn|social.+sec|national.+id|identity|hetu|nino|bsn|cpf|dni", "ID_NUMBER"),
    (r"passport", "PASSPORT"),
    (r"driver.?s?.+lic", "DRIVERS_LICENSE"),
    (r"mrn|medical.+record|chart.+num|patient.+id", "MRN"),
    (r"insurance|policy|member.+id|group.+num", "INSURANCE_ID"),
    (r"iban|bank.+acc|account.+num|routing|sort.+code|bsb", "FINANCIAL"),
    (r"credit.+card|card.+num|cc.+num", "CREDIT_CARD"),
    (r"salary|income|wage|compensation|pay", "FINANCIAL"),
    (r"ip.+addr|ip$", "IP"),
    (r"diagnosis|condition|dx", "MEDICAL"),
    (r"medication|rx|prescription|drug", "MEDICAL"),
    (r"blood.+type|genetic|dna|genome|brca|marker", "MEDICAL"),
    (r"disabilit|mental.+health|psych", "MEDICAL"),
    (r"religio|faith|worship", "SENSITIVE"),
    (r"politic|party|affiliation", "SENSITIVE"),
    (r"ethnic|race|national.+origin", "SENSITIVE"),
    (r"sex$|gender|orientation|lgb", "SENSITIVE"),
)
SAFE = r"(?:id|row|index|count|total|status|type|category|flag|created|updated|modified|timestamp|date$|age|description|notes|comments|region|country|city|state)$"


def classify(column: str) -> str | None:
    """The type a column's name stands for, or None."""
    if re.match(SAFE, column, re.I):
        return None
    return next((kind for pattern, kind in COLUMNS if re.search(pattern, column, re.I)), None)


def _own(marks: Column, column: int) -> Column:
    """One column's marks, by start; they were numbered from its right."""
    return F.reverse(F.filter(marks, lambda m: m["ord"] == column))


def _in_column(spans: Column, column: int) -> Column:
    """A column's spans from its right, with the column's number in place of the rule's."""
    return F.reverse(F.transform(spans, lambda s: changed(s, ord=F.lit(column))))


def scrub_table(df: DataFrame, types: dict[str, str | None] | None = None, config: Config | None = None) -> DataFrame:
    """``df`` with redacted string columns and a placeholders map for each row.

    A column with a type (by name, or by ``types``) is replaced as a whole, others by their spans; null and blank values
    and columns of other kinds stay. The numbering is the row's: columns in order share it, so no two values of a row
    get one placeholder unless they are equal. Classification happens once, when the plan is built.
    """
    config = config or Config()
    texts = [c for c, kind in df.dtypes if kind == "string"]
    kinds = {c: (types or {}).get(c, classify(c)) for c in texts}
    out, parts = df, []
    for i, c in enumerate(texts):
        value = F.col(c)
        if kinds[c]:
            whole = F.array(span(F.lit(0), F.length(value), value, F.lit("column"), F.lit(kinds[c]), F.lit(0), F.lit("column"), F.lit(1.0), F.lit(0)))
            out = out.withColumn(f"__s{i}", F.when(F.length(F.trim(value)) > 0, whole).otherwise(F.expr(NONE)))
        else:
            out = spans_frame(out, c, config, out=f"__s{i}")
        parts.append(_in_column(F.col(f"__s{i}"), i))
    if not texts:
        return df.withColumn("placeholders", F.expr("cast(map() as map<string,string>)"))
    out = out.withColumn("__all", F.concat(*parts)).withColumn("__m", numbers(F.col("__all"), config.placeholder)).drop("__all")
    redacted = {}
    for i, c in enumerate(texts):
        redacted[c] = rebuilt(F.col(c), _own(F.col("__m"), i))
    return out.withColumns({"placeholders": originals(F.col("__m")), **redacted}).drop("__m", *[f"__s{i}" for i in range(len(texts))])
