"""Check digits as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check letters and weights of the national schemes.
DNI = "TRWAGMYFPDXBNJZSQVHLCKE"
HETU = "0123456789ABCDEFHJKLMNPRSTUVWXY"
CPF1, CPF2 = (10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2)
BSN, NHS, RRN = (9, 8, 7, 6, 5, 4, 3, 2, -1), (10, 9, 8, 7, 6, 5, 4, 3, 2), (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)


def digits(value: Column) -> Column:
    return F.transform(F.filter(F.split(F.regexp_replace(value, r"[^0-9]", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))


def weighted(ds: Column, weights: tuple[int, ...]) -> Column:
    w = F.array(*map(F.lit, weights))
    return F.aggregate(F.zip_with(F.slice(ds, 1, len(weights)), w, lambda a, b: F.coalesce(a, F.lit(0)) * b), F.lit(0), lambda acc, x: acc + x)


def luhn(value: Column) -> Column:
    ds = F.reverse(digits(value))
    total = F.aggregate(F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda a, x: a + x)
    return (F.size(ds) >= 2) & (total % 10 == 0)


def iban(value: Column) -> Column:
    clean = F.upper(F.regexp_replace(value, " ", ""))
    turned = F.concat(F.substr(clean, F.lit(5)), F.substring(clean, 1, 4))
    rest = F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return clean.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & (rest == 1)


def hetu(value: Column, legacy: bool = False) -> Column:
    """The check character over date and individual number. ``legacy`` slices one place later, as older results did."""
    clean = F.regexp_replace(value, " ", "")
    number = F.concat(F.substring(clean, 1, 6), F.substring(clean, 9 if legacy else 8, 3)).try_cast("long")
    return F.coalesce((F.length(clean) == 11) & (F.substring(clean, 11, 1) == F.substr(F.lit(HETU), (number % 31 + 1).cast("int"), F.lit(1))), F.lit(False))


def dni(value: Column) -> Column:
    clean = F.trim(value)
    number = F.substring(clean, 1, 8).try_cast("long")
    return F.coalesce((F.length(clean) == 9) & (F.upper(F.substring(clean, 9, 1)) == F.substr(F.lit(DNI), (number % 23 + 1).cast("int"), F.lit(1))), F.lit(False))


def nie(value: Column) -> Column:
    clean = F.upper(F.trim(value))
    return clean.rlike("^[XYZ]") & dni(F.concat(F.translate(F.substring(clean, 1, 1), "XYZ", "012"), F.substr(clean, F.lit(2))))


def cpf(value: Column) -> Column:
    ds = digits(value)
    check = lambda s: F.when(s % 11 < 2, 0).otherwise(11 - s % 11)
    return (F.size(ds) == 11) & (F.size(F.array_distinct(ds)) > 1) & (F.get(ds, F.lit(9)) == check(weighted(ds, CPF1))) & (F.get(ds, F.lit(10)) == check(weighted(ds, CPF2)))


def _last_word(value: Column) -> Column:
    return F.when(value.contains(":"), F.element_at(F.split(F.trim(value), r"\s+"), -1)).otherwise(value)


def bsn(value: Column) -> Column:
    ds = digits(_last_word(value))
    ds = F.when(F.size(ds) == 8, F.concat(F.array(F.lit(0)), ds)).otherwise(ds)
    total = weighted(ds, BSN)
    return (F.size(ds) == 9) & (total % 11 == 0) & (total != 0)


def nhs(value: Column) -> Column:
    ds = digits(_last_word(value))
    check = (11 - weighted(ds, NHS) % 11) % 11
    return (F.size(ds) == 10) & (check != 10) & (F.get(ds, F.lit(9)) == check)


def rrn(value: Column) -> Column:
    ds = digits(value)
    return (F.size(ds) == 13) & (F.get(ds, F.lit(12)) == (11 - weighted(ds, RRN) % 11) % 10)


CHECKS = {"credit_card": luhn, "iban": iban, "finland_hetu": hetu, "spain_dni": dni, "spain_nie": nie, "brazil_cpf": cpf, "netherlands_bsn": bsn, "uk_nhs": nhs, "south_korea_rrn": rrn}


def valid(rule: Column, value: Column, legacy_hetu: bool = False) -> Column:
    """True or false by the rule's check; null for a rule without one."""
    out = F.lit(None).cast("boolean")
    for name, check in CHECKS.items():
        out = F.when(rule == name, check(value, legacy_hetu) if name == "finland_hetu" else check(value)).otherwise(out)
    return out
