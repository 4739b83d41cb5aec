"""Undoing obfuscation: look-alike letters, written-out @ and dots, spelled digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spans import changed, let, span

# Look-alikes with what they stand for, written-out signs, digit words.
LOOK_ALIKE = ("аеорсухАВЕКМНОРСТ–—‘’“” ", "aeopcyxABEKMHOPCT--''\"\" ")
SIGNS = (
    (r"\s*\[\s*at\s*\]\s*", "@"),
    (r"\s*\(\s*at\s*\)\s*", "@"),
    (r"\s+at\s+", "@"),
    (r"\s*\[\s*dot\s*\]\s*", "."),
    (r"\s*\(\s*dot\s*\)\s*", "."),
    (r"\s+dot\s+", "."),
)
DIGIT_WORDS = (("zero", "0"), ("one", "1"), ("two", "2"), ("three", "3"), ("four", "4"), ("five", "5"), ("six", "6"), ("seven", "7"), ("eight", "8"), ("nine", "9"), ("oh", "0"))
SEPARATORS = (("dash", "-"), ("hyphen", "-"), ("dot", "."), ("point", "."), ("space", " "), ("comma", ","))


def plain_letters(text: Column) -> Column:
    return F.translate(text, *LOOK_ALIKE)


def plain_signs(text: Column) -> Column:
    for pattern, sign in SIGNS:
        text = _where(text, pattern, sign)
    return text


def _where(text: Column, pattern: str, sign: str) -> Column:
    """A replacement on the texts alone that have what it looks for, blanks around it aside."""
    core = pattern.removeprefix(r"\s*").removesuffix(r"\s*").replace(r"\s+", r"\s")
    return let(text, lambda t: F.when(t.rlike("(?iU)" + core), F.regexp_replace(t, "(?iU)" + pattern, sign)).otherwise(t))


def spelled(text: Column) -> Column:
    """Whether three or more digit words stand in a row; separators don't break the row, other words do."""
    words = F.split(F.lower(text), r"(?U)\s+")
    digits, between = F.array(*[F.lit(w) for w, _ in DIGIT_WORDS]), F.array(*[F.lit(w) for w, _ in SEPARATORS])

    def step(acc: Column, w: Column) -> Column:
        w = F.regexp_replace(w, r"^[.,;:\-()\[\]]+|[.,;:\-()\[\]]+$", "")
        run = F.when(F.array_contains(digits, w), acc["run"] + 1).when(F.array_contains(between, w), acc["run"]).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["most"], run).alias("most"))

    counted = F.aggregate(words, F.struct(F.lit(0).alias("run"), F.lit(0).alias("most")), step, lambda acc: acc["most"] >= 3)
    digit, sign = "|".join(w for w, _ in DIGIT_WORDS), "|".join(w for w, _ in SEPARATORS)
    # Two digit words with nothing but signs and separators between them: without, no three stand in a row.
    return F.when(text.rlike(rf"(?iU)\b(?:{digit})\b\W+(?:(?:{sign})\b\W+)*(?:{digit})\b"), counted).otherwise(F.lit(False))


def plain_digits(text: Column) -> Column:
    def rewritten(text: Column) -> Column:
        out = text
        for word, sign in DIGIT_WORDS + SEPARATORS:
            out = F.regexp_replace(out, rf"(?iU)\b{word}\b", sign)
        # Blanks go between digits and the signs that stand alone among them.
        joined = F.regexp_replace(out, r"(?U)(?<=\d)\s+(?=\d|[-.](?:\s+[-.])*\s+\d)", "")
        return F.regexp_replace(joined, r"(?U)(?<=[\d][-.])\s+(?=\d)", "")

    return let(text, lambda t: F.when(spelled(t), rewritten(t)).otherwise(t))


def normalised(text: Column) -> Column:
    return plain_digits(plain_signs(plain_letters(text)))


def obfuscations(text: Column) -> Column:
    """Which kinds of obfuscation a text has."""
    signs = F.lit(False)
    for pattern, _ in SIGNS:
        signs = signs | text.rlike("(?iU)" + pattern)
    return F.array_compact(F.array(F.when(signs, "email_obfuscation"), F.when(spelled(text), "spelled_digits"), F.when(plain_letters(text) != text, "homoglyphs")))


def mapped_back(text: Column, plain: Column, spans: Column) -> Column:
    """Spans of the plain text as spans of the original one: from behind the word before to the word after, as first found there."""

    def of(s: Column) -> Column:
        head = F.substr(plain, F.greatest(F.lit(0), s["start"] - 20) + 1, F.least(s["start"], F.lit(20)))
        tail = F.substr(plain, s["end"] + 1, F.lit(20))
        word = lambda c, k: F.coalesce(F.try_element_at(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""), F.lit(k)), F.lit(""))
        left, right = word(head, -1), word(tail, 1)
        found = F.when(left != "", F.position(left, text)).otherwise(0)
        start = F.when(found > 0, found - 1 + F.length(left)).otherwise(0)
        stop = F.when(right != "", F.position(right, text, start + 1)).otherwise(0)
        end = F.when(stop > 0, stop - 1).otherwise(F.length(text))
        raw = F.substr(text, start + 1, F.greatest(end - start, F.lit(0)))
        cut = F.regexp_replace(raw, r"^[ \t\n]+", "")
        inner = F.regexp_replace(cut, r"[ \t\n]+$", "")
        at = start + F.length(raw) - F.length(cut)
        return span(at, at + F.length(inner), inner, F.concat(F.lit("obfuscated_"), s["rule"]), s["type"], s["level"], F.lit("obfuscation"), s["confidence"] * 0.9, s["ord"])

    return F.filter(F.transform(spans, of), lambda s: s["end"] > s["start"])


def unseen(new: Column, old: Column) -> Column:
    """Spans that have none of the same text or type among the old ones that start within 50 characters."""
    return F.filter(new, lambda n: ~F.exists(old, lambda o: (F.abs(n["start"] - o["start"]) < 50) & ((n["text"] == o["text"]) | (n["type"] == o["type"]))))


def shifted(spans: Column, by: int) -> Column:
    return F.transform(spans, lambda s: changed(s, ord=s["ord"] + by))
