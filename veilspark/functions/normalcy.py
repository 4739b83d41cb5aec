"""How usual a text looks: scores of sliding windows, suspicious regions, and the gate of a model review."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Config
from .spans import let, merged

# Window, stride, and what speaks for harmless text, with weights.
SIZE, STRIDE, FACTOR = 80, 40, 0.7
SAFE = (
    ("code_block", r"(?iU)(?:def |class |import |from |return |if |for |while |try:|except:|function |const |let |var |=>|->|\{\{|\}\}|SELECT |INSERT |UPDATE |DELETE |CREATE |DROP )", 0.9),
    ("url", r"(?U)https?://\S+", 0.8),
    ("file_path", r"(?U)(?:/[\w.-]+){2,}|(?:[A-Z]:\\[\w\\.-]+)", 0.8),
    ("json_xml", r"(?U)[{}\[\]\":].*[{}\[\]\":]|<\/?[a-zA-Z][^>]*>", 0.7),
    ("instruction_phrases", r"(?iU)\b(?:please|summarize|explain|describe|list|compare|analyze|translate|write|create|generate|help me|how to|what is|can you|could you|I need|we need|the following|for example|in order to|make sure|step \d|note that|keep in mind|as follows)\b", 0.6),
    ("generic_connectors", r"(?iU)\b(?:the|a|an|is|are|was|were|been|being|have|has|had|do|does|did|will|would|shall|should|can|could|may|might|must|need|and|but|or|nor|for|yet|so|if|then|else|when|while|this|that|these|those|it|they|we|you|he|she|with|from|into|about|between|through|during|before|after|however|therefore|furthermore|moreover|although|because|since|according to|in addition|on the other hand|as a result)\b", 0.3),
    ("technical_terms", r"(?iU)\b(?:algorithm|database|server|client|API|endpoint|protocol|configuration|implementation|deployment|architecture|framework|function|method|variable|parameter|module|package|library|analysis|hypothesis|experiment|result|conclusion|methodology|percentage|coefficient|standard deviation|mean|median|diagnosis|treatment|symptom|condition|medication|procedure)\b", 0.5),
    ("safe_numbers", r"(?iU)(?:version|v|step|chapter|section|page|item|row|column|line|figure|table|example|option|level|tier|grade|score|count|port|error|code|status|id)\s*(?:#|:)?\s*\d+", 0.7),
    ("measurements", r"(?iU)\d+(?:\.\d+)?\s*(?:kg|lb|mg|g|oz|km|mi|m|cm|mm|ft|in|°[CF]|mph|kph|ms|sec|min|hr|GB|MB|KB|TB|px|em|rem|%)\b", 0.8),
    ("editorial_date", r"(?iU)(?:published|updated|created|modified|posted|released|as of|since|until|by|deadline|due|effective)\s+(?:on\s+)?\w+\s+\d{1,2},?\s+\d{4}", 0.7),
)


def window_score(chunk: Column, own: tuple[tuple[str, str, float], ...] = ()) -> Column:
    """1 for certainly harmless, 0 for nothing known. Each further sign counts for less."""
    rules = sorted([*SAFE, *((n, "(?iU)" + r, w) for n, r, w in own)], key=lambda r: -r[2])
    score, left = F.lit(0.0), F.lit(1.0)
    found = F.array_compact(F.array(*[F.when(chunk.rlike(r), F.lit(w)) for _, r, w in rules]))

    def step(acc: Column, w: Column) -> Column:
        part = w * acc["left"] * FACTOR
        return F.struct((acc["score"] + part).alias("score"), (acc["left"] - part).alias("left"))

    summed = lambda weights: F.aggregate(weights, F.struct(score.alias("score"), left.alias("left")), step, lambda acc: F.least(acc["score"], F.lit(1.0)))
    short = F.length(F.regexp_replace(chunk, r"(?U)^\s+|\s+$", "")) < 5
    bare = ~chunk.rlike(r"[\p{L}\p{N}]")
    return F.when(~chunk.rlike(r"(?U)\S"), 1.0).otherwise(let(found, lambda weights: F.when(F.size(weights) > 0, summed(weights)).when(short, 0.8).when(bare, 0.9).otherwise(0.0)))


def windows(text: Column, own: tuple[tuple[str, str, float], ...] = ()) -> Column:
    """(start, end, score) of each window; none for an empty text.

    The text is cut into strides once, and a window is two of them: a substring at each start would be read from the
    text's beginning every time.
    """

    def of(pieces: Column) -> Column:
        def window(piece: Column, k: Column) -> Column:
            start = k * STRIDE
            chunk = F.concat(piece, F.coalesce(F.get(pieces, k + 1), F.lit("")))
            return let(chunk, lambda c: F.struct(start.alias("start"), (start + F.length(c)).alias("end"), window_score(c, own).alias("score")))

        return F.transform(pieces, window)

    return let(F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{STRIDE}}}"), F.lit(0)), of)


def suspicious(text: Column, below: float = 0.5, own: tuple[tuple[str, str, float], ...] = ()) -> Column:
    return merged(F.filter(windows(text, own), lambda w: w["score"] < below))


def uncovered(regions: Column, spans: Column) -> Column:
    """Regions of which any character is outside all spans."""
    cover = merged(spans)
    return F.filter(regions, lambda r: ~F.exists(cover, lambda c: (c["start"] <= r["start"]) & (r["end"] <= c["end"])))


def needs_review(text: Column, regions: Column, open_: Column, spans: Column, config: Config) -> Column:
    """Whether a model should look: some open region has enough letters or digits, and what is known isn't yet ample and sure."""
    content = F.exists(open_, lambda r: F.length(F.regexp_replace(F.substr(text, r["start"] + 1, r["end"] - r["start"]), r"[^\p{L}\p{N}]", "")) >= config.min_uncovered)
    total = lambda a: F.aggregate(a, F.lit(0), lambda acc, r: acc + r["end"] - r["start"])
    near = F.filter(spans, lambda s: F.exists(regions, lambda r: (s["start"] < r["end"]) & (s["end"] > r["start"])))
    mean = F.aggregate(near, F.lit(0.0), lambda acc, s: acc + s["confidence"]) / F.size(near)
    covered = (total(regions) - total(open_)) / total(regions)
    return content & ~F.coalesce((F.size(near) > 0) & (covered >= config.skip_coverage) & (mean >= config.skip_confidence), F.lit(False))
