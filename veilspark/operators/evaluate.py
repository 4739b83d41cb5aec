"""Quality of detections against expected spans or strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    b = float(beta) ** 2
    below = b * precision + recall
    return F.when(below == 0, 0.0).otherwise((1 + b) * precision * recall / below)


def overlap_scores(gold: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """tp, fn, fp and rates: an expected span counts if any found one overlaps it; a found one is false if it overlaps none. Both: (key, start, end)."""
    g, d = gold.select(F.col(key).alias("k"), F.col("start").alias("gs"), F.col("end").alias("ge")), found.select(F.col(key).alias("k"), F.col("start").alias("ds"), F.col("end").alias("de"))
    meet = (F.col("gs") < F.col("de")) & (F.col("ge") > F.col("ds"))
    hits = g.join(d, (g["k"] == d["k"]) & meet, "left_semi").agg(F.count(F.lit(1)).alias("tp"))
    misses = g.join(d, (g["k"] == d["k"]) & meet, "left_anti").agg(F.count(F.lit(1)).alias("fn"))
    false = d.join(g, (g["k"] == d["k"]) & meet, "left_anti").agg(F.count(F.lit(1)).alias("fp"))
    return rates(hits.join(F.broadcast(misses)).join(F.broadcast(false)))


def rates(df: DataFrame) -> DataFrame:
    """Adds recall, precision, f1 and f2 to rows of tp, fn, fp."""
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    df = df.withColumn("recall", r.cast("double")).withColumn("precision", p.cast("double"))
    return df.withColumn("f1", f_beta(F.col("precision"), F.col("recall"), 1)).withColumn("f2", f_beta(F.col("precision"), F.col("recall"), 2))


def strict_matches(expected: Column, found: Column) -> Column:
    """How many expected strings have a found one of their own: each in turn takes the first left that contains it or lies in it, case aside."""
    low = F.transform(found, lambda f: F.lower(f))

    def step(acc: Column, e: Column) -> Column:
        e = F.lower(e)
        free = F.filter(F.sequence(F.lit(1), F.size(low)), lambda i: ~F.array_contains(acc["used"], i) & (F.element_at(low, i).contains(e) | e.contains(F.element_at(low, i))))
        pick = F.try_element_at(free, F.lit(1))
        return F.struct(F.when(pick.isNull(), acc["used"]).otherwise(F.concat(acc["used"], F.array(pick))).alias("used"))

    start = F.struct(F.expr("cast(array() as array<int>)").alias("used"))
    return F.when(F.size(found) == 0, 0).otherwise(F.aggregate(expected, start, step, lambda acc: F.size(acc["used"])))


def reused_matches(expected: Column, found: Column) -> Column:
    """How many expected strings have any found one; a found one may serve several."""
    return F.size(F.filter(expected, lambda e: F.exists(found, lambda f: F.lower(f).contains(F.lower(e)) | F.lower(e).contains(F.lower(f)))))


def gone(sanitized: Column, values: Column) -> Column:
    """How many values no longer stand in a redacted text."""
    return F.size(F.filter(values, lambda v: ~sanitized.contains(v)))


def clean_rate(df: DataFrame, spans: str = "spans") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.size(spans) == 0).alias("clean"))


def only_in(a: DataFrame, b: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of a that overlap none of b's."""
    x, y = a.alias("x"), b.alias("y")
    return x.join(y, (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.start") < F.col("y.end")) & (F.col("x.end") > F.col("y.start")), "left_anti")


def compare(runs: dict[str, DataFrame]) -> DataFrame:
    """Counts by configuration and type: (config, type, n)."""
    out = None
    for name, found in runs.items():
        part = found.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("config"), "type", "n")
        out = part if out is None else out.unionByName(part)
    return out


def misses(gold: DataFrame, found: DataFrame, texts: DataFrame, key: str = "doc_id", around: int = 22, top: int = 20) -> DataFrame:
    """The most frequent missed labels with a piece of context of one example each; gold: (key, start, end, label)."""
    lost = only_in(gold, found, key).join(texts.select(key, "text"), key)
    cut = F.substr(F.col("text"), F.greatest(F.col("start") - around, F.lit(0)) + 1, F.col("end") - F.greatest(F.col("start") - around, F.lit(0)) + around)
    return lost.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(cut).alias("example")).orderBy(F.desc("n"), "label").limit(top)
