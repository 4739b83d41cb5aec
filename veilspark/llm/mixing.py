"""Mixing sources to target weights by entropy balancing.

Every document has a rate: how often the mix takes it. Among all rates that give each source its target number of
words, the chosen ones are closest (in relative entropy, documents as units) to one common base rate. The convex dual
has one multiplier per source, and its solution tilts the base rate exponentially in the document's size:
``rate = min(cap, base * exp(multiplier * size / mean size of the source))``. The multipliers come from Newton steps
whose gradient and curvature are aggregated on the executors; a bracket keeps each step safe. Rates are then rounded to
whole copies by diffusing the rounding error from the largest document of a group to the smallest.
"""

from __future__ import annotations

import math
from itertools import cycle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, words_of

#: The largest number of sources: the driver holds a few numbers for each.
MAX_SOURCES = 1_000_000
#: Tables of one row for each source are sent to all executors up to so many sources, about 100 bytes each; beyond, they are shuffled.
SENT_SOURCES = 100_000
#: Rows of a source that are rounded together.
GROUP_ROWS = 1000


def _by_source(rows: DataFrame, law: DataFrame, sources: int, on: str | F.Column = "source_no") -> DataFrame:
    """Joins a table of one row for each source. Few sources are broadcast, so a large one isn't gathered in a task."""
    return rows.join(F.broadcast(law) if sources <= SENT_SOURCES else law, on)


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``cap`` times its size; what is cut goes to the others by weight."""
    targets = [0.0] * len(sizes)
    open_, left = [i for i in range(len(sizes)) if sizes[i] > 0], total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / whole > cap * sizes[i]]
        if not full:
            for i in open_:
                targets[i] = left * weights[i] / whole
            break
        for i in full:
            targets[i] = float(cap * sizes[i])
        left -= sum(targets[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return targets


def solve_dual(hist: DataFrame, stats: list[tuple[int, int, int]], targets: list[float], base: float, cap: float, tol: float = 1e-7, most: int = 60) -> list[float | None]:
    """The multiplier of each source; None where every document is taken ``cap`` times.

    ``hist`` has (source_no, size, n): as many documents of that size. stats: (source_no, documents, words).
    """
    spark = hist.sparkSession
    live = {k: {"t": targets[i], "mean": w / n, "x": 0.0, "lo": -math.inf, "hi": math.inf} for i, (k, n, w) in enumerate(stats) if w and targets[i] < cap * w * (1 - 1e-9)}
    done: dict[int, float] = {}
    for _ in range(most):
        if not live:
            break
        at = spark.createDataFrame([(k, v["x"], v["mean"]) for k, v in live.items()], "source_no int, x double, mean double")
        z = F.col("size") / F.col("mean")
        tilt = base * F.exp(F.least(F.col("x") * z, F.lit(700.0)))
        rate = F.least(F.lit(cap), tilt)
        rows = (
            _by_source(hist, at, len(live))
            .groupBy("source_no")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("g"), F.sum(F.when(tilt < cap, F.col("n") * F.col("size") * z * rate)).alias("h"))
            .collect()
        )
        for r in rows:
            v = live[r["source_no"]]
            off = r["g"] - v["t"]
            if abs(off) <= tol * v["t"]:
                done[r["source_no"]] = live.pop(r["source_no"])["x"]
                continue
            v["hi" if off > 0 else "lo"] = v["x"]
            step = v["x"] - off / r["h"] if r["h"] else math.nan
            if not v["lo"] < step < v["hi"]:
                if math.isinf(v["hi"]):
                    step = 2 * abs(v["x"]) + 1
                elif math.isinf(v["lo"]):
                    step = -2 * abs(v["x"]) - 1
                else:
                    step = (v["lo"] + v["hi"]) / 2
            v["x"] = step
    done |= {k: v["x"] for k, v in live.items()}
    return [round(done[k], 9) if k in done else None for k, _, _ in stats]


def _round(pdf: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for one group: the error moves on from large documents to small ones."""
    pdf = pdf.sort_values(["size", "doc_id", "key"], ascending=[False, True, True], kind="stable")
    size, plan, most = pdf["size"].tolist(), pdf["plan"].tolist(), pdf["most"].tolist()
    copies, error = np.zeros(len(size), "int64"), 0.0
    for i, (s, p, m) in enumerate(zip(size, plan, most, strict=True)):
        if s:
            want = p + error
            copies[i] = c = min(max(math.floor(want / s + 0.5), 0), m)
            error = want - c * s
        else:
            copies[i] = math.floor(p + 0.5)
    return pdf.assign(copies=copies, taken=copies * pdf["size"])[["doc_id", "source", "size", "source_size", "target", "rate", "copies", "taken", "key"]]


def mix(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2, size: F.Column | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, rate, copies, taken, key: a hash of the text) for each row of ``df`` (doc_id, source, text).

    Sources in code-point order, null last, get ``weights`` in turn; together they get ``share`` of all words.
    A null or empty text has size 0; it is taken 0 words, and ``copies`` is its base rate rounded. Repeated rows and
    ids count as documents of their own. An empty table gives no rows. Other columns are not read.
    """
    spark = df.sparkSession
    rows = saved(df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), (words_of(F.col("text")) if size is None else size).alias("size"), _key().alias("key")))
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()
    if len(per) > MAX_SOURCES:
        raise ValueError(f"this operator is made for {MAX_SOURCES} sources at most")
    per.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    weight = cycle(weights)
    stats = [(i, r["n"], r["words"]) for i, r in enumerate(per)]
    targets = water_fill([w for _, _, w in stats], [float(next(weight)) for _ in stats], share * sum(w for _, _, w in stats), cap)
    names = spark.createDataFrame([(r["source"], i, r["n"]) for i, r in enumerate(per)], "s string, source_no int, n_source long")
    numbered = _by_source(rows, names, len(stats), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    hist = saved(numbered.groupBy("source_no", "size").agg(F.count(F.lit(1)).alias("n")).where("size > 0"))
    base = float(min(share, cap))
    multipliers = solve_dual(hist, stats, targets, base, cap)
    law = spark.createDataFrame(
        [(i, w, targets[i], multipliers[i], w / n) for i, n, w in stats], "source_no int, source_size long, target double, x double, mean double"
    )
    rate = F.when(F.col("size") == 0, F.lit(float(base))).when(F.col("x").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), base * F.exp(F.least(F.col("x") * F.col("size") / F.col("mean"), F.lit(700.0)))))
    planned = (
        _by_source(numbered, law, len(stats))
        .withColumn("rate", rate)
        .withColumn("plan", F.round(F.col("rate") * F.greatest("size", F.lit(1)), 4))
        .withColumn("most", F.lit(cap))
        .withColumn("part", F.pmod(F.xxhash64("doc_id", "size", "key"), F.ceil(F.col("n_source") / group_rows)))
    )
    return planned.groupBy("source_no", "part").applyInPandas(
        _round, "doc_id long, source string, size long, source_size long, target double, rate double, copies long, taken long, key long"
    )


def _key() -> F.Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def mixed(df: DataFrame, **law) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it. Rows alike in doc_id, source and text give one of them as often as they are taken together."""
    same = ["doc_id", "source", "key"]
    copies = mix(df, **law).groupBy(*same).agg(F.sum("copies").alias("__copies")).where("__copies > 0").select(*(F.col(c).alias(f"__{c}") for c in same), "__copies")
    rows = df.withColumn("__row", _key()).dropDuplicates(["doc_id", "source", "__row"])
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id")) & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__row") == F.col("__key"))
    taken = rows.join(copies, on).withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
    return taken.select(*df.columns)
