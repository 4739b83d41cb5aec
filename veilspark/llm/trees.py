"""Quality rules: gradient-boosted trees over document statistics, in numpy.

The statistics are those of the usual rules for web text (length, symbols, repeated lines and passages, case, ...).
Trees are grown on histograms with logistic loss; features named as monotonic can only lower (or raise) the score. The
ensemble is flattened to node arrays, which score a whole batch level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, carrying

#: Labelled rows that a model is fitted on, at most: the first ones in the order of a hash of their id.
SAMPLE = 20_000
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "exclaims", "distinct", "line_words", "bullets", "other_marks")
#: +1: more of it can't lower the score; -1: can't raise it.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "exclaims": -1}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more; by doubling, so windows are compared exactly."""
    n = len(words)
    if n <= window:
        return 0
    ids: dict[bytes, int] = {}
    rank = np.fromiter((ids.setdefault(w, len(ids)) for w in words), "int64", n)
    if len(ids) == n:
        return 0
    step = 1
    while step < window:
        key = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank = np.unique(key, return_inverse=True)[1]
        step *= 2
    often = np.bincount(rank)[rank] > 1
    if not often.any():
        return 0
    edge = np.zeros(n + 1, "int64")
    starts = np.flatnonzero(often)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts named in COUNTS, and the features named in FEATURES."""
    data = (text or "").encode()
    words = data.split()
    n = len(words)
    n_chars = len(text or "")
    word_chars = n_chars - (len(data) - len(data.translate(None, SPACES)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(SPACES)]
    n_dup = len(lines) - len(set(lines))
    repeats = repeated_words(words)
    upper = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = len(data) - len(data.translate(None, b"0123456789"))
    marks = len(data) - len(data.translate(None, b"@[]{}^~_=+/\\`"))
    m, c = max(1, n), max(1, word_chars)
    return [n, word_chars, n_symbols, n_dup, repeats], [
        float(np.log1p(n)), word_chars / m, n_symbols / m, n_dup / max(1, len(lines)), repeats / m, upper / c, digits / c, data.count(b"!") / m, len(set(words)) / m,
        m / max(1, len(lines)), sum(x.lstrip(SPACES)[:1] in (b"-", b"*") for x in lines) / max(1, len(lines)), marks / c,
    ]


@dataclass(frozen=True)
class Trees:
    """An ensemble in flat arrays: node i of all trees tests ``feature[i] <= threshold[i]`` and goes to left[i] or right[i]; a leaf goes to itself."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row; all trees at once, level by level."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, least: float = 4.0, ridge: float = 1.0) -> Trees:
    """Gradient-boosted trees with logistic loss. Without rows, or with one label only, the score is the share of ones, smoothed."""
    monotone = monotone or {}
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
        margin = np.full(len(y), base)

        def leaf(v: float) -> int:
            i = len(value)
            for a, b in ((feature, 0), (threshold, 0.0), (left, i), (right, i), (value, rate * v)):
                a.append(b)
            return i

        def grow(rows: np.ndarray, level: int, low: float, high: float) -> int:
            g, h = grad[rows], hess[rows]
            total_g, total_h = g.sum(), h.sum()
            own = float(np.clip(-total_g / (total_h + ridge), low, high))
            if level == depth or total_h < 2 * least:
                return leaf(own)
            best = (1e-6, None)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                gl = np.cumsum(np.bincount(binned[rows, j], g, len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[rows, j], h, len(c) + 1))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
                gain = -(gl * vl + (hl + ridge) * vl**2 / 2 + gr * vr + (hr + ridge) * vr**2 / 2) + (total_g * own + (total_h + ridge) * own**2 / 2)
                ok = (hl >= least) & (hr >= least)
                if s := monotone.get(j):
                    ok &= s * (vr - vl) >= 0
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (j, k, vl[k], vr[k]))
            if best[1] is None:
                return leaf(own)
            j, k, vl, vr = best[1]
            i = leaf(0.0)
            feature[i], threshold[i] = j, float(cuts[j][k])
            goes_left, middle = binned[rows, j] <= k, (vl + vr) / 2
            s = monotone.get(j, 0)
            left[i] = grow(rows[goes_left], level + 1, low if s >= 0 else max(low, middle), high if s <= 0 else min(high, middle))
            right[i] = grow(rows[~goes_left], level + 1, low if s <= 0 else max(low, middle), high if s >= 0 else min(high, middle))
            return i

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
            if np.abs(grad).max() < 1e-3:
                break
            first = len(value)
            roots.append(grow(np.arange(len(y)), 0, -np.inf, np.inf))
            tree = Trees(0.0, np.array([0]), *(np.array(a[first:]) - (first if a in (left, right) else 0) for a in (feature, threshold, left, right, value)), depth)
            at = np.zeros(len(y), "int64")
            for _ in range(depth):
                at = np.where(x[np.arange(len(y)), tree.feature[at]] <= tree.threshold[at], tree.left[at], tree.right[at])
            margin += tree.value[at]
    arrays = (np.array(roots, "int64"), np.array(feature, "int64"), np.array(threshold, "float64"), np.array(left, "int64"), np.array(right, "int64"), np.array(value, "float64"))
    return Trees(base, *arrays, depth)


def measured(df: DataFrame, model: Trees | None = None, keep: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """The statistics of each row of ``df`` (doc_id, text): (doc_id, counts, features), and with a model (score, base_failed, kept); then the columns in ``carry``."""
    names = ["doc_id", *COUNTS, "features", *(["score", "base_failed", "kept"] if model else []), *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 1):
            stats = [statistics(t) for t in part.column(1).to_pylist()]
            counts = np.array([s[0] for s in stats], "int64").reshape(len(stats), len(COUNTS))
            features = np.array([s[1] for s in stats], "float64").reshape(len(stats), len(FEATURES))
            columns = [part.column(0), *(pa.array(counts[:, j]) for j in range(len(COUNTS))), pa.array(list(features), pa.list_(pa.float64()))]
            if model:
                score = model.score(features)
                failed = (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])
                columns += [pa.array(score), pa.array(failed), pa.array(~failed & (score >= keep))]
            yield pa.RecordBatch.from_arrays([*columns, *part.columns[2:]], names)

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", features array<double>" + ", score double, base_failed boolean, kept boolean" * bool(model)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"__{c}") for c in carry)).mapInArrow(run, carrying(schema, df, carry))


def sampled_labels(labels: DataFrame, label: str, sample: int, where: Column | None = None) -> DataFrame:
    """(label_id, y): at most ``sample`` labelled ids, the first in the order of a hash; rows without id or label are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows if where is None else rows.where(where)
    return rows.groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(F.col(label).cast("int")).alias("y")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)


def train(df: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Fits the quality model on a bounded sample of labelled rows (``quality`` of ``labels``)."""
    chosen = sampled_labels(labels, "quality", sample)
    rows = df.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id").cast("long") == F.col("label_id"))
    known = measured(rows.select("doc_id", "text")).select("doc_id", "features").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).orderBy("doc_id").limit(2 * sample)
    got = known.select("features", "y").toPandas()
    x = np.array(got["features"].tolist(), "float64").reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy("float64"), {FEATURES.index(k): v for k, v in MONOTONE.items()})


def judge(df: DataFrame, labels: DataFrame, keep: float = 0.5, sample: int = SAMPLE, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, features, score, base_failed, kept) for each row.

    ``base_failed``: under 20 words, or over 30 % of them in repeated 8-word windows. ``kept``: the base rules hold and
    the model gives a probability of at least ``keep``. A null text counts as empty and fails the base rules. Repeated
    rows get the same verdict; without labels the model gives one half to all. Other columns are not
    read but for those in ``carry``, which follow as they are.
    """
    return measured(df, train(df, labels, sample), keep, carry)
