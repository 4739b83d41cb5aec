"""Toxicity by a factorization machine over hashed terms.

A document is the bag of its lower-case words and their four-letter beginnings, hashed; every term has a weight and a
short factor vector. ``score = sigmoid(bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j)``: the pair term raises the
score of terms that are toxic only together, such as an insult and the mention of a group, which weights alone can't
tell from each of them. It is computed in linear time as (|sum v_i x_i|^2 - sum |v_i|^2 x_i^2) / 2.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, carrying, given_back
from .trees import sampled_labels

#: Labelled rows that the machine is fitted on, at most.
SAMPLE = 10_000
BUCKETS, FACTORS = 1 << 18, 4
#: Terms in this share of the fitted rows, 20 at least, are also looked at in pairs.
SHARE = 0.02
#: Words that a task remembers before it starts anew, about 250 bytes each.
CACHED = 100_000
TERM = re.compile(r"\w+")


def terms(text: str | None, cache: dict[str, tuple[int, ...]], buckets: int = BUCKETS, live: np.ndarray | None = None) -> np.ndarray:
    """The distinct hashed terms of a text, sorted; with ``live``, those that are true in it."""
    found: set[int] = set()
    for word in set(TERM.findall((text or "").lower())):
        both = cache.get(word)
        if both is None:
            if len(cache) > CACHED:
                cache.clear()
            both = (xxhash.xxh32_intdigest(word) % buckets, xxhash.xxh32_intdigest("^" + word[:4]) % buckets)
            both = cache[word] = both if live is None else tuple(t for t in both if live[t])
        found.update(both)
    return np.sort(np.fromiter(found, "int64", len(found)))


@dataclass
class Machine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def margin(self, rows: list[np.ndarray]) -> np.ndarray:
        """A present term has the value 1; rows are joined end to end and summed by segment."""
        sizes = np.array([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        if not sizes.sum():
            return out
        full = np.flatnonzero(sizes)
        at, starts = np.concatenate([rows[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        v = self.factor[at]
        s = np.add.reduceat(v, starts)
        out[full] += np.add.reduceat(self.weight[at], starts) + ((s**2).sum(1) - np.add.reduceat((v**2).sum(1), starts)) / 2
        return out

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(rows), -30, 30)))


def telling(rows: list[np.ndarray], y: np.ndarray, buckets: int, most: int, least: float) -> np.ndarray:
    """The terms whose presence depends on the label: those of highest chi-square, from ``least`` on."""
    on, off = np.zeros(buckets), np.zeros(buckets)
    for r, label in zip(rows, y, strict=True):
        (on if label else off)[r] += 1
    n1, n0 = y.sum(), len(y) - y.sum()
    seen = on + off
    gap = np.abs(on * (n0 - off) - off * (n1 - on))
    chi = len(y) * np.maximum(0, gap - len(y) / 2) ** 2 / np.maximum(1, n1 * n0 * seen * (len(y) - seen))
    best = np.argsort(-chi, kind="stable")[:most]
    return np.sort(best[chi[best] >= least])


def paired(rows: list[np.ndarray], y: np.ndarray, buckets: int, known: np.ndarray, share: float = SHARE, least: float = 40.0, tile: int = 1024) -> np.ndarray:
    """The terms that tell the label only beside another one: among the rows with some term, their chi-square is at least ``least``.

    Every pair of terms found in that share of the rows is looked at, in tiles; terms in ``known`` are looked at as
    companions. Work grows with the square of the number of such terms, which the share bounds.
    """
    seen = np.bincount(np.concatenate(rows), minlength=buckets)
    used = np.flatnonzero((seen >= max(20, share * len(rows))) & (seen < len(rows)))
    place = np.full(buckets, -1)
    place[used] = np.arange(len(used))
    doc = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    at = place[np.concatenate(rows)]
    doc, at = doc[at >= 0], at[at >= 0]
    by = np.argsort(at, kind="stable")
    doc, at = doc[by], at[by]
    # Rows of label 1 come first, so that their part of a product is a product of the first rows.
    turn = np.empty(len(rows), "int64")
    turn[np.argsort(y != 1, kind="stable")] = np.arange(len(rows))
    doc, ones = turn[doc], int((y == 1).sum())
    told = np.isin(used, known)
    found = np.zeros(len(used), bool)

    def part(k: int) -> np.ndarray:
        a, b = np.searchsorted(at, [k, min(k + tile, len(used))])
        x = np.zeros((len(rows), min(tile, len(used) - k)), "float32")
        x[doc[a:b], at[a:b] - k] = 1
        return x

    def hits(on: np.ndarray, both: np.ndarray, n1: np.ndarray, n: np.ndarray) -> np.ndarray:
        n1, n, off = n1[:, None], n[:, None], both - on
        gap = np.maximum(0, np.abs(on * (n - n1 - off) - off * (n1 - on)) - n / 2)
        return (n * gap**2 >= least * np.maximum(1, n1 * (n - n1) * both * (n - both))) & (both >= 10)

    for k in range(0, len(used), tile):
        x = part(k)
        n, n1 = x.sum(0).astype("float64"), x[:ones].sum(0).astype("float64")
        for j in range(k, len(used), tile):
            z = x if j == k else part(j)
            of = x[:ones].T @ z[:ones]
            both, on = (of + x[ones:].T @ z[ones:]).astype("float64"), of.astype("float64")
            own, other = slice(k, k + x.shape[1]), slice(j, j + z.shape[1])
            m, m1 = z.sum(0).astype("float64"), z[:ones].sum(0).astype("float64")
            hit = hits(on, both, n1, n) & ~told[None, other]
            back = hits(on.T, both.T, m1, m) & ~told[None, own]
            if j == k:
                np.fill_diagonal(hit, False)
                np.fill_diagonal(back, False)
            found[other] |= hit.any(0) | back.any(1)
            found[own] |= hit.any(1) | back.any(0)
    return used[found]


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.3, decay: float = 1e-3, buckets: int = BUCKETS, factors: int = FACTORS, most: int = 4096, least: float = 20.0, seed: int = 7) -> Machine:
    """Adaptive gradient steps over shuffled batches, on the terms that tell alone or in a pair; classes weigh alike.

    Without rows of both labels the score is the share of ones, smoothed.
    """
    mean = (y.sum() + 0.5) / (len(y) + 1)
    random = np.random.default_rng(seed)
    whole = Machine(float(np.log(mean / (1 - mean))), np.zeros(buckets), np.zeros((buckets, factors)))
    if not len(y) or y.sum() in (0, len(y)):
        return whole
    used = telling(rows, y, buckets, most, least)
    used = np.union1d(used, paired(rows, y, buckets, used))
    place = np.full(buckets, -1)
    place[used] = np.arange(len(used))
    rows = [(p := place[r])[p >= 0] for r in rows]
    m = Machine(whole.bias, np.zeros(len(used)), random.normal(0, 0.01, (len(used), factors)))
    sum_w, sum_v, sum_b = np.full(len(used), 1e-2), np.full((len(used), factors), 1e-2), 1e-2
    share = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        order = random.permutation(len(y))
        for k in range(0, len(y), batch):
            pick = order[k : k + batch]
            some = [rows[i] for i in pick]
            sizes = np.array([len(r) for r in some])
            g = (1 / (1 + np.exp(-np.clip(m.margin(some), -30, 30))) - y[pick]) * share[pick]
            sum_b += (g.mean()) ** 2
            m.bias -= rate * g.mean() / np.sqrt(sum_b)
            if not sizes.sum():
                continue
            at, doc = np.concatenate(some), np.repeat(np.arange(len(some)), sizes)
            v = m.factor[at]
            s = np.zeros((len(some), v.shape[1]))
            np.add.at(s, doc, v)
            terms_, where = np.unique(at, return_inverse=True)
            gw = np.bincount(where, g[doc], len(terms_)) + decay * m.weight[terms_]
            each = g[doc, None] * (s[doc] - v)
            gv = np.stack([np.bincount(where, each[:, f], len(terms_)) for f in range(v.shape[1])], 1) + decay * m.factor[terms_]
            sum_w[terms_] += gw**2
            sum_v[terms_] += gv**2
            m.weight[terms_] -= rate * gw / np.sqrt(sum_w[terms_])
            m.factor[terms_] -= 0.2 * rate * gv / np.sqrt(sum_v[terms_])
    whole.bias, whole.weight[used], whole.factor[used] = m.bias, m.weight, m.factor
    return whole


def train(df: DataFrame, labels: DataFrame, where: Column | None = None, sample: int = SAMPLE) -> Machine:
    """Fits on a bounded sample of labelled rows (``toxic`` of ``labels``) of those that ``where`` admits."""
    chosen = sampled_labels(labels, "toxic", sample, where)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        for part in by_size(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([terms(t, cache).astype("int32") for t in part.column(1).to_pylist()], pa.list_(pa.int32())), part.column(2)], ["doc_id", "terms", "y"])

    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "y")
    got = rows.mapInArrow(hashed, "doc_id long, terms array<int>, y int").orderBy("doc_id", F.xxhash64("terms")).limit(2 * sample).toArrow()
    machine = fit(_lists(got.column("terms")), np.array(got.column("y").to_pylist(), "float64"))
    del got
    pa.default_memory_pool().release_unused()
    return machine


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    out = []
    for chunk in column.chunks:
        values, offsets = chunk.values.to_numpy(zero_copy_only=False), chunk.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def rate(df: DataFrame, machine: Machine, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score) for each row of ``df`` (doc_id, text); a null text counts as empty and gets the bias alone.

    Repeated rows get the same score, an empty table gives none, other columns are not read but for those in ``carry``,
    which follow as they are.
    """
    shared = df.sparkSession.sparkContext.broadcast((machine.bias, machine.weight.astype("float32"), machine.factor.astype("float32")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple[int, ...]] = {}
        own = Machine(*shared.value)
        live = (own.weight != 0) | own.factor.any(axis=1)
        for part in by_size(batches, 1):
            score = own.score([terms(t, cache, live=live) for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score.astype("float64")), *part.columns[2:]], ["doc_id", "score", *carry])
        del cache
        given_back()

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"__{c}") for c in carry)).mapInArrow(run, carrying("doc_id long, score double", df, carry))
