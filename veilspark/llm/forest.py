"""N-gram Jaccard join by a MinHash LSH forest.

A text is the set of its word 5-grams. A tree of the forest has texts by their signatures (runs of min-hashes); texts
that share a prefix of a tree meet there. The full depth is shortened to the longest prefix at which texts at the
threshold still meet in some tree with the target recall. At one threshold that bound gives every text the same length,
so prefixes are grouped as they are and no trie is walked. Texts that meet are put into one candidate component, and all
pairs of a component are verified exactly on the whole shingle sets, in blocks, so no link between texts of one component
is lost and no pair is ever emitted as a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, partitions, saved, stored

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.999
TREES, DEPTH = 32, 8
#: Shingles of one block: 8 bytes each, and a task holds two blocks.
BLOCK = 400_000


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word n-grams; one of all its words if it has fewer, none without words."""
    words = (text or "").encode().split()
    if not words:
        return np.zeros(0, "uint64")
    ids: dict[bytes, int] = {}
    order = np.fromiter((ids.setdefault(w, len(ids)) for w in words), "int64", len(words))
    own = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in ids), "uint64")[order]
    return np.unique(_rolled(own, min(n, len(words))))


def _rolled(own: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros(len(own) - n + 1, "uint64")
        for k in range(n):
            out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + own[k : k + len(out)])
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def depth_for(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold still meets in one of the trees with the target recall."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def signature(shingled: np.ndarray, trees: int, length: int, seed: int = 1) -> np.ndarray:
    """One 64-bit prefix for each tree: ``length`` min-hashes, 8 bits of each."""
    random = np.random.default_rng(seed)
    odd = random.integers(0, 1 << 31, trees * length, dtype="uint32") * np.uint32(2) + np.uint32(1)
    add = random.integers(0, 1 << 32, trees * length, dtype="uint32")
    x = (shingled >> np.uint64(32)).astype("uint32")
    least = np.full(trees * length, 0xFFFFFFFF, "uint32")
    with np.errstate(over="ignore"):
        for k in range(0, len(x), 256):
            least = np.minimum(least, (x[k : k + 256, None] * odd + add).min(axis=0))
        bits = ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype("uint64").reshape(trees, length)
        out = np.zeros(trees, "uint64")
        for k in range(length):
            out = (out << np.uint64(8)) | bits[:, k]
    return out.view("int64")


def _same(text: Column) -> Column:
    """16 bytes that name the exact text; a null one counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)), 1, 16)


def _signed(df: DataFrame, n: int, trees: int, length: int) -> DataFrame:
    """(doc_id, same, size, sig) for each row; ``same`` names the exact text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 1):
            size, sig = [], []
            for text in part.column(1).to_pylist():
                s = shingles(text, n)
                size.append(len(s))
                sig.append(signature(s, trees, length) if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size, pa.int64()), pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "same", "size", "sig"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _same(F.col("text")).alias("same")).mapInArrow(run, "doc_id long, same binary, size long, sig array<long>")


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the least id of the connected component, for each id in ``edges`` (a, b).

    Alternates two steps that keep connectivity: every vertex hangs its larger neighbours, then its smaller ones, on
    the least vertex it knows. Edges shrink to stars in a few rounds, also for long chains; no list of neighbours is
    ever gathered.
    """
    larger = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = saved(edges.where("a <> b").select(*larger(F.col("a"), F.col("b"))).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        far = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        up = edges.join(least, "a").select(F.col("a"), F.col("m").alias("b")).where("a <> b")
        large = far.union(up).select(*larger(F.col("a"), F.col("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b"))).select(*larger(F.col("a"), F.col("b"))).distinct()
        edges = saved(small)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    ids = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return ids.union(edges.select(F.col("b").alias("id"), F.col("b").alias("root"))).groupBy("id").agg(F.min("root").alias("root"))


def _verified(threshold: float):
    """For one task (some whole components, or two blocks of one): the links of each text, and a spanning forest of them."""

    def of_component(ids: np.ndarray, sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, links: np.ndarray, parent: np.ndarray) -> None:
        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        sizes = np.array([len(s) for s in sets])
        shingle, where = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        _, term, often = np.unique(shingle, return_inverse=True, return_counts=True)
        shared = often[term] > 1
        place = np.cumsum(often > 1) - 1
        term, where = place[term[shared]], where[shared]
        by_row = np.argsort(where, kind="stable")
        term, where = term[by_row], where[by_row]
        edges = np.searchsorted(where, np.arange(len(sets) + 1))
        width = int(place[-1]) + 1 if len(place) else 0
        if not width:
            return
        step = max(1, min(1024, (16 << 20) // max(1, width)))
        for a in range(0, len(first), step):
            rows = first[a : a + step]
            for b in range(0, len(second), step):
                columns = second[b : b + step]
                inter = _overlaps(rows, columns, term, edges, width)
                union = sizes[rows][:, None] + sizes[columns][None, :] - inter
                hit = inter >= threshold * union - 1e-9
                hit &= ids[rows][:, None] < ids[columns][None, :] if first is second else ids[rows][:, None] != ids[columns][None, :]
                i, j = np.nonzero(hit)
                np.add.at(links, rows[i], 1)
                np.add.at(links, columns[j], 1)
                for x, y in zip(rows[i].tolist(), columns[j].tolist(), strict=True):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["comp", "id"], kind="stable").reset_index(drop=True)
        ids, block = pdf["id"].to_numpy(), pdf["block"].to_numpy()
        sets = [np.frombuffer(s, "uint64") for s in pdf["shingles"]]
        links, parent = np.zeros(len(ids), "int64"), np.arange(len(ids))
        for rows in pdf.groupby("comp", sort=False).indices.values():
            local_links, local_parent = np.zeros(len(rows), "int64"), np.arange(len(rows))
            own = block[rows]
            if pdf["b"].iloc[rows[0]] == pdf["a"].iloc[rows[0]]:
                first = second = np.arange(len(rows))
            else:
                first, second = np.flatnonzero(own == pdf["a"].iloc[rows[0]]), np.flatnonzero(own == pdf["b"].iloc[rows[0]])
            of_component(ids[rows], [sets[i] for i in rows], first, second, local_links, local_parent)
            links[rows], parent[rows] = local_links, rows[local_parent]
        return pd.DataFrame({"id": ids, "links": links, "parent": ids[parent]})

    return run


def _overlaps(rows: np.ndarray, columns: np.ndarray, term: np.ndarray, edges: np.ndarray, width: int) -> np.ndarray:
    """How many shingles each row text shares with each column text, by a product of 0/1 matrices of the shingles both sides have."""

    def gathered(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = edges[which + 1] - edges[which]
        at = np.repeat(edges[which] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return np.repeat(np.arange(len(which)), counts), term[at]

    (r, rt), (c, ct) = gathered(rows), gathered(columns)
    here = np.zeros(width, "int8")
    here[rt] = 1
    there = np.zeros(width, "int8")
    there[ct] = 1
    both = (here & there).astype(bool)
    place = np.cumsum(both) - 1
    n = int(both.sum())
    total = np.zeros((len(rows), len(columns)), "float32")
    keep_r, keep_c = both[rt], both[ct]
    r, rt, c, ct = r[keep_r], place[rt[keep_r]], c[keep_c], place[ct[keep_c]]
    for k in range(0, n, 4096):
        w = min(4096, n - k)
        x, y = np.zeros((len(rows), w), "float32"), np.zeros((len(columns), w), "float32")
        of, to = (rt >= k) & (rt < k + w), (ct >= k) & (ct < k + w)
        x[r[of], rt[of] - k] = 1
        y[c[to], ct[to] - k] = 1
        total += x @ y.T
    return total


def linked(df: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links, n_copies) for each row of ``df`` (doc_id, text).

    Texts are told apart by their own hash, never by doc_id.

    A class is a connected component of links (similarity of at least ``threshold``) and exact copies; class_id is its
    least doc_id. n_links counts the *different* texts linked to this one, n_copies the rows with this very text.
    A text of fewer than ``n`` words is one shingle of them all. Texts without words, null ones too (taken as empty),
    have no shingles: they are linked to nothing, and class only with equal texts. Repeated rows are copies. A null
    doc_id is a document like any other but never names a class that has another id. Other columns are not read.
    """
    rows, texts = _classed(df, threshold, n, recall, trees, depth, block)
    return rows.select("doc_id", "same").join(texts.select("same", "class_id", "n_links", "n_copies"), "same").drop("same")


def _classed(df: DataFrame, threshold: float, n: int, recall: float, trees: int, depth: int, block: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, same, ...), and (same, doc_id: the least, lead, class_id, n_links, n_copies) for each different text.

    ``lead`` says whether the text stands for its class: it has the class's least doc_id, null last, then the least hash.
    """
    spark = df.sparkSession
    length = depth_for(threshold, recall, trees, depth)
    rows = stored(_signed(df, n, trees, length), "signed")
    texts = saved(rows.groupBy("same").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.first("size").alias("size"), F.first("sig").alias("sig")).withColumn("id", F.xxhash64("same")))
    prefixes = texts.where("size > 0").select("id", "size", F.posexplode("sig").alias("tree", "prefix"))
    leads = prefixes.groupBy("tree", "prefix").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    stars = prefixes.join(leads, ["tree", "prefix"]).where("id <> lead").groupBy("id", "lead").agg(F.first("size").alias("size")).select(F.col("id").alias("a"), F.col("lead").alias("b"))
    groups = saved(components(stars).join(texts.select("id", "size"), "id"))
    plan = groups.groupBy("root").agg(F.sum("size").alias("all")).withColumn("blocks", F.ceil(F.col("all") / block).cast("int"))
    tasks = F.greatest(F.lit(1), F.lit(4 * partitions(spark)))
    small = F.struct(F.lit(-1).cast("long").alias("task"), F.pmod(F.xxhash64("root"), tasks).cast("int").alias("a"), F.lit(-1).alias("b"))
    assigned = groups.drop("size").join(plan.drop("all"), "root").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    texts_of = df.select(F.xxhash64(_same(F.col("text"))).alias("id"), F.col("text").cast("string").alias("text")).dropDuplicates(["id"]).join(assigned, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 1):
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in (0, 2, 3, 4)), pa.array([shingles(t, n).tobytes() for t in part.column(1).to_pylist()], pa.binary())], ["id", "root", "blocks", "block", "shingles"])

    known = texts_of.mapInArrow(sets, "id long, root long, blocks int, block int, shingles binary")
    pair: Column = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.col("root").alias("task"), F.least(F.col("block"), k).alias("a"), F.greatest(F.col("block"), k).alias("b")))
    dealt = known.withColumn("at", F.explode(F.when(F.col("blocks") == 1, F.array(small)).otherwise(pair))).select("id", F.col("root").alias("comp"), "block", "shingles", "at.*")
    verdict = _verified(threshold)

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["b"].iloc[0] < 0:
            pdf = pdf.assign(b=pdf["a"])
        return verdict(pdf)

    checked = saved(dealt.groupBy("task", "a", "b").applyInPandas(verify, "id long, links long, parent long"))
    n_links = checked.groupBy("id").agg(F.sum("links").alias("n_links"))
    classes = components(checked.where("id <> parent").select(F.col("id").alias("a"), F.col("parent").alias("b")))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id")
    members = saved(classes.join(texts.select("id", first.alias("first")), "id"))
    labels = members.join(members.groupBy("root").agg(F.min("first").alias("least")), "root").select("id", "least", (F.col("first.id") == F.col("least.id")).alias("lead"))
    found = texts.join(n_links, "id", "left").join(labels, "id", "left")
    class_id = F.when(F.col("least").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return rows, found.select("same", "doc_id", F.coalesce("lead", F.lit(True)).alias("lead"), class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies")


def kept(df: DataFrame, threshold: float = THRESHOLD, n: int = NGRAM, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each class one row of the text that leads it, under that text's least doc_id.

    A class is left by class and exact text, so rows without doc_id, and different texts under one, don't stand for each other.
    """
    _, texts = _classed(df, threshold, n, recall, trees, depth, block)
    firsts = texts.where("lead").select(F.col("same").alias("__first"), F.col("doc_id").alias("__id"))
    chosen = df.withColumn("__same", _same(F.col("text"))).dropDuplicates(["doc_id", "__same"])
    return chosen.join(firsts, (F.col("__same") == F.col("__first")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left_semi").drop("__same")
