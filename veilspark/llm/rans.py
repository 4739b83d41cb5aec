"""Token ids in a binary format: a static range asymmetric numeral system.

One frequency table, counted over the whole corpus, is shared by all blocks. A block holds the ids of consecutive
documents in the order of doc_id (one too long for a block goes on in the next) as interleaved streams, one state each, so that a whole row of
ids is coded at once. Blocks are independent of each other, and inside a block checkpoints keep the states and the
place in the words, from which decoding can start as well. Checksums cover the ids of every block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_size, partitions, saved, stored
from .tokens import tokenizer

SCALE = 20
LANES, BLOCK, CHECKPOINT = 4096, 1 << 20, 64
LOW = np.uint64(1 << 31)
W32 = np.uint64(32)


@dataclass(frozen=True)
class Table:
    freq: np.ndarray
    start: np.ndarray
    symbol: np.ndarray

    @staticmethod
    def of(counts: np.ndarray, scale: int = SCALE) -> Table:
        """Counts scaled to a sum of 2**scale, none that occurs under 1: shares are rounded down, and what is left goes to the largest remainders."""
        total, room = int(counts.sum()), 1 << scale
        used = np.flatnonzero(counts)
        freq = np.zeros(len(counts), "int64")
        if total:
            if len(used) > room:
                raise ValueError("more symbols than the scale has places")
            exact = counts[used] * (room - len(used)) / total
            freq[used] = 1 + np.floor(exact).astype("int64")
            left = room - int(freq.sum())
            best = used[np.argsort(-(exact - np.floor(exact)), kind="stable")]
            freq[best[np.arange(left) % len(best)]] += 1 if left <= len(best) else 0
            freq[used[np.argmax(counts[used])]] += room - int(freq.sum())
        start = np.concatenate([[0], np.cumsum(freq)[:-1]])
        return Table(freq.astype("uint64"), start.astype("uint64"), np.repeat(np.arange(len(freq)), freq).astype("uint32"))


def encode(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT, scale: int = SCALE) -> bytes:
    """One block: a head, the checkpoints (row, place, states), and the words."""
    n = len(ids)
    lanes = max(1, min(lanes, n))
    rows = -(-n // lanes)
    state = np.full(lanes, LOW, "uint64")
    freq, start, shift = table.freq, table.start, np.uint64(63 - scale)
    parts, marks, emitted = [], [], 0
    for row in range(rows - 1, -1, -1):
        s = ids[row * lanes : (row + 1) * lanes]
        k = len(s)
        f, x = freq[s], state[:k]
        if not f.all():
            raise ValueError("an id that the table doesn't have")
        full = x >= f << shift
        if full.any():
            words = x[full].astype("uint32")
            parts.append(words)
            emitted += len(words)
            x = np.where(full, x >> W32, x)
        q, r = np.divmod(x, f)
        state[:k] = (q << np.uint64(scale)) + r + start[s]
        if row and row % every == 0:
            marks.append((row, emitted, state.copy()))
    words = np.concatenate(parts[::-1]) if parts else np.zeros(0, "uint32")
    head = np.array([n, lanes, every, len(marks), len(words)], "<u8").tobytes()
    body = b"".join(np.array([row, len(words) - e], "<u8").tobytes() + st.astype("<u8").tobytes() for row, e, st in marks[::-1])
    return head + state.astype("<u8").tobytes() + body + words.astype("<u4").tobytes()


def decode(data: bytes, table: Table, checkpoint: int | None = None, scale: int = SCALE) -> np.ndarray:
    """The ids of a block, or those from a checkpoint on (from 0)."""
    n, lanes, _, marks, n_words = (int(v) for v in np.frombuffer(data, "<u8", 5))
    at = 40
    state, row, place = np.frombuffer(data, "<u8", lanes, at).copy(), 0, 0
    at += 8 * lanes
    size = 16 + 8 * lanes
    if checkpoint is not None:
        row, place = (int(v) for v in np.frombuffer(data, "<u8", 2, at + checkpoint * size))
        state = np.frombuffer(data, "<u8", lanes, at + checkpoint * size + 16).copy()
    words = np.frombuffer(data, "<u4", n_words, at + marks * size).astype("uint64")
    out = np.zeros(n, "uint32")
    mask, sc = np.uint64((1 << scale) - 1), np.uint64(scale)
    for r in range(row, -(-n // lanes)):
        k = min(lanes, n - r * lanes)
        x = state[:k]
        slot = x & mask
        s = table.symbol[slot]
        out[r * lanes : r * lanes + k] = s
        x = table.freq[s] * (x >> sc) + slot - table.start[s]
        need = x < LOW
        m = int(np.count_nonzero(need))
        if m:
            x[need] = (x[need] << W32) | words[place : place + m]
            place += m
        state[:k] = x
    if checkpoint is None and (place != n_words or (state != LOW).any()):
        raise ValueError("a block doesn't end as it began")
    return out[row * lanes :]


def crc_of_both(first: int, second: int, length: int) -> int:
    """The crc32 of two strings end to end, from theirs and the second's length: appending zeros is linear over bits."""

    def times(matrix: list[int], v: int) -> int:
        out, k = 0, 0
        while v:
            if v & 1:
                out ^= matrix[k]
            v >>= 1
            k += 1
        return out

    # Fixed value: the reversed polynomial of crc32. One zero bit, then doubled: 2, 4, 8 (a byte), ...
    matrix = [0xEDB88320, *(1 << k for k in range(31))]
    for _ in range(3):
        matrix = [times(matrix, v) for v in matrix]
    while length:
        if length & 1:
            first = times(matrix, first)
        matrix = [times(matrix, v) for v in matrix]
        length >>= 1
    return first ^ second


def packed(data: bytes) -> bytes:
    """For ids between the two passes, not in the files."""
    return pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unpacked(data: bytes, size: int) -> bytes:
    return pa.Codec("zstd").decompress(data, size, asbytes=True)


def tokenised(df: DataFrame, path: str, end_id: int) -> DataFrame:
    """(part, docs, sizes, ids): runs of texts, each text's ids with the end id, in the order of doc_id (null first) by partition, whose number is ``part``.

    ``ids`` are those of the run's documents end to end, compressed. The last row of a partition that has any, without
    documents, holds there how often each id occurs in it.
    """
    spark = df.sparkSession
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("crc", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    dealt = rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "crc").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "crc").drop("crc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(path), TaskContext.get().partitionId()
        end, total, any_ = np.array([end_id], own.kind).tobytes(), np.zeros(max(own.size, end_id + 1), "int64"), False

        def row(docs: list, sizes: list, ids: bytes) -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([packed(ids)], pa.binary()), pa.array([len(ids)], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["part", "docs", "sizes", "ids", "bytes"])

        for b in by_size(batches, 1):
            ids = [data + end for data in own.packed(b.column(1).to_pylist())]
            whole = b"".join(ids)
            total += np.bincount(np.frombuffer(whole, own.kind), minlength=len(total))
            any_ = True
            yield row(b.column(0).to_pylist(), [len(i) // len(end) for i in ids], whole)
        if any_:
            yield row([], [], total.tobytes())

    return dealt.mapInArrow(run, "part int, docs array<long>, sizes array<long>, ids binary, bytes long")


def counted(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, from the counts of each part; as many numbers as the vocabulary has come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total = np.frombuffer(unpacked(data, size), "int64")
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    got = tokens.where("size(docs) = 0").select("ids", "bytes").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(int(got["id"].max()) + 1 if len(got) else 1, "int64")
    out[got["id"].to_numpy("int64")] = got["n"].to_numpy("int64")
    return out


def blocked(tokens: DataFrame, counts: np.ndarray, block: int = BLOCK) -> DataFrame:
    """One row for each block, in order: part, number in the part, ids of the part before it, its pieces of documents, checksum and data.

    A document lies whole in a block unless it is longer than one; a piece is (doc_id, its document's number in the part,
    its own in the document, whether it is the last, ids). The partitions of ``tokens`` are read as they are, one after
    the other, so blocks never hold documents of two parts.
    """
    shared = tokens.sparkSession.sparkContext.broadcast(counts)
    piece = pa.struct([("doc_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.int32()), ("last", pa.bool_()), ("n", pa.int64())])
    names = ["part", "block", "at", "pieces", "n", "crc32", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.of(shared.value)
        held: list[np.ndarray] = []
        pieces: list[dict] = []
        number, at, size, seq, part = 0, 0, 0, 0, 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate(held).astype("uint32")
            row = [pa.array([part], pa.int32()), pa.array([number]), pa.array([at]), pa.array([pieces], pa.list_(piece)), pa.array([len(ids)], pa.int64())]
            return pa.RecordBatch.from_arrays([*row, pa.array([zlib.crc32(ids.astype("<u4").tobytes())], pa.int64()), pa.array([encode(ids, table)], pa.binary())], names)

        for b in batches:
            for part, docs, sizes, data, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                run_ids, begin = np.frombuffer(unpacked(data, raw), "<u2" if raw == 2 * sum(sizes) else "<u4"), 0
                for doc, n in zip(docs, sizes, strict=True):
                    if size and size + n > block:
                        yield out()
                        number, at, size, held, pieces = number + 1, at + size, 0, [], []
                    for k, done in enumerate(range(0, n, block)):
                        take = min(n - done, block)
                        held.append(run_ids[begin + done : begin + done + take])
                        size += take
                        pieces.append({"doc_id": doc, "seq": seq, "piece": k, "last": done + take == n, "n": take})
                        if done + take < n:
                            yield out()
                            number, at, size, held, pieces = number + 1, at + size, 0, [], []
                    seq, begin = seq + 1, begin + n
        if size:
            yield out()

    kind = "struct<doc_id: bigint, seq: bigint, piece: int, last: boolean, n: bigint>"
    return tokens.where("size(docs) > 0").mapInArrow(run, f"part int, block long, at long, pieces array<{kind}>, n long, crc32 long, data binary")


def read_back(blocks: DataFrame, counts: np.ndarray) -> DataFrame:
    """(part, at, doc_id, n_tokens, ids_crc32) for each document in the blocks, each block decoded on its own and checked; ``at`` counts the part's ids before the document."""
    shared = blocks.sparkSession.sparkContext.broadcast(counts)
    kinds = {"part": pa.int32(), "seq": pa.int64(), "at": pa.int64(), "doc_id": pa.int64(), "piece": pa.int32(), "last": pa.bool_(), "n": pa.int64(), "crc": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table.of(shared.value)
        for b in batches:
            for part, at, pieces, crc, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw, begin = decode(data, table).astype("<u4").tobytes(), 0
                if zlib.crc32(raw) != crc:
                    raise ValueError("a block's checksum is wrong")
                rows = []
                for p in pieces:
                    rows.append((part, p["seq"], at + begin, p["doc_id"], p["piece"], p["last"], p["n"], zlib.crc32(raw[4 * begin : 4 * (begin + p["n"])])))
                    begin += p["n"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = []
            for pieces in b.column(4).to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = crc_of_both(crc, p["crc"], 4 * p["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crcs, pa.int64())], ["part", "at", "doc_id", "n_tokens", "ids_crc32"])

    # Read twice below, so stored: blocks are decoded once.
    rows = stored(blocks.select("part", "at", "pieces", "crc32", "data").mapInArrow(run, "part int, seq long, at long, doc_id long, piece int, last boolean, n long, crc long"), "pieces")
    whole = rows.where("piece = 0 and last").select("part", "at", "doc_id", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    cut = rows.where("piece > 0 or not last").groupBy("part", "seq").agg(F.min("at").alias("at"), F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "n", "crc"))).alias("all"))
    return whole.union(cut.drop("seq").mapInArrow(joined, "part int, at long, doc_id long, n_tokens long, ids_crc32 long"))


def write(df: DataFrame, path: str, end_id: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Encodes every text of ``df`` (doc_id, text) and stores the blocks in the shared folder: (the blocks as read from there, id counts).

    The ids are checkpointed by partition, and every partition becomes one file: files by name, and blocks in a file, are
    in the order of doc_id.
    """
    tokens = saved(tokenised(df, path, end_id))
    counts = counted(tokens)
    return stored(blocked(tokens, counts), "blocks"), counts


def digests(df: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the stored blocks.

    ``start`` counts the ids of all documents before it in the order of doc_id (null first; rows of one id in the order
    of their texts' checksums); it follows from the blocks' order and lengths. A null text counts as empty and has the
    end id alone. Repeated rows are documents of their own, an empty table gives none; other columns are not read.
    """
    blocks, counts = write(df, path, end_id)
    sums = blocks.groupBy("part").agg(F.sum("n").alias("all"))
    before = sums.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))
    # One row for each partition of the files.
    return read_back(blocks, counts).join(F.broadcast(before), "part").select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
