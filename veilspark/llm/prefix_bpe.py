"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece (one match of the splitting pattern) there is exactly one token that can end its encoding.
It is the one token ``t`` whose left neighbour, the stored last token of the prefix before ``t``, would stay apart from
it under the merge ranks. So the table of last tokens is filled from left to right, and the encoding of *every* prefix
is read off it backwards. Appending bytes only extends the table; an edit re-splits and re-encodes near itself until
the piece boundaries fall together with the old ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix, exists

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, given_back, uncollected

#: Pieces, and pairs of tokens, that a worker remembers before it starts anew; about 250 and 120 bytes each.
CACHED, PAIRS = 120_000, 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}


class PrefixBPE:
    """Exact encoding under a rank table (lowest-ranked adjacent pair first, any pair whose bytes are a token)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self.ends = {token[i:] for token in ranks for i in range(len(token))}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.apart: dict[int, bool] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        # A token that its own merges don't lead to is in no encoding, but for a piece that is just this token.
        self.usable = {token: rank for token, rank in ranks.items() if len(token) == 1 or self._split(rank)}

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The last merge that makes a token; None for a token that no merge makes (a byte)."""
        if rank not in self.parts:
            token, bytes_of, ranks = self.bytes_of[rank], self.bytes_of, self.ranks
            ids = [ranks[token[i : i + 1]] for i in range(len(token))]
            while len(ids) > 2:
                merged = [ranks.get(bytes_of[a] + bytes_of[b], rank) for a, b in zip(ids, ids[1:], strict=False)]
                at = min(range(len(merged)), key=merged.__getitem__)
                if merged[at] >= rank:
                    break
                ids[at : at + 2] = [merged[at]]
            self.parts[rank] = (ids[0], ids[1]) if len(ids) == 2 else None
        return self.parts[rank]

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether BPE over the bytes of the two tokens gives just these two: no merge across the border comes early enough."""
        pair = left << 32 | right
        known = self.apart.get(pair)
        if known is None:
            if len(self.apart) > PAIRS:
                self.apart.clear()
            known = self.apart[pair] = self._undo(left, right)
        return known

    def _undo(self, left: int, right: int) -> bool:
        """Takes the later of the two tokens' merges back, step by step; a border pair ranked below what was undone last would have merged first."""
        bytes_of, ranks, before = self.bytes_of, self.ranks, 1 << 40
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], 1 << 40) < before:
                return False
            of_left, of_right = self._split(left), self._split(right)
            if of_left is None and of_right is None:
                return True
            # Of two merges the one with the higher rank came last; at equal rank the left one came first.
            if of_right is None or (of_left is not None and left > right):
                before, left = left, of_left[1]
            else:
                before, right = right + 1, of_right[0]

    def extend(self, piece: bytes, last: list[int], lengths: list[int]) -> None:
        """Fills the table for the prefixes that it doesn't have yet; with an empty table, for all."""
        usable, ends, apart, known = self.usable, self.ends, self.stays_apart, self.apart.get
        for end in range(len(last) + 1, len(piece) + 1):
            start = end - 1
            while True:
                tail = piece[start:end]
                rank = usable.get(tail)
                if rank is None:
                    if tail not in ends:
                        raise ValueError("the rank table lacks single bytes")
                elif start == 0:
                    break
                else:  # one token only fits, so the search ends there
                    fits = known(last[start - 1] << 32 | rank)
                    if fits or (fits is None and apart(last[start - 1], rank)):
                        break
                start -= 1
            last.append(rank)
            lengths.append(end - start)

    @staticmethod
    def read(last: list[int], lengths: list[int], end: int | None = None) -> list[int]:
        """The encoding of a prefix, from the table."""
        ids, at = [], len(last) if end is None else end
        while at:
            ids.append(last[at - 1])
            at -= lengths[at - 1]
        return ids[::-1]

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self.pieces.get(text)
        return self.learn([text])[0] if ids is None else ids

    def learn(self, texts: list[str]) -> list[tuple[int, ...]]:
        """Encodes pieces in sorted order: the table goes on from the prefix that a piece shares with the one before it."""
        if len(self.pieces) > CACHED:
            self.pieces.clear()
        last: list[int] = []
        lengths: list[int] = []
        before, out = b"", []
        for text in texts:
            data = text.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                ids = (whole,)
            else:
                same = len(commonprefix((before, data)))
                del last[same:], lengths[same:]
                self.extend(data, last, lengths)
                ids, before = tuple(self.read(last, lengths)), data
            if len(text) < 64:
                self.pieces[text] = ids
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class EditableEncoding:
    """A text with its encoding, which follows appends and edits without encoding the whole text anew."""

    def __init__(self, bpe: PrefixBPE, pattern: str, text: str = ""):
        self.bpe, self.split, self.text = bpe, regex.compile(pattern), text
        self.spans: list[tuple[int, int]] = []
        self.ids: list[tuple[int, ...]] = []
        self.renewed = 0
        self._fill(0, [], 0, 0)

    def _fill(self, start: int, tail: list[tuple[int, int]], keep: int, resume: int) -> None:
        """Splits from ``start`` until a boundary at or after ``resume`` is one of ``tail``'s starts."""
        old_ids, old_spans, starts = self.ids[keep:], self.spans[keep:], {s: i for i, (s, _) in enumerate(tail)}
        del self.ids[keep:], self.spans[keep:]
        self.renewed = 0
        at = start
        for m in self.split.finditer(self.text, start):
            if m.start() >= resume and m.start() in starts:
                i = starts[m.start()]
                self.spans += tail[i:]
                self.ids += old_ids[len(old_spans) - len(tail) + i :]
                return
            self.spans.append(m.span())
            self.ids.append(self.bpe.piece(m.group()))
            self.renewed += 1
            at = m.end()
        assert at == len(self.text), "the pattern leaves no gaps"

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end]. A piece is kept if it ends two or more characters before the edit (what its match has looked at), or begins after it where a new boundary meets an old one."""
        keep = bisect_right([e for _, e in self.spans], start - 2)
        move = len(new) - (end - start)
        tail = [(s + move, e + move) for s, e in self.spans[keep:] if s >= end]
        self.text = self.text[:start] + new + self.text[end:]
        self._fill(self.spans[keep - 1][1] if keep else 0, tail, keep, start + len(new))

    def tokens(self) -> list[int]:
        return [i for ids in self.ids for i in ids]


#: Below this code point the character classes of Python's ``re`` are written out; they have been stable for long.
PLAIN = 0x250


def _ranges(kind: str) -> str:
    codes = [c for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind]
    return "".join(f"\\u{c:04x}" for c in codes)


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``regex.findall`` of a pattern; for texts of plain characters under the usual byte-level pattern, the same by ``re``, which is faster.

    Letters and numbers may come before the contractions there, as these begin with an apostrophe.
    """
    general = regex.compile(pattern).findall
    usual = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    if pattern != usual:
        return general
    l, n, s = _ranges("L"), _ranges("N"), r"\t-\r \x85\xa0"
    plain = re.compile(rf" ?[{l}]+| ?[{n}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+").findall
    odd = re.compile(f"[^\x00-{chr(PLAIN - 1)}]").search
    return lambda text: general(text) if odd(text) else plain(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> PrefixBPE:
    """One for each Python worker."""
    return PrefixBPE(read_ranks(path))


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256) for each row of ``df`` (doc_id, text).

    Every match of ``pattern`` is encoded separately; ``ids`` (array of int) is left out unless asked for. The hashes are
    of the decimal ids joined by one space, and of the bytes that decoding the ids gives. A null text counts as empty:
    no tokens. Repeated rows give repeated results, an empty table none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split = encoder(ranks_path if exists(ranks_path) else SparkFiles.get(ranks_path.rsplit("/", 1)[-1])), splitter(pattern)
        known, bytes_of = bpe.pieces, bpe.bytes_of
        decimal = {rank: str(rank) for rank in bytes_of}
        for part in by_size(batches, 1):
            rows = []
            with uncollected():
                pieces = [split(text or "") for text in part.column(1).to_pylist()]
                new = set().union(*pieces).difference(known)
                extra = dict(zip(order := sorted(new), bpe.learn(order), strict=True))
                for ps in pieces:
                    ids: list[int] = []
                    for p in ps:
                        ids += known.get(p) or extra.get(p) or bpe.piece(p)
                    joined = " ".join(map(decimal.__getitem__, ids)).encode()
                    rows.append((len(ids), ids if with_ids else None, hashlib.sha256(joined).hexdigest(), hashlib.sha256(b"".join(map(bytes_of.__getitem__, ids))).hexdigest()))
            n, ids_, a, b = zip(*rows, strict=True)
            columns = [part.column(0), pa.array(n, pa.int64()), *([pa.array(ids_, pa.list_(pa.int32()))] if with_ids else []), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", *(["ids"] if with_ids else []), "ids_sha256", "decoded_sha256"])
        given_back()

    kept = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, n_tokens long, " + "ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string")
