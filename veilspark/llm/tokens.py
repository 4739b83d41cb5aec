"""Token counts by section, and the tokenizer the token operators share."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from os.path import exists

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, uncollected
from .prefix_bpe import splitter

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("first", "last", "most")
#: Pieces a worker remembers before it starts anew, about 250 bytes each.
CACHED = 900_000


class _Pieces(dict):
    """Piece -> its ids as bytes; a piece that isn't there goes to the library's model, and stays if it is short."""

    def __init__(self, library, code: str):
        super().__init__()
        # Fixed rule of byte-level vocabularies: printable bytes show as themselves, the others as 256 and up in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 256 + i for i, b in enumerate(sorted(set(range(256)).difference(shown)))}
        self.model, self.code = library.model.tokenize, code

    def __missing__(self, piece: str) -> bytes:
        ids = array(self.code, [token.id for token in self.model(piece.encode().decode("latin-1").translate(self.shown))]).tobytes()
        if len(piece) < 64:
            self[piece] = ids
        return ids


class PieceTokenizer:
    """A byte-level tokenizer of the ``tokenizers`` library; it encodes each distinct piece of the splitting pattern once.

    The library splits by the same pattern and never merges across pieces, so whole texts get the same ids. A piece goes
    to the library's model at once, with its bytes shown as the vocabulary shows them. A text that has the string of an
    added token (such as ``<|endoftext|>``) goes through the library's whole pipeline, which gives that token's id.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        before = self.library.pre_tokenizer
        if not isinstance(before, ByteLevel) or before.add_prefix_space or self.library.normalizer is not None:
            raise ValueError("a byte-level tokenizer without a normalizer or a prefix space is asked for")
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.split = splitter(PATTERN)
        self.size = self.library.get_vocab_size()
        self.kind, self.code = ("<u2", "H") if self.size <= 1 << 16 else ("<u4", "I")
        self.known = _Pieces(self.library, self.code)
        # The library shows each byte as one character, so a token has as many bytes as characters.
        self.lengths = np.array([len(self.library.id_to_token(i) or "") for i in range(self.size)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        return [np.frombuffer(data, self.kind) for data in self.packed(texts)]

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of 2 bytes, of 4 under a larger vocabulary."""
        if len(self.known) > CACHED:
            self.known.clear()
        with uncollected():
            return [self._whole(t) if self.added(t) else b"".join(map(self.known.__getitem__, self.split(t))) for t in (t or "" for t in texts)]

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    """One for each Python worker."""
    return PieceTokenizer(path if exists(path) else SparkFiles.get(path.rsplit("/", 1)[-1]))


def line_sections(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text (without their line ends) as byte spans."""
    ends = np.flatnonzero(np.frombuffer(data + b"\n", "uint8") == 10)
    return np.concatenate([[0], ends[:-1] + 1]), ends


def attributed(token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str = "most") -> np.ndarray:
    """The section of each token, -1 for none. Tokens lie end to end; sections are ordered and apart, and may leave gaps.

    A token that touches one section belongs to it. One that touches several goes to the ``first``, the ``last``, or
    the one it shares ``most`` bytes with (of equals the first). An interval join by two binary searches.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    begin = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    full = ends > starts
    places, s, e = np.flatnonzero(full), starts[full], ends[full]
    low, high = np.searchsorted(e, begin, "right"), np.searchsorted(s, token_ends, "left") - 1
    inside = (low <= high) & (token_ends > begin)
    pick = np.where(rule == "last", high, low)
    if rule == "most":
        for i in np.flatnonzero(inside & (high > low)):
            k = np.arange(low[i], high[i] + 1)
            pick[i] = k[np.argmax(np.minimum(e[k], token_ends[i]) - np.maximum(s[k], begin[i]))]
    out = np.full(len(token_ends), -1)
    out[inside] = places[pick[inside]]
    return out


def section_counts(df: DataFrame, path: str, rule: str = "most") -> DataFrame:
    """(doc_id, section, start, length, n_tokens): the tokens of each line of each text.

    Whole texts are encoded once; token spans are joined with line spans (start and length in characters) and
    counted. Section -1 has the tokens that touch no line, line ends alone; it is there if it has any. A null or empty
    text has one empty section 0. The counts of a text add up to its tokens. Repeated rows give repeated results, an
    empty table none; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for part in by_size(batches, 1):
            doc, rows = [], [[], [], [], []]
            texts = part.column(1).to_pylist()
            for text, ids in zip(texts, own.encode(texts), strict=True):
                data = (text or "").encode()
                starts, ends = line_sections(data)
                at = attributed(np.cumsum(own.lengths[ids]), starts, ends, rule)
                counts = np.bincount(at + 1, minlength=len(starts) + 1)
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, "uint8") & 0xC0) != 0x80)])
                first = 0 if counts[0] else 1
                doc.append(len(starts) + 1 - first)
                rows[0].append(np.arange(first - 1, len(starts)))
                rows[1].append(np.concatenate([[0], chars[starts]])[first:])
                rows[2].append(np.concatenate([[0], chars[ends] - chars[starts]])[first:])
                rows[3].append(counts[first:])
            ids = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), doc)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(np.concatenate(r).astype("int64")) for r in rows)], ["doc_id", "section", "start", "length", "n_tokens"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, section long, start long, length long, n_tokens long")
