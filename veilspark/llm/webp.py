"""Media columns: lossless WebP in Python and numpy.

``decode`` reads any still or animated lossless file: prefix codes (simple and normal, with meta codes), back-references,
colour cache, and the predictor, cross-colour, subtract-green and palette transforms. ``encode`` writes such files; each
feature can be asked for.

Texts are stored as grey images, 192 samples a row. For each image the encoder prices subtract-green alone, with the
predictor (the best of the 14 modes in each tile) and the palette (packed pixels), and takes the cheapest; looks for
back-references in what that leaves; prices codes of its own for each band of 64 rows; under one code, where samples come again
at once more often than by chance, prices colour caches of 1 to 10 bits; and writes prefix codes made for that image or band.
After subtract-green a grey image's red and blue are 0, so the best cross-colour factors are 0 and that transform only adds
bits: texts get none. Images of a batch are coded together, and decoded together, a symbol of each at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, stored

ROW = 192
#: Rows of a frame, at most; the format ends at 16383.
FRAME_ROWS = 4096
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
#: Longest code and shortest back-reference that texts get; the sides of predictor tiles and of those with codes of their own, as powers.
DEEPEST, SHORTEST, TILE, BAND = 10, 6, 5, 6
#: A colour cache is tried where samples equal the one before them so many times as often as by chance.
AGAIN = 1.5
#: Images that are decoded together, at least, and entries of their codes' tables, at most.
TOGETHER, ENTRIES = 32, 1 << 23
#: The bits of a number under 1 << 15, turned round.
TURNED = np.zeros(1 << 15, "int64")
for _k in range(15):
    TURNED |= ((np.arange(1 << 15) >> _k) & 1) << (14 - _k)

# Fixed values of the format: the order of code length codes, and the neighbours (x, y) that short distance codes mean.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# ---- prefix codes


def code_lengths(counts: list[float], most: int = 15) -> list[int]:
    """Lengths of an optimal prefix code, none over ``most``: rare symbols are made less rare until they fit."""
    used = [i for i, c in enumerate(counts) if c > 0]
    out = [0] * len(counts)
    if len(used) == 1:
        out[used[0]] = 1
        return out
    floor = 0.0
    while used:
        leaves = sorted((max(counts[i], floor), i) for i in used)
        weights, n = [c for c, _ in leaves], len(leaves)
        parents, made = [0] * (2 * n - 1), n  # leaves, then joined nodes; both are in ascending order
        leaf, node = 0, n
        while made < 2 * n - 1:
            total = 0
            for _ in range(2):
                if leaf < n and (node >= made or weights[leaf] <= weights[node]):
                    k, leaf = leaf, leaf + 1
                else:
                    k, node = node, node + 1
                parents[k] = made
                total += weights[k]
            weights.append(total)
            made += 1
        deep = [0] * (2 * n - 1)
        for k in range(2 * n - 3, -1, -1):
            deep[k] = deep[parents[k]] + 1
        if max(deep) <= most:
            for k, (_, i) in enumerate(leaves):
                out[i] = deep[k]
            break
        floor = max(2 * floor, sum(counts) / (1 << most))
    return out


def codes(lengths: tuple[int, ...]) -> dict[int, str]:
    """Symbol -> its bits as they stand in the stream; a lone symbol has none."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: ""}
    out, code, before = {}, 0, 0
    for n, s in used:
        code <<= n - before
        out[s] = format(code, f"0{n}b")
        code, before = code + 1, n
    return out


class Bits:
    """Reads bits, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def peek(self, n: int) -> int:
        k = self.at >> 3
        return (int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        out = self.peek(n)
        self.at += n
        if self.at > 8 * len(self.data) + 64:
            raise ValueError("the image data end early")
        return out


@lru_cache(maxsize=1024)
def _table(lengths: tuple[int, ...]) -> tuple[int, list[tuple[int, int]]]:
    """(window bits, for each window: symbol and length)."""
    width = max(lengths, default=0)
    own = codes(lengths)
    if not own:
        raise ValueError("a prefix code has no symbols")
    if len(own) == 1:
        return 0, [(next(iter(own)), 0)]
    if sum(2.0**-n for n in lengths if n) != 1:
        raise ValueError("a prefix code isn't complete")
    table = [(0, 0)] * (1 << width)
    for s, bits in own.items():
        table[int(bits[::-1], 2) :: 1 << len(bits)] = [(s, len(bits))] * (1 << (width - len(bits)))
    return width, table


def _read_code(bits: Bits, size: int) -> tuple[int, ...]:
    """A code's lengths."""
    lengths = [0] * size
    simple = bits.peek(19)
    if simple & 1:
        n = 11 if simple & 4 else 4
        lengths[(simple >> 3) & ((1 << (n - 3)) - 1)] = 1
        if simple & 2:
            lengths[(simple >> n) & 255] = 1
            n += 8
        bits.read(n)
        return tuple(lengths)
    bits.read(1)
    first = [0] * 19
    for k in range(4 + bits.read(4)):
        first[LENGTH_ORDER[k]] = bits.read(3)
    width, table = _table(tuple(first))
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    at, before = 0, 8
    k, used, mask = bits.at >> 3, bits.at & 7, (1 << width) - 1
    rest = int.from_bytes(bits.data[k : k + 2 * size + 8], "little") >> used  # a length takes 14 bits at most
    taken = 0
    while at < size and left:
        left -= 1
        s, n = table[rest & mask]
        rest >>= n
        taken += n
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        extra = (2, 3, 7)[s - 16]
        times = (11 if s == 18 else 3) + (rest & ((1 << extra) - 1))
        rest >>= extra
        taken += extra
        if at + times > size:
            raise ValueError("code lengths run over")
        if s == 16:
            lengths[at : at + times] = [before] * times
        at += times
    bits.at += taken
    if bits.at > 8 * len(bits.data) + 64:
        raise ValueError("the image data end early")
    return tuple(lengths)


# ---- decoding


class Green(NamedTuple):
    """An entropy-coded image in which only green and distances have bits, from bit ``at`` of ``data`` on."""

    data: bytes
    at: int
    width: int
    total: int
    green: tuple[int, ...]
    distance: tuple[int, ...]
    red: int
    blue: int
    alpha: int


def _pixels(bits: Bits, width: int, height: int, whole: bool) -> np.ndarray | Green:
    """An entropy-coded image, as ARGB numbers; meta codes only in the whole image, which is left as it is where only green has bits."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, groups = None, 0, 1
    if whole and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (_pixels(bits, -(-width >> meta_bits), -(-height >> meta_bits), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    group_codes = [tuple(_read_code(bits, n) for n in sizes) for _ in range(groups)]
    total = width * height
    if whole and meta is None and not cache_bits:
        green, *rest, distance = group_codes[0]
        if all(c.count(0) == 255 for c in rest):
            red, blue, alpha = (c.index(max(c)) for c in rest)
            if green.count(0) < 279:
                return Green(bits.data, bits.at, width, total, green, distance, red, blue, alpha)
            if any(green[:256]):
                return np.full((height, width), alpha << 24 | red << 16 | green.index(max(green)) << 8 | blue, "uint32")
    if meta is not None and not cache_bits and (meta == meta[:, :1]).all() and all(c == group_codes[0][k] and c.count(0) == 255 for g in group_codes for k, c in enumerate(g) if 0 < k < 4):
        red, blue, alpha = (c.index(max(c)) for c in group_codes[0][1:4])
        samples = _by_bands(bits, [(group_codes[g][0], group_codes[g][4]) for g in meta[:, 0].tolist()], width << meta_bits, width, total)
        return (samples.astype("uint32") << 8 | alpha << 24 | red << 16 | blue).reshape(height, width)
    tables = [[_table(c) if any(c) else (0, [(0, 0)]) for c in g] for g in group_codes]
    out, cache, at = [0] * total, [0] * (1 << cache_bits), 0
    in_row = meta.tolist() if meta is not None else None

    def symbol(t: tuple[int, list[tuple[int, int]]]) -> int:
        s, n = t[1][bits.peek(t[0])]
        bits.at += n
        return s

    def far(s: int) -> int:
        return s + 1 if s < 4 else ((2 + (s & 1)) << ((s - 2) >> 1)) + bits.read((s - 2) >> 1) + 1

    def remember(argb: int) -> None:
        if cache_bits:
            cache[(0x1E35A7BD * argb & 0xFFFFFFFF) >> (32 - cache_bits)] = argb

    while at < total:
        own = tables[in_row[at // width >> meta_bits][at % width >> meta_bits] if in_row else 0]
        s = symbol(own[0])
        if s < 256:
            red, blue, alpha = symbol(own[1]), symbol(own[2]), symbol(own[3])
            out[at] = argb = alpha << 24 | red << 16 | s << 8 | blue
            remember(argb)
            at += 1
        elif s < 280:
            times = far(s - 256)
            code = far(symbol(own[4]))
            if code > 120:
                back = code - 120
            else:
                x, y = NEAR[code - 1]
                back = max(1, x + y * width)
            if back > at or at + times > total:
                raise ValueError("a back-reference leaves the image")
            part = (out[at - back : at] * (times // back + 1))[:times]
            out[at : at + times] = part
            if cache_bits:  # in the order in which each value came last
                for argb in reversed(dict.fromkeys(reversed(part))):
                    remember(argb)
            at += times
        else:
            out[at] = argb = cache[s - 280]
            remember(argb)
            at += 1
    if bits.at > 8 * len(bits.data):
        raise ValueError("the image data end early")
    return np.array(out, "uint32").reshape(height, width)


def _tables(lengths: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """The codes in the rows, each as a table of 1 << ``wide`` entries by its next bits (the first one on top): 16 x symbol + length."""
    many = (lengths > 0).sum(1)
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    if not many.all():
        raise ValueError("a prefix code has no symbols")
    if ((np.bincount(row, 1 << (15 - n), len(lengths)) != 1 << 15) & (many > 1)).any():
        raise ValueError("a prefix code isn't complete")
    order = np.argsort(row * 16 + n, kind="stable")
    row, symbol, n = row[order], symbol[order], np.where(many[row[order]] == 1, 0, n[order])
    return np.repeat(symbol * 16 + n, 1 << (wide[row] - n))


def _symbols(images: list[Green]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of images, one image after the other: how many each has, entries (symbol << 8, 64 for a length, the bits taken with the extra ones) and places in bits; and the joined data, 7 bytes from each byte on.

    One token of each image at a time; of the few longest images, one image at a time.
    """
    sizes = np.array([len(i.data) for i in images])
    pad = b"\0" * 2048
    data = b"".join(i.data for i in images) + pad
    window = np.ndarray(len(data) - 7, "<i8", data, strides=(1,)) & ((1 << 56) - 1)
    ends = 8 * np.cumsum(sizes)

    # For each image the table of green and the one of distances, side by side; an entry tells where the next token's table begins.
    greens, backs = np.array([i.green for i in images], "int64"), np.array([i.distance for i in images], "int64")
    backs[~backs.any(1), 0] = 1
    wide = np.maximum(greens.max(1), backs.max(1))
    begin = 2 * (np.cumsum(1 << wide) - (1 << wide))
    entries = np.arange(256 + 24)
    extra = np.where(entries < 256, 0, np.maximum(entries - 258, 0) >> 1)
    table = np.empty(int(2 * (1 << wide).sum()), "int64")
    width = np.repeat(1 << wide, 1 << wide)
    here = np.repeat(begin, 1 << wide)
    place = np.arange(len(here)) + here - np.repeat(np.cumsum(1 << wide) - (1 << wide), 1 << wide)
    e = _tables(greens, wide)
    symbol = e >> 4
    table[place] = symbol << 8 | (symbol > 255) << 6 | ((e & 15) + extra[symbol]) | (here + np.where(symbol > 255, width, 0)) << 32
    e = _tables(backs, wide)
    symbol = e >> 4
    table[place + width] = symbol << 8 | ((e & 15) + (np.maximum(symbol - 2, 0) >> 1)) | here << 32

    who = np.argsort(-sizes, kind="stable")
    pos, end, turn, base = (ends - 8 * sizes + np.array([i.at for i in images]))[who], ends[who], 15 - wide[who], begin[who]
    short = who.astype("uint16")
    owners, found, places, steps = [], [], [], 0
    while len(who) >= TOGETHER:
        w = window.take(pos >> 3)
        w >>= pos & 7
        w &= 32767
        w = TURNED.take(w)
        w >>= turn
        w += base
        e = table.take(w)
        found.append(e)
        places.append(pos)
        owners.append(short)
        pos = pos + (e & 63)
        base = e >> 32
        steps += 1
        if not steps & 3:
            live = pos <= end  # a last distance may take no bits
            if not live.all():
                who, short, pos, end, turn, base = (x[live] for x in (who, short, pos, end, turn, base))
    for k, p, stop, at in zip(who.tolist(), pos.tolist(), end.tolist(), base.tolist(), strict=True):
        n = int(wide[k])
        a, mask = int(begin[k]), (1 << n) - 1
        order = TURNED[: 1 << n] >> (15 - n)
        tables = table[a : a + mask + 1][order].tolist(), table[a + mask + 1 : a + 2 * mask + 2][order].tolist()
        now, es, ps = tables[at > a], [], []
        add, put = es.append, ps.append
        while p <= stop:
            rest, most = int.from_bytes(data[p >> 3 : (p >> 3) + 64], "little") >> (p & 7), min(stop + 1, p + 448)
            while p < most:
                e = now[rest & mask]
                add(e)
                put(p)
                n = e & 63
                rest >>= n
                p += n
                now = tables[e >> 6 & 1]
        found.append(np.array(es, "int64"))
        places.append(np.array(ps, "int64"))
        owners.append(np.full(len(es), k, "uint16"))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    entry = (np.concatenate(found) & 0x7FFFFFFF).astype("int32")[order]
    return np.bincount(owner, minlength=len(images)), entry, np.concatenate(places).astype("int32")[order], window


def _by_bands(bits: Bits, codes_of: list[tuple[tuple[int, ...], tuple[int, ...]]], step: int, width: int, total: int) -> np.ndarray:
    """The green samples of an image whose codes of green and distances change after each ``step`` samples; a token at a time."""

    @lru_cache(maxsize=None)
    def table(lengths: tuple[int, ...]) -> tuple[int, list[int]]:
        if not any(lengths):
            return 0, [0]
        n = 0 if len(lengths) - lengths.count(0) == 1 else max(lengths)
        return (1 << n) - 1, _tables(np.array([lengths], "int64"), np.array([max(lengths)]))[TURNED[: 1 << n] >> (15 - n)].tolist()

    raw, data, at, p = bytearray(total), bits.data, 0, bits.at
    end, rest, held = 8 * len(data), 0, 0
    for k, (green, distance) in enumerate(codes_of):
        (first, greens), (second, backs), stop = table(green), table(distance), min(total, (k + 1) * step)
        while at < stop:
            if held < 64:
                if p > end:
                    raise ValueError("the image data end early")
                rest, held = int.from_bytes(data[p >> 3 : (p >> 3) + 64], "little") >> (p & 7), 504
            e = greens[rest & first]
            s, n = e >> 4, e & 15
            if s < 256:
                raw[at] = s
                at += 1
            else:
                found = []
                for s in (s - 256, -1):
                    if s < 0:
                        e = backs[(rest >> n) & second]
                        s, n = e >> 4, n + (e & 15)
                    m = max(s - 2, 0) >> 1
                    found.append((s if s < 4 else ((2 + (s & 1)) << m) + ((rest >> n) & ((1 << m) - 1))) + 1)
                    n += m
                times, code = found
                x, y = NEAR[min(code, 120) - 1]
                back = code - 120 if code > 120 else max(1, x + y * width)
                if back > at or at + times > total:
                    raise ValueError("a back-reference leaves the image")
                raw[at : at + times] = (raw[at - back : at] * (times // back + 1))[:times] if back < times else raw[at - back : at - back + times]
                at += times
            rest >>= n
            p += n
            held -= n
    if p > end:
        raise ValueError("the image data end early")
    return np.frombuffer(raw, "uint8")


def _greens(images: list[Green]) -> list[np.ndarray]:
    """The green samples of images that have two symbols or more."""
    totals = np.array([i.total for i in images])
    many, entry, place, window = _symbols(images)
    if not many.all():
        raise ValueError("the image data end early")
    ends, first = np.cumsum(totals), np.cumsum(many) - many
    owner = np.repeat(np.arange(len(images)), many)

    def value(k: np.ndarray, least: int) -> np.ndarray:
        s = (entry[k] >> 8) - least
        n = np.maximum(s - 2, 0) >> 1
        p = place[k] + (entry[k] & 63) - n
        return np.where(s < 4, s, ((2 + (s & 1)) << n) + ((window[p >> 3] >> (p & 7)) & ((1 << n) - 1))) + 1

    copy = np.flatnonzero(entry & 64)
    if len(copy) and copy[-1] + 1 == len(entry):  # cut off after a length
        copy = copy[:-1]
    copy = copy[owner[copy] == owner[copy + 1]]
    long = np.ones(len(entry), "int64")
    long[copy], long[copy + 1] = value(copy, 256), 0
    code = value(copy + 1, 0)
    start = np.cumsum(long) - long
    start -= np.repeat(start[first] - ends + totals, many)  # tokens beyond the last sample are the filling bits'
    limit = np.repeat(ends, many)
    inside = start < limit
    final = np.flatnonzero(inside & (start + long >= limit) & (long > 0))
    if len(final) < len(images):
        raise ValueError("the image data end early")
    if (start[final] + long[final] != ends).any():
        raise ValueError("a back-reference leaves the image")
    final += (entry[final] >> 6) & 1
    if (place[final] + (entry[final] & 63) > 8 * np.cumsum([len(i.data) for i in images])).any():
        raise ValueError("the image data end early")

    raw = bytearray(int(ends[-1]))
    out = np.frombuffer(raw, "uint8")
    alone = inside & (long > 0) & ((entry & 64) == 0)
    out[start[alone]] = entry[alone] >> 8
    kept = inside[copy]
    copy, code = copy[kept], code[kept]
    own, start, long = owner[copy], start[copy], long[copy]
    close = np.array(NEAR, "int64")[np.minimum(code, 120) - 1]
    far = np.where(code > 120, code - 120, np.maximum(1, close[:, 0] + close[:, 1] * np.array([i.width for i in images])[own]))
    if (far > start - (ends - totals)[own]).any():
        raise ValueError("a back-reference leaves the image")
    for at, n, back in zip(start.tolist(), long.tolist(), far.tolist(), strict=True):
        raw[at : at + n] = raw[at - back : at - back + n] if back >= n else (raw[at - back : at] * (n // back + 1))[:n]
    return np.split(out, ends[:-1])


def _channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> 24, argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1).astype("int32")


def _joined(c: np.ndarray) -> np.ndarray:
    c = c.astype("uint32") & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _predicted(mode: int, l: np.ndarray, t: np.ndarray, tr: np.ndarray, tl: np.ndarray) -> np.ndarray:  # noqa: E741
    half = lambda a, b: (a + b) >> 1
    if mode == 0:
        return np.array([255, 0, 0, 0], "int32")
    if mode in (1, 2, 3, 4):
        return (l, t, tr, tl)[mode - 1]
    if mode == 5:
        return half(half(l, tr), t)
    if mode in (6, 7, 8, 9):
        return half(*((l, tl), (l, t), (tl, t), (t, tr))[mode - 6])
    if mode == 10:
        return half(half(l, tl), half(t, tr))
    if mode == 11:
        return l if np.abs(t - tl).sum() < np.abs(l - tl).sum() else t
    if mode == 12:
        return np.clip(l + t - tl, 0, 255)
    if mode == 13:
        mean = half(l, t)
        return np.clip(mean + ((mean - tl) / 2).astype("int32"), 0, 255)
    return np.array([255, 0, 0, 0], "int32")


def _predictions(out: np.ndarray, modes: np.ndarray, size: int, y: int, x: int) -> np.ndarray:
    if y == 0:
        return np.array([255, 0, 0, 0], "int32") if x == 0 else out[0, x - 1]
    if x == 0:
        return out[y - 1, 0]
    right = out[y - 1, x + 1] if x + 1 < out.shape[1] else out[y, 0]
    return _predicted(int(modes[y >> size, x >> size]), out[y, x - 1], out[y - 1, x], right, out[y - 1, x - 1])


def _unpredicted(c: np.ndarray, modes: list[list[int]], size: int) -> np.ndarray:
    """Pixels from what the predictor left. A channel that it left nothing of is 0, and alpha 255."""
    height, width = c.shape[:2]
    c = c & 255
    some = [k for k in range(4) if c[..., k].any()]
    lines = [[c[y, :, k].tolist() for k in some] for y in range(height)]
    black = [255 * (k == 0) for k in some]
    for y, line in enumerate(lines):
        for x in range(width):
            mode = modes[y >> size][x >> size] if x and y else 1 if x else 2 if y else 0
            if mode == 11:
                tops = lines[y - 1]
                nearer = sum(abs(t[x] - t[x - 1]) for t in tops) < sum(abs(own[x - 1] - t[x - 1]) for own, t in zip(line, tops, strict=True))
                mode = 1 if nearer else 2
            for k, own in enumerate(line):
                if mode == 1:
                    p = own[x - 1]
                elif mode in (0, 14, 15):
                    p = black[k]
                else:
                    top = lines[y - 1][k]
                    t = top[x]
                    if mode != 2:
                        l, tl, tr = own[x - 1], top[x - 1], top[x + 1] if x + 1 < width else own[0]  # noqa: E741
                        if mode == 3:
                            p = tr
                        elif mode == 4:
                            p = tl
                        elif mode == 5:
                            p = (((l + tr) >> 1) + t) >> 1
                        elif mode == 6:
                            p = (l + tl) >> 1
                        elif mode == 7:
                            p = (l + t) >> 1
                        elif mode == 8:
                            p = (tl + t) >> 1
                        elif mode == 9:
                            p = (t + tr) >> 1
                        elif mode == 10:
                            p = (((l + tl) >> 1) + ((t + tr) >> 1)) >> 1
                        elif mode == 12:
                            p = min(255, max(0, l + t - tl))
                        else:
                            mean = (l + t) >> 1
                            p = min(255, max(0, mean + int((mean - tl) / 2)))
                    else:
                        p = t
                own[x] = (own[x] + p) & 255
    out = np.zeros_like(c)
    out[..., 0] = 255
    for k, channel in enumerate(some):
        out[..., channel] = [line[k] for line in lines]
    return out


def _signed_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype("int8").astype("int32") * b.astype("int8").astype("int32")) >> 5


def _spread(block: np.ndarray, size: int, height: int, width: int) -> np.ndarray:
    return np.repeat(np.repeat(block, 1 << size, 0), 1 << size, 1)[:height, :width]


def _opened(data: bytes) -> tuple[list, np.ndarray | Green, int]:
    """A VP8L chunk's transforms, coded image and height."""
    bits = Bits(data)
    if bits.read(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, now = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICTOR, CROSS):
            size = bits.read(3) + 2
            transforms.append((kind, now, size, _pixels(bits, -(-now >> size), -(-height >> size), False)))
        elif kind == GREEN:
            transforms.append((kind, now, 0, None))
        else:
            n = bits.read(8) + 1
            table = _joined(np.cumsum(_channels(_pixels(bits, n, 1, False)), axis=1))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, now, pack, table[0]))
            now = -(-now >> pack)
    return transforms, _pixels(bits, now, height, True), height


def _undone(transforms: list, image: np.ndarray | Green, green: np.ndarray | None, height: int) -> np.ndarray:
    """An image's pixels, (height, width, 4) bytes in the order alpha, red, green, blue."""
    if isinstance(image, Green):
        if [t[0] for t in transforms] == [GREEN]:
            out = np.empty((height, image.width, 4), "uint8")
            out[...] = green.reshape(height, -1, 1)
            out[..., 0] = image.alpha
            if image.red or image.blue:
                out[..., 1] += np.uint8(image.red)
                out[..., 3] += np.uint8(image.blue)
            return out
        image = (green.astype("uint32") << 8 | image.alpha << 24 | image.red << 16 | image.blue).reshape(height, -1)
    argb = image
    for kind, own_width, size, extra in reversed(transforms):
        if kind == PALETTE:
            green = (argb >> 8) & 255
            if size:
                each, step = 8 >> size, 1 << size
                green = np.stack([(green >> (each * k)) & ((1 << each) - 1) for k in range(step)], -1).reshape(height, -1)[:, :own_width]
            argb = np.append(extra, np.zeros(256 - len(extra), "uint32"))[green]
            continue
        c = _channels(argb)
        if kind == GREEN:
            c[..., 1] += c[..., 2]
            c[..., 3] += c[..., 2]
        elif kind == CROSS:
            t = _spread(_channels(extra), size, height, own_width)
            c[..., 1] = (c[..., 1] + _signed_product(t[..., 3], c[..., 2])) & 255
            c[..., 3] += _signed_product(t[..., 2], c[..., 2]) + _signed_product(t[..., 1], c[..., 1])
        else:
            c = _unpredicted(c, ((extra >> 8) & 15).tolist(), size)
        argb = _joined(c)
    return _channels(argb).astype("uint8")


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, bytes]]:
    while at + 8 <= end:
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > end:
            raise ValueError("a chunk runs over")
        yield data[at : at + 4], data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2


def decode(data: bytes) -> list[np.ndarray]:
    """The frames of a file (one for a still image); bytes in the order alpha, red, green, blue."""
    return decode_all([data])[0]


def decode_all(files: list[bytes]) -> list[list[np.ndarray]]:
    """The frames of each file; images in which only green has bits are decoded together."""
    opened, of = [], []
    for k, data in enumerate(files):
        if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
            raise ValueError("not a WebP file")
        for name, body in _chunks(data, 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))):
            if name == b"VP8 ":
                raise ValueError("a lossy image")
            found = [body] if name == b"VP8L" else [x for n, x in _chunks(body, 16, len(body)) if n == b"VP8L"] if name == b"ANMF" else []
            opened += map(_opened, found)
            of += [k] * len(found)
    simple = [k for k, (_, image, _) in enumerate(opened) if isinstance(image, Green)]
    greens: dict[int, np.ndarray] = {}
    part, room = [], 0
    for k in simple:
        wide = 2 << max(opened[k][1].green + opened[k][1].distance)
        if part and (room + wide > ENTRIES or len(part) == 1 << 15):
            greens |= zip(part, _greens([opened[j][1] for j in part]), strict=True)
            part, room = [], 0
        part.append(k)
        room += wide
    if part:
        greens |= zip(part, _greens([opened[j][1] for j in part]), strict=True)
    out: list[list[np.ndarray]] = [[] for _ in files]
    for k, (transforms, image, height) in enumerate(opened):
        out[of[k]].append(_undone(transforms, image, greens.pop(k, None), height))
    return out


# ---- encoding


def _field(value: int, n: int) -> str:
    """A number's bits in stream order."""
    return format(value, f"0{n}b")[::-1] if n else ""


def _prefix(value: int) -> tuple[int, str]:
    """A length or distance (from 1) as its symbol and extra bits."""
    if value <= 4:
        return value - 1, ""
    v = value - 1
    top = v.bit_length() - 2
    return 2 * (top + 1) + ((v >> top) & 1), _field(v & ((1 << top) - 1), top)


#: Numbers under 8 in 3 bits; runs of code lengths of 0, as their symbol and extra bits.
OCTAL = [_field(k, 3) for k in range(8)]
ZEROS = {n: (17, _field(n - 3, 3)) if n <= 10 else (18, _field(n - 11, 7)) for n in range(3, 139)}


@lru_cache(maxsize=256)
def _written(lengths: tuple[int, ...]) -> str:
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        used = used or [0]
        small = used[0] < 2
        return "1" + str(len(used) - 1) + ("0" + _field(used[0], 1) if small else "1" + _field(used[0], 8)) + (_field(used[1], 8) if len(used) == 2 else "")
    items, k = [], 0
    for s in [*used, len(lengths)]:
        while s - k >= 3:
            run = min(s - k, 138)
            items.append(ZEROS[run])
            k += run
        items += [(0, "")] * (s - k)
        if s < len(lengths):
            items.append((lengths[s], ""))
        k = s + 1
    many = Counter(s for s, _ in items)
    own = tuple(code_lengths([many[s] for s in range(19)], 7))
    bits, last = codes(own), max(i for i, s in enumerate(LENGTH_ORDER) if own[s])
    return "0" + _field(max(0, last + 1 - 4), 4) + "".join(OCTAL[own[s]] for s in LENGTH_ORDER[: max(4, last + 1)]) + "0" + "".join(bits[s] + extra for s, extra in items)


def _coded(argb: np.ndarray, whole: bool, cache_bits: int, copies: bool, meta_bits: int = 0) -> str:
    """An entropy-coded image with codes of its own."""
    height, width = argb.shape
    flat = argb.ravel().tolist()
    cache, seen, items, at = [None] * (1 << cache_bits), {}, [], 0
    key = lambda v: (0x1E35A7BD * v & 0xFFFFFFFF) >> (32 - cache_bits)
    while at < len(flat):
        n, back = 0, 0
        if copies and at + 4 <= len(flat):
            four = tuple(flat[at : at + 4])
            from_ = seen.get(four)
            if from_ is not None:
                back = at - from_
                while n < 4032 and at + n + 64 <= len(flat) and flat[at + n : at + n + 64] == flat[at + n - back : at + n - back + 64]:
                    n += 64
                while n < 4096 and at + n < len(flat) and flat[at + n] == flat[at + n - back]:
                    n += 1
        if n >= 4:
            items.append(("copy", at, n, back))
        else:
            n = 1
            v = flat[at]
            items.append(("cache", at, key(v)) if cache_bits and cache[key(v)] == v else ("pixel", at, v))
        if copies:
            for k in range(at, min(at + min(n, 16), len(flat) - 3)):
                seen[tuple(flat[k : k + 4])] = k
        if cache_bits:
            for v in reversed(dict.fromkeys(reversed(flat[at : at + n]))):
                cache[key(v)] = v
        at += n
    groups = (-(-width >> meta_bits)) * (-(-height >> meta_bits)) if meta_bits else 1
    group_of = (lambda p: (p // width >> meta_bits) * (-(-width >> meta_bits)) + (p % width >> meta_bits)) if meta_bits else lambda p: 0
    counts = [[Counter() for _ in range(5)] for _ in range(groups)]
    symbols = []
    for item in items:
        g = group_of(item[1])
        if item[0] == "pixel":
            v = item[2]
            own = [(0, v >> 8 & 255, ""), (1, v >> 16 & 255, ""), (2, v & 255, ""), (3, v >> 24, "")]
        elif item[0] == "cache":
            own = [(0, 280 + item[2], "")]
        else:
            (a, x), (b, y) = _prefix(item[2]), _prefix(2 if item[3] == 1 else 1 if item[3] == width else item[3] + 120)
            own = [(0, 256 + a, x), (4, b, y)]
        symbols.append((g, own))
        for c, s, _ in own:
            counts[g][c][s] += 1
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    lengths = [[tuple(code_lengths([c[s] for s in range(n)])) for c, n in zip(g, sizes, strict=True)] for g in counts]
    out = ["1" + _field(cache_bits, 4) if cache_bits else "0"]
    if whole:
        out.append("1" + _field(meta_bits - 2, 3) + _coded((np.arange(groups, dtype="uint32") << 8).reshape(-(-height >> meta_bits), -1), False, 0, False) if meta_bits else "0")
    out += [_written(n) for g in lengths for n in g]
    bits = [[codes(n) for n in g] for g in lengths]
    out += [bits[g][c][s] + extra for g, own in symbols for c, s, extra in own]
    return "".join(out)


def _packed(bits: str) -> bytes:
    return int(bits[::-1] or "0", 2).to_bytes((len(bits) + 7) // 8, "little")


def _head(height: int, width: int) -> str:
    return _field(0x2F, 8) + _field(width - 1, 14) + _field(height - 1, 14) + "1000"


def _vp8l(argb: np.ndarray, transforms: tuple[int, ...], cache_bits: int, copies: bool, meta_bits: int, block: int, modes: tuple[int, ...]) -> bytes:
    height, width = argb.shape
    out = [_head(height, width)]
    for kind in transforms:
        out.append("1" + _field(kind, 2))
        c = _channels(argb)
        height, now = argb.shape
        by, bx = -(-height >> block), -(-now >> block)
        if kind == GREEN:
            c[..., 1] -= c[..., 2]
            c[..., 3] -= c[..., 2]
            argb = _joined(c)
        elif kind == CROSS:
            t = np.zeros((by, bx, 4), "int32")
            t[..., 0], t[..., 1], t[..., 2], t[..., 3] = 255, 250, 16, 32
            out.append(_field(block - 2, 3) + _coded(_joined(t), False, 0, False))
            t = _spread(t, block, height, now)
            c[..., 3] -= _signed_product(t[..., 2], c[..., 2]) + _signed_product(t[..., 1], c[..., 1])
            c[..., 1] -= _signed_product(t[..., 3], c[..., 2])
            argb = _joined(c)
        elif kind == PREDICTOR:
            used = np.resize(np.array(modes, "uint32"), (by, bx))
            out.append(_field(block - 2, 3) + _coded(used << 8 | 0xFF000000, False, 0, False))
            left = c.copy()
            for y in range(height):
                for x in range(now):
                    left[y, x] = c[y, x] - _predictions(c, used, block, y, x)
            argb = _joined(left)
        else:
            table, index = np.unique(argb, return_inverse=True)
            index = index.reshape(argb.shape).astype("uint32")
            if len(table) > 256:
                raise ValueError("over 256 colours")
            steps = np.diff(_channels(table), axis=0, prepend=0)
            out.append(_field(len(table) - 1, 8) + _coded(_joined(steps)[None, :], False, 0, False))
            pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1 if len(table) <= 16 else 0
            step, each = 1 << pack, 8 >> pack
            index = np.pad(index, ((0, 0), (0, -now % step))).reshape(height, -1, step)
            argb = sum(index[..., k] << (each * k) for k in range(step)).astype("uint32") << 8 | 0xFF000000
    out.append("0" + _coded(argb, True, cache_bits, copies, meta_bits))
    return _packed("".join(out))


def _file(frames: list[tuple[bytes, int, int]]) -> bytes:
    chunk = lambda name, body: name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)
    if len(frames) == 1:
        body = chunk(b"VP8L", frames[0][0])
    else:
        height, width = max(f[1] for f in frames), max(f[2] for f in frames)
        body = chunk(b"VP8X", b"\x02\0\0\0" + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")) + chunk(b"ANIM", b"\xff\xff\xff\xff\0\0")
        body += b"".join(chunk(b"ANMF", b"\0" * 6 + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little") + b"\x64\0\0\x02" + chunk(b"VP8L", data)) for data, h, w in frames)
    return b"RIFF" + (4 + len(body)).to_bytes(4, "little") + b"WEBP" + body


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache_bits: int = 0, copies: bool = False, meta_bits: int = 0, block: int = 3, modes: tuple[int, ...] = tuple(range(14))) -> bytes:
    """A still image from (height, width, 4) bytes (alpha, red, green, blue), with the features asked for."""
    height, width = pixels.shape[:2]
    return _file([(_vp8l(_joined(pixels), transforms, cache_bits, copies, meta_bits, block, modes), height, width)])


@lru_cache(maxsize=1)
def _logs() -> np.ndarray:
    """Logarithms of 0 (as of 1) to a frame's samples, in 256ths of a bit: whole numbers, so sums don't depend on their order."""
    return np.rint(256 * np.log2(np.maximum(1, np.arange(ROW * FRAME_ROWS + 1)))).astype("int64")


def _bits(counts: np.ndarray) -> np.ndarray:
    """For each row of counts: the bits (in 256ths) that its own code takes at the least."""
    return (counts * (_logs()[counts.sum(1)][:, None] - _logs()[counts])).sum(1)


def _residuals(rows: np.ndarray, heights: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Of images (rows of samples, and how many rows each has): what each predictor mode leaves, the modes of each image's tiles, by the sums of residuals (7 at most, each), and those sums by image."""
    first = np.cumsum(heights) - heights
    side = 1 << TILE
    l, t, tr, tl = (np.zeros_like(rows) for _ in range(4))  # noqa: E741
    l[:, 1:], t[1:] = rows[:, :-1], rows[:-1]
    tl[1:, 1:], tr[1:, :-1], tr[:, -1] = rows[:-1, :-1], rows[:-1, 1:], rows[:, 0]
    left, top = rows - l, rows - t
    edge = top[:, 0].copy()
    edge[first] = rows[first, 0]
    half = lambda a, b: (a & b) + ((a ^ b) >> 1)
    apart = lambda a, b: np.maximum(a, b) - np.minimum(a, b)
    l_tl, mean, t_tr = half(l, tl), half(l, t), half(t, tr)
    step = tl.astype("int16")
    full = np.clip(np.add(l, t, dtype="int16") - step, 0, 255).astype("uint8")
    step = np.subtract(mean, step, dtype="int16")
    step += step < 0
    step >>= 1
    step += mean
    predictions = (np.uint8(0), l, t, tr, tl, half(half(l, tr), t), l_tl, mean, half(tl, t), t_tr, half(l_tl, t_tr), None, full, np.clip(step, 0, 255).astype("uint8"))
    tall = -(-heights // side)
    tiles = np.repeat(first - side * (np.cumsum(tall) - tall), tall) + side * np.arange(int(tall.sum()))
    found, costs = [], []
    for p in predictions:
        r = np.where(apart(t, tl) < apart(l, tl), left, top) if p is None else rows - p
        r[:, 0], r[first] = edge, left[first]
        found.append(r)
        small = np.minimum(np.minimum(r, 0 - r), 7).view("uint64")  # 8 samples at a time: 32 rows' sums stay under 256
        costs.append(np.add.reduceat(small, tiles, axis=0).view("uint8").reshape(-1, ROW // side, side).sum(2, dtype="int64"))
    best = np.argmin(costs, 0)
    ends = np.cumsum(tall)
    return found, np.split(best, ends[:-1]), np.add.reduceat(np.min(costs, 0).sum(1), ends - tall)


def _packed_palette(part: np.ndarray) -> tuple[str, np.ndarray] | None:
    """Of samples (height, width) with few values: the transform's bits and the packed indices; None for over 16 values."""
    table, index = np.unique(part, return_inverse=True)
    if len(table) > 16:
        return None
    pack = 3 if len(table) <= 2 else 2 if len(table) <= 4 else 1
    step, each = 1 << pack, 8 >> pack
    index = index.reshape(part.shape)
    index = np.pad(index, ((0, 0), (0, -part.shape[1] % step))).reshape(len(part), -1, step)
    packed = sum(index[..., k] << (each * k) for k in range(step)).astype("uint8")
    grey = table.astype("uint32")
    steps = np.diff(_channels(grey << 16 | grey << 8 | grey | 0xFF000000), axis=0, prepend=0)
    return "1" + _field(PALETTE, 2) + _field(len(table) - 1, 8) + _coded(_joined(steps)[None, :], False, 0, False), packed


def _transformed(rows: np.ndarray, heights: np.ndarray) -> tuple[list[tuple[str, np.ndarray]], list[bool]]:
    """For each grey image: its cheapest transforms' bits and the samples they leave, (height, width); and whether the predictor is among them, which leaves nothing of alpha."""
    ends = np.cumsum(heights)
    of = np.repeat(256 * np.arange(len(heights)), heights)[:, None]
    counts = np.bincount((rows + of).ravel(), minlength=256 * len(heights)).reshape(-1, 256)
    residuals, modes, left = _residuals(rows, heights)
    plain, colours, side = _bits(counts), (counts > 0).sum(1), 1 << TILE
    small = left < 5 * ROW * heights
    green = "1" + _field(GREEN, 2)
    out, used = [], []
    for k, (end, height) in enumerate(zip(ends.tolist(), heights.tolist(), strict=True)):
        price, head, samples, by = int(plain[k]), green, rows[end - height : end], False
        if small[k]:
            chosen = np.choose(np.repeat(np.repeat(modes[k], side, 0)[:height], side, 1), [r[end - height : end] for r in residuals])
            predicted = int(_bits(np.bincount(chosen.ravel(), minlength=256)[None, :])[0])
            if predicted < price:
                tiles = "1" + _field(PREDICTOR, 2) + _field(TILE - 2, 3) + _coded(modes[k].astype("uint32") << 8 | 0xFF000000, False, 0, False)
                if predicted + 256 * len(tiles) < price:
                    price, head, samples, by = predicted + 256 * len(tiles), green + tiles, chosen, True
        if colours[k] <= 16:
            table, packed = _packed_palette(rows[end - height : end])
            if int(_bits(np.bincount(packed.ravel(), minlength=256)[None, :])[0]) + 256 * (len(table) - len(green)) < price:
                head, samples, by = table, packed, False
        out.append((head, samples))
        used.append(by)
    return out, used


def _copies(flat: np.ndarray, image: np.ndarray, starts: np.ndarray, ends: np.ndarray, each: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, lengths and distances of the back-references in images that lie one after the other; ``each``: 256ths of a bit that a sample takes otherwise."""
    size = len(flat)
    eight = np.ndarray(size + SHORTEST, "<u8", flat.tobytes() + bytes(16), strides=(1,)).astype("uint64")
    window = eight[:size] & np.uint64((1 << 8 * SHORTEST) - 1)
    key = (window * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(size, dtype="uint64")
    key.sort()
    place = (key & np.uint64(0xFFFFFFFF)).astype("int64")
    like = (key[1:] ^ key[:-1]) >> np.uint64(32) == 0
    source = np.full(size, -1)
    like = np.flatnonzero(like)
    source[place[like + 1]] = place[like]
    at = np.flatnonzero((source >= starts[image]) & (np.arange(size) + SHORTEST <= ends[image]))
    at = at[window[source[at]] == window[at]]
    before, own = source[at], image[at]
    # The next 8 samples at once; what goes on behind them is counted only where it is needed.
    unlike = eight[at + SHORTEST] ^ eight[before + SHORTEST]
    low = unlike & (~unlike + np.uint64(1))
    long = SHORTEST + np.where(unlike == 0, 8, (np.log2(np.maximum(low, 1).astype("float64")) / 8).astype("int64"))
    long = np.minimum(long, ends[own] - at)
    most = SHORTEST + 8
    won = lambda k, n: n * each[own[k]] - 256 * (8 + np.maximum(0, _logs()[n] // 256 - 2) + np.floor(np.log2(at[k] - before[k] + 120)).astype("int64") - 1)
    good = (won(slice(None), long) > 0) | (long == most)
    at, before, own, long = at[good], before[good], own[good], long[good]
    passed = np.zeros(size + 1, "int64")
    passed[at + 1] = 1
    following = np.cumsum(passed)[at + long]
    following[long == most] = -1
    following, after, raw, kept, grown = following.tolist(), np.cumsum(passed), flat.tobytes(), [], []
    k, end = 0, len(at)
    while k < end:
        kept.append(k)
        to = following[k]
        if to < 0:
            p, q, n = at.item(k), before.item(k), most
            limit = min(ends.item(own.item(k)) - p, 4096)
            while n + 64 <= limit and raw[p + n : p + n + 64] == raw[q + n : q + n + 64]:
                n += 64
            while n < limit and raw[p + n] == raw[q + n]:
                n += 1
            grown.append(n)
            to = after.item(p + n)
        k = to
    kept = np.array(kept, "int64")
    n = long[kept]
    n[n == most] = grown
    gain = won(kept, n)
    kept, n, gain = kept[gain > 0], n[gain > 0], gain[gain > 0]
    total = np.bincount(own[kept], gain, len(starts))
    enough = (total > 256 * 80)[own[kept]]  # about what the distances' code takes
    kept, n = kept[enough], n[enough]
    return at[kept], n, at[kept] - before[kept]


def _canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of each row's lengths, as numbers of the bits in stream order; a lone symbol has none."""
    row, symbol = np.nonzero(lengths)
    n = lengths[row, symbol]
    many = np.bincount(16 * row + n, minlength=16 * len(lengths)).reshape(-1, 16)
    following, code = np.zeros_like(many), np.zeros(len(lengths), "int64")
    for k in range(1, 16):
        code = (code + many[:, k - 1]) << 1
        following[:, k] = code
    order = np.argsort(row * 16 + n, kind="stable")
    row, symbol, n = row[order], symbol[order], n[order]
    group = row * 16 + n
    new = np.flatnonzero(np.diff(group, prepend=-1))
    rank = np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group))))
    out = np.zeros(lengths.shape, "int64")
    out[row, symbol] = TURNED[((following[row, n] + rank) << (15 - n)) & 32767]
    return out


def _stepped(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances (from 1) as symbols, extra bits and how many."""
    v = value - 1
    top = np.maximum(np.floor(np.log2(np.maximum(v, 1))).astype("int64") - 1, 0)
    return np.where(v < 4, v, 2 * (top + 1) + ((v >> top) & 1)), np.where(v < 4, 0, v & ((1 << top) - 1)), np.where(v < 4, 0, top)


def _banded(owner: np.ndarray, symbol: np.ndarray, row: np.ndarray, heights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many groups of codes each image gets (one, or one for each band of rows where that is cheaper), and each token's group."""
    tall = -(-heights >> BAND)
    band, groups = row >> BAND, np.ones(len(heights), "int64")
    large = np.flatnonzero(tall > 1)
    if len(large):
        price = lambda c: _bits(c) + 256 * (250 + 5 * (c > 0).sum(1))  # noqa: E731  # about what a group's codes take as well
        token = np.flatnonzero((tall > 1)[owner])
        image, bands = np.searchsorted(large, owner[token]), tall[large]
        first = np.cumsum(bands) - bands
        whole = price(np.bincount(280 * image + symbol[token], minlength=280 * len(large)).reshape(-1, 280))
        own = price(np.bincount(280 * (first[image] + band[token]) + symbol[token], minlength=280 * int(bands.sum())).reshape(-1, 280))
        cheaper = np.add.reduceat(own, first) < whole
        groups[large[cheaper]] = bands[cheaper]
    return groups, (np.cumsum(groups) - groups)[owner] + np.where(groups[owner] > 1, band, 0)


def _cached(samples: np.ndarray, alpha: int, at: np.ndarray, symbols: np.ndarray) -> tuple[int, np.ndarray]:
    """The size of colour cache (0: none) by which an image's tokens at these samples take the fewest bits, and their symbols with it."""
    argb = np.arange(256, dtype="uint64") << np.uint64(8) | np.uint64(alpha << 24)
    best, found, least = 0, symbols, int(_bits(np.bincount(symbols)[None, :])[0])
    for n in range(1, 11):
        place = (((argb * np.uint64(0x1E35A7BD) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - n)).astype("int64"))[samples]
        order = np.argsort(place.astype("uint16"), kind="stable")
        there, value, hit = place[order], samples[order], np.zeros(len(samples), bool)
        hit[order[1:]] = (there[1:] == there[:-1]) & (value[1:] == value[:-1])
        own = np.where((symbols < 256) & hit[at], 280 + place[at], symbols)
        counts = np.bincount(own)
        price = int(_bits(counts[None, :])[0]) + 256 * (20 + 4 * int((counts[280:] > 0).sum()))
        if price < least:
            best, found, least = n, own, price
    return best, found


def _images(parts: list[bytes]) -> list[bytes]:
    """Grey images, of rows of 192 samples each, as VP8L chunks."""
    heights = np.array([len(p) // ROW for p in parts])
    plans, predicted = _transformed(np.frombuffer(b"".join(parts), "uint8").reshape(-1, ROW), heights)
    count = len(parts)
    flat = np.concatenate([p[1].ravel() for p in plans])
    sizes = np.array([p[1].size for p in plans])
    ends = np.cumsum(sizes)
    image = np.repeat(np.arange(count), sizes)
    counts = np.bincount(256 * image + flat, minlength=256 * count).reshape(-1, 256)
    place, long, back = _copies(flat, image, ends - sizes, ends, _bits(counts) // sizes)
    covered = np.zeros(len(flat) + 1, "int8")
    covered[place] += 1
    np.subtract.at(covered, place + long, 1)
    alone = np.cumsum(covered[:-1], dtype="int8") == 0

    # Tokens: a sample each, or a copy's length; a copy's distance comes after its length.
    starts = alone.copy()
    starts[place] = True
    at = np.flatnonzero(starts)
    owner, symbol = image[at], flat[at].astype("int64")
    copy = np.flatnonzero(~alone[at])
    symbol[copy], more, n_more = _stepped(long)
    symbol[copy] += 256
    widths = np.array([p[1].shape[1] for p in plans])
    wide = widths[owner[copy]]
    far = np.where(back == 1, 2, np.where(back == wide, 1, back + 120))
    step, rest, n_rest = _stepped(far)
    within = at - (ends - sizes)[owner]
    groups, group = _banded(owner, symbol, within // widths[owner], heights)

    # Under one code, samples that come again at once more often than by chance: a colour cache may pay.
    again = np.bincount(owner[(symbol < 256) & (within > 0) & (flat[at] == flat[at - 1])], minlength=count)
    chance = np.bincount(owner, minlength=count) / sizes.astype("float64") ** 2
    caches = [0] * count
    for k in np.flatnonzero((groups == 1) & (again > 16 + AGAIN * chance * (counts * counts).sum(1))).tolist():
        part = slice(*np.searchsorted(owner, (k, k + 1)))
        caches[k], symbol[part] = _cached(plans[k][1].ravel(), 0 if predicted[k] else 255, within[part], symbol[part])
    size = 280 + (1 << max(caches) if any(caches) else 0)
    many, who = int(groups.sum()), group[copy]
    lengths = np.array([code_lengths(c, DEEPEST) for c in np.bincount(size * group + symbol, minlength=size * many).reshape(-1, size).tolist()], "int64")
    backs = np.array([code_lengths(c, DEEPEST) for c in np.bincount(40 * who + step, minlength=40 * many).reshape(-1, 40).tolist()], "int64")
    zero, opaque = _written((1, *[0] * 255)), _written((*[0] * 255, 1))
    heads, own = [], iter(zip(lengths.tolist(), backs.tolist(), strict=True))
    for (head, samples), left, cache_bits, n in zip(plans, predicted, caches, groups.tolist(), strict=True):
        bits = _head(len(samples), ROW) + head + "0" + ("1" + _field(cache_bits, 4) if cache_bits else "0")
        bits += "0" if n == 1 else "1" + _field(BAND - 2, 3) + _coded(np.repeat(np.arange(n, dtype="uint32")[:, None] << 8, -(-samples.shape[1] >> BAND), 1), False, 0, False)
        for main, b in islice(own, n):
            bits += _written(tuple(main[: 280 + (1 << cache_bits if cache_bits else 0)])) + 2 * zero + (zero if left else opaque) + _written(tuple(b))
        heads.append((_packed(bits), len(bits)))

    main, main_n = _canonical(lengths)[group, symbol], np.where((lengths > 0).sum(1) == 1, 0, 1)[group] * lengths[group, symbol]
    main[copy] |= more << main_n[copy]
    main_n[copy] += n_more
    second_n = np.where((backs > 0).sum(1) == 1, 0, 1)[who] * backs[who, step]
    second = _canonical(backs)[who, step] | rest << second_n
    value, n = np.insert(main, copy + 1, second), np.insert(main_n, copy + 1, second_n + n_rest)
    owner = np.insert(owner, copy + 1, owner[copy])

    # Each image begins at a whole word; its head's bits are followed by its tokens'.
    head_n = np.array([h[1] for h in heads])
    spent = np.bincount(owner, n, count).astype("int64")
    words = -(-(head_n + spent) // 32) + 2
    begin = 32 * (np.cumsum(words) - words)
    total = np.cumsum(n) - n
    offset = total + (begin + head_n - np.cumsum(spent) + spent)[owner]
    stream = np.zeros(int(words.sum()), "uint32")
    held = value.astype("uint64") << (offset & 31).astype("uint64")
    word = offset >> 5
    new = np.flatnonzero(np.diff(word, prepend=-1))
    held, word = np.bitwise_or.reduceat(held, new), word[new]
    stream[word] |= (held & np.uint64(0xFFFFFFFF)).astype("uint32")
    stream[word + 1] |= (held >> np.uint64(32)).astype("uint32")
    raw, out = stream.tobytes(), []
    for (head, n), b, tokens in zip(heads, (begin // 8).tolist(), spent.tolist(), strict=True):
        data = bytearray(raw[b : b + (n + tokens + 7) // 8])
        rest = data[len(head) - 1]
        data[: len(head)] = head
        data[len(head) - 1] |= rest if n % 8 else 0
        out.append(bytes(data))
    return out


def to_files(payloads: list[bytes]) -> list[bytes]:
    """Payloads (multiples of 192 bytes) as files of grey images, 192 samples a row."""
    parts = [(k, p[i : i + ROW * FRAME_ROWS]) for k, p in enumerate(payloads) for i in range(0, len(p), ROW * FRAME_ROWS)]
    frames: list[list[tuple[bytes, int, int]]] = [[] for _ in payloads]
    for (k, part), data in zip(parts, _images([p for _, p in parts]) if parts else [], strict=True):
        frames[k].append((data, len(part) // ROW, ROW))
    return [_file(f) for f in frames]


def to_media(payload: bytes) -> bytes:
    """Bytes (a positive multiple of 192) as grey images, 192 samples a row."""
    return to_files([payload])[0]


def padded(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode()
    return len(data), data + b" " * (-len(data) % ROW or (0 if data else ROW))


def features(frames: list[np.ndarray]) -> str:
    """Size, mean, spread and horizontal gradient of the grey samples, and their histogram in 16 bins; in whole numbers, so exact."""
    grey = np.concatenate([f[..., 2] for f in frames])
    n, counts = grey.size, np.bincount(grey.ravel(), minlength=256)
    levels = np.arange(256)
    mean, square = int((counts * levels).sum()), int((counts * levels * levels).sum())
    slope = int(np.abs(np.diff(grey.astype("int16"), axis=1)).sum(dtype="int64"))
    return f"{grey.shape[1]}x{grey.shape[0]} mean={mean * 1000 // n} var={(square * n - mean * mean) * 1000 // (n * n)} slope={slope * 1000 // n} hist=" + ",".join(map(str, counts.reshape(16, 16).sum(1).tolist()))


def store(df: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) for each row of ``df`` (doc_id, text): the text's UTF-8, padded by spaces to a positive multiple of 192, as a lossless file.

    A null text counts as empty: 192 spaces. Equal texts give equal files, repeated rows repeated ones; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 1, 1 << 17):
            sizes, payloads = zip(*map(padded, part.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(to_files(list(payloads)), pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(df: DataFrame) -> DataFrame:
    """Decodes each media value of ``df`` (doc_id, n_bytes, media): sizes and hashes of the file and of the payload read from its pixels, and features of the pixels."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in by_size(batches, 2):
            rows = []
            files = part.column(2).to_pylist()
            for media, frames in zip(files, decode_all(files), strict=True):
                payload = b"".join(f[..., 2].tobytes() for f in frames)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(frames)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return df.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digests(df: DataFrame) -> DataFrame:
    """Stores every text as a media file in the shared folder, reads the files back and gives their digests."""
    return read(stored(store(df), "media"))
