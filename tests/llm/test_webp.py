"""What texts' files are made of, and how they are read: together, alone, and by a plain reader of the format."""

import numpy as np
import pytest

from veilspark.llm import webp

RANDOM = np.random.default_rng(5)
WORDS = ["".join(RANDOM.choice(list("etaoinshrdlu"), RANDOM.integers(2, 9))) for _ in range(300)]
PROSE = " ".join(RANDOM.choice(WORDS, 700))
RARE = "".join(RANDOM.choice(list("qzxjkvbQZXJKV~^`@{}"), 6000))


def pad(text: str) -> bytes:
    return webp.padded(text)[1]


def chunk(file: bytes) -> bytes:
    return next(body for name, body in webp._chunks(file, 12, len(file)) if name == b"VP8L")


def transforms(file: bytes) -> list[int]:
    return [t[0] for t in webp._opened(chunk(file))[0]]


def plainly(data: bytes) -> tuple[bytes, int, tuple[int, ...]]:
    """The samples of a grey image with subtract-green and one group of codes, bit by bit; how many copies it has, and green's code lengths."""
    stream, at = "".join(format(b, "08b")[::-1] for b in data), 0

    def take(n):
        nonlocal at
        at += n
        return int(stream[at - n : at][::-1] or "0", 2)

    def decoder(lengths):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) < 2:
            return {"": used[0][1] if used else 0}
        out, code, before = {}, 0, 0
        for n, s in used:
            code <<= n - before
            out[format(code, f"0{n}b")] = s
            code, before = code + 1, n
        return out

    def symbol(code):
        bits = ""
        while bits not in code:
            bits += str(take(1))
        return code[bits]

    def lengths(size):
        out = [0] * size
        if take(1):
            two, wide = take(1), take(1)
            for k in range(1 + two):
                out[take(8 if k or wide else 1)] = 1
            return out
        first = [0] * 19
        for k in range(4 + take(4)):
            first[webp.LENGTH_ORDER[k]] = take(3)
        code = decoder(first)
        assert take(1) == 0
        k = 0
        while k < size:
            s = symbol(code)
            assert s != 16
            n, run = (s, 1) if s < 16 else (0, 3 + take(3)) if s == 17 else (0, 11 + take(7))
            out[k : k + run] = [n] * run
            k += run
        return out

    def far(s):
        return s + 1 if s < 4 else ((2 + s % 2) << (s - 2) // 2) + take((s - 2) // 2) + 1

    assert take(8) == 0x2F
    width, height = take(14) + 1, take(14) + 1
    take(4)
    assert (take(1), take(2), take(1), take(1), take(1)) == (1, webp.GREEN, 0, 0, 0)
    sizes = [lengths(n) for n in (280, 256, 256, 256, 40)]
    green, red, blue, alpha, distance = map(decoder, sizes)
    assert (red, blue, alpha) == ({"": 0}, {"": 0}, {"": 255})
    out, copies = bytearray(), 0
    while len(out) < width * height:
        s = symbol(green)
        if s < 256:
            out.append(s)
            continue
        n, code = far(s - 256), far(symbol(distance))
        back = code - 120 if code > 120 else max(1, webp.NEAR[code - 1][0] + width * webp.NEAR[code - 1][1])
        copies += 1
        for _ in range(n):
            out.append(out[-back])
    return bytes(out), copies, tuple(sizes[0])


def test_each_text_has_a_code_of_its_own_and_copies():
    prose, rare = (chunk(webp.to_media(pad(t))) for t in (PROSE, RARE))
    (one, copies, code), (two, _, other) = plainly(prose), plainly(rare)
    assert (one, two) == (pad(PROSE), pad(RARE)) and copies > 50
    assert not any(code[ord(c)] for c in "qzQZ~^") and max(other[ord(c)] for c in set(RARE)) <= 6
    counts = np.bincount(list(pad(RARE)))
    counts = counts[counts > 0]
    least = -(counts * np.log2(counts / counts.sum())).sum()
    assert 8 * len(rare) < 1.03 * least + 1000 and len(prose) < 0.45 * len(pad(PROSE))


def test_the_cheapest_transforms_are_taken():
    smooth = np.cumsum(RANDOM.integers(-2, 3, 192 * 40)).astype("uint8").tobytes()
    few = "".join(RANDOM.choice(list("ACGT"), 5000))
    files = webp.to_files([pad(PROSE), smooth, pad(few)])
    assert list(map(transforms, files)) == [[webp.GREEN], [webp.GREEN, webp.PREDICTOR], [webp.PALETTE]]
    assert len(files[1]) < 0.4 * len(smooth) and len(files[2]) < 0.3 * len(few)


def test_bands_of_other_letters_have_other_codes():
    half = 64 * webp.ROW
    text = "".join(RANDOM.choice(list("abcdefghijklmnopqrst"), half)) + "".join(RANDOM.choice(list("ABCDEFGHIJ0123456789"), half))
    file = webp.to_media(text.encode())
    assert 8 * len(file) < 4.5 * 2 * half  # one code takes 5.3 bits a letter
    assert webp.decode(file)[0][..., 2].tobytes() == text.encode()


def test_a_colour_cache_where_it_pays():
    text = "".join(c * int(n) for c, n in zip(RANDOM.choice(list("etaoinshrdlu,.09"), 4000), RANDOM.integers(1, 4, 4000), strict=True))
    files = []
    for again in (webp.AGAIN, 1e9):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(webp, "AGAIN", again)
            patch.setattr(webp, "_residuals", lambda rows, heights: ([], [], heights * webp.ROW * 7))  # the predictor would do as well
            files.append(webp.to_media(pad(text)))
    assert len(files[0]) < 0.9 * len(files[1]) and transforms(files[0]) == [webp.GREEN]
    assert all(webp.decode(f)[0][..., 2].tobytes() == pad(text) for f in files)


def test_read_alone_and_together():
    texts = [PROSE[: 50 * k] + WORDS[k] * (k % 7) for k in range(70)] + ["", "a", " " * 999, RARE, "x" * 900_000, few_words(5), few_words(40000)]
    payloads = [pad(t) for t in texts] + [bytes(RANDOM.integers(0, k, n, dtype="uint8")) for k in (2, 3, 17, 256) for n in (192, 5760)]
    files = webp.to_files(payloads)
    assert files == [webp.to_media(p) for p in payloads]
    for payload, frames, file in zip(payloads, webp.decode_all(files), files, strict=True):
        assert b"".join(f[..., 2].tobytes() for f in frames) == payload
        assert all((f[..., 0] == 255).all() and (f[..., 1:] == f[..., 2:3]).all() for f in frames)
        assert all((a == b).all() for a, b in zip(frames, webp.decode(file), strict=True))


def few_words(n: int) -> str:
    return " ".join(RANDOM.choice(WORDS[:5], n))


@pytest.mark.parametrize("others", [0, 60])
def test_lost_bytes_are_noticed(others):
    files = webp.to_files([pad(PROSE + w) for w in WORDS[:others]])
    for text in (PROSE, RARE):
        data = chunk(webp.to_media(pad(text)))
        for n in (2, 9, 200):
            with pytest.raises(ValueError):
                webp.decode_all([webp._file([(data[:-n], 1, webp.ROW)]), *files])
