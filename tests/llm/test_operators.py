"""The training-data operators against brute force, round trips and odd tables."""

import hashlib
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")

from veilspark.llm import forest, hilbert, mixing, prefix_bpe, rans, tokens, toxicity, trees, warc, webp  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, rate double"
LONG = "lorem ipsum dolor sit amet " * 4000
ROWS = [
    (1, "one two three four five six seven", "en", "b", 3, "x", 1.0),
    (2, "one two three four five six seven", "en", None, 3, "x", 1.0),
    (2, "one two three four five six seven", "en", None, 3, "x", 1.0),
    (3, None, None, "a", None, None, None),
    (4, "", "de", "a", 0, None, None),
    (5, LONG, "en", "a", 9, None, None),
    (None, "no id here\nno id here\nbut words é 漢 😀", "fr", "c", 1, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def test_water_filling():
    assert mixing.water_fill([10, 10, 100], [3, 1, 2], 180, 2) == [20, 20, 140]
    assert mixing.water_fill([0, 10], [1, 1], 15, 2) == [0, 15]


def test_mix_meets_targets(spark, odd):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 3}") for i in range(600)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=50).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 0.01 * g["target"].iloc[0] and (g["taken"] <= 2 * g["size"]).all()
    out = mixing.mix(odd).toPandas()
    assert len(out) == len(ROWS) and (out["taken"] <= 2 * out["size"]).all()
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_hilbert_curve_is_one_path(spark):
    for d, bits in ((2, 3), (3, 2), (4, 1)):
        points = spark.createDataFrame(list(product(range(1 << bits), repeat=d)), ",".join(f"c{i} int" for i in range(d)))
        way = points.select("*", hilbert.curve_index([F.col(f"c{i}") for i in range(d)], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in way] == list(range(1 << bits * d))
        assert all(sum(abs(a[i] - b[i]) for i in range(d)) == 1 for a, b in zip(way, way[1:], strict=False))


def test_shards_are_even(spark, odd):
    got = hilbert.shard(odd, ["source", "lang", "n_chars"], 4).toPandas()
    assert sorted(got["shard"].value_counts()) == [1, 2, 2, 2]
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert hilbert.shard(odd.limit(0), ["source"], 4).count() == 0


def test_webp_features_round_trip():
    random = np.random.default_rng(0)
    for h, w, k in ((1, 1, 2), (5, 7, 3), (20, 33, 12), (9, 17, 200)):
        image = random.integers(0, 256, (k, 4), dtype="uint8")[random.integers(0, k, (h, w))]
        image[:, : w // 2] = image[:1, : w // 2]
        for transforms in ((), (0,), (1,), (2,), (3,), (0, 1, 2), (3, 0)):
            for cache, copies, meta in ((0, False, 0), (4, False, 0), (6, True, 0), (3, True, 2)):
                assert (webp.decode(webp.encode(image, transforms, cache, copies, meta))[0] == image).all()
    for data in (b"", b"RIFF", webp.encode(np.zeros((4, 4, 4), "uint8"))[:-8]):
        with pytest.raises(ValueError):
            webp.decode(data) or (_ for _ in ()).throw(ValueError)


def test_media_digests(odd):
    got = webp.digests(odd).collect()
    assert len(got) == len(ROWS)
    for r in got:
        text = next(t[1] or "" for t in ROWS if t[0] == r.doc_id)
        payload = text.encode() + b" " * (-len(text.encode()) % 192 or (0 if text else 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text.encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))


@pytest.fixture(scope="module")
def tiktoken_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=prefix_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})


def test_bpe_equals_the_library(spark, odd, tiktoken_encoding):
    got = prefix_bpe.encode_documents(odd, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).collect()
    for r in got:
        text = next(t[1] or "" for t in ROWS if t[0] == r.doc_id)
        ids = tiktoken_encoding.encode_ordinary(text)
        assert r.ids == ids and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edits_follow(tiktoken_encoding):
    random = np.random.default_rng(3)
    parts = ["a", "th", "e ", "  ", "\n", "É", "漢", "😀", "'s", "'ll", "22", "--", "\t", "ing", "́", "x" * 40]
    bpe = prefix_bpe.encoder(P.path("byte_bpe_50k.tiktoken"))
    for _ in range(40):
        e = prefix_bpe.EditableEncoding(bpe, P.PATTERN, "".join(random.choice(parts, 30)))
        for _ in range(8):
            i = int(random.integers(0, len(e.text) + 1))
            e.edit(i, min(len(e.text), i + int(random.integers(0, 6))), "".join(random.choice(parts, int(random.integers(0, 4)))))
            assert e.tokens() == tiktoken_encoding.encode_ordinary(e.text)
        e.append(" end")
        assert e.tokens() == tiktoken_encoding.encode_ordinary(e.text)
    last, lengths = [], []
    bpe.extend(b"internationally", last, lengths)
    for n in range(1, 16):
        assert bpe.read(last, lengths, n) == tiktoken_encoding.encode_ordinary("internationally"[:n])


def brute_repeats(words, n=8):
    seen = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    hit = {k for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for k in range(i, i + n)}
    return len(hit)


def test_statistics_equal_brute_force(odd, labels):
    random = np.random.default_rng(1)
    for _ in range(60):
        words = [bytes([97 + int(c)]) for c in random.integers(0, 3, int(random.integers(0, 60)))]
        assert trees.repeated_words(words) == brute_repeats(words)
    got = {r.doc_id: r for r in trees.judge(odd, labels).collect()}
    assert got[3].n_words == 0 and not got[3].kept and got[5].base_failed and got[None].n_dup_lines == 1
    assert trees.judge(odd, labels.limit(0)).count() == len(ROWS)


def test_trees_learn_and_stay_monotone():
    random = np.random.default_rng(2)
    x = random.random((3000, 4))
    y = ((x[:, 0] < 0.5) ^ (random.random(3000) < 0.05)).astype(float)
    model = trees.fit(x, y, {0: -1})
    assert ((model.score(x) >= 0.5) == (x[:, 0] < 0.5)).mean() > 0.97
    line = np.repeat(random.random((1, 4)), 200, 0)
    line[:, 0] = np.linspace(0, 1, 200)
    assert (np.diff(model.score(line)) <= 1e-12).all()


def test_factorization_machine_learns_pairs(spark, odd, labels):
    random = np.random.default_rng(4)
    rows, y = [], []
    for _ in range(3000):
        insult, group = (int(v) for v in random.random(2) < 0.5)
        rows.append(np.unique(np.concatenate([random.integers(100, 130, 6), [1] * insult, [2] * group])).astype("int64"))
        y.append(float(insult and group))
    machine = toxicity.fit(rows[:2400], np.array(y[:2400]), buckets=256, epochs=20)
    assert ((machine.score(rows[2400:]) >= 0.5) == np.array(y[2400:])).mean() > 0.99
    # The interaction itself, which no sum of weights has: v1.v2 takes its part.
    assert machine.factor[1] @ machine.factor[2] > 0.05
    out = toxicity.rate(odd, toxicity.train(odd, labels)).toPandas()
    assert len(out) == len(ROWS) and out["score"].between(0, 1).all()


def test_sections_add_up(odd):
    ends = np.array([3, 6, 9])
    starts, stops = np.array([0, 4, 8]), np.array([4, 7, 9])
    assert tokens.attributed(ends, starts, stops, "first").tolist() == [0, 0, 1]
    assert tokens.attributed(ends, starts, stops, "last").tolist() == [0, 1, 2]
    assert tokens.attributed(ends, starts, stops, "most").tolist() == [0, 1, 1]
    got = tokens.section_counts(odd.where("doc_id <> 2"), P.path("byte_bpe_50k.json")).toPandas()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, g in got.dropna(subset=["doc_id"]).groupby("doc_id"):
        text = next(t[1] or "" for t in ROWS if t[0] == i)
        assert g["n_tokens"].sum() == len(library.encode(text, add_special_tokens=False).ids) and (g["section"] >= 0).sum() == text.count("\n") + 1


def test_rans_round_trip_and_checkpoints(spark, odd):
    random = np.random.default_rng(1)
    for n in (1, 5, 4095, 4097, 700_000):
        ids = (random.zipf(1.3, n) % 50_000).astype("uint32")
        table = rans.Table.of(np.bincount(ids))
        data = rans.encode(ids, table)
        assert (rans.decode(data, table) == ids).all()
        for k in range(int(np.frombuffer(data, "<u8", 5)[3])):
            assert (rans.decode(data, table, k) == ids[(k + 1) * rans.CHECKPOINT * min(rans.LANES, n) :]).all()
    assert rans.crc_of_both(zlib.crc32(b"abc"), zlib.crc32(b"defgh"), 5) == zlib.crc32(b"abcdefgh")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    counts = rans.counted(made := rans.tokenised(odd, P.path("byte_bpe_50k.json"), 2).cache())
    small = rans.read_back(rans.blocked(made, counts, block=100), counts).toPandas()
    whole = rans.digests(odd, P.path("byte_bpe_50k.json")).toPandas()
    assert sorted(small["ids_crc32"]) == sorted(whole["ids_crc32"])
    start = 0
    for i, text, *_ in sorted(ROWS, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        hit = whole[(whole["doc_id"].isna() if i is None else whole["doc_id"] == i) & (whole["start"] == start)]
        assert hit[["n_tokens", "ids_crc32"]].values.tolist() == [[len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())]]
        start += len(ids)


def test_rans_files_hold_the_ids_in_order(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(i * 7919 % 500, f"text {i} of some words, é 漢 " * (i % 9) + ("a <|endoftext|> b" if i % 50 == 0 else "")) for i in range(500)] + [(None, "<|endoftext|>"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    blocks, counts = rans.write(df, P.path("byte_bpe_50k.json"))
    table, found = rans.Table.of(counts), []
    for name in sorted(blocks.inputFiles()):
        for b in spark.read.parquet(name).collect():
            found += rans.decode(bytes(b.data), table).tolist()
    want = []
    for i, text in sorted(rows, key=lambda r: (-1, zlib.crc32((r[1] or "").encode())) if r[0] is None else (r[0], 0)):
        want += [*library.encode(text or "", add_special_tokens=False).ids, 2]
    assert found == want and 50256 in want
    got = rans.digests(df, P.path("byte_bpe_50k.json")).orderBy("start").collect()
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist() and len(got) == len(rows)


def test_warc_derivatives(spark):
    page = '<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>var t="</p>";</script><p>Hi <b>you</b><br>two</p><!-- no --><a href="/x?a=1&amp;b=2">go</a></body></html>'
    pages = spark.createDataFrame([(1, "http://e.org/d/", page), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    rows = warc.derivatives(warc.responses(pages)).collect()
    assert len(rows) == 6
    one = {r.record_type: r for r in rows if r.page_id == 1}
    headers, block = warc.parse(bytes(one["conversion"].warc))
    assert block.decode() == "Hi you\ntwo\ngo" and dict(headers)["WARC-Refers-To"] == one["metadata"].refers_to
    assert dict(headers)["WARC-Block-Digest"] == warc.sha1(block) and one["metadata"].n_links == 1
    assert b'"http://e.org/x?a=1&b=2"' in bytes(one["metadata"].warc) and b"A & B" in bytes(one["metadata"].warc)


def test_warc_odd_records(spark):
    page = '<head><title>t</title><p>seen<a data-href="/no" href="/yes">x</a><!-- <a href="/comment"> --><script>"<a href=/script>"</script><a class=q href=/z>y</a>'
    assert warc.links(page, "http://e.org/") == ["http://e.org/yes", "http://e.org/z"] and warc.visible(page).split("\n") == ["seenx", "y"]
    latin = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>")], b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\n\r\n<p>caf\xe9")
    packed = zlib.compress("<p>é".encode())
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: deflate\r\n\r\n" + b"%x\r\n" % len(packed) + packed + b"\r\n0\r\n\r\n"
    other = warc.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:2>")], chunked)
    assert warc.derive(latin)[1][2].decode() == "café" and warc.derive(other)[1][2].decode() == "é"
    bad = [b"", b"no record", latin[:-20], b"WARC/1.1\r\nContent-Length: x\r\n\r\n"]
    records = spark.createDataFrame([(i, b) for i, b in enumerate([latin, *bad, None])], "page_id long, warc binary")
    assert [r.page_id for r in warc.derivatives(records).collect()] == [0, 0] and warc.derivatives(records.limit(0)).count() == 0


def test_mix_by_brute_force(spark):
    random = np.random.default_rng(2)
    rows = [(i, "w " * int(random.integers(0, 60)), None if i % 7 == 0 else f"s{i % 4}") for i in range(900)] + [(None, "n " * k, "s1") for k in range(40)] + [(5, "same words here", "s2")] * 3
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), group_rows=100).toPandas()
    names = sorted({r[2] for r in rows if r[2]}) + [None]
    sizes = [sum(len(r[1].split()) for r in rows if r[2] == n) for n in names]
    want = dict(zip(names, mixing.water_fill(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes), 2), strict=True))
    for name, size in zip(names, sizes, strict=True):
        g = got[got["source"].isna() if name is None else got["source"] == name]
        # Entropy balancing by bisection over one multiplier.
        s, low, high = g["size"].to_numpy("float64"), -50.0, 50.0
        rate = lambda x, s=s: np.minimum(2, 1.5 * np.exp(np.minimum(700, x * s / s.mean())))
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (middle, high) if (s * rate(middle)).sum() < want[name] else (low, middle)
        assert g["target"].iloc[0] == pytest.approx(want[name]) and g["source_size"].iloc[0] == size
        if want[name] < 2 * size:
            assert np.allclose(g["rate"][s > 0], rate(high)[s > 0], atol=1e-4)
        assert abs(g["taken"].sum() - want[name]) <= 0.01 * want[name] + 60
    out = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("doc_id").count().collect()
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("copies > 0").groupBy("doc_id").agg(F.sum("copies").alias("count")).collect()
    assert {r.doc_id: r["count"] for r in out} == {r.doc_id: r["count"] for r in again}


def brute_links(texts, n=5, least=0.8):
    sets = {t: {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := t.split()) else set() for t in texts}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def test_join_loses_no_link(spark, odd):
    random = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for i in range(150):
        words = list(base)
        for k in random.integers(0, 120, int(random.integers(0, 4))):
            words[k] = f"x{i}"
        texts.append(" ".join(words))
    texts += ["short one", "short one", "", "four words in all", *(" ".join(f"{c}{k}" for k in range(50)) for c in "abc")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = brute_links(set(texts))
    degree = Counter(x for pair in links for x in pair)
    root = {t: t for t in texts}

    def top(t):
        while root[t] != t:
            t = root[t]
        return t

    for a, b in links:
        root[top(a)] = top(b)
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(top(t), i)
    for block in (400_000, 3000):  # one task, and many blocks
        got = {r.doc_id: (r.class_id, r.n_links) for r in forest.linked(df, block=block).collect()}
        assert got == {i: (least[top(t)], degree[t]) for i, t in enumerate(texts)}
    assert forest.linked(odd).count() == len(ROWS) and forest.linked(odd.limit(0)).count() == 0
    assert {r.doc_id for r in forest.kept(odd).collect()} == {1, 3, 5, None}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r.id: r.root for r in forest.components(edges).collect()} == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_pipeline_runs(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clean = [(i, " ".join(f"word{(i * 37 + k * k) % 997}" for k in range(60)), "en", f"s{i % 2}", 9) for i in range(40)]
    docs = [*clean, (100, clean[0][1], "en", "s0", 9), (101, clean[1][1] + " idiot moron idiot scum", "en", "s1", 9), (102, "a b " * 100, "en", "s1", 9)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(d[0], int(d[0] != 102), int(d[0] == 101)) for d in docs]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()}
    assert 100 not in out and 102 not in out and len(out & set(range(40))) > 20
