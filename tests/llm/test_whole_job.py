"""Operators and stages on rows without ids or under shared ones."""

import numpy as np
import pytest


def test_join_links_texts_without_id_or_under_one(spark):
    from veilspark.llm import forest

    base = [f"w{k}" for k in range(120)]
    near = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(6)]
    other = [" ".join(f"{c}{k}" for k in range(60)) for c in "ab"]
    rows = [(None, near[0]), (None, near[1]), (None, other[0]), (None, other[1]), (9, near[2]), (9, near[3]), (9, near[3]), (4, near[4]), (9, "another text of some words under nine")]
    got = sorted((r.doc_id or 0, r.class_id or 0, r.n_links, r.n_copies) for r in forest.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted([(0, 4, 4, 1), (0, 4, 4, 1), (0, 0, 0, 1), (0, 0, 0, 1), (9, 4, 4, 1), (9, 4, 4, 2), (9, 4, 4, 2), (4, 4, 4, 1), (9, 9, 0, 1)])


def test_pipeline_judges_rows_not_ids(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    clean = [(i, " ".join(f"word{(i * 37 + k * k) % 997}" for k in range(60)), "en", f"s{i % 2}", 9) for i in range(40)]
    marked = [*clean, (100, clean[1][1] + " idiot moron idiot scum", "en", "s1", 9), (101, "a b " * 100, "en", "s1", 9)]
    lost = [(None, " ".join(f"free{i}x{k}" for k in range(60)), "en", "s0", 9) for i in range(4)] + [(7, " ".join(f"seven{k}" for k in range(60)), "en", "s0", 9)]
    bad = [(None, lost[0][1] + " idiot moron idiot scum", "en", "s0", 9), (None, "c d " * 100, "en", "s0", 9), (None, lost[1][1] + " end", "en", "s0", 9)]
    spark.createDataFrame([*marked, *lost, *bad], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], int(d[0] != 101), int(d[0] == 100)) for d in marked], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
    got = docs.collect()
    texts = [r.text for r in got]
    for row in (lost[0], lost[2], lost[3], lost[4], clean[7]):
        assert texts.count(row[1]) == 1, row
    assert texts.count(lost[1][1]) + texts.count(bad[2][1]) == 1 and not {bad[0][1], bad[1][1], marked[-1][1], marked[-2][1]} & set(texts)


def test_machine_learns_a_pair_without_single_signal():
    from veilspark.llm import toxicity

    random = np.random.default_rng(11)
    y = (random.random(10_000) < 0.113).astype("float64")
    both = (y == 1) & (random.random(len(y)) < 0.03)
    one, two = both | (random.random(len(y)) < 0.05), both | (random.random(len(y)) < 0.05)
    rows = [np.unique(np.concatenate([random.integers(100, 400, 6), [1] * int(a), [2] * int(b)])).astype("int64") for a, b in zip(one, two, strict=True)]
    known = toxicity.telling(rows, y, 512, 4096, 20.0)
    assert not {1, 2} & set(known.tolist())
    assert {1, 2} <= set(toxicity.paired(rows, y, 512, known).tolist())
    machine = toxicity.fit(rows, y, buckets=512)
    alone, pair = machine.score([np.array([1]), np.array([2])]), machine.score([np.array([1, 2])])
    assert machine.factor[1] @ machine.factor[2] > 0.05 and pair[0] > 0.5 > alone.max()
