"""Queries over whole tables."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veilspark.functions import normalcy

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_normalcy_queries_cover_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 0")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    queries = entry.queries()
    assert {r.doc_id for r in queries["normalcy_windows"](spark, SF).select("doc_id").collect()} == ids
    assert {r.doc_id for r in queries["review_gate"](spark, SF).select("doc_id").collect()} >= ids
    regions = queries["suspicious_merge"](spark, SF)
    assert regions.count() and {r.doc_id for r in regions.select("doc_id").collect()} <= ids


def test_windows_are_cut_by_code_points(spark):
    for text in ("", "a" * 40, "😀" * 85 + "the end\r\n", "\n" * 45 + "x"):
        got = spark.range(1).select(normalcy.windows(F.lit(text)).alias("w")).first().w
        assert [(w.start, w.end) for w in got] == [(k, min(k + 80, len(text))) for k in range(0, len(text), 40)]
