"""Sources that are small beside the table: means beyond one table of the distribution."""

import math
from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from test_mixing import count

from pathloom.llm import mixing, queries


def test_one_row_of_a_small_source(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 100)
    sources = ["src0"] * 10_000 + ["src1"] * 3000 + [None]
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, "t", "en", s, 1) for i, s in enumerate(sources)], columns)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    mean = 1 / 7 * len(sources)
    for out in (queries.op4_mixing(spark, f"file://{tmp_path}"), pipeline.mixture(spark, docs, "")):
        got = Counter(r.doc_id for r in out.where("source is null").select("doc_id").collect())
        assert list(got) == [13_000] and abs(got[13_000] - mean) < 6 * math.sqrt(mean)
        assert out.where("source is null").agg(F.min("copy"), F.max("copy"), F.countDistinct("copy")).first() == (1, got[13_000], got[13_000])


def test_one_table_up_to_700(spark):
    df = spark.createDataFrame([(i, "x" if i else "y") for i in range(650)], "doc_id long, source string")
    got = Counter(r.doc_id for r in mixing.mix(df, {"y": 1.0}, seed=1, most_rate=math.inf).collect())
    assert got == {0: count(0, 650.0, 1)}


def test_sums_of_draws_have_the_mean_and_variance(spark):
    df = spark.createDataFrame([(i, "y" if i < 400 else "x") for i in range(400 * 800)], "doc_id long, source string")
    got = list(Counter(r.doc_id for r in mixing.mix(df, {"y": 1.0}, most_rate=math.inf).select("doc_id").collect()).values())
    mean = sum(got) / 400
    variance = sum((x - mean) ** 2 for x in got) / 399
    assert len(got) == 400 and abs(mean - 800) < 4 * math.sqrt(800 / 400) and 0.7 < variance / 800 < 1.35
