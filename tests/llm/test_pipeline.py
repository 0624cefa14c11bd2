"""run() against plain Python, stage by stage on the stage's own input."""

from collections import Counter

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from test_decontam import brute as brute_decontam
from test_langid import slow_predict, slow_profile
from test_mixing import count
from test_ring import close, slow_set
from test_secrets import brute as brute_secrets
from test_simhash import slow_components

from pathloom.llm import langid


def redacted(text):
    spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in brute_secrets(text)))
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def expected(rows, items):
    """rows: (doc_id, text, lang, source, n_chars). Returns a Counter of (row, copy)."""
    langs = {r[2] for r in rows if r[2] is not None and r[1] is not None}
    profiles = {g: slow_profile([r[1] for r in rows if r[2] == g and r[1] is not None], langid.PROFILE) for g in langs}
    kept = [r for r in rows if (p := slow_predict(r[1], profiles, langid.PROFILE))[0] != "und" and p[1] >= pipeline.LEAST_LANGUAGE_SCORE]
    sets = {r[0]: slow_set(r[1]) for r in kept}
    least = slow_components(list(sets), lambda a, b: close(sets[a], sets[b]))
    kept = [r for r in kept if least[r[0]] == r[0]]
    clean = {i for i, _, hit, _ in brute_decontam([(r[0], r[1]) for r in kept], items) if not hit}
    kept = [r for r in kept if r[0] in clean]
    kept = [(i, t, *r[2:4], len(t) if t != r[1] else r[4]) for r in kept for i, t in [(r[0], redacted(r[1]))]]
    n = Counter(r[3] for r in kept)
    w = {s: pipeline.WEIGHTS.get(s, pipeline.REST) for s in n}
    rate = {s: w[s] / sum(w.values()) * len(kept) / n[s] for s in n}
    return Counter((*r, k + 1) for r in kept for k in range(count(r[0], rate[r[3]], 42)))


def test_run_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) < 4000").orderBy(F.xxhash64("doc_id")).limit(250)
    extra = spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "", None, None, None), (10**6 + 2, "12345 !!", "de", "src1", 8)], docs.schema)
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    item = bench.first().text
    extra = extra.unionAll(spark.createDataFrame([(10**6 + 3, f"The and of that. {item} And the of.", "en", None, 5), (10**6 + 4, "the and of token = 'abcdefgh1' with that", "en", None, 5)], docs.schema))
    path = f"file://{tmp_path}"
    docs.unionAll(extra).withColumn("copy", F.lit(0)).write.parquet(f"{path}/documents.parquet")
    bench.write.parquet(f"{path}/benchmark.parquet")
    rows = [tuple(r) for r in docs.unionAll(extra).collect()]
    got = Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.copy) for r in pipeline.run(spark, path).collect())
    assert got == expected(rows, [tuple(r) for r in bench.collect()])
    assert not {r[0] for r in got} & {10**6, 10**6 + 1, 10**6 + 2, 10**6 + 3}


def test_stages_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("fp", F.lit(1))
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == pipeline.COLUMNS


def test_empty_documents(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
