import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pathloom.llm import mixing


def count(key, rate, seed):
    u = int(hashlib.md5(f"{seed}:{key}".encode()).hexdigest()[:13], 16) / 2**52
    p = c = math.exp(-rate)
    k = 0
    while c <= u and k < rate + 12 * math.sqrt(rate) + 20:
        k += 1
        p = p * rate / k
        c += p
    return k


def test_counts_against_the_inverse_distribution(spark):
    rows = [(i, ["a", "b", "c", None][i % 4 if i % 3 else 0], f"t{i}") for i in range(3000)] + [(None, "a", "n"), (5, "a", "again"), (5, "a", "again")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    weights, rest = {"a": 1.0, "b": 3.0, "c": 0.0}, 0.5
    n = Counter(s for _, s, _ in rows)
    w = {s: weights.get(s, rest) if s else rest for s in n}
    rate = {s: w[s] / sum(w.values()) * len(rows) / n[s] for s in n}
    want = Counter()
    for i, s, t in rows:
        for k in range(count("" if i is None else i, rate[s], 9) if rate[s] else 0):
            want[(i, s, t, k + 1)] += 1
    out = mixing.mix(df, weights, seed=9, rest=rest)
    got = out.collect()
    assert Counter((r.doc_id, r.source, r.text, r.copy) for r in got) == want
    assert all(r.shuffle_key == hashlib.md5(f"9:{'' if r.doc_id is None else r.doc_id}:{r.copy}".encode()).hexdigest() for r in got)
    share = Counter(r.source for r in got)
    for s in n:
        assert abs(share[s] / len(got) - w[s] / sum(w.values())) < 0.03
    per_part = [[r.shuffle_key for r in p] for p in out.rdd.glom().collect()]
    assert all(p == sorted(p) for p in per_part)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_large_rates_and_the_shuffle_join(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    df = spark.createDataFrame([(i, "x" if i else "y") for i in range(200)], "doc_id long, source string")
    got = Counter(r.doc_id for r in mixing.mix(df, {"y": 0.9, "x": 0.1}, seed=1).collect())
    assert got[0] == count(0, 0.9 * 200, 1) > 100
    with pytest.raises(Exception, match="rate over the limit"):
        mixing.mix(df.unionAll(df.where("source = 'x'")).unionAll(df.where("source = 'x'")).unionAll(df.where("source = 'x'")), {"y": 1.0}, most_rate=500.0).collect()


def test_empty_tables_and_refusals(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    assert mixing.mix(df.limit(0), {"a": 1.0}).count() == 0
    assert mixing.mix(df, {}).count() == 0
    clash = df.withColumns({"copy": F.lit("x"), "shuffle_key": F.lit(0), "n": F.lit(7), "c": F.lit(8), "key": F.lit("k"), "row": F.lit(1)})
    out = mixing.mix(clash, {"a": 1.0}, seed=1)
    assert out.columns == ["doc_id", "source", "n", "c", "key", "row", "copy", "shuffle_key"]
    assert all(r.n == 7 and r.c == 8 and r.key == "k" and isinstance(r.copy, int) for r in out.collect())
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": -1.0})
