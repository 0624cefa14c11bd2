import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import grading


def test_gradients_lower_the_loss_and_cuts_are_ordered():
    rng = np.random.default_rng(3)
    truth = rng.normal(size=50)
    rows = [np.flatnonzero(rng.random(50) < 0.2).astype(np.int32) for _ in range(800)]
    s = np.array([truth[r].sum() for r in rows])
    y = np.digitize(s + rng.logistic(size=800) * 0.3, [-1.5, 0.0, 1.5])
    model = grading.Ordinal.fit(rows, y, buckets=64)
    assert (np.diff(model.cuts) > 0).all() and model.grades == [0, 1, 2, 3]
    score = np.array([model.weights[r].sum() for r in rows])
    assert np.corrcoef(score, s)[0, 1] > 0.95
    tails = model.tails(score)
    assert (np.diff(tails, axis=1) <= 0).all()
    assert np.mean((tails > 0.5).sum(1) == y) > 0.7


def test_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", grading.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    train, test = labels.where("doc_id % 3 != 0"), labels.where("doc_id % 3 = 0")
    out = grading.grade(docs, train).join(test, F.col("id") == F.col("doc_id")).select("grade", "kept", "expected_grade", "tail_probability").toPandas()
    kept = out.groupby("grade").kept.mean()
    assert kept[2] > 0.97 and kept[0] < 0.15 and kept[1] < 0.15
    assert out.groupby("grade").expected_grade.mean().is_monotonic_increasing


def test_few_ratings_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b"), (2, "")], "doc_id long, text string").withColumn("grade", F.lit(9))
    none = spark.createDataFrame([(1, None), (None, 2)], "doc_id long, grade int")
    assert [(r.tail_probability, r.kept) for r in grading.grade(df, none).collect()] == [(1.0, True)] * 4
    one = spark.createDataFrame([(1, 3)], "doc_id long, grade int")
    assert {r.expected_grade for r in grading.grade(df, one).collect()} == {3.0}
    two = spark.createDataFrame([(1, 0), (2, 1), (2, 5)], "doc_id long, grade int")
    assert grading.grade(df, two).count() == 4
    assert grading.grade(df.limit(0), none.limit(0)).count() == 0


def slow_loss(model, rows, y, weights, base, gaps):
    """Mean negative log likelihood with grades weighted alike, by the definition of the cumulative link."""
    cuts = [base]
    for g in gaps:
        cuts.append(cuts[-1] + math.exp(g))
    n = Counter(y)
    total = 0.0
    for x, g in zip(rows, y, strict=True):
        s = sum(weights[b] for b in x)
        up = 1.0 if g == len(cuts) else 1 / (1 + math.exp(s - cuts[g]))
        low = 0.0 if g == 0 else 1 / (1 + math.exp(s - cuts[g - 1]))
        total -= math.log(up - low) / (len(n) * n[g])
    return total


def test_fit_against_numeric_gradients():
    """A few steps of the fit, with every derivative taken by differences of the loss."""
    rng = np.random.default_rng(8)
    rows = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(40)]
    y = rng.integers(0, 4, 40)
    rounds, rate, l1, l2 = 6, 0.1, 5e-4, 1e-5
    got = grading.Ordinal.fit(rows, y, buckets=6, rounds=rounds)
    share = [k / 4 for k in (1, 2, 3)]
    logit = [math.log(p / (1 - p)) for p in share]
    p = [0.0] * 6 + [logit[0]] + [math.log(b - a) for a, b in zip(logit, logit[1:])]
    loss = lambda p: slow_loss(None, rows, y.tolist(), p[:6], p[6], p[7:])
    m, v = [0.0] * 9, [0.0] * 9
    for t in range(1, rounds + 1):
        grad = [(loss([q + (1e-5 if k == i else 0) for k, q in enumerate(p)]) - loss([q - (1e-5 if k == i else 0) for k, q in enumerate(p)])) / 2e-5 + (l2 * p[i] if i < 6 else 0) for i in range(9)]
        step = rate * (1 - 0.9 * t / rounds)
        for i, g in enumerate(grad):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            scale = math.sqrt(v[i] / (1 - 0.999**t)) + 1e-8
            p[i] -= step * m[i] / (1 - 0.9**t) / scale
            if i < 6:
                p[i] = math.copysign(max(0.0, abs(p[i]) - step * l1 / scale), p[i])
    cuts = np.cumsum([p[6], *(math.exp(g) for g in p[7:])])
    # the cuts' first derivatives are 0, where Adam magnifies the error of a difference
    assert np.allclose(got.weights, p[:6], atol=1e-3) and np.allclose(got.cuts, cuts, atol=1e-3)
    assert np.abs(got.weights).min() > 0.05


def test_grade_against_plain_python(spark):
    """The whole operator on a small table: which rows fit, which are held back, the threshold, and every row's numbers."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(9001, None), (9002, ""), (3, dict(docs.select("doc_id", "text").collect())[3])]
    ratings = [(i, i % 3) for i, _ in rows[:120]] + [(5, 2), (None, 1), (6, None), (77_777, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("grade", F.lit("x"))
    got = grading.grade(df, spark.createDataFrame(ratings, "doc_id long, grade int"))
    rated = {}
    for i, g in ratings:
        if i is not None and g is not None:
            rated[i] = min(g, rated.get(i, g))
    h = grading.Hasher()
    fit = sorted(((h(t.encode()), rated[i]) for i, t in dict(rows).items() if i in rated and t is not None), key=lambda r: (zlib.crc32(r[0].tobytes()), r[1]))
    back, front = fit[::5], [r for k, r in enumerate(fit) if k % 5]
    model = grading.Ordinal.fit([x for x, _ in front], np.array([g for _, g in front]))
    tail = lambda x, j: 1 / (1 + math.exp(model.cuts[j] - sum(model.weights[b] for b in x)))
    cut = min(0.5, float(np.quantile([tail(x, 1) for x, g in back if g == 2], grading.LOST_GOOD)))
    want = []
    for i, t in rows:
        x = h(t.encode() if t is not None else None)
        want.append((i, round(tail(x, 0) + tail(x, 1), 9), round(tail(x, 1), 9), tail(x, 1) >= cut))
    assert sorted((r.id, round(r.expected_grade, 9), round(r.tail_probability, 9), r.kept) for r in got.collect()) == sorted(want)


def test_rows_of_a_grade_are_those_that_hash_lowest(spark):
    """With more ratings than rows: the sample is the first by hash, whatever the grade's share."""
    ratings = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 0, 1).otherwise(0).alias("grade"))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"))
    all_rows = grading.grade(docs, ratings, rows=50)
    assert all_rows.count() == 30_000
    first = [r.doc_id for g in (0, 1) for r in ratings.where(F.col("grade") == g).orderBy(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)), "doc_id").limit(50).collect()]
    few = grading.grade(docs, ratings.where(F.col("doc_id").isin(first)), rows=50)
    assert all_rows.exceptAll(few).isEmpty()


def test_long_texts(spark):
    text = " ".join(f"word{i}" for i in range(400_000))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, text + " end")], "doc_id long, text string")
    assert grading.grade(df, spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, grade int")).count() == 3
