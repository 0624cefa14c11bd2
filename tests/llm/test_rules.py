import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)]


def texts():
    rng = random.Random(2)
    out = [None, "", " \n\t", "a", "é ü x\x1cy", "# a\n# a\n\n\n # a", "a b c d e a b c d e", "a a a a a a", "1 2 3 4 5 6\n1 2 3 4 5 6\n", "😀 <b>|&"]
    for _ in range(40):
        w = rng.choices(["a", "b", "ccc", "#", "é"], k=rng.randint(1, 60))
        out.append("".join(x + rng.choice([" ", "\n", "  "]) for x in w))
    return out


def test_counts_against_brute_force(spark, monkeypatch):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: [r[c] for c in rules.COUNTS] for r in rules.statistics(df).collect()}
    assert got == {i: brute(t) for i, t in rows}
    monkeypatch.setattr(rules, "_LONG", 2)
    for _, t in rows:
        assert rules.measure(None if t is None else t.encode())[0] == brute(t)


def test_forest_isolates_outliers():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(2000, 4))
    odd = rng.normal(size=(20, 4)) + 8
    forest = rules.Forest(rows)
    assert forest.score(odd).min() > np.quantile(forest.score(rows), 0.99)
    one = rules.Forest(np.zeros((5, 3)))
    assert np.isfinite(one.score(np.ones((2, 3)))).all()


def path_length(tree, x):
    feature, cut, children, length = tree
    at = 0
    while feature[at] >= 0:
        at = children[at][int(x[feature[at]] >= cut[at])]
    return length[at]


def test_scores_are_mean_path_lengths():
    rows = np.random.default_rng(1).normal(size=(300, 3))
    forest = rules.Forest(rows, trees=7)
    for x, s in zip(rows[:20], forest.score(rows[:20])):
        mean = np.mean([path_length(t, x) for t in forest.trees])
        assert s == pytest.approx(2 ** -(mean / rules._expected(256)))


def test_verdicts_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = {r.id: r for r in rules.judge(docs, labels).collect()}
    assert len(out) == docs.count()
    good = [out[r.doc_id].kept or out[r.doc_id].base_failed for r in labels.where("quality = 1").collect()]
    bad = [out[r.doc_id].kept for r in labels.where("quality = 0").collect()]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2
    assert all(not (r.base_failed and r.kept) for r in out.values())
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in out.values())


def test_no_labels_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j k"), (None, None), (2, "a"), (1, "a b c d e f g h i j k")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, quality int")
    got = sorted(((r.id, r.base_failed, r.kept) for r in rules.judge(df, labels).collect()), key=str)
    assert got == [(1, False, True), (1, False, True), (2, True, False), (None, True, False)]
    assert rules.judge(df.limit(0), labels.limit(0)).count() == 0


def test_all_labelled_rows_make_the_model(spark):
    """10,500 good rows, of which those with the highest hashes are of another kind, and 10,500 bad ones: a cut of 10,000 by the hash knew nothing of that kind."""
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30))
    rows = spark.range(21_000).select(F.col("id").alias("doc_id")).withColumn("quality", (F.col("doc_id") % 2).cast("int")).withColumn("rare", (F.col("quality") == 1) & (h >= 0.953 * (1 << 30)))
    words = F.array_join(F.transform(F.sequence(F.lit(1), 12 + F.col("doc_id") % 5), lambda k: F.concat(F.lit("w"), (F.col("doc_id") * k).cast("string"))), " ")
    text = F.when(F.col("quality") == 0, F.concat(words, F.lit(" $$$$$$$$$$$$$$"))).when(F.col("rare"), F.concat(words, F.lit(" " + 30 * "#"))).otherwise(words)
    df = rows.withColumn("text", text).cache()
    assert 400 < df.where("rare").count() < 600
    out = rules.judge(df, df).join(df.select(F.col("doc_id").alias("id"), "quality", "rare"), "id")
    rate = {(r.quality, r.rare): r.kept for r in out.groupBy("quality", "rare").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1, True] > 0.8 and rate[1, False] > 0.99


def test_forest_of_parts_is_the_forest_of_the_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, len(rules.FEATURES))) ** 3
    h, label = rng.integers(0, 1 << 40, len(x)), (np.arange(len(x)) % 10 > 0).astype(int)
    seen = []

    def whole(forest):
        found = forest.summary([(h, label, x)])
        if forest.level == 0:
            seen.append((found[1].sum(), found[2].min(0), found[3].max(0), forest.copies))
        return found

    one = rules.Forest.of(2700, whole)
    counted, low, high, copies = seen[0]
    assert counted == 2700 * copies and (low == x.min(0)).all() and (high == x.max(0)).all()
    df = spark.createDataFrame([(int(a), int(b), r.tolist()) for a, b, r in zip(h, label, x)], "h long, label long, features array<double>").repartition(5)
    other = rules.Forest.of(2700, rules._look(df))
    assert all((a == b).all() for s, t in zip(one.trees, other.trees) for a, b in zip(s, t)) and len(one.trees) == len(other.trees) == rules.TREES
    assert (rules._scores(df, other).sum(1) == [300, 2700]).all()


def test_threshold_against_all_cuts():
    rng = np.random.default_rng(4)
    for n_good, n_bad, lost in ((0, 3, 0.1), (1, 0, 0.1), (50, 0, 0.1), (50, 20, 0.1), (400, 30, 0.01), (400, 30, 0.0)):
        good, bad = rng.beta(4, 8, n_good), rng.beta(6, 6, n_bad)
        cut = rules.threshold(*(np.bincount(rules.steps(x), minlength=rules.STEPS + 1) for x in (good, bad)), lost)
        if not n_good:
            assert cut == float("inf")
            continue
        worth = lambda c: (bad > c).mean() - (good > c).mean() if n_bad else 0.0
        cuts = [k / rules.STEPS for k in range(0, rules.STEPS + 1, 7)]
        assert (good > cut).mean() <= lost and worth(cut) >= max(worth(c) for c in cuts if (good > c).mean() <= lost) - 1e-9
        assert n_bad or not (good > cut).any()


def test_rows_are_judged_by_trees_of_others():
    rng = np.random.default_rng(5)
    x, h = rng.normal(size=(2000, 3)), rng.integers(0, 1 << 40, 2000)
    forest = rules.Forest.of(len(x), lambda f: f.summary([(h, np.ones(len(x), np.int64), x)]))
    assert forest.copies == 13 and len(forest.trees) == 100
    for k, s in zip(range(20), forest.score(x, h)):
        lengths = [path_length(t, x[k]) for i, t in enumerate(forest.trees) if (i - h[k]) % 100 >= 13]
        assert len(lengths) == 87 and s == pytest.approx(2 ** -(np.mean(lengths) / rules._expected(256)))
    same = rules.Forest.of(len(x), lambda f: f.summary([(0 * h, np.ones(len(x), np.int64), x)]))
    assert len(same.trees) == 13 and (same.score(x, 0 * h) == same.score(x)).all()
