"""Rows that share an id, null or not, and differ in their texts."""

import random

from pyspark.sql import functions as F

from pathloom.llm import suffixes


def words(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))


PASSAGE = words(0, 150)
ROWS = [
    (1, words(1, 50) + PASSAGE),
    (None, words(2, 100) + PASSAGE + words(3, 30)),
    (None, words(4, 120)),
    (None, words(5, 400)),
    (7, words(6, 130) + PASSAGE),
    (7, words(7, 110)),
    (7, words(8, 500)),
    (7, words(8, 500)),
]


def test_spans_stay_with_their_own_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = sorted((str(r.id), bytes(r.kept).decode()) for r in suffixes.deduplicated(df).collect())
    want = sorted((str(i), t if i == 1 else t.replace(PASSAGE, "")) for i, t in ROWS)
    assert got == want


def test_places_have_the_ids_of_the_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    covered = set()
    for i, start, stop, first, at in (tuple(r) for r in suffixes.repeats(df).collect()):
        assert first == 1 and ROWS[0][1][at : at + stop - start] == PASSAGE[at - 50 : at - 50 + stop - start]
        covered |= {(i, k) for k in range(start, stop)}
    assert covered == {(7, k) for k in range(130, 280)} | {(suffixes._LAST, k) for k in range(100, 250)}


def test_several_null_ids_keep_one_of_a_repeat(spark):
    df = spark.createDataFrame([(None, words(k, 60 + k) + PASSAGE) for k in range(10, 14)], "doc_id long, text string").withColumn("key", F.lit(0))
    got = [bytes(r.kept).decode() for r in suffixes.deduplicated(df).collect()]
    assert sum(t.endswith(PASSAGE) for t in got) == 1 and len(got) == 4
