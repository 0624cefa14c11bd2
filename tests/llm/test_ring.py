import random

import corpus_pipeline as pipeline
from pyspark.sql import functions as F

from test_simhash import slow_components

from pathloom.llm import ring


def slow_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def close(a, b):
    return 5 * len(a & b) >= 4 * len(a | b) if a or b else True


def texts():
    """Copies with 0 to 40 words changed, chains of changes, one often used passage, short texts."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    out = [None, "", "one", "One", "a b c d", "a b c d e", "a b c d e f"]
    for n in (6, 30, 45, 46, 90, 300, 800):
        for _ in range(4):
            base = rng.choices(vocabulary, k=n) + (passage if n < 100 else [])
            out += [" ".join(base), " ".join(base).upper()]
            for _ in range(8):
                v = base.copy()
                for _ in range(rng.randint(0, 1 + n // 20)):
                    v[rng.randrange(len(v))] = rng.choice(vocabulary)
                if rng.random() < 0.3:
                    v = v[: rng.randint(1, len(v))]
                out.append("  ".join(v))
                base = v if rng.random() < 0.3 else base
    return out


def test_against_all_pairs(spark, monkeypatch):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: slow_set(t) for i, t in rows}
    want = slow_components(list(sets), lambda a, b: close(sets[a], sets[b]))
    assert 40 < len(set(want.values())) < len(want) - 80
    for rounds, few, group in ((2, 6, 200), (0, 0, 2), (0, 10**9, 200)):  # with hubs; all by rare shingles, in small parts; all by pairs
        for name, value in (("ROUNDS", rounds), ("PAIR_ROWS", few), ("GROUP_ROWS", group)):
            monkeypatch.setattr(ring, name, value)
        got = {r.id: (r.component_id, r.is_kept) for r in ring.near_duplicates(df).collect()}
        assert got == {i: (want[i], want[i] == i) for i in sets}


def test_stage_keeps_one_of_each_group(spark):
    rows = list(enumerate(texts()))
    sets = {i: slow_set(t) for i, t in rows}
    want = slow_components(list(sets), lambda a, b: close(sets[a], sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(0)})
    assert {r.doc_id for r in pipeline.near_duplicates(spark, df, "").collect()} == set(want.values())


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "A b c d"), (None, None)], "doc_id long, text string")
    got = [(r.id, r.component_id, r.is_kept) for r in ring.near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(2, 2, True), (3, 2, False), (3, 2, False), (None, 2, False), (None, None, True)], key=str)
    assert ring.near_duplicates(df.limit(0)).count() == 0
