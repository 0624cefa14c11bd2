import random
import re

from pyspark.sql import functions as F

from pathloom.llm import decontam


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}).encode())


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                got = wins.get(tuple(w[k : k + n]))
                if got:
                    hit |= set(range(k, k + n))
                    found |= got
        out.append((i, len(w), len(hit), tuple(sorted(found))))
    return sorted(out, key=str)


def tables():
    rng = random.Random(4)
    vocabulary = ["the", "of", "and", "Ähre", "x1", "don't", "a-b", "q", "Z", "it", "was"]
    text = lambda n: rng.choice([" ", "\n", ", "]).join(rng.choices(vocabulary, k=n))
    items = [(k, text(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for k in range(14)] + [(14, None), (15, ""), (16, "..."), (None, "q q q q"), (3, "the of the of the of the of the of the of")]
    docs = []
    for k in range(60):
        t = text(rng.choice([0, 3, 40, 200]))
        if rng.random() < 0.5:
            t += " " + (rng.choice(items)[1] or "").upper() + "; " + text(4)
        docs.append((k, t))
    return docs + [(60, None), (60, items[4][1]), (None, items[5][1])], items


def test_against_brute_force(spark):
    docs, items = tables()
    want = brute(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit("x")).withColumn("items", F.lit(1)).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 60):
        got = decontam.contaminated(df, bench, block_words=block, keep=("n", "text")).collect()
        assert sorted(((r.id, r.n_words, r.n_hit, tuple(r.items)) for r in got), key=str) == want
        for r in got:
            assert r.n == "x" and r.n_hit == sum(s.stop - s.start for s in r.spans)
    assert sum(1 for r in want if r[2]) > 20


def test_empty_tables(spark):
    docs, items = tables()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.contaminated(df.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontam.contaminated(df, bench.limit(0)).collect()} == {0}


def test_prefix_is_the_rarest_shingle():
    w = tuple(b"a b c d e f g h i j".split())
    index = decontam.prefix_index([w], {b"a b c": 9, b"b c d": 0, b"c d e": 5, b"d e f": 1, b"e f g": 2, b"f g h": 2, b"g h i": 2, b"h i j": 2})
    assert index == {b"b c d": [(1, w)]}
