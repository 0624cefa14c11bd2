import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pathloom.llm import langid


def grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split(" ")
    out = Counter()
    for w in filter(None, words):
        p = f" {w} "
        out.update(w)
        out.update(p[i : i + n] for n in (2, 3) for i in range(len(p) - n + 1))
    return out


def key(gram):
    codes = [0 if c == " " else ord(c) for c in gram]
    k = 0
    for c in codes:
        k = k << 21 | c
    return k | {1: 3 << 62, 2: 1 << 63, 3: 0}[len(gram)]


def slow_profile(texts, size):
    total = sum((grams(t) for t in texts), Counter())
    order = sorted(total, key=lambda g: (-total[g], np.uint64(key(g)).view(np.int64)))
    return {g: r for r, g in enumerate(order[:size])}


def slow_predict(text, profiles, size):
    n = grams(text or "")
    if not n:
        return "und", 0.0
    rank = {g: sum(m > n[g] for m in n.values()) for g in n}
    rank = {g: r for g, r in rank.items() if r < size}
    far = {lang: sum(abs(p[g] - r) if g in p else size for g, r in rank.items()) for lang, p in profiles.items()}
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (size * len(rank))


TEXTS = ["The cat and the dog, then.", "Der Hund und die Katze! Straße", "a", "É", "x2y _z", "ＡＢ İx 漢字 𠀀", "the the  the\nother", "der die das und", " "]


def test_grams_and_keys():
    for t in TEXTS:
        want = Counter({key(g): n for g, n in grams(t).items()})
        assert Counter(langid.keys_of(t).tolist()) == want


def test_against_plain_python(spark):
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(TEXTS * 3)] + [(98, None, "en"), (99, "", "fr"), (None, "the", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = {lang: slow_profile([t or "" for _, t, g in rows if g == lang], 30) for lang in ("en", "de")}
    learned = langid.learn(df, size=30)
    got = {lang: {} for lang in profiles}
    for r in learned.collect():
        got[r.lang][r.gram % 2**64] = r.rank
    assert got == {lang: {key(g): r for g, r in p.items()} for lang, p in profiles.items()}
    found = langid.identify(df, learned, size=30, keep=("lang", "text")).collect()
    assert Counter((r.id, r.text, r.lang) for r in found) == Counter(rows)
    want = {i: slow_predict(t, profiles, 30) for i, t, _ in rows}
    assert all(r.lang_pred == want[r.id][0] and abs(r.score - want[r.id][1]) < 1e-9 for r in found)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.learn(docs.where(~langid.held_out())), keep=("lang",)).where(langid.held_out("id")).collect()
    assert len(out) > 100 and all(zlib.crc32(str(r.id).encode()) % 5 == 0 for r in out)
    assert sum(r.lang_pred == r.lang for r in out) >= 0.98 * len(out)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "abc", "en")], "doc_id long, text string, lang string").withColumn("id", F.lit(1))
    assert langid.identify(df.limit(0), langid.learn(df)).count() == 0
    assert [tuple(r) for r in langid.identify(df, langid.learn(df.limit(0))).collect()] == [(1, "und", 0.0)]
