import random
import re

import xxhash
from pyspark.sql import functions as F

from pathloom.llm import simhash
from pathloom.llm.components import components


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}).encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def texts():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 3, 40, 300]))) for _ in range(30)]
    out = [None, "", " \t\n", "One", "one TWO", "Straße É x", "a b c d", "\x1c x y"]
    for b in base:
        out += [b, b, b.upper()]
        w = b.split()
        for _ in range(4):
            v = w.copy()
            v[rng.randrange(len(v))] = rng.choice(vocabulary)
            out.append("  ".join(v))
    return out


def test_against_brute_force(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("id", F.lit("x"))
    fps = {i: slow_fingerprint(t) for i, t in rows}
    want = slow_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    for limit in (200, 1):  # pairs, and the star form
        got = {r.id: (r.fp % 2**64, r.component_id, r.is_kept) for r in simhash.near_duplicates(df, bucket_rows=limit).collect()}
        assert got == {i: (fps[i], want[i], want[i] == i) for i in fps}
    assert len(set(want.values())) < len(want) - 60


def test_links_keep_the_components_of_all_close_pairs(spark):
    rng = random.Random(1)
    near = [0]
    for _ in range(300):
        near.append(rng.choice(near) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    near = sorted({x - 2**64 if x >= 2**63 else x for x in near + [rng.getrandbits(64) for _ in range(20)]})
    df = spark.createDataFrame([(x,) for x in near], "fp long")
    for bits in (0, 1, 2):
        want = slow_components(near, lambda a, b: ((a ^ b) % 2**64).bit_count() <= bits)
        for limit in (10**6, 5):
            got = dict.fromkeys(near) | {x: x for x in near}
            got |= {r.node: r.root for r in components(simhash.links(df, bits, limit)).collect()}
            assert got == want, (bits, limit)


def test_nulls_ties_and_empty_tables(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (2, "A b c d"), (None, None)], "doc_id long, text string")
    got = sorted(simhash.near_duplicates(df).collect(), key=str)
    assert [(r.id, r.component_id) for r in got if r.fp] == [(2, 2), (3, 2), (3, 2), (None, 2)]
    assert [(r.id, r.component_id, r.is_kept) for r in got if not r.fp] == [(None, None, True)]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_bucket_of_very_long_text():
    text = ("alpha beta gamma delta " * 40000).encode()
    assert simhash.fingerprint(text) == slow_fingerprint(text.decode())


def test_deduplicated_rows(spark):
    rows = [(1, "a b c d e"), (2, "A b c d e"), (2, "other words in here now"), (3, "x"), (3, "x"), (None, "x"), (None, "lone words of null id"), (None, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_hash", F.lit("kept"))
    got = sorted(((r.doc_id, r.text) for r in simhash.deduplicated(df.drop("_hash")).collect()), key=str)
    assert got == sorted([(1, "a b c d e"), (2, "other words in here now"), (3, "x"), (None, "lone words of null id"), (4, None)], key=str)
