import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pathloom.llm import suffixes


def brute(rows, least=100):
    """{id: (n_bytes, n_removed, n_spans, kept)} with rows in the order of ids."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - least + 1):
            s = b[p : p + least]
            if s in seen:
                gone[p : p + least] = b"\1" * least
            seen.add(s)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone) if not g))
    return out


def corpus(seed):
    rng = random.Random(seed)

    def text(n):
        return " ".join("".join(rng.choices("abcdeéñ", k=rng.randint(1, 8))) for _ in range(n))

    passages = [text(rng.randint(15, 80)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "x" * 99), (4, "x" * 100), (5, "x" * 350), (6, "ab" * 120), (7, "ab" * 121)]
    for i in range(8, 90):
        t = text(rng.choice([5, 30, 100]))
        for _ in range(rng.randint(0, 3)):
            p, k = rng.choice(passages), rng.randint(0, len(t))
            c = rng.randint(0, len(p) // 3)
            t = t[:k] + p[c : rng.randint(c, len(p))] + t[k:]
        if rng.random() < 0.3:
            t = rng.choice(rows)[1] or t
        if rng.random() < 0.3:
            k = rng.randint(0, len(t))
            t = t[:k] + "#" + t[k:]
        rows.append((i, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limits", [(3000, 500), (3, 500), (3000, 0)])
def test_against_brute_force(spark, monkeypatch, limits):
    monkeypatch.setattr(suffixes, "GROUP_ROWS", limits[0])
    monkeypatch.setattr(suffixes, "TASK_ROWS", limits[1])
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("x")).repartition(5)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.deduplicated(df).collect()}
    assert got == brute(rows)
    assert sum(v[1] for v in got.values()) > 1000


def test_occurrences_stand_earlier(spark):
    rows = corpus(4)
    text = {i: (t or "").encode() for i, t in rows}
    found = suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert found
    for r in found:
        n = r.stop - r.start
        assert n >= 100 and (r.first_id, r.first_start) < (r.id, r.start)
        assert text[r.id][r.start : r.stop] == text[r.first_id][r.first_start : r.first_start + n]


def test_long_text_over_part_borders(spark):
    rng = random.Random(8)
    piece = "".join(rng.choices("abcdefgh ", k=70_000))
    rows = [(1, piece + "|" + piece[5000:66_000]), (2, "y" + piece[65_400:65_700])]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_nulls_repeated_rows_and_empty_tables(spark):
    t = "".join(random.Random(2).choices("abcdef ", k=300))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (7, None)], "doc_id long, text string")
    got = sorted(((r.id, r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.deduplicated(df).collect()), key=str)
    full, none = hashlib.sha256(t.encode()).hexdigest(), hashlib.sha256(b"").hexdigest()
    assert got == [(5, 300, 0, full), (5, 300, 0, full), (7, 0, 0, none), (None, 300, 300, none)]
    assert suffixes.deduplicated(df.limit(0)).count() == 0


def test_maximal_repeats_have_all_occurrences():
    rng = random.Random(6)
    core = bytes(rng.choices(b"abcdefgh", k=24))
    for _ in range(200):
        made = {(bytes(rng.choices(b"ab", k=rng.randint(0, 3))) * rng.randint(1, 30))[-76:] + core + b"|" + (bytes(rng.choices(b"xy", k=2)) * rng.randint(20, 38)) for _ in range(6)}
        contexts = [(c, c.index(core)) for c in made if len(c) >= 100]
        want, got = {}, {}
        for n, (c, a) in enumerate(contexts):
            for t in range(77):
                if a - t >= 0 and a - t + 100 <= len(c):
                    want.setdefault((t, c[a - t : a - t + 100]), set()).add(n)
        for left, right, members in suffixes.maximal_repeats(contexts):
            for t in range(100 - right, left + 1):
                c, a = contexts[members[0]]
                key = (t, c[a - t : a - t + 100])
                assert key not in got
                got[key] = set(members)
        assert got == {k: v for k, v in want.items() if len(v) > 1}
