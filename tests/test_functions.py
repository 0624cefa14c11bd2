import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pathloom.errors import InvalidRequest
from pathloom.functions import text as T
from pathloom.functions import values as V
from pathloom.sources import generator

NAMES = ["ΟΔΟΣ.txt", ".gitignore", "a.", "no_ext", "İ.txt", "ＡＢＣ.txt", "Cafe\u0301.TXT", "über-Größe_2.tar.GZ", "東京 資料", "a\\b//c", "", "x", "٣४.a", "ﬁle ½", "e\u0301\u0308x", "\U0001f600 a", None]


def slow_tokens(text):
    out, now = [], ""
    for c in text + "\n":
        # letters, letter numbers, and the other alphabetic characters that the data has
        if c.isalpha() or unicodedata.category(c)[0] == "N":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def test_text_kernel(spark):
    df = spark.createDataFrame(list(enumerate(NAMES)), "i long, name string").withColumn("n", T.normalize(F.col("name")))
    got = df.select("name", "n", T.fold_separators(F.col("name")).alias("f"), T.tokens(F.col("n")).alias("t"), T.prefixes(F.col("n"), 3).alias("p"), T.grams(F.col("n")).alias("g"), T.extension(F.col("name")).alias("e"), T.hex_term(F.col("n")).alias("h")).collect()
    for r in got:
        if r.name is None:
            assert r.n is None and r.e is None
            continue
        n = "".join(c.lower() for c in unicodedata.normalize("NFKC", r.name))
        assert r.n == n == T.normalize_text(r.name)
        assert r.f == T.fold_separators_text(r.name)
        assert r.t == slow_tokens(n) == T.tokens_of(n), r.name
        assert r.p == [n[:k] for k in range(1, min(3, len(n)) + 1)]
        assert r.g == [n[k : k + 3] for k in range(len(n) - 2)] == T.grams_of(n)
        assert r.h == n.encode().hex()
        tail = r.name.rpartition(".")[2].lower() if "." in r.name else ""
        assert r.e == (tail or None)
    assert T.normalize_text("ΟΔΟΣ") == "οδοσ"


def test_parent_path(spark):
    rows = [("C:\\a\\b.txt", "C:\\a"), ("/ab/c", "/ab"), ("/a/b", None), ("ab/c", None), ("abc/d", "abc"), ("none", None)]
    got = spark.createDataFrame(rows, "p string, want string").select(T.parent_path(F.col("p")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_content_line(spark):
    df = spark.createDataFrame([("The CAT, a-b " + "x" * 40 + " end",)], "t string")
    assert df.select(T.content_line(F.col("t"))).first()[0] == " the cat a b \x00 end "


def test_ids(spark):
    raw = bytes(range(16))
    df = spark.createDataFrame([(f"volume:{raw.hex().upper()}",), ("link:" + "0" * 32,), ("volume:0",), ("volume:" + "g" * 32,)], "t string")
    got = [r[0] for r in df.select(V.parse_id("volume", F.col("t"))).collect()]
    assert [g.error for g in got] == [None, "prefix", "length", "digit"] and bytes(got[0].value) == raw
    assert spark.createDataFrame([(raw,)], "b binary").select(V.format_id("document", F.col("b"))).first()[0] == f"document:{raw.hex()}"
    assert V.parse_id_text("volume", f"volume:{raw.hex()}") == raw
    for bad, error in (("x", "prefix"), ("volume:1", "length"), ("volume:" + "z" * 32, "digit")):
        with pytest.raises(InvalidRequest) as e:
            V.parse_id_text("volume", bad)
        assert e.value.details["error"] == error


def test_hashes(spark):
    assert V.stable_hash(b"") == V.FNV_OFFSET
    assert V.stable_hash(b"a") == 0xD228CB696F1A8CAF78912B704E4A8964
    df = spark.createDataFrame([(b"v" * 16, b"f" * 16, "n"), (None, None, "n")], "v binary, f binary, n string")
    got = [bytes(r[0]) for r in df.select(V.link_id(F.col("v"), F.col("f"), F.col("n"))).collect()]
    assert got == [V.link_id_of(b"v" * 16, b"f" * 16, "n"), V.link_id_of(None, None, "n")]
    assert V.root_link_id_of(V.root_link_id_of(b"q" * 16)) == b"q" * 16
    assert V.scoped_volume_id_of(b"v" * 16, "/A") == V.scoped_volume_id_of(b"v" * 16, "/a")


def test_numbers(spark):
    df = spark.createDataFrame([(116444736000000000 + 15_000_000, 3, 7, 1_000_001)], "ft long, a long, b long, ns long")
    r = df.select(V.filetime_ms(F.col("ft")), V.filetime_ms(F.lit(5)), V.basis_points(F.col("a"), F.col("b")), V.basis_points(F.col("b"), F.col("a")), V.basis_points(F.col("a"), F.lit(0).cast("long")), V.ceil_millis(F.col("ns")), V.add_saturating(F.lit((1 << 63) - 1), F.col("a")), V.subtract_saturating(F.col("a"), F.col("b")), V.generation_name(F.col("a")), V.disk_reserve(F.lit(1000).cast("long"), 50, 10)).first()
    assert list(r) == [1500, None, 4285, 10000, None, 2, (1 << 63) - 1, 0, "generation-" + "0" * 19 + "3", 100]
    assert V.ceil_millis_of(1) == 1 and V.generation_name_of(3) == r[8]
    big = spark.createDataFrame([(-1,), (-1,), (5,)], "v long")
    assert big.select(V.wrapped_sum(F.col("v")).alias("s")).first().s == 3


def scalar_record(ordinal, seed):
    """One record at a time, in plain integers."""
    mask = (1 << 64) - 1

    def mix(z):
        z = z + 0x9E3779B97F4A7C15 & mask
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        return z ^ z >> 31

    state = seed ^ ordinal * 0x9E3779B97F4A7C15 & mask

    def draw():
        nonlocal state
        state = mix(state)
        return state

    G = generator
    pool = G.UNICODE_STEMS if ordinal % 29 == 0 else G.ASCII_STEMS
    stem, second = pool[draw() % len(pool)], G.ASCII_STEMS[draw() % 20]
    d = draw() % 10_000
    e = G.EXTENSIONS[min(d * d // 10_000 * 20 // 10_000, 19)]
    name = f"{stem}_{second}_{ordinal:08d}.{e}" if ordinal % 11 == 0 else f"{stem}-{ordinal:08d}.{e}" if ordinal % 7 == 0 else f"{stem}_{ordinal % 10_000:04d}.{e}"
    path = "/catalog"
    for _ in range(2 + draw() % 6):
        path += "/" + G.DIRECTORIES[draw() % 20]
    return ordinal, name, f"{path}/{name}", e, 128 + draw() % (8 << 30), 1_577_836_800_000 + draw() % 220_752_000_000


def test_generator_against_one_at_a_time(spark):
    got = [tuple(r) for r in generator.catalog(spark, 400, 20260814).orderBy("ordinal").collect()]
    assert got == [scalar_record(i, 20260814) for i in range(400)]
    assert [tuple(r) for r in generator.catalog(spark, 5, 20260814, start=100).collect()] == got[100:105]
    assert (V.mix64(np.array([0, 1], np.uint64)) != 0).all()
    assert spark.createDataFrame([(0,)], "v long").select(V.splitmix64(F.col("v"))).first()[0] % (1 << 64) == 0xE220A8397B1DCDAF


def test_query_workload(spark):
    rows = generator.retrieval_queries(spark, 1000, 5, 3).orderBy("place").toPandas()
    assert list(rows.kind) == ["exact", "token", "prefix"] * 5
    for k in range(0, 15, 3):
        name = scalar_record(int(rows.expected_ordinal[k]), 3)[1]
        stem = pd.Series([name]).str.split(r"[_.-]", regex=True)[0][0]
        assert list(rows.text[k : k + 3]) == [name, stem, stem[:4]]
    assert generator.retrieval_queries(spark, 0, 5, 3).count() == 0
