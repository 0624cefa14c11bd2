import hashlib
import random
import re

from pyspark.sql import functions as F

from pathloom.llm import secrets

PATTERNS = {
    "assign": (re.compile(r"""(?:(?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    # the rule's own pattern in another engine; what it takes is in test_secrets_pem.py
    "pem": (re.compile(secrets.RULES[3].pattern, re.ASCII), lambda m: True),
}


def brute(text):
    found = [(m.start(), n, m.end(), k) for n, (k, (p, good)) in enumerate(PATTERNS.items()) for m in p.finditer(text or "") if good(m)]
    return [f"{k}:{s}:{e}" for s, _, e, k in sorted(found)]


TEXTS = [
    None, "", "nothing here", 'token = "abcdef"', "token=abc token: abcdef", "token=token: abcdefgh", "PassWord='x+y/z_9.=-'", "api_key:secret=longenough", "apikey==abcdefg",
    "éé \U0001f600 secret : hunter22 \x01\x02\x03 token=\x01abcdefgh", "AKIA" + "Q7" * 8, "AKIA" + "Q7" * 7 + "Q", "xAKIAAKIA" + "Z" * 15, "a" * 23, "a" * 24 + "g" + "0" * 40,
    "secret=" + "0123456789abcdef" * 3, "-----BEGIN RSA PRIVATE KEY-----\nabc", "toKen=abcdefgh ſecret=abcdefgh", "passwd  =  'short' passwd = longer1 password=abcdef.password=abcdef", "$1 \\ token=$1abcdef token=a\\bcdefgh",
]


def test_against_plain_regular_expressions(spark):
    rng = random.Random(3)
    pieces = [t for t in TEXTS if t] + ["token", "=", " ", '"', "AKIA", "0a" * 13, "\n", "secret:"]
    texts = TEXTS + ["".join(rng.choices(pieces, k=rng.randint(1, 9))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("blob", F.lit(1))
    ledger = secrets.scan(df.drop("blob"))
    got = secrets.findings(df.drop("blob"), ledger, ["doc_id"]).select("doc_id", secrets.shown(F.col("found")).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: ",".join(brute(t)) for i, t in enumerate(texts)}


def test_ledger_scans_only_what_it_lacks(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    one = spark.createDataFrame([("a", 1, "token=abcdefgh"), ("b", 1, "token=abcdefgh"), ("a", 2, "token=zzzzzzzz")], "path string, version int, text string")
    two = one.unionAll(spark.createDataFrame([("c", 1, "token=zzzzzzzz"), ("c", 2, "new secret=abcdefgh"), ("d", 1, None)], one.schema))
    n = len(secrets.RULES)
    assert secrets.update(one, path).count() == 2 * n
    known = spark.read.parquet(path)
    assert {r.blob for r in secrets.scan(two, ledger=known).collect()} == {hashlib.sha256(t.encode()).hexdigest() for t in ("new secret=abcdefgh", "")}
    assert secrets.update(two, path).count() == 4 * n
    assert secrets.scan(two, ledger=spark.read.parquet(path)).count() == 0
    newer = (*secrets.RULES[:-1], secrets.Rule("pem", r"()(secret)", 1, version=2))
    rows = secrets.scan(two, ledger=spark.read.parquet(path), rules=newer).collect()
    assert len(rows) == 4 and {(r.rule, r.version) for r in rows} == {("pem", 2)}
    ledger = secrets.update(two, path, rules=newer)
    found = {(r.path, r.version): [s.kind for s in r.found] for r in secrets.findings(two, ledger, ["path", "version"], rules=newer).collect()}
    assert found == {("a", 1): ["assign"], ("b", 1): ["assign"], ("a", 2): ["assign"], ("c", 1): ["assign"], ("c", 2): ["assign", "pem"], ("d", 1): []}
    old = {(r.path, r.version): len(r.found) for r in secrets.findings(two, ledger, ["path", "version"]).collect()}
    assert old[("c", 2)] == 1


def test_redaction(spark):
    rows = [(1, "é token=abcdefgh and AKIA" + "Q" * 20 + "!"), (2, "secret=" + "0" * 40), (3, None), (4, "clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = secrets.findings(df, secrets.scan(df), ["doc_id"])
    got = {r.doc_id: r.t for r in df.join(found, "doc_id").select("doc_id", secrets.redacted(F.col("text"), F.col("found")).alias("t")).collect()}
    assert got == {1: "é [SECRET] and [SECRET]!", 2: "[SECRET]", 3: None, 4: "clean"}


def test_many_matches_long_texts_and_marks(spark):
    """Tens of thousands of matches in one text, characters beyond 16 bits and byte order marks, overlaps across rules."""
    rng = random.Random(5)
    pieces = ["\ufefftoken=abcdefgh ", "\U0001f600é ", "secret=" + "0a" * 14 + " ", "AKIA" + "Z" * 16 + "\ufeff", "plain words "]
    texts = ["".join(rng.choices(pieces, k=n)) for n in (255, 256, 257, 700, 40_000)] + ["\ufeff", "\ufefftoken=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = secrets.findings(df, secrets.scan(df), ["doc_id", "text"]).select("doc_id", secrets.shown(F.col("found")).alias("s"), secrets.redacted(F.col("text"), F.col("found")).alias("t")).collect()
    for r in found:
        assert r.s == ",".join(brute(texts[r.doc_id]))
        want, at = "", 0
        for a, b in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in r.s.split(",") if x):
            want, at = (want + texts[r.doc_id][at:a] + "[SECRET]" if a >= at else want), max(at, b)
        assert r.t == want + texts[r.doc_id][at:]


def test_path_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "b", "token=abcdefgh", 7)], "found long, blob string, text string, spans long")
    (r,) = secrets.findings(df, secrets.scan(df), ["found", "blob", "spans"]).collect()
    assert (r.found, r.blob, r.spans) == (1, "b", 7)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    ledger = secrets.scan(df)
    assert ledger.count() == 0 and secrets.findings(df, ledger, ["doc_id"]).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = secrets.findings(df, secrets.scan(df), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
