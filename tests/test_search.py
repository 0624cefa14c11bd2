import random

import pytest
from pyspark.sql import functions as F

from pathloom.errors import InvalidRequest, QuerySyntax
from pathloom.functions import text as T
from pathloom.operators import content, evaluate
from pathloom.plans import content_query as Q
from pathloom.plans import search as S
from pathloom.plans import strategies as R

DOCUMENTS = "document_id long, name string, resolved_path string, extension string, kind string, size long"


def catalog(n=300, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "ΟΔΟΣ", "re", "port", "wi", "x1", "alphabet", "Ünder"]
    rows = []
    for i in range(n):
        name = rng.choice(["-", "_", " ", "."]).join(rng.choices(words, k=rng.randint(1, 3))) + rng.choice(["", ".txt", ".MD"])
        path = "/" + "/".join(rng.choices(words, k=rng.randint(0, 3)) + [name])
        rows.append((i, name, path, name.rpartition(".")[2].lower() if name.endswith((".txt", ".MD")) else None, rng.choice(["file", "directory", "symlink"]), rng.randint(0, 100)))
    return rows


def slow_search(rows, r: S.SearchRequest):
    q = T.normalize_text(r.query)
    out = []
    for i, name, path, ext, kind, size in rows:
        n, p = T.normalize_text(name), T.normalize_text(path)
        nt, pt = T.tokens_of(n), T.tokens_of(p)
        found = {"exact": n == q, "token": q in nt, "prefix": len(q) <= 32 and any(t.startswith(q) for t in nt), "path": q in pt, "substring": len(q) >= 3 and q in n}
        if not any(found[m] for m in r.modes):
            continue
        if r.scope == "files" and kind == "directory" or r.scope == "folders" and kind != "directory":
            continue
        if r.extensions and (ext is None or T.normalize_text(ext) not in map(T.normalize_text, r.extensions)):
            continue
        if r.directory_prefix is not None and not p.startswith(T.normalize_text(r.directory_prefix)):
            continue
        if r.minimum_size is not None and size < r.minimum_size or r.maximum_size is not None and size > r.maximum_size:
            continue
        c = 0 if n == q else 1 if n.startswith(q) else 2 if q in nt else 3 if len(q) >= 3 and q in n else 4 if q in p else None
        if c is not None:
            out.append((c, n.encode(), p.encode(), i))
    return [(i, c) for c, _, _, i in sorted(out)[: r.top_k]]


@pytest.fixture(scope="module")
def docs(spark):
    return S.with_search_columns(spark.createDataFrame(catalog(), DOCUMENTS)).cache()


def test_search_against_brute_force(docs):
    rows = catalog()
    for q in ["alpha", "ALPHA.txt", "beta", "wi", "re", "eta-", "οδοσ", "x", "gamma port", "under", "lph", "a" * 40, "_", ".md"]:
        for more in ({}, {"scope": "files", "top_k": 100}, {"scope": "folders"}, {"extensions": ("TXT",)}, {"directory_prefix": "/AL", "top_k": 50}, {"minimum_size": 20, "maximum_size": 60}, {"modes": ("token", "path")}):
            r = S.SearchRequest(q, **more)
            got = S.search(docs, r).orderBy("rank").collect()
            assert [(h.document_id, h.match_class) for h in got] == slow_search(rows, r), (q, more)
            assert [h["rank"] for h in got] == list(range(1, len(got) + 1)) and all(h.ranking_version == 1 for h in got)


def test_many_queries_at_once(spark, docs):
    qs = ["alpha", "wi", "eta-", "οδοσ", "zzz", "lph", "x1", "gamma port", "re"]
    got = S.search_many(docs, S.query_frame(spark, qs), 7).orderBy("query_id", "rank").collect()
    for k, q in enumerate(qs):
        assert [(h.document_id, h.match_class) for h in got if h.query_id == k] == slow_search(catalog(), S.SearchRequest(q, top_k=7)), q


def test_short_query_is_found_by_prefix_and_classed_by_path(spark):
    df = S.with_search_columns(spark.createDataFrame([(1, "red widget", "/a/red widget", None, "file", 1)], DOCUMENTS))
    assert [h.match_type for h in S.search(df, S.SearchRequest("wi")).collect()] == ["path"]


def test_candidate_limit_is_deterministic(docs):
    few = S.search(docs, S.SearchRequest("alpha", candidate_limit=5, top_k=100)).collect()
    assert len(few) == 5


def test_requests_are_checked():
    for bad in ({"query": ""}, {"query": "x" * 1025}, {"query": "a", "top_k": 0}, {"query": "a", "top_k": 101}, {"query": "a", "extensions": ("e",) * 33}, {"query": "a", "scope": "x"}, {"query": "a", "modes": ("fuzzy",)}):
        with pytest.raises(InvalidRequest):
            S.SearchRequest(**bad).validate()
    assert S.tool_request("q", extensions=["..TXT", "txt", "md"]).extensions == ("md", "txt")
    for bad in ({"top_k": 51}, {"extensions": ["a.b"]}, {"extensions": ["x" * 33]}):
        with pytest.raises(InvalidRequest):
            S.tool_request("q", **bad)
    for bad in (("", 1), ("x" * 65, 1), ("x", 10_001)):
        with pytest.raises(InvalidRequest):
            S.validate_envelope(*bad)
    with pytest.raises(InvalidRequest):
        S.validate_ids([1, 1])


def test_lookup_keeps_the_order_of_ids(docs):
    assert [r.document_id for r in S.lookup(docs, [5, 1, 999, 3]).collect()] == [5, 1, 3]


def test_no_python_in_a_search_plan(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/d")
    plan = S.search(spark.read.parquet(f"{tmp_path}/d"), S.SearchRequest("alpha"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "TakeOrderedAndProject" in plan


def test_controlled_recall(spark):
    raw, queries = evaluate.controlled_workload(spark)
    df = S.with_search_columns(raw)
    found = S.search_many(df, queries, 100_000).where(F.contains("name_norm", F.col("q")))
    out = evaluate.recall_precision(evaluate.substring_truth(df, queries), found, queries).collect()
    assert len(out) == 19 and all(r.recall == r.precision == 1 and r.relevant for r in out)
    few = S.search(df, S.SearchRequest("qxzmarker")).collect()
    assert [h.name for h in few] == ["target-qxzmarker-after-collisions.txt"]


def test_strategies(spark):
    rows = [(i, n, f"/p/{n}", None, "file", 0) for i, n in enumerate(["alpha", "alphabet.txt", "x alpha.txt", "xalphaq.txt", "xalphaq.txt", "abc-then-bcd.txt", "abcd"])] + [(9, "other", "/alpha/other", None, "file", 0)]
    df = R.with_columns(spark.createDataFrame(rows, DOCUMENTS))
    ranked = R.run(df, "alpha", "lexical_then_trigram").orderBy("rank").collect()
    assert [(r.document_id, r.match_type) for r in ranked] == [(0, "exact"), (1, "prefix"), (2, "token"), (3, "substring"), (4, "substring")]
    assert [r.document_id for r in R.run(df, "abcd", "trigram").collect()] == [6]
    assert {r.document_id for r in R.candidates(df, R.plan("abcd", "trigram")).collect()} == {5, 6}
    assert {r.document_id for r in R.candidates(df, R.plan("abcd", "four_gram")).collect()} == {6}
    for bad, error in ((("",), "empty"), (("ab", "trigram", True), "expensive_short_substring"), (("abc", "trigram", False, 501), "candidate_limit")):
        with pytest.raises(InvalidRequest) as e:
            R.plan(*bad)
        assert e.value.details["error"] == error


TEXTS = ["The launch codeword is ultramarine-constellation today", "exact phrase here", "phrase exact", "alpha twoterm", "beta", "", None, "naïve Σ test_case"]


def test_content_queries(spark):
    df = content.index(spark.createDataFrame(list(enumerate(TEXTS)), "document_id long, text string"))
    find = lambda q: [r.document_id for r in content.search(df, q, 100).collect()]
    assert find("ultramarine") == [0] and find("ultram") == [0] and find("ult") == []
    assert find("twoterm alpha beta") == [3, 4]
    assert find('"exact phrase"') == [1]
    assert find("exact AND phrase") == [1, 2] and find("+exact -here") == [2] and find("phrase NOT here") == [2]
    assert find("(alpha OR beta) AND NOT twoterm") == [4]
    assert find("ultramarine-constellation") == [0] and find("constellation-ultramarine") == []
    assert find("NAÏVE") == [7] and find("σ") == [7] and find("test_case") == [7] and find("!!!") == []
    for bad in ("", " ", "x" * 1025, 'a "b', "a AND", "(a", "a)", "-a", "f:a", "a*", "a~1", "a^2", "[a TO b]", "OR"):
        with pytest.raises(QuerySyntax):
            content.search(df, bad, 10)
    with pytest.raises(InvalidRequest):
        content.search(df, "a", 101)
    posted = content.postings(df)
    assert {r.document_id for r in content.phrase_postings(posted, ["exact", "phrase"]).collect()} == {1}
    assert Q.parse("a b") == Q.Bool(should=(Q.Phrase(("a",)), Q.Phrase(("b",))))


def test_percentiles(spark):
    df = spark.createDataFrame([("g", float(v)) for v in range(1, 11)] + [("h", 5.0), ("h", None)], "k string, v double")
    near = {r.k: r for r in evaluate.percentiles(df, "v", ["k"]).collect()}
    assert (near["g"].p50, near["g"].p95, near["g"].p99, near["g"].maximum, near["g"].samples) == (5, 10, 10, 10, 10) and near["h"].p50 == 5
    assert evaluate.percentiles(df, "v", ["k"], floor_index=True).where("k = 'g'").first().p95 == 9


def test_percentiles_of_hot_groups_and_values(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([3, 3, 3, None, rng.randrange(50)])) for _ in range(3000)] + [("one", 7), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    for floor in (False, True):
        got = {r.k: tuple(r)[1:] for r in evaluate.percentiles(df, "v", ["k"], floor_index=floor).collect()}
        want = {}
        for k in {k for k, v in rows if v is not None}:
            vs = sorted(v for g, v in rows if g == k and v is not None)
            at = lambda p: vs[(len(vs) - 1) * p // 100] if floor else vs[-(-len(vs) * p // 100) - 1]  # noqa: B023, E731
            want[k] = (len(vs), at(50), at(95), at(99), vs[-1])
        assert got == want
    assert evaluate.percentiles(df.limit(0), "v", ["k"]).count() == 0
