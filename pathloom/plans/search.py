"""Catalog search: retrieval modes, filters, classes and ranks as one Catalyst plan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..functions import text as T
from ..schemas import SCOPES

RANKING_VERSION = 1
LONGEST_PREFIX = 32
SHORTEST_SUBSTRING = 3
MODES = ("exact", "prefix", "token", "path", "substring")
#: Bounds of a request.
QUERY_BYTES, TOP_K, EXTENSIONS, LOOKUP_IDS, DEADLINE_MS, REQUEST_ID_BYTES = 1024, 100, 32, 100, 10_000, 64


@dataclass(frozen=True)
class SearchRequest:
    """A search. extensions are compared normalized and as they are; directory_prefix is a plain prefix of the normalized path."""

    query: str
    scope: str = "all"
    extensions: tuple[str, ...] = ()
    directory_prefix: str | None = None
    minimum_size: int | None = None
    maximum_size: int | None = None
    top_k: int = 10
    modes: tuple[str, ...] = MODES
    candidate_limit: int | None = field(default=None)

    def validate(self) -> SearchRequest:
        if not 1 <= len(self.query.encode()) <= QUERY_BYTES:
            raise InvalidRequest(f"a query has 1 to {QUERY_BYTES} bytes")
        if not T.normalize_text(self.query):
            raise InvalidRequest("the query is empty")
        if not 1 <= self.top_k <= TOP_K:
            raise InvalidRequest(f"top_k is 1 to {TOP_K}")
        if len(self.extensions) > EXTENSIONS:
            raise InvalidRequest(f"at most {EXTENSIONS} extensions")
        if self.scope not in SCOPES:
            raise InvalidRequest(f"scope is one of {', '.join(SCOPES)}")
        if set(self.modes) - set(MODES) or not self.modes:
            raise InvalidRequest(f"modes are of {', '.join(MODES)}")
        return self


def validate_envelope(request_id: str, deadline_ms: int, version: int = 1, versions: tuple[int, ...] = (1, 2)) -> None:
    """Bounds of what stands around any request."""
    if version not in versions:
        raise InvalidRequest("the protocol version isn't known")
    if not 1 <= len(request_id.encode()) <= REQUEST_ID_BYTES:
        raise InvalidRequest(f"a request id has 1 to {REQUEST_ID_BYTES} bytes")
    if not 0 < deadline_ms <= DEADLINE_MS:
        raise InvalidRequest(f"a deadline is at most {DEADLINE_MS} ms")


def validate_ids(ids: list) -> None:
    if not 1 <= len(ids) <= LOOKUP_IDS or len(set(ids)) != len(ids):
        raise InvalidRequest(f"1 to {LOOKUP_IDS} different ids")


def tool_request(query: str, top_k: int = 10, extensions: list[str] | None = None, **rest) -> SearchRequest:
    """A request from a tool call: at most 50 hits; extensions lose leading dots, are letters and digits of up to 32 bytes, distinct and sorted."""
    if not 1 <= top_k <= 50:
        raise InvalidRequest("top_k is 1 to 50")
    out = set()
    for e in extensions or []:
        e = e.lstrip(".").lower()
        if not e or len(e.encode()) > 32 or not (e.isascii() and e.isalnum()):
            raise InvalidRequest("an extension has 1 to 32 letters and digits")
        out.add(e)
    return SearchRequest(query, top_k=top_k, extensions=tuple(sorted(out)), **rest).validate()


def with_search_columns(documents: DataFrame) -> DataFrame:
    """Add the columns that search reads: name_norm, path_norm, name_tokens, path_tokens, extension_norm.

    Run when documents are projected and stored, so that searches read them.
    """
    out = documents.withColumns({"name_norm": T.normalize(F.col("name")), "path_norm": T.normalize(F.col("resolved_path")), "extension_norm": T.normalize(F.col("extension"))})
    return out.withColumns({"name_tokens": T.tokens(F.col("name_norm")), "path_tokens": T.tokens(F.col("path_norm"))})


def mode_predicate(mode: str, q: str) -> Column:
    """Rows that a mode retrieves for the normalized query q."""
    if mode == "exact":
        return F.col("name_norm") == q
    if mode == "token":
        return F.array_contains("name_tokens", q)
    if mode == "prefix":
        return F.exists("name_tokens", lambda t: F.startswith(t, F.lit(q))) if len(q) <= LONGEST_PREFIX else F.lit(False)
    if mode == "path":
        return F.array_contains("path_tokens", q)
    return F.contains("name_norm", F.lit(q)) if len(q) >= SHORTEST_SUBSTRING else F.lit(False)


def filters(request: SearchRequest) -> Column:
    """The request's filters on a document."""
    out = [{"all": F.lit(True), "files": F.col("kind") != "directory", "folders": F.col("kind") == "directory"}[request.scope]]
    if request.extensions:
        out.append(F.col("extension_norm").isin(*[T.normalize_text(e) for e in request.extensions]))
    if request.directory_prefix is not None:
        out.append(F.startswith("path_norm", F.lit(T.normalize_text(request.directory_prefix))))
    if request.minimum_size is not None:
        out.append(F.col("size") >= request.minimum_size)
    if request.maximum_size is not None:
        out.append(F.col("size") <= request.maximum_size)
    return reduce(lambda a, b: a & b, out)


def match_class(q: Column, shortest: int = SHORTEST_SUBSTRING) -> Column:
    """0 exact, 1 prefix, 2 token, 3 substring, 4 path, null for none; q is normalized."""
    name, path = F.col("name_norm"), F.col("path_norm")
    return (
        F.when(name == q, 0)
        .when(F.startswith(name, q), 1)
        .when(F.array_contains(F.col("name_tokens"), q), 2)
        .when((F.char_length(q) >= shortest) & F.contains(name, q), 3)
        .when(F.contains(path, q), 4)
    )


def class_name(c: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ("exact", "prefix", "token", "substring", "path"))), c + 1)


#: What decides between hits of one class.
ORDER = ("match_class", "name_norm", "path_norm", "document_id")


def search(documents: DataFrame, request: SearchRequest) -> DataFrame:
    """The best top_k hits, with match_class, match_type, rank (from 1) and ranking_version.

    Every document that a mode retrieves and the filters pass is ranked. candidate_limit, if given, first keeps that many
    retrieved documents, in the order of modes and then ids, before filters: a deterministic form of a bounded candidate window.
    """
    request.validate()
    q = T.normalize_text(request.query)
    modes = [m for m in MODES if m in request.modes]
    found = reduce(lambda a, b: a | b, (mode_predicate(m, q) for m in modes))
    rows = documents.where(found)
    if request.candidate_limit is not None:
        first = reduce(lambda c, m: c.when(mode_predicate(m[1], q), m[0]), list(enumerate(modes))[1:], F.when(mode_predicate(modes[0], q), 0))
        rows = rows.orderBy(first, "document_id").limit(request.candidate_limit)
    ranked = rows.where(filters(request)).withColumn("match_class", match_class(F.lit(q))).where("match_class is not null")
    best = ranked.orderBy(*ORDER).limit(request.top_k)
    rank = F.row_number().over(Window.orderBy(*ORDER))  # over top_k rows
    return best.withColumns({"match_type": class_name(F.col("match_class")), "rank": rank, "ranking_version": F.lit(RANKING_VERSION)})


HIT = ["document_id", "volume_id", "file_id", "file_link_id", "name", "resolved_path", "extension", "kind", "size", "modified_at_unix_ms", "availability", "match_type", "rank", "ranking_version"]
ITEM = [c for c in HIT if c not in ("match_type", "rank", "ranking_version")]


def lookup(documents: DataFrame, ids: list, columns: list[str] | None = None) -> DataFrame:
    """Documents with the ids, in the ids' order; missing ones are left out."""
    validate_ids(ids)
    spark = documents.sparkSession
    kind = documents.schema["document_id"].dataType.simpleString()
    wanted = spark.createDataFrame(list(enumerate(ids)), f"ordinal long, document_id {kind}")
    out = documents.join(F.broadcast(wanted), "document_id").orderBy("ordinal")
    return out.select(*(columns or documents.columns))


def page(documents: DataFrame, after, limit: int) -> DataFrame:
    """The next `limit` documents by id after the cursor (None: from the start)."""
    rows = documents if after is None else documents.where(F.col("document_id") > F.lit(after))
    return rows.orderBy("document_id").limit(limit)


def postings(documents: DataFrame, gram: int = 3) -> DataFrame:
    """(kind, term, document_id): the terms by which documents are found. Stored and bucketed by term, it serves batches of queries."""
    def of(kind: str, terms: Column) -> DataFrame:
        return documents.select(F.lit(kind).alias("kind"), F.explode(F.array_distinct(terms)).alias("term"), "document_id")

    return (
        documents.select(F.lit("exact").alias("kind"), F.col("name_norm").alias("term"), "document_id").where("term is not null")
        .unionAll(of("token", F.col("name_tokens")))
        .unionAll(of("prefix", F.flatten(F.transform("name_tokens", lambda t: T.prefixes(t, LONGEST_PREFIX)))))
        .unionAll(of("path", F.col("path_tokens")))
        .unionAll(of("gram", T.grams(F.col("name_norm"), gram)))
    )


def query_frame(spark: SparkSession, queries: list[str]) -> DataFrame:
    rows = [(i, q, T.normalize_text(q)) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id long, query string, q string")


def search_many(documents: DataFrame, queries: DataFrame, top_k: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Hits of many queries at once: queries has (query_id, q), q normalized.

    Queries and documents meet on equal terms. A substring query looks up its rarest gram only, and every hit is
    verified, so results are those of search() without filters.
    """
    index = postings(documents) if index is None else index
    terms = queries.where("q != ''").select("q").distinct()  # equal queries are answered once
    lexical = terms.select("q", F.explode(F.array(*map(F.lit, ("exact", "token", "prefix", "path")))).alias("kind"), F.col("q").alias("term"))
    asked = terms.where(F.char_length("q") >= SHORTEST_SUBSTRING).select("q", F.explode(F.array_distinct(T.grams(F.col("q")))).alias("term"))
    often = index.where("kind = 'gram'").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    rarest = asked.join(often, "term").groupBy("q").agg(F.min_by("term", F.struct("n", "term")).alias("term")).select("q", F.lit("gram").alias("kind"), "term")
    met = lexical.unionByName(rarest).join(index, ["kind", "term"])
    verified = met.where((F.col("kind") != "prefix") | (F.char_length("q") <= LONGEST_PREFIX))
    # one row for a pair; a pair that only a gram brought must hold the query in its name
    pairs = verified.groupBy("q", "document_id").agg(F.min(F.col("kind") == "gram").alias("gram_only"))
    hits = pairs.join(documents, "document_id").where(~F.col("gram_only") | F.contains("name_norm", F.col("q"))).withColumn("match_class", match_class(F.col("q"))).where("match_class is not null")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(*ORDER))
    best = hits.withColumn("rank", rank).where(F.col("rank") <= top_k).withColumns({"match_type": class_name(F.col("match_class")), "ranking_version": F.lit(RANKING_VERSION)}).drop("gram_only")
    return queries.select("query_id", "q").join(best, "q")
