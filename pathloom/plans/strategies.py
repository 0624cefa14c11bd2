"""Retrieval strategies of the evaluation harness: which candidates an index brings, and what verification leaves of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidRequest
from ..functions import text as T
from .search import class_name, match_class

STRATEGIES = ("trigram", "lexical_then_trigram", "four_gram", "lexical")
#: Candidates that a plan takes by default and at most; characters of a name's prefixes.
CANDIDATES, MOST_CANDIDATES, PREFIX = 300, 500, 16


@dataclass(frozen=True)
class Plan:
    """A query that may run: its folded form, its strategy and the candidates it takes."""

    q: str
    strategy: str
    candidates: int


def plan(query: str, strategy: str = "lexical_then_trigram", substring_only: bool = False, candidates: int = CANDIDATES) -> Plan:
    """Refuse empty queries, substring searches under three characters, and candidate limits outside 1 to MOST_CANDIDATES."""
    q = T.fold_separators_text(query)
    if not q:
        raise InvalidRequest("the query is empty", error="empty")
    if substring_only and len(q) < 3:
        raise InvalidRequest("a substring has three characters", error="expensive_short_substring")
    if not 1 <= candidates <= MOST_CANDIDATES:
        raise InvalidRequest(f"candidates are 1 to {MOST_CANDIDATES}", error="candidate_limit")
    if strategy not in STRATEGIES:
        raise InvalidRequest("the strategy isn't known")
    return Plan(q, strategy, candidates)


def with_columns(documents: DataFrame) -> DataFrame:
    """Add the folded columns that strategies read."""
    out = documents.withColumns({"name_norm": T.fold_separators(F.col("name")), "path_norm": T.fold_separators(F.col("resolved_path"))})
    return out.withColumn("name_tokens", T.tokens(F.col("name_norm")))


def lexical(q: str, prefix: int = PREFIX) -> Column:
    """The whole name, one of its tokens, or a prefix of up to 16 characters of the whole name."""
    name = F.col("name_norm")
    return (name == q) | F.array_contains("name_tokens", q) | (F.startswith(name, F.lit(q)) if len(q) <= prefix else F.lit(False))


def gram_candidates(q: str, width: int) -> Column:
    """Names that hold every gram of q, in whatever order: what an index of grams brings before verification."""
    wanted = sorted(set(T.grams_of(q, width)))
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), T.grams(F.col("name_norm"), width))) == 0 if wanted else F.lit(False)


def candidates(documents: DataFrame, p: Plan) -> DataFrame:
    """Candidates with priority (0 lexical, 1 grams), the first `p.candidates` by priority and id."""
    width = 4 if p.strategy == "four_gram" and len(p.q) >= 4 else 3
    lex, grams = lexical(p.q), gram_candidates(p.q, width)
    if p.strategy == "lexical" or (p.strategy == "four_gram" and len(p.q) < 4):
        priority = F.when(lex, 0)
    elif p.strategy == "lexical_then_trigram":
        priority = F.when(lex, 0).when(grams, 1)
    else:
        priority = F.when(grams, 1)
    return documents.withColumn("priority", priority).where("priority is not null").orderBy("priority", "document_id").limit(p.candidates)


def verified(found: DataFrame, p: Plan) -> DataFrame:
    """Candidates that match, ranked: classes as in search but for any length of substring, ties by id."""
    rows = found.withColumn("match_class", match_class(F.lit(p.q), 1)).where("match_class is not null")
    rank = F.row_number().over(Window.orderBy("match_class", "name_norm", "path_norm", "document_id"))  # over p.candidates rows
    return rows.withColumns({"match_type": class_name(F.col("match_class")), "rank": rank})


def run(documents: DataFrame, query: str, strategy: str, **policy) -> DataFrame:
    p = plan(query, strategy, **policy)
    return verified(candidates(documents, p), p)


def plain_search(documents: DataFrame, query: str, limit: int) -> DataFrame:
    """The first harness: plain lower case, the whole name, a token, or a prefix of up to 32 characters of the whole name; by id."""
    q = query.lower()
    rows = documents.withColumn("name_norm", F.lower("name"))
    return rows.withColumn("name_tokens", T.tokens(F.col("name_norm"))).where(lexical(q, 32)).orderBy("document_id").limit(limit)
