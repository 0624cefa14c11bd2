"""The content query language: terms, OR, AND, NOT, +, -, phrases, groups; as a predicate on a content line."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QuerySyntax
from ..functions.text import content_tokens_of

PREFIX_CHARS = 4
QUERY_BYTES = 1024
LIMIT = 100
_LEX = re.compile(r'\s*(?:"([^"]*)"|([()])|([+-])|([^\s()"]+))')
_UNSUPPORTED = re.compile(r"[\^~*?\[\]{}]|^[A-Za-z_]+:")


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]


@dataclass(frozen=True)
class Prefix:
    token: str


@dataclass(frozen=True)
class Bool:
    """should: one of them if there is no must; must: all; never: none."""

    must: tuple = ()
    should: tuple = ()
    never: tuple = ()


def parse(query: str) -> Bool | Phrase | None:
    """The query's tree; None if it holds no searchable token. Terms side by side are alternatives; AND binds before OR.

    Wildcards, ranges, boosts, fuzzy terms, fields, unbalanced quotes or groups, and exclusions alone are refused.
    """
    if query.count('"') % 2:
        raise QuerySyntax("a quote isn't closed")
    lexed, at = [], 0
    while at < len(query) and query[at:].strip():
        m = _LEX.match(query, at)
        if not m:
            raise QuerySyntax("the query can't be read")
        at = m.end()
        if m[1] is not None:
            lexed.append(("phrase", m[1]))
        elif m[2]:
            lexed.append((m[2], m[2]))
        elif m[3]:
            lexed.append(("sign", m[3]))
        elif m[4] in ("AND", "OR", "NOT"):
            lexed.append((m[4], m[4]))
        else:
            if _UNSUPPORTED.search(m[4]):
                raise QuerySyntax(f"{m[4]!r} isn't supported")
            lexed.append(("phrase", m[4]))
    tree, rest = _alternatives(lexed, 0)
    if rest != len(lexed):
        raise QuerySyntax("a group isn't opened")
    return tree


def _alternatives(lexed, at):
    must, should, never = [], [], []
    while at < len(lexed) and lexed[at][0] != ")":
        if lexed[at][0] == "OR":
            at += 1
            if at == len(lexed) or lexed[at][0] in ("OR", "AND", ")"):
                raise QuerySyntax("OR needs two sides")
            continue
        clauses = []
        while True:
            sign, node, at = _clause(lexed, at)
            clauses.append((sign, node))
            if at < len(lexed) and lexed[at][0] == "AND":
                at += 1
                continue
            break
        if len(clauses) == 1:
            sign, node = clauses[0]
            if node is not None:
                {"+": must, "-": never, "": should}[sign].append(node)
        else:
            held = Bool(must=tuple(n for s, n in clauses if n is not None and s != "-"), never=tuple(n for s, n in clauses if n is not None and s == "-"))
            if held.must or held.never:
                should.append(held)
    if not must and not should:
        if never:
            raise QuerySyntax("a query of exclusions alone matches nothing")
        return None, at
    if len(should) == 1 and not must and not never:
        return should[0], at
    return Bool(tuple(must), tuple(should), tuple(never)), at


def _clause(lexed, at):
    if at == len(lexed):
        raise QuerySyntax("an operator has no right side")
    sign = ""
    kind, value = lexed[at]
    if kind in ("NOT", "sign"):
        sign = "-" if kind == "NOT" or value == "-" else "+"
        at += 1
        if at == len(lexed):
            raise QuerySyntax("an operator has no right side")
        kind, value = lexed[at]
    if kind == "(":
        node, at = _alternatives(lexed, at + 1)
        if at == len(lexed):
            raise QuerySyntax("a group isn't closed")
        return sign, node, at + 1
    if kind != "phrase":
        raise QuerySyntax(f"{value} stands where a term is due")
    tokens = tuple(content_tokens_of(value))
    return sign, Phrase(tokens) if tokens else None, at + 1


def plan(query: str) -> Bool | Phrase | Prefix | None:
    """parse() of the trimmed query; a single token of PREFIX_CHARS letters, digits or _ also finds longer tokens."""
    query = query.strip()
    if not 1 <= len(query.encode()) <= QUERY_BYTES:
        raise QuerySyntax(f"a query has 1 to {QUERY_BYTES} bytes")
    tree = parse(query)
    tokens = content_tokens_of(query)
    if len(query) >= PREFIX_CHARS and all(c.isalnum() or c == "_" for c in query) and len(tokens) == 1:
        return Bool(should=tuple(x for x in (tree, Prefix(tokens[0])) if x is not None))
    return tree


def predicate(tree, line: Column) -> Column:
    """Whether a content line (functions.text.content_line) matches the tree."""
    if tree is None:
        return F.lit(False)
    if isinstance(tree, Phrase):
        return F.contains(line, F.lit(f" {' '.join(tree.tokens)} "))
    if isinstance(tree, Prefix):
        return F.contains(line, F.lit(f" {tree.token}"))
    must = [predicate(x, line) for x in tree.must] or [reduce(lambda a, b: a | b, (predicate(x, line) for x in tree.should), F.lit(False) if tree.should else F.lit(True))]
    return reduce(lambda a, b: a & b, must + [~predicate(x, line) for x in tree.never])
