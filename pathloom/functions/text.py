"""Text kernel: normal forms, tokens, prefixes, grams and name parts.

Everything but normalize() is a built-in expression. normalize() runs once, when documents are projected; queries are
normalized on the driver, so search plans hold no Python.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What separates tokens: anything but letters and numbers.
SEPARATORS = r"[^\p{IsAlphabetic}\p{N}]+"


def normalize_text(text: str) -> str:
    """NFKC, then each character's own lower case (no contextual final sigma)."""
    if text.isascii():
        return text.lower()
    return "".join(c.lower() for c in unicodedata.normalize("NFKC", text))


def fold_separators_text(text: str) -> str:
    """normalize_text with each run of path separators as one slash."""
    return re.sub(r"[\\/]+", "/", normalize_text(text))


@F.pandas_udf(StringType())
def _normalize(text: pd.Series) -> pd.Series:
    return text.map(normalize_text, na_action="ignore")


def normalize(text: Column) -> Column:
    return _normalize(text)


def fold_separators(text: Column) -> Column:
    return F.regexp_replace(normalize(text), r"[\\/]+", "/")


def tokens(normal: Column) -> Column:
    """Runs of letters and numbers, in order."""
    return F.filter(F.split(normal, SEPARATORS), lambda t: t != "")


def tokens_of(text: str) -> list[str]:
    """tokens() of a normalized string, on the driver."""
    return [t for t in re.split(r"[^\w]+|_+", text) if t] if text.isascii() else _tokens_of(text)


def _tokens_of(text: str) -> list[str]:
    out, now = [], ""
    for c in text + " ":
        if c.isalpha() or unicodedata.category(c)[0] == "N" or unicodedata.category(c) in ("Mn", "Mc") and now and _alphabetic_mark(c):
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def _alphabetic_mark(c: str) -> bool:
    """Vowel signs and the like, which count as alphabetic; accents on their own don't."""
    return unicodedata.category(c) == "Mc" or unicodedata.combining(c) == 0


def prefixes(token: Column, longest: int = 32) -> Column:
    """The token's first 1, 2, ... characters, up to `longest`."""
    n = F.least(F.char_length(token), F.lit(longest))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.left(token, i))).otherwise(F.array().cast("array<string>"))


def grams(text: Column, width: int = 3) -> Column:
    """All runs of `width` characters; none if the text is shorter."""
    n = F.char_length(text) - width + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(width)))).otherwise(F.array().cast("array<string>"))


def grams_of(text: str, width: int = 3) -> list[str]:
    return [text[i : i + width] for i in range(len(text) - width + 1)]


def hex_term(gram: Column) -> Column:
    """The UTF-8 bytes in lower-case hex, so that no tokenizer can split the term."""
    return F.lower(F.hex(F.encode(gram, "UTF-8")))


def extension(name: Column) -> Column:
    """Lower-cased text after the last dot; null without a dot or with nothing after it."""
    return F.nullif(F.lower(F.when(F.contains(name, F.lit(".")), F.substring_index(name, ".", -1))), F.lit(""))


def display_path(components: Column) -> Column:
    return F.array_join(components, "/")


def parent_path(path: Column) -> Column:
    """What stands before the last separator of either kind, if that is past the third character; else null."""
    head = F.regexp_extract(path, r"^(.*)[\\/][^\\/]*$", 1)
    return F.when(F.char_length(head) > 2, head)


def content_line(text: Column) -> Column:
    """The text's lower-cased tokens as one line, a blank around each: a term is `contains(' t ')`, a phrase `contains(' a b ')`.

    Tokens of 40 bytes or more can't be searched; a mark holds their place, so that phrases don't close over them.
    """
    words = F.transform(F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != ""), lambda t: F.when(F.octet_length(t) < 40, t).otherwise("\x00"))
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def content_tokens_of(text: str) -> list[str]:
    """Searchable tokens of a query string, on the driver."""
    return [t for t in tokens_of("".join(c.lower() for c in text)) if len(t.encode()) < 40]
