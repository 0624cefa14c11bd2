"""Language identification by rank-order n-gram profiles and out-of-place distance (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import functools
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import by_batch

#: N-grams in a profile, and the out-of-place distance of an n-gram that a profile lacks.
PROFILE = 400
#: Profiles go to every task; more languages than this are refused.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
#: Code points are letters up to here.
_CODES = 0x33480


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    return np.array([(ord(low) if len(low := chr(c).lower()) == 1 else c) if chr(c).isalpha() else 0 for c in range(_CODES)], np.uint64)


def keys_of(text: str) -> np.ndarray:
    """The n-grams of 1 to 3 characters of the lower-cased words of letters, each word with a blank on either side.

    A key has 21 bits for a character, the first highest, the blank is 0; keys of shorter n-grams are marked by bit 63 and 62.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(codes < _CODES, _letters()[np.minimum(codes, _CODES - 1)], np.uint64(0))
    c = np.concatenate([[np.uint64(0)], c, [np.uint64(0)]])
    c = c[np.concatenate([[True], (c[1:] != 0) | (c[:-1] != 0)])]  # blanks in a row are one
    if len(c) < 3:
        return np.zeros(0, np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = ((two[:-1] << np.uint64(21)) | c[2:])[c[1:-1] != 0]
    return np.concatenate([c[c != 0] | np.uint64(1 << 63 | 1 << 62), two | np.uint64(1 << 63), three])


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank): the `size` most frequent n-grams (keys as of keys_of) of each language, rank 0 first, ties by key.

    Counts cover every row with a text and a language. Counts are summed in each task before the shuffle.
    """
    rows = rows.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        parts: dict[str, list[np.ndarray]] = defaultdict(list)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang):
            keys, n = np.unique(np.concatenate(parts.pop(lang)), return_counts=True)
            if lang in sums:
                both, inverse = np.unique(np.concatenate([sums[lang][0], keys]), return_inverse=True)
                keys, n = both, np.bincount(inverse, weights=np.concatenate([sums[lang][1], n])).astype(np.int64)
            sums[lang] = keys, n

        def counted():
            for lang, (keys, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(keys.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])
            sums.clear()

        sizes: Counter = Counter()
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                lang = lang.as_py()
                keys = keys_of(text.as_py())
                parts[lang].append(keys)
                sizes[lang] += len(keys)
                if sizes.total() > 4_000_000:
                    for x in list(parts):
                        add(x)
                    sizes.clear()
            if sum(len(x[0]) for x in sums.values()) > 2_000_000:
                yield from counted()
        for x in list(parts):
            add(x)
        yield from counted()

    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram")) - 1
    return counts.withColumn("rank", rank).where(F.col("rank") < size).select("lang", "gram", "rank")


class Profiles:
    """The learned profiles in a task: out-of-place distances of a text to each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.langs = sorted({r[0] for r in rows})
        self.size = size
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.keys, inverse = np.unique(np.array([r[1] for r in rows], np.int64).view(np.uint64), return_inverse=True)
        self.ranks = np.full((len(self.keys), len(self.langs)), -1, np.int32)
        for (lang, _, rank), k in zip(rows, inverse, strict=True):
            self.ranks[k, at[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): score is 1 minus the mean out-of-place distance over the profile's size; ties go to the first language.

        An n-gram's rank in the text is the number of more frequent ones. `und` and 0 without a letter or without any profile.
        """
        keys = keys_of(text or "")
        if not len(keys) or not self.langs:
            return UNKNOWN, 0.0
        keys, n = np.unique(keys, return_counts=True)
        rank = len(n) - np.searchsorted(np.sort(n), n, side="right")
        top = rank < self.size
        keys, rank = keys[top], rank[top]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        inside = self.keys[at] == keys
        mine = self.ranks[at[inside]]
        out = np.where(mine < 0, self.size, np.abs(mine - rank[inside, None])).sum(0) + self.size * int((~inside).sum())
        best = int(np.argmin(out))
        return self.langs[best], max(0.0, 1 - float(out[best]) / (self.size * len(keys)))


def identify(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, *keep, lang_pred, score) for each row of docs, from its text alone.

    profiles is what learn() returns: at most MOST_LANGUAGES x size rows, which go to the tasks. A text that is null
    or has no letter is `und` with score 0. Repeated rows stay; an empty table gives an empty one.
    """
    rows = [tuple(r) for r in profiles.select("lang", "gram", "rank").limit(MOST_LANGUAGES * size + 1).collect()]
    if len(rows) > MOST_LANGUAGES * size:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    # the text is the last column, and goes to Python once if it is kept
    name = {text_col: "text"} if docs.schema[text_col].dataType.simpleString() == "string" else {}
    name = {c: name.get(c, f"keep_{c}") for c in keep}
    picked = docs.select(F.col(id_col).alias("id"), *(F.col(c).alias(k) for c, k in name.items() if k != "text"), F.col(text_col).cast("string").alias("text"))
    given = len(picked.columns) - ("text" not in name.values())

    def make():
        p = Profiles(shared.value, size)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [p.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            return pa.RecordBatch.from_arrays([*b.columns[:given], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*b.schema.names[:given], "lang_pred", "score"])

        return one

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:given])
    return by_batch(picked, make, f"{fields}, lang_pred string, score double").select("id", *(F.col(name[c]).alias(c) for c in keep), "lang_pred", "score")


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the documents whose crc32(id as text) mod 5 is 0; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
