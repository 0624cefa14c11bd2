"""Quality classifier: ordinal cumulative-link (proportional odds) regression on hashed words.

P(grade <= j) = sigmoid(t_j - w.x) with ordered thresholds t and weights w that all grades share. x has a 1 for each
hashed word of the text, its marks between words and its shape. The model is fitted here on graded rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, utf8, written

BUCKETS = 1 << 18
#: Rows by which the model is fitted: at most so many of each grade, the first by a hash of the id.
ROWS_A_GRADE = 4000
#: Different grades that ratings may have.
MOST_GRADES = 100
#: Share of top-graded rows whose tail probability may lie under the selection's threshold.
LOST_GOOD = 0.01
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\x20\x09-\x0DA-Za-z0-9\x80-\xff]+")
_CACHED = 200_000


def shapes(text: bytes) -> list[bytes]:
    """Names of the text's shape: coarse shares of distinct and upper-case words, of marks and of repeated lines."""
    words = text.split()
    n = len(words)
    if not n:
        return [b"shape:none"]
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    marks = (byte[0x21:0x30].sum() + byte[0x3A:0x41].sum() + byte[0x5B:0x61].sum() + byte[0x7B:0x7F].sum()) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    out = [b"shape:marks%d" % min(8, int(4 * marks)), b"shape:lines%d" % int(4 * (1 - len(set(lines)) / len(lines))), b"shape:upper%d" % int(6 * sum(len(w) > 2 and w.isupper() for w in words) / n)]
    return out + [b"shape:distinct%d" % int(8 * min(1, len(set(words)) / n**0.9))] * (n >= 20)


class Hasher:
    """Distinct buckets of a text's tokens; remembers the buckets of frequent tokens."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.of = buckets, {}

    def _bucket(self, token: bytes) -> tuple[int, ...]:
        kind = b"m" if not (token[:1].isalnum() or token[0] >= 0x80) else b"w"
        names = [kind + token.lower()]
        if kind == b"w" and len(token) > 2 and token.isupper():
            names.append(b"shape:upper")
        if token.isdigit():
            names = [b"shape:digits%d" % min(len(token), 12)]
        return tuple(zlib.crc32(x) % self.buckets for x in names)

    def __call__(self, text: bytes | None) -> np.ndarray:
        of = self.of
        if len(of) > _CACHED:
            of.clear()
        out: set[int] = set()
        for t in set(_TOKEN.findall(text or b"")):
            found = of.get(t)
            if found is None:
                found = of[t] = self._bucket(t)
            out.update(found)
        out.update(zlib.crc32(s) % self.buckets for s in shapes(text or b""))
        return np.fromiter(sorted(out), np.int32, len(out))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Ordinal:
    """weights: one for each bucket; cuts: ascending thresholds between the grades."""

    def __init__(self, grades: list[int], weights: np.ndarray, cuts: np.ndarray):
        self.grades, self.weights, self.cuts = grades, weights, cuts

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and each threshold j."""
        return _sigmoid(scores[:, None] - self.cuts[None, :])

    @classmethod
    def fit(cls, rows: list[np.ndarray], y: np.ndarray, buckets: int = BUCKETS, rounds: int = 400, rate: float = 0.1, l1: float = 5e-4, l2: float = 1e-5) -> Ordinal:
        """Adam steps on the mean negative log likelihood with a soft threshold for l1; grades are weighted alike."""
        grades = sorted({int(v) for v in y})
        k = len(grades)
        level = np.searchsorted(grades, y)
        weights = np.zeros(buckets)
        if k < 2 or not len(rows):
            return cls(grades, weights, np.zeros(0))
        flat, which = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        used, flat = np.unique(flat, return_inverse=True)
        each = (len(y) / (k * np.bincount(level, minlength=k)))[level] / len(y)
        share = np.cumsum(np.full(k, 1 / k))[:-1]
        w, base, gaps = np.zeros(len(used)), np.log(share[0] / (1 - share[0])), np.log(np.maximum(1e-3, np.diff(np.log(share / (1 - share)))))
        params = [w, np.array([base]), gaps]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, rounds + 1):
            cuts = params[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[2]))])
            s = np.bincount(which, weights=params[0][flat], minlength=len(rows))
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            up, low = _sigmoid(edges[level + 1] - s), _sigmoid(edges[level] - s)
            up[level == k - 1], low[level == 0] = 1.0, 0.0
            p = np.maximum(up - low, 1e-9)
            d_up, d_low = up * (1 - up) / p * each, low * (1 - low) / p * each
            g_cut = np.array([d_low[level == j + 1].sum() - d_up[level == j].sum() for j in range(k - 1)])
            g_w = np.bincount(flat, weights=(d_up - d_low)[which], minlength=len(used)) + l2 * params[0]
            g_gap = np.array([g_cut[j + 1 :].sum() * np.exp(params[2][j]) for j in range(k - 2)])
            step = rate * (1 - 0.9 * t / rounds)
            for i, g in enumerate((g_w, np.array([g_cut.sum()]), g_gap)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                scale = np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8
                params[i] = params[i] - step * m[i] / (1 - 0.9**t) / scale
                if i == 0:
                    params[0] = np.sign(params[0]) * np.maximum(0, np.abs(params[0]) - step * l1 / scale)
        weights[used] = params[0]
        return cls(grades, weights, params[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[2]))]))


def grade_of(quality: Column, toxic: Column) -> Column:
    """Graded rating from two labels: 0 toxic, 1 poor, 2 good; null where a label is missing."""
    return F.when(toxic == 1, 0).when((toxic == 0) & (quality == 0), 1).when((toxic == 0) & (quality == 1), 2)


def _features(rows: DataFrame, buckets: int) -> DataFrame:
    def make():
        h = Hasher(buckets)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([b.column(0), pa.array([h(t) for t in utf8(b.column(1))], pa.list_(pa.int32()))], ["grade", "x"])

        return one

    return by_batch(rows.select("grade", "text"), make, "grade int, x array<int>")


def grade(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", rating_id: str = "doc_id", rating_col: str = "grade", rows: int = ROWS_A_GRADE, buckets: int = BUCKETS) -> DataFrame:
    """(id, expected_grade, tail_probability, kept) for each row of docs.

    tail_probability: of the highest grade. kept: it reaches a threshold that LOST_GOOD of the top-graded rows held back
    from fitting (every fifth) miss, at most 0.5. ratings: (id, integer grade) with MOST_GRADES grades at most, of each of which `rows`
    are used, those whose ids hash lowest (the cut leaves half as many again or more to choose from). What comes to the driver is the hashed
    features of those rows, at most `buckets` numbers each, however long the texts. Rows with a null
    are no ratings, of repeated ratings for an id the least counts, of an id's texts the one that hashes lowest. With fewer than two grades rated every row is kept
    with tail_probability 1. Null texts count as empty; texts of any length are read whole.
    Ties in the hash go by id. Repeated rows stay; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rated = ratings.select(F.col(rating_id).alias("id"), F.col(rating_col).cast("int").alias("grade")).dropna().groupBy("id").agg(F.min("grade").alias("grade"))
    rated = written(rated.withColumn("h", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 30))), "rated")
    counts = {r.grade: r.n for r in rated.groupBy("grade").agg(F.count("*").alias("n")).limit(MOST_GRADES + 1).collect()}
    if len(counts) > MOST_GRADES:
        raise ValueError(f"ratings have more than {MOST_GRADES} grades")
    sample = None
    for g in sorted(counts):  # a cut of the hashes first, so that tasks send about as many rows as are taken
        share = min(1.0, 1.5 * (rows + 50) / counts[g])
        part = rated.where((F.col("grade") == g) & (F.col("h") < int(share * (1 << 30)))).orderBy("h", "id").limit(rows).select("id", "grade")
        sample = part if sample is None else sample.unionAll(part)
    if sample is None:
        sample = rated.select("id", "grade")
    one = text.join(F.broadcast(sample), "id").groupBy("id", "grade").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = _features(one, buckets).toArrow()
    x = [np.asarray(v.values) if v.is_valid else np.zeros(0, np.int32) for v in found["x"]]
    y = np.array(found["grade"].to_pylist(), np.int64)
    order = sorted(range(len(x)), key=lambda i: (zlib.crc32(x[i].tobytes()), y[i]))  # whatever order the tasks end in
    x, y = [x[i] for i in order], y[order]
    back = (np.arange(len(y)) % 5 == 0) & (len(y) > 1)
    model = Ordinal.fit([r for r, b in zip(x, back, strict=True) if not b], y[~back], buckets)
    cut = 0.0
    if len(model.cuts):
        top = [x[i] for i in np.flatnonzero(back & (y == model.grades[-1]))]
        tail = np.array([model.tails(np.array([model.weights[r].sum()]))[0, -1] for r in top])
        cut = min(0.5, float(np.quantile(tail, LOST_GOOD))) if len(tail) else 0.5
    shared = spark.sparkContext.broadcast((model, cut, buckets))

    def make():
        model, cut, buckets = shared.value
        h = Hasher(buckets)

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            s = np.array([model.weights[h(t)].sum() for t in utf8(b.column(1))])
            if len(model.cuts):
                tails = model.tails(s)
                expected = model.grades[0] + tails @ np.diff(model.grades)
                last = tails[:, -1]
            else:
                expected, last = np.full(len(s), float(model.grades[0]) if model.grades else 0.0), np.ones(len(s))
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(expected), pa.array(last), pa.array(last >= cut)], ["id", "expected_grade", "tail_probability", "kept"])

        return one

    return by_batch(text, make, f"id {text.schema['id'].dataType.simpleString()}, expected_grade double, tail_probability double, kept boolean")
