"""Near-duplicates by SimHash: pigeonring filter over fingerprint segments.

The 64 bits are cut into a ring of three segments (21, 21, 22 bits). Two fingerprints that differ
in at most 2 bits have, by the pigeonring principle, a segment from which every chain of l
consecutive segments differs in at most 2l/3 bits: none in the first, at most one in the first
two. The segment after the first therefore agrees in its lower or upper half as well. A row goes
to six buckets (first segment, next segment's half), the chain is checked in the join's condition, and only
then the whole Hamming distance.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import by_batch, utf8, written

SEGMENTS = ((0, 21), (21, 21), (42, 22))
BITS = 2
#: Buckets with more fingerprints go to the star form, which is exact and linear in their number.
BUCKET_ROWS = 200
#: Up to so many rows that go, their ids are broadcast; beyond, the join is a shuffle.
GONE_ROWS = 1_000_000
_BLOCK = 1 << 16
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """SimHash of lower-cased (A-Z) word shingles, repeats included; 0 without words. Long texts go in blocks."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, _BLOCK):
        part = words[i : i + _BLOCK + width - 1]
        if n == 1:
            h = [digest(b" ".join(words), 42)]
        else:
            h = [digest(b" ".join(s), 42) for s in zip(*(part[k:] for k in range(width)), strict=False)]
        bits = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(bits, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def text_hash(text: Column) -> Column:
    """What tells rows of one id apart; a null text is empty."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, text_hash, fp) for each row of docs; fp is the fingerprint as a signed long. A null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_hash(text).alias("text_hash"), text.alias("text"))

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            fps = np.fromiter((fingerprint(t, width) for t in utf8(b.column(2))), np.uint64, b.num_rows)
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["id", "text_hash", "fp"])

        return one

    return by_batch(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, fp long")


def _segment(c: Column, k: int) -> Column:
    at, n = SEGMENTS[k % 3]
    return F.shiftrightunsigned(c, at).bitwiseAND(F.lit((1 << n) - 1))


def _bucketed(fps: DataFrame) -> DataFrame:
    """(k, key, fp): the six buckets of each distinct fingerprint."""
    fp, out = F.col("fp"), []
    for i in range(3):
        first, after, n = _segment(fp, i), _segment(fp, i + 1), SEGMENTS[(i + 1) % 3][1]
        for j, half in enumerate((after.bitwiseAND(F.lit((1 << n // 2) - 1)), F.shiftrightunsigned(after, n // 2))):
            out.append(F.struct(F.lit(2 * i + j).cast("int").alias("k"), (F.shiftleft(first, 12) + half).alias("key")))
    return fps.select("fp", F.explode(F.array(*out)).alias("b")).select("b.k", "b.key", "fp")


def links(fps: DataFrame, bits: int = BITS, bucket_rows: int = BUCKET_ROWS, rows: int | None = None) -> DataFrame:
    """(a, b) between distinct fingerprints whose components are those of all pairs at `bits` or fewer differing bits (2 at most).

    In buckets of up to bucket_rows fingerprints these are the pairs themselves. Fingerprints of larger buckets link,
    for each of the 65 values that differ from them in at most one bit, to the smallest fingerprint near the same value;
    two fingerprints share such a value exactly if they differ in at most 2 bits, so this is exact too.
    rows: about how many fingerprints there are at most, if known.
    """
    if not 0 <= bits <= 2:
        raise ValueError("the ring of three segments serves 0 to 2 bits")
    keys = _bucketed(fps)
    sizes = keys.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = written(keys.join(sizes, ["k", "key"]), "buckets", None if rows is None else 6 * rows)
    small = sized.where(F.col("n") <= bucket_rows).select("k", "key", "fp")
    x = small.select("k", "key", F.col("fp").alias("a"))
    y = small.select("k", "key", F.col("fp").alias("b"))
    diff = F.expr("a ^ b")
    # chains from the segment k div 2: two segments hold at most 1 difference, all three at most 2
    chain = F.when(F.col("k") < 2, F.bit_count(diff.bitwiseAND(F.lit((1 << 42) - 1)))).when(F.col("k") < 4, F.bit_count(F.shiftrightunsigned(diff, 21))).otherwise(F.bit_count(diff.bitwiseAND(F.lit(-(1 << 42) | ((1 << 21) - 1)))))
    close = x.join(y, ["k", "key"]).where((F.col("a") < F.col("b")) & (chain <= 1) & (F.bit_count(diff) <= bits)).select("a", "b")
    hot = sized.where(F.col("n") > bucket_rows).select("fp").distinct()
    near = F.array(F.lit(0).cast("long"), *(F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64 if bits else 0)))
    stars = hot.select("fp", F.explode(near).alias("flip")).select("fp", F.expr("fp ^ flip").alias("mid"))
    if bits == 1:  # a distance of 1: one of the two is the shared value itself
        stars = stars.join(hot.select(F.col("fp").alias("mid")), "mid", "left_semi")
        stars = stars.select(F.col("fp").alias("a"), F.col("mid").alias("b")).where("a != b")
    else:
        least = stars.groupBy("mid").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
        stars = stars.join(least, "mid").select(F.col("fp").alias("a"), "b").where("a != b")
    return close.unionAll(stars)


def marked(fps: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """fps (id, text_hash, fp) with component_id and is_kept: components of edges(a, b) between values of fp."""
    nodes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    roots = written(components(edges), "roots", rows)
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    out = fps.join(linked.select("fp", "root").join(ids, "root").select("fp", "component_id"), "fp")
    return out.select("id", "text_hash", "fp", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("is_kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, text_hash, fp, component_id, is_kept) for each row of docs.

    component_id is the smallest id that links reach. is_kept holds for rows with that id; text_hash is text_hash() of the row's text.
    Equal fingerprints are one node, so copies never make pairs. Rows with a null id take part: they get
    the group's smallest id that is not null, null if there is none, and then is_kept is true for them.
    Repeated rows stay repeated. An empty table gives an empty one; other columns are not looked at.
    """
    fps = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    rows = fps.count()
    return marked(fps, links(fps.select("fp").distinct(), bits, bucket_rows, rows), rows)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = near_duplicates, **how) -> DataFrame:
    """The rows of docs that find() (near_duplicates(), or another's) keeps: one of each group. Rows that repeat an id and text are one row.

    A group in which all ids are null keeps one row for each text. Columns of docs may have any names.
    """
    marks = written(find(docs, id_col, text_col, **how).groupBy("id", "text_hash").agg(F.first("is_kept").alias("is_kept"), F.count("*").alias("n")), "marks")
    gone = marks.where(~F.col("is_kept")).select(F.col("id").alias("gone_id"), F.col("text_hash").alias("gone_hash"))
    rows = docs.select(F.col(id_col).alias("id"), text_hash(F.col(text_col)).alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    near = F.broadcast(gone) if gone.count() <= GONE_ROWS else gone
    out = rows.join(near, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash")), "left_anti")
    if not marks.where(F.col("is_kept") & (F.col("n") > 1)).isEmpty():
        out = out.dropDuplicates(["id", "text_hash"])
    return out.select("row.*")
