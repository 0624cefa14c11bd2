"""Repeated byte strings of a corpus by enhanced suffix arrays.

1. Every string of MIN bytes in a text belongs to one anchor: the K bytes inside it that hash lowest (leftmost on ties).
   The choice depends on the string alone, so equal strings meet at equal anchors. Neighbouring strings with the
   same anchor form a context. Only anchors that occur twice or more go on.
2. The contexts of those anchors are cut out of the texts. Equal contexts shrink to the earliest in each task.
3. For each anchor the contexts' suffixes at the anchor are sorted, with their common prefix lengths: an
   enhanced suffix array. A stack scan gives its interval tree. Of each interval the left parts are sorted and scanned
   likewise: where left extensions differ, the interval splits. What comes out are the maximal repeats, as far as the
   anchor's strings reach, each with all its occurrences.

Anchors with very many contexts skip the third step: their strings meet as 128-bit digests in an aggregation, which
is linear and has no group in one task.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import by_batch, discard, utf8, written
from .simhash import text_hash

MIN = 100
K = 24
#: Contexts of one anchor that a task takes in one suffix array; larger groups are settled by digests, exactly.
GROUP_ROWS = 20_000
#: An anchor with so many different contexts in one task goes there without coming to the third step at all.
TASK_ROWS = 5000
_HELD = 48 << 20
_PART = 1 << 16
_LAST = (1 << 63) - 1
_POS = 17
_GOLD = 0x9E3779B97F4A7C15
_RANDOM = np.random.default_rng(20).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _rolled(b: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k bytes of b, from those of 1, 2, 4, ... bytes."""
    have, size, out, filled = _RANDOM[b], 1, None, 0
    while True:
        if k & size:
            if out is None:
                out, filled = have, size
            else:
                m = len(b) - filled - size + 1
                out = have[:m] * np.uint64(pow(_GOLD, filled, 1 << 64)) + out[size : size + m]
                filled += size
        if filled == k:
            break
        have = have[:-size] * np.uint64(pow(_GOLD, size, 1 << 64)) + have[size:]
        size *= 2
    out = out ^ (out >> np.uint64(29))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, start, anchor - start, strings) of each context of text, part by part."""
    n, span = len(text) - MIN + 1, MIN - K + 1
    for at in range(0, max(0, n), _PART):
        h = _rolled(np.frombuffer(text, np.uint8, min(_PART, n - at) + MIN - 1, at))
        low = np.uint64((1 << _POS) - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        m, size = key, 1
        while size * 2 <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        count = len(key) - span + 1
        m = np.minimum(m[:count], m[span - size : span - size + count])
        pos = (m & low).astype(np.int64)
        start = np.flatnonzero(np.diff(pos, prepend=-1))
        a = pos[start]
        yield h[a].view(np.int64), start + at, a - start, np.diff(start, append=len(pos))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """(h, known, id, start, anchor, n): known rows have a hash that occurs twice in one batch."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            parts = []
            for i, t in zip(b.column(0), utf8(b.column(1)), strict=True):
                for h, start, anchor, n in anchors(t or b""):
                    parts.append((h, np.full(len(h), i.as_py(), np.int64), start, anchor, n))
            h, ids, start, anchor, n = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(5))
            _, first, inverse, times = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            known = times[inverse] > 1
            # a known hash also sends one row without a context to the others' partition
            sent = first[times > 1]
            cat = lambda x, y: np.concatenate([x, y])
            zeros = np.zeros(len(sent), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(cat(h, h[sent])), pa.array(cat(known, zeros.astype(bool))), pa.array(cat(ids, ids[sent])), pa.array(cat(start, start[sent]).astype(np.int32)), pa.array(cat(anchor, anchor[sent]).astype(np.int16)), pa.array(cat(n, zeros).astype(np.int32))],
                ["h", "known", "id", "start", "anchor", "n"],
            )

        return one

    return by_batch(texts, make, "h long, known boolean, id long, start int, anchor short, n int")


def _repeated(rows: DataFrame) -> DataFrame:
    """The rows whose hash occurs twice or more: known ones pass, the others meet by hash, at most one of each batch."""
    dealt = rows.repartition(F.when(F.col("known"), F.xxhash64("id", "start")).otherwise(F.col("h")))

    def run(batches):
        t = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        known, n = (t[c].to_numpy() for c in ("known", "n"))
        other = np.flatnonzero(~known)
        h = t["h"].to_numpy()[other]
        _, inverse, times = np.unique(h, return_inverse=True, return_counts=True)
        keep = known.copy()
        keep[other] = (times[inverse] > 1) & (n[other] > 0)
        yield from t.filter(pa.array(keep)).select(["h", "id", "start", "anchor", "n"]).combine_chunks().to_batches(50_000)

    return dealt.mapInArrow(run, "h long, id long, start int, anchor short, n int")


_CONTEXT = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("anchor", pa.int16()), ("context", pa.binary()), ("hot", pa.bool_()), ("first_id", pa.int64()), ("first_start", pa.int32())])
_CONTEXT_DDL = "h long, id long, start int, stop int, anchor short, context binary, hot boolean, first_id long, first_start int"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _contexts(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """Rows with a context, the earliest of equal ones in the task; and rows without, for the others, with that earliest place."""
    places = repeated.groupBy("id").agg(F.collect_list(F.struct("h", "start", "anchor", "n")).alias("places")).hint("shuffle_hash")
    joined = texts.join(places, "id").select("id", "text", "places")

    def run(batches):
        held: dict[tuple, tuple[int, int]] = {}
        size, out = 0, []

        def settled():
            often: dict[int, int] = {}
            for h, _, _ in held:
                often[h] = often.get(h, 0) + 1
            for (h, anchor, context), (i, start) in held.items():
                yield (h, i, start, start + len(context), anchor, context, often[h] > TASK_ROWS, None, None)
            held.clear()

        for b in batches:
            lists = b.column(2)
            flat, ends = lists.flatten(), np.asarray(lists.offsets)
            ends = ends - ends[0]
            columns = [c.to_numpy(zero_copy_only=False) for c in flat.flatten()]
            for r, (i, t) in enumerate(zip(b.column(0), utf8(b.column(1)), strict=True)):
                i = i.as_py()
                for h, start, anchor, n in zip(*(c[ends[r] : ends[r + 1]].tolist() for c in columns), strict=True):
                    key = (h, anchor, t[start : start + n + MIN - 1])
                    at = (i, start)
                    before = held.setdefault(key, at)
                    if before is at:
                        size += n + MIN + 200
                    elif before != at:
                        if at < before:
                            held[key], before, at = at, at, before
                        out.append((h, *at, at[1] + n + MIN - 1, anchor, None, False, *before))
                if size > _HELD:
                    out += settled()
                    size = 0
                while len(out) >= 10_000:
                    yield _batch(out[:10_000], _CONTEXT)
                    del out[:10_000]
        out += settled()
        for k in range(0, len(out), 10_000):
            yield _batch(out[k : k + 10_000], _CONTEXT)

    return joined.mapInArrow(run, _CONTEXT_DDL)


def _prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7 >> 3)


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(value, value of the parent, first, last) of each node of the interval tree with two suffixes or more.

    lcp[i] is the common prefix of suffixes i and i + 1. A stack holds the open intervals; the root's parent has -1.
    """
    stack = [(-1, 0)]
    for i, v in enumerate([*lcp, -1]):
        first = i
        while stack[-1][0] > v:
            value, first = stack.pop()
            yield value, max(stack[-1][0], v), first, i
        if stack[-1][0] < v:
            stack.append((v, first))


def maximal_repeats(contexts: list[tuple[bytes, int]]) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members) for distinct contexts (bytes, place of the anchor in them): the members, all of them, share
    the string from `left` bytes before the anchor to `right` after its start, of MIN bytes or more; it is maximal among
    strings of the anchor. Each string of MIN bytes that two contexts share at the anchor is in one of these, with all its occurrences."""
    order = sorted(range(len(contexts)), key=lambda c: contexts[c][0][contexts[c][1] :])
    right = [contexts[c][0][contexts[c][1] :] for c in order]
    lefts = [contexts[c][0][: contexts[c][1]][::-1] for c in order]
    for depth, outer, i, j in intervals([_prefix(a, b) for a, b in zip(right, right[1:], strict=False)]):
        low, high = max(0, MIN - depth), min(MIN - K, MIN - outer - 1)
        if low > high:
            continue
        inside = sorted(range(i, j + 1), key=lefts.__getitem__)
        shared = [_prefix(lefts[a], lefts[b]) for a, b in zip(inside, inside[1:], strict=False)]
        for reach, less, first, last in intervals(shared):
            x, y = max(low, less + 1), min(high, reach)
            if x <= y:
                yield y, MIN - x, [order[m] for m in inside[first : last + 1]]


def _settle(rows: list[tuple], merged: bool) -> Iterator[tuple]:
    """(id, start, stop, first_id, first_start) for the occurrences that are not the first, of one anchor's rows (id, start, anchor, context).

    merged: only the bytes that they cover, one row for a context, without first places: all its strings hold the anchor, so what they cover is one span.
    """
    earliest: dict[tuple[bytes, int], tuple[int, int]] = {}
    for i, start, anchor, context in rows:
        at, key = (i, start), (context, anchor)
        before = earliest.setdefault(key, at)
        if before != at:
            if at < before:
                earliest[key], before, at = at, at, before
            yield (*at, at[1] + len(context), *before)
    if len(earliest) < 2:
        return
    keys = list(earliest)
    places = [(earliest[k][0], earliest[k][1] + k[1]) for k in keys]
    reach: dict[int, tuple[int, int]] = {}
    for left, right, members in maximal_repeats(keys):
        i, a = first = min(places[m] for m in members)
        for m in members:
            if places[m] != first:
                if merged:
                    x, y = reach.get(m, (0, 0))
                    reach[m] = max(x, left), max(y, right)
                else:
                    yield places[m][0], places[m][1] - left, places[m][1] + right, i, a - left
    for m, (left, right) in reach.items():
        yield places[m][0], places[m][1] - left, places[m][1] + right, None, None


_SPAN = pa.schema([("id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("first_id", pa.int64()), ("first_start", pa.int32()), ("h", pa.int64()), ("anchor", pa.int16()), ("context", pa.binary())])
_SPAN_DDL = "id long, start int, stop int, first_id long, first_start int, h long, anchor short, context binary"


def _by_suffix_array(contexts: DataFrame, merged: bool) -> DataFrame:
    """Spans; and, with their contexts, the rows of anchors with over GROUP_ROWS rows, which are left to digests."""
    dealt = contexts.select("h", "id", "start", "anchor", "context").repartition("h").sortWithinPartitions("h")

    def run(batches):
        now, rows, large = None, [], False

        def left():
            for i, start, anchor, context in rows:
                yield i, start, start + len(context), None, None, now, anchor, context
            rows.clear()

        def ended():
            if large:
                yield from left()
            else:
                yield from ((*s, None, None, None) for s in _settle(rows, merged))
                rows.clear()

        def found():
            nonlocal now, large
            for b in batches:
                for h, i, start, anchor, context in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if h != now:
                        yield from ended()
                        now, large = h, False
                    rows.append((i, start, anchor, context))
                    if len(rows) > GROUP_ROWS:
                        large = True
                        yield from left()
            yield from ended()

        out = []
        for row in found():
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out, _SPAN)
                out = []
        if out:
            yield _batch(out, _SPAN)

    return dealt.mapInArrow(run, _SPAN_DDL)


def _by_digest(contexts: DataFrame) -> DataFrame:
    """Spans of the contexts' strings that stand earlier elsewhere, for anchors whose contexts don't fit one suffix array."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for i, start, context in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for j in range(len(context) - MIN + 1):
                    d = hashlib.blake2b(context[j : j + MIN], digest_size=16).digest()
                    out.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), i, start + j))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "id", "start"])

        return one

    strings = by_batch(contexts.select("id", "start", "context"), make, "a long, b long, id long, start int")
    first = strings.groupBy("a", "b").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    ahead = strings.join(first, ["a", "b"])
    start = ahead.where("id = first_id").groupBy("a", "b").agg(F.min("start").alias("first_start"))
    later = ahead.join(start, ["a", "b"]).where("id != first_id or start != first_start")
    return later.select("id", "start", (F.col("start") + MIN).cast("int").alias("stop"), "first_id", "first_start")


def _release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """(id, key, text) for each row of docs, and (key, of): the id of each key, where keys aren't the ids themselves.

    A key is of one id and text. Where an id (null is one) has several texts, keys are numbers in the order of ids, nulls
    last, and of the texts' hashes.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("key"), text.alias("text"), text_hash(text).alias("_hash"))
    if rows.groupBy("key").agg((F.min("_hash") != F.max("_hash")).alias("several")).where("several").isEmpty():
        return rows.select("id", "key", "text"), None
    order = [F.col("of").asc_nulls_last(), F.col("of_hash").asc()]
    pairs = rows.select(F.col("id").cast("long").alias("of"), F.col("_hash").alias("of_hash")).distinct()
    keys = written(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()), "keys")
    keyed = rows.drop("key").join(keys, F.col("id").cast("long").eqNullSafe(F.col("of")) & (F.col("_hash") == F.col("of_hash")))
    return keyed.select("id", "key", "text"), keys.select("key", "of")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", merged: bool = False) -> DataFrame:
    """(id, start, stop, first_id, first_start): occurrences of repeated strings of MIN bytes or more, but for their first ones.

    The bytes start to stop of id's text also stand at first_start of first_id, which is earlier: a smaller id, or the
    same and an earlier start. Every string of MIN bytes that also starts earlier lies in one of the rows. Ids are integers;
    null ones are taken as the largest. Rows with one id and text count as the same document, seen again; rows with one id
    and different texts are documents of their own, in the order of the texts' hashes. Texts that are null
    or shorter than MIN give no rows. merged: what the rows cover is the same, in fewer rows; their first places may be null.
    """
    texts, keys = _keyed(docs, id_col, text_col)
    spans = _spans(texts.select(F.col("key").alias("id"), "text"), merged)
    if keys is None:
        return spans
    known = keys.withColumn("of", F.coalesce("of", F.lit(_LAST)))
    mine, first = known.toDF("id", "of"), known.toDF("first_id", "first_of")
    out = spans.join(mine, "id").join(first, "first_id", "left")
    return out.select(F.col("of").alias("id"), "start", "stop", F.col("first_of").alias("first_id"), "first_start")


def _spans(texts: DataFrame, merged: bool) -> DataFrame:
    """repeats() for texts (id, text) whose ids are keys of one text each."""
    spark = texts.sparkSession
    able = texts.where(F.octet_length("text") >= MIN)
    repeated = written(_repeated(_anchor_rows(able)), "anchors")
    _release(spark)
    cut = written(_contexts(able, repeated), "contexts")
    discard(repeated)
    _release(spark)
    held = cut.where(F.col("context").isNotNull())
    hot = held.where("hot").select("h").distinct()
    settled = written(_by_suffix_array(held.join(hot, "h", "left_anti"), merged), "spans")
    _release(spark)
    columns = ["id", "start", "stop", "first_id", "first_start"]
    rest = held.join(hot, "h", "left_semi").select("id", "start", "context").unionAll(settled.where(F.col("context").isNotNull()).select("id", "start", "context"))
    spans = cut.where(F.col("context").isNull()).select(columns).unionAll(settled.where(F.col("context").isNull()).select(columns)).unionAll(_by_digest(rest))
    return spans


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) for each row of docs; kept has the bytes that no row of repeats() covers.

    A null text is empty. Rows that repeat an id and text stay, and since they are one document they keep the same bytes. An empty table gives an empty one.
    """
    texts, _ = _keyed(docs, id_col, text_col)
    spans = written(_spans(texts.select(F.col("key").alias("id"), "text"), merged=True).select("id", "start", "stop"), "removed")
    _release(docs.sparkSession)
    lists = spans.groupBy("id").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).withColumnRenamed("id", "key").hint("shuffle_hash")
    joined = texts.join(lists, "key", "left").select("id", "text", "spans")

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for t, s in zip(utf8(b.column(1)), b.column(2), strict=True):
                t = t or b""
                if not s.is_valid:
                    out.append((len(t), 0, 0, t))
                    continue
                edges = np.zeros(len(t) + 1, np.int64)
                np.add.at(edges, s.values.field("start").to_numpy(), 1)
                np.add.at(edges, s.values.field("stop").to_numpy(), -1)
                gone = np.cumsum(edges)[:-1] > 0
                out.append((len(t), int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()), np.frombuffer(t, np.uint8)[~gone].tobytes()))
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[k] for x in out], pa.int64()) for k in range(3)), pa.array([x[3] for x in out], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

        return one

    return by_batch(joined, make, f"id {texts.schema['id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary")
