"""Benchmark decontamination: a prefix-filtered set join of item windows with documents.

An item's window (10 consecutive words) is the set of its word shingles. A document that contains the window contains
all of them, so with the shingles in one global order, rarest in the corpus first, the necessary prefix is the first
shingle alone: it is what is joined. Its place bounds the rest: it fixes where the window starts in the document, and
the window must fit between the document's ends. Then the words are compared.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, utf8, written

WINDOW = 10
SHINGLE = 3
#: Words of distinct windows that go to the tasks at once, and their bytes. A larger benchmark is taken in blocks, each against all documents.
BLOCK_WORDS = 5_000_000
BLOCK_BYTES = 32 << 20
_KEPT = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEPT else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _shingles(words: list[bytes], width: int = SHINGLE) -> list[bytes]:
    return [b" ".join(s) for s in zip(*(words[k:] for k in range(width)), strict=False)]


def windows_of(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(w, items): the distinct windows of all items, words joined by blanks, and the ids that have each. Null ids are ''."""
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(item_text_col).cast("string").alias("t"))

    def run(batches):
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                w = words_of(t)
                starts = range(max(1, len(w) - window + 1) if w else 0)
                for k in range(0, len(starts), 50_000):
                    part = [b" ".join(w[j : j + window]) for j in starts[k : k + 50_000]]
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(part), pa.string()), pa.array(part, pa.binary())], ["i", "w"])

    return items.mapInArrow(run, "i string, w binary").groupBy("w").agg(F.sort_array(F.collect_set("i")).alias("items"))


def _width(window: tuple) -> int:
    return min(SHINGLE, len(window))


def rarity(docs: DataFrame, wanted: list[bytes], text_col: str) -> dict[bytes, int]:
    """How often each wanted shingle occurs in all documents; as many rows come back as are wanted, at most."""
    if not wanted:
        return {}
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(wanted))
    widths = sorted({len(s.split(b" ")) for s in wanted})

    def run(batches):
        n: Counter = Counter()
        for b in batches:
            for t in utf8(b.column(0)):
                w = words_of(t)
                for k in widths:
                    n.update(filter(shared.value.__contains__, w if k == 1 else _shingles(w, k)))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["s", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.s): r.n for r in rows}


def prefix_index(windows, counts: dict[bytes, int]) -> dict[bytes, list[tuple[int, tuple[bytes, ...]]]]:
    """Rarest shingle -> (its offset in the window, window). Ties in rarity go by the shingle's bytes."""
    index: dict[bytes, list[tuple[int, tuple[bytes, ...]]]] = defaultdict(list)
    for w in windows:
        s = _shingles(list(w), _width(w))
        at = min(range(len(s)), key=lambda i: (counts.get(s[i], 0), s[i], i))
        index[s[at]].append((at, w))
    return dict(index)


def occurrences(words: list[bytes], index, widths: list[int]) -> list[tuple[int, tuple[bytes, ...]]]:
    """(start, window) of every occurrence of a window in words."""
    out = []
    for k in widths:
        for i, s in enumerate(words if k == 1 else _shingles(words, k)):
            if s in index:
                for offset, w in index[s]:
                    start = i - offset
                    if _width(w) == k and 0 <= start <= len(words) - len(w) and tuple(words[start : start + len(w)]) == w:
                        out.append((start, w))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(*keep, id, n_words, n_hit, items, spans) for each row of docs.

    items: the item ids (as strings, sorted) with a window in the document; spans: (start, end) word ranges that
    occurrences cover, merged. Windows of all items are taken in blocks by their hash, of about block_words words and BLOCK_BYTES bytes, so the broadcast
    of a benchmark of any size, or with items of any size, stays bounded; with more than one block each block is a pass over all documents,
    joined by the row's number. Null or empty texts have no words; null item ids count as the item ''. Repeated rows stay; texts of
    any length are read whole, a text's matches cost time in proportion to their number.
    """
    windows = written(windows_of(benchmark, item_col, item_text_col, window), "windows")
    size = windows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("w") + F.aggregate("items", F.lit(0), lambda a, i: a + F.octet_length(i))), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size.n * window // block_words), -(-size.bytes // BLOCK_BYTES), 1)
    # a text, or an id, that is kept goes to Python once
    name = {id_col: "id"} | ({text_col: "text"} if docs.schema[text_col].dataType.simpleString() == "string" else {})
    name = {c: name.get(c, f"keep_{c}") for c in keep}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(k) for c, k in name.items() if k not in ("id", "text")))
    if blocks > 1:
        rows = written(rows.withColumn("n", F.monotonically_increasing_id()), "documents")
    kept = rows.columns[1 if "text" in name.values() else 2 :]
    fields = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, spans {_SPANS}, items array<string>{fields}"
    out = None
    for k in range(blocks):  # the driver holds one block at a time
        block = windows.where(F.pmod(F.xxhash64("w"), F.lit(blocks)) == k) if blocks > 1 else windows
        part = _matched(rows, {tuple(bytes(r.w).split(b" ")): r["items"] for r in block.collect()}, kept, schema)
        out = part if out is None else out.unionAll(part)
    if blocks > 1:
        same = [F.first(c).alias(c) for c in ("id", "n_words", *kept[:-1])]
        out = out.groupBy("n").agg(*same, F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        out = by_batch(out.select("id", "n_words", "spans", "items", *kept[:-1]), _merged, schema.removesuffix(", `n` bigint"))
    return out.select(*(F.col(name[c]).alias(c) for c in keep), "id", "n_words", F.expr("aggregate(spans, 0L, (a, s) -> a + s.stop - s.start)").alias("n_hit"), "items", "spans")


_SPANS = "array<struct<start:long,stop:long>>"
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _merged():
    """The batches with spans that overlap or touch made one."""

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for spans in b.column(2).to_pylist():
            row: list[dict] = []
            for s in sorted(spans, key=lambda s: (s["start"], s["stop"])):
                if row and s["start"] <= row[-1]["stop"]:
                    row[-1]["stop"] = max(row[-1]["stop"], s["stop"])
                else:
                    row.append(s)
            out.append(row)
        return pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, _SPANS_ARROW), *b.columns[3:]], b.schema.names)

    return one


def _matched(rows: DataFrame, windows, kept: list[str], schema: str) -> DataFrame:
    every = sorted({s for w in windows for s in _shingles(list(w), _width(w))})
    counts = rarity(rows, every, "text")
    index = prefix_index(windows, counts)
    widths = sorted({_width(w) for w in windows})
    shared = rows.sparkSession.sparkContext.broadcast((index, windows, widths))

    def make():
        index, items, widths = shared.value

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            n, hits, found = [], [], []
            for t in utf8(b.column(1)):
                words = words_of(t)
                n.append(len(words))
                got = occurrences(words, index, widths)
                found.append(sorted({i for _, w in got for i in items[w]}))
                covered = np.zeros(len(words) + 1 if got else 0, np.int64)
                for s, w in got:
                    covered[s : s + len(w)] = 1
                edge = np.flatnonzero(np.diff(covered, prepend=0))
                hits.append([{"start": int(s), "stop": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(hits, _SPANS_ARROW), pa.array(found, pa.list_(pa.string())), *b.columns[b.num_columns - len(kept) :]], ["id", "n_words", "spans", "items", *kept])

        return one

    return by_batch(rows, make, schema)
