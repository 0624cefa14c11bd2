"""Quality rules: statistics of a text, hard rules on them, and an isolation forest for what the rules don't name."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_batch, discard, trim, utf8, written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
REPEAT = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["mean_word", "symbols", "dup_lines", "upper", "marks"]
TREES, TREE_ROWS = 100, 256
#: Thresholds are multiples of 1 / STEPS, a power of two, so that rows over them are counted exactly.
STEPS = 1 << 16
#: Share of good labelled rows that the threshold may reject.
LOST_GOOD = 0.01
#: Labelled rows of a task.
TASK_ROWS = 50_000
_LONG = 50_000


def repeated_words(words: list[bytes], width: int = REPEAT) -> int:
    """Words inside windows of `width` words that occur twice or more in the text, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    if n < _LONG:
        windows = list(zip(*(words[k:] for k in range(width)), strict=False))
        if len(set(windows)) == n:
            return 0
        often = Counter(windows)
        twice = np.fromiter((often[w] > 1 for w in windows), bool, n)
    else:  # a few numbers a word instead of tuples
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words))
        columns = np.lib.stride_tricks.sliding_window_view(at, width)
        order = np.lexsort([columns[:, k] for k in range(width)])
        same = (columns[order[1:]] == columns[order[:-1]]).all(1)
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + width, -1)
    return int((np.cumsum(inside) > 0).sum())


def measure(text: bytes | None) -> tuple[list[int], list[float]]:
    """(COUNTS, FEATURES) of a text; a null text has no words."""
    text = text or b""
    words = text.split()
    n = len(words)
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(byte.sum() - byte[0x80:0xC0].sum())
    chars = points - int(sum(byte[c] for c in SPACES))
    symbols = int(sum(byte[c] for c in SYMBOLS))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in text.split(b"\n"):
        if line.strip(SPACES):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(words)
    letters = max(1, chars - int(byte[0x21:0x41].sum() + byte[0x5B:0x61].sum() + byte[0x7B:0x7F].sum()))
    of = max(1, n)
    marks = int(byte[0x21:0x30].sum() + byte[0x3A:0x41].sum() + byte[0x5B:0x61].sum() + byte[0x7B:0x7F].sum())
    features = [chars / of, symbols / of, dup / max(1, lines), int(byte[0x41:0x5B].sum()) / letters, marks / of]
    return [n, chars, symbols, dup, repeats], features


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, *COUNTS, features) for each row of docs; features is an array in the order of FEATURES."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [measure(t) for t in utf8(b.column(1))]
            counts = np.array([x[0] for x in found], np.int64).reshape(-1, len(COUNTS))
            return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array([x[1] for x in found], pa.list_(pa.float64()))], ["id", *COUNTS, "features"])

        return one

    return by_batch(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(f'{c} long' for c in COUNTS)}, features array<double>")


class Forest:
    """Isolation forest (Liu, Ting and Zhou, 2008), grown a level at a time from summaries of its nodes, so that the rows can be anywhere.

    Every row grows trees: it goes to so many of them that a tree has `tree_rows` rows or more, where there are as many. A node counts by
    its share of its tree's rows, at `tree_rows` of them, so depths and scores compare however many rows there are. Cuts are uniform
    between the asinh of a node's least and greatest value: among many rows a few lie far out, and plain uniform cuts would go to the gap.
    Rows that aren't counted widen their nodes only: statistics that are constant in the others need them to split on.
    """

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7):
        h = np.random.default_rng(seed).integers(0, 1 << 62, len(rows))
        self._grow(len(rows), lambda forest: forest.summary([(h, np.ones(len(rows), np.int64), rows)]), trees, tree_rows, seed)

    @classmethod
    def of(cls, count: int, look: Callable[[Forest], tuple[np.ndarray, ...]], trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = 7) -> Forest:
        """The forest of rows of which look() makes summary(), `count` of them counted."""
        out = cls.__new__(cls)
        out._grow(count, look, trees, tree_rows, seed)
        return out

    def _grow(self, count: int, look: Callable, trees: int, tree_rows: int, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.rows = min(tree_rows, count)
        self.depth = max(1, math.ceil(math.log2(max(2, self.rows))))
        self.copies = min(trees, math.ceil(tree_rows * trees / max(1, count)))
        n = 2 ** (self.depth + 1) - 1  # the nodes below i are 2i + 1 and 2i + 2
        self.feature, self.cut = np.full((trees, n), -1, np.int32), np.zeros((trees, n))
        length, whole = np.zeros((trees, n)), np.zeros(trees)
        for self.level in range(self.depth + 1):
            slot, counts, low, high = look(self)
            tree, node = slot >> self.level, (slot & ((1 << self.level) - 1)) + (1 << self.level) - 1
            if self.level == 0:
                whole[tree] = counts
            mass = counts * self.rows / np.maximum(1, whole[tree])
            length[tree, node] = self.level + _expected(mass)
            able = high > low
            inner = np.flatnonzero((mass > 1) & able.any(1)) if self.level < self.depth else []
            f = np.where(able, rng.random(able.shape), -1.0).argmax(1)[inner]
            low, high = low[inner, f], high[inner, f]
            cut = np.arcsinh(low) + rng.random(len(inner)) * (np.arcsinh(high) - np.arcsinh(low))
            self.feature[tree[inner], node[inner]] = f
            self.cut[tree[inner], node[inner]] = np.clip(np.sinh(cut), np.nextafter(low, np.inf), high)  # rows on either side
        at = np.arange(n)[:, None]
        below = [np.where(f[:, None] < 0, at, 2 * at + [1, 2]).astype(np.int32) for f in self.feature]
        self.grown = np.flatnonzero(whole)
        self.trees = [(self.feature[t], self.cut[t], below[t], length[t]) for t in self.grown]

    def summary(self, parts: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
        """(slot, counted rows, least, greatest value by feature) of the deepest nodes that parts (hashes of 0 or more, 1 for counted
        and 0 for other rows, rows) have rows in; slot numbers them by tree."""
        trees, first = len(self.feature), (1 << self.level) - 1
        counts, there = np.zeros(trees << self.level, np.int64), np.zeros(trees << self.level, bool)
        low = high = None
        for h, counted, rows in parts:
            if low is None:
                low, high = np.full((len(counts), rows.shape[1]), np.inf), np.full((len(counts), rows.shape[1]), -np.inf)
            tree = ((h % trees)[:, None] + np.arange(self.copies)).ravel() % trees
            row = np.repeat(np.arange(len(rows)), self.copies)
            node = np.zeros(len(row), np.int64)
            for _ in range(self.level):
                f = self.feature[tree, node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[row, f] >= self.cut[tree, node]))
            row, slot = row[node >= first], ((tree << self.level) + node - first)[node >= first]
            if len(row):
                order = np.argsort(slot, kind="stable")
                row, slot = row[order], slot[order]
                starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                at = slot[starts]
                there[at] = True
                counts[at] += np.add.reduceat(counted[row], starts)
                low[at] = np.minimum(low[at], np.minimum.reduceat(rows[row], starts))
                high[at] = np.maximum(high[at], np.maximum.reduceat(rows[row], starts))
        slot = np.flatnonzero(there)
        return slot, counts[slot], *(np.zeros((0, 0)) if x is None else x[slot] for x in (low, high))

    def score(self, rows: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """0 to 1, higher for rows that fewer random splits isolate. h: hashes of rows that grew trees; these are then scored by the others, where those are half of the trees or more."""
        total, others, n = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows), np.int64)
        every = np.arange(len(rows))
        for t, (feature, cut, children, length) in zip(self.grown, self.trees, strict=True):
            at = np.zeros(len(rows), np.int32)
            for _ in range(self.depth):
                f = feature[at]
                at = children[at, (rows[every, f] >= cut[at]).astype(np.int8)]
            total += length[at]
            if h is not None and 2 * self.copies <= len(self.feature):
                other = (t - h) % len(self.feature) >= self.copies
                others[other] += length[at][other]
                n += other
        mean = np.where(n > 0, others / np.maximum(1, n), total / len(self.trees))
        return 2.0 ** -(mean / max(1e-9, float(_expected(self.rows))))


def _expected(n: float | np.ndarray) -> np.ndarray:
    """Mean path length of a search that fails among n rows; shares of rows lie between."""
    n = np.asarray(n, float)
    m = np.maximum(n, 2)
    return np.where(n > 2, np.maximum(1, 2 * (np.log(m - 1) + 0.5772156649015329) - 2 * (m - 1) / m), np.clip(n - 1, 0, 1))


def steps(score: np.ndarray) -> np.ndarray:
    """The number k for which a score is over (k - 1) / STEPS and not over k / STEPS."""
    return np.ceil(score * STEPS).astype(np.int64)


def threshold(good: np.ndarray, bad: np.ndarray, lost: float = LOST_GOOD) -> float:
    """The score over which a row is rejected, from the numbers of good and bad labelled rows by steps(): of the multiples of 1 / STEPS
    that reject at most the share `lost` of the good rows, that which rejects most bad ones less good ones; the least of equals.
    Where that gains nothing, no good row is over it; without good rows, nothing is."""
    if not good.sum():
        return float("inf")
    over_good, over_bad = (x.sum() - np.cumsum(x) for x in (good, bad))
    gain = np.where(over_good <= lost * good.sum(), over_bad / max(1, bad.sum()) - over_good / good.sum(), -1.0)
    best = int(gain.argmax()) if gain.max() > 1e-12 else int((over_good == 0).argmax())
    return best / STEPS


def _rows(b: pa.RecordBatch) -> np.ndarray:
    return b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _look(known: DataFrame) -> Callable[[Forest], tuple[np.ndarray, ...]]:
    """Forest.summary() over known (h, label, features): a task sends a row for each node, and good rows (label 1) are counted."""
    numbers = {"good": F.sum} | {f"low{k}": F.min for k in range(len(FEATURES))} | {f"high{k}": F.max for k in range(len(FEATURES))}

    def look(forest: Forest) -> tuple[np.ndarray, ...]:
        shared = known.sparkSession.sparkContext.broadcast(forest)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = ((b.column("h").to_numpy(), b.column("label").to_numpy(), _rows(b)) for b in batches if b.num_rows)
            slot, counts, low, high = shared.value.summary(parts)
            if len(slot):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, counts, *low.T, *high.T)], ["slot", *numbers])
            trim()

        sent = known.mapInArrow(run, ", ".join(["slot long", "good long", *(f"{c} double" for c in list(numbers)[1:])]))
        got = sent.groupBy("slot").agg(*(f(c).alias(c) for c, f in numbers.items())).toArrow().sort_by("slot")
        shared.destroy()
        low, high = (np.column_stack([got[f"{c}{k}"].to_numpy() for k in range(len(FEATURES))]) for c in ("low", "high"))
        return got["slot"].to_numpy(), got["good"].to_numpy(), low, high

    return look


def _scores(known: DataFrame, forest: Forest) -> np.ndarray:
    """Rows of known (h, label, features) by label and steps()."""
    shared = known.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * (STEPS + 1), np.int64)
        for b in batches:
            at = b.column("label").to_numpy() * (STEPS + 1) + steps(shared.value.score(_rows(b), b.column("h").to_numpy()))
            counts += np.bincount(at, minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["at", "n"])
        trim()

    got = known.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    shared.destroy()
    out = np.zeros(2 * (STEPS + 1), np.int64)
    out[got["at"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(2, -1)


def fit(known: DataFrame) -> tuple[Forest, float] | tuple[None, None]:
    """The forest and the threshold of labelled rows (h, label, features), h a hash of 0 or more: all of them grow trees, bad ones (label 0)
    without being counted, and all set the threshold, by the trees that they didn't grow."""
    n = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    if n.get(1, 0) < 2:
        return None, None
    known = known.coalesce(1 + sum(n.values()) // TASK_ROWS)
    forest = Forest.of(n[1], _look(known))
    bad, good = _scores(known, forest)
    return forest, threshold(good, bad)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(id, *COUNTS, base_failed, score, kept) for each row of docs.

    The forest and its threshold come from the statistics of all rows that are labelled good (1) or bad (0) and hold the hard rules, see fit().
    Every row is then scored. kept: the hard rules hold and the score is not over the threshold. Rows with a null id or label are no labels; of repeated labels for an id the least counts.
    Without two good labels only the hard rules decide. Repeated rows stay; empty tables give an empty one.
    """
    stats = written(statistics(docs, id_col, text_col), "statistics")
    marked = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)").groupBy("id").agg(F.min("label").alias("label"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    h = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 1).alias("h")
    known = written(stats.where(~failed).join(marked, "id").select(h, F.col("label").cast("long").alias("label"), "features"), "labelled")
    model, cut = fit(known)
    discard(known)
    shared = docs.sparkSession.sparkContext.broadcast((model, cut))
    kept = stats.columns[:-1]

    def make():
        forest, cut = shared.value

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            x = _rows(b)
            score = forest.score(x) if forest else np.zeros(b.num_rows)
            fine = score <= cut if forest else np.ones(b.num_rows, bool)
            return pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(score), pa.array(fine)], [*kept, "score", "fine"])

        return one

    scored = by_batch(stats, make, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in stats.schema.fields[:-1])}, score double, fine boolean")
    return scored.select(*kept, failed.alias("base_failed"), "score", (~failed & F.col("fine")).alias("kept"))
