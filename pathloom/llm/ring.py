"""Near-duplicates of word shingles by wide SimHash fingerprints on a ring of segments, at a set similarity of 4/5 or more.

A text's set holds the hashes of its shingles of WIDTH words; equal sets are one node. Its fingerprint has RING segments of
64 bits, each the SimHash of the shingles that fall to the segment by their hash.

1. Keys. Two sets of similarity 4/5 whose sizes are under s differ in D = 2(s - 1)/9 shingles at most. Dealt to D + 1 segments,
   they agree in one whole segment: the start of a chain in which, by the pigeonring principle, the segments differ
   in 0, then at most 1, then at most 2 shingles together. A segment's shingles are a key. Sets for which D would be SEGMENTS or more
   deal a part of their shingles, chosen by hash, to SEGMENTS segments. Sets that share a key then meet by the chain's first two
   segments: the first as it is, the second with at most 1 difference. What has only a common passage in the first falls apart there.
2. Hubs. In each bucket that holds two components or more, the members meet one of them, the bucket's hub: first the member that
   shares most with others, then another. A set goes on with the hub whose fingerprint is nearest. A group of copies is thus
   linked without its pairs.
3. Sets in buckets that still hold two components or more: in buckets of up to PAIR_ROWS rows as pairs, else by their rarest
   shingles. In any order of all shingles, two close sets share one of the first n - m + 1 of each, m being what they must share. With the
   shingles that the fewest of them have first, a set that has many to itself meets nobody, where pairs within the
   buckets would be of the square of a group's size.
4. A pair must have a chain of segments whose fingerprint bits differ within the proportional budget, and then not more
   than BITS of all bits. What passes is verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import release, trim, utf8, written
from .simhash import marked, text_hash

WIDTH = 5
#: A pair is close if its similarity is UP / DOWN or more.
UP, DOWN = 4, 5
#: Segments of shingles that make keys, segments of the fingerprint, and the bits of all of those that may differ.
SEGMENTS, RING = 16, 16
BITS = 13 * RING
#: A chain of so many segments is asked of a pair.
CHAIN = 8
#: Of larger sets' shingles so many that differ are dealt, on average, at a similarity of just 4/5.
DEALT = 16
#: Rounds of hubs; buckets of so many rows are taken as pairs after them.
ROUNDS, PAIR_ROWS = 2, 16
#: Sets of a hub's group that one task verifies, and rows up to which a table of keys is broadcast.
GROUP_ROWS, KEYS = 200, 250_000
#: Texts that a worker holds the sets of at a time.
_SLICE = 500
_MIX = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Sizes from which a class starts: each is 5/4 of the one before or more.
_STARTS = [1]
while _STARTS[-1] < 1 << 40:
    _STARTS.append(-(-_STARTS[-1] * DOWN // UP))
_STARTS = np.array(_STARTS, np.int64)


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of the hashes of lower-cased (A-Z) word shingles; fewer words are one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(width, len(words))):
        h += one[k : k + n] * _MIX[k]
    return np.unique(_mixed(h))


def _node(s: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(s.tobytes(), 42) - (1 << 63)


def fingerprint(s: np.ndarray) -> np.ndarray:
    """RING longs: segment k has the SimHash of the shingles whose hash starts with k; 0 without any."""
    out = np.zeros((RING, 64), bool)
    at = (s >> np.uint64(60)).astype(np.int64)  # s is sorted, so are segments
    there, first = np.unique(at, return_index=True)
    ends = [*first[1:], len(s)]
    bits = _mixed(s + _MIX[7])
    for k, i, j in zip(there.tolist(), first.tolist(), ends, strict=False):
        n = np.zeros(64, np.int64)
        for x in range(i, j, 1 << 16):
            part = bits[x : min(j, x + (1 << 16))]
            n += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = 2 * n > j - i
    return np.packbits(out, axis=1, bitorder="little").view(np.int64)[:, 0]


def size_class(n: int) -> int:
    return int(np.searchsorted(_STARTS, n, side="right")) - 1


def _dealt(s: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, segments, number of segments) of the shingles that class c looks at, for sets of up to the class's sizes."""
    differ = 2 * (int(_STARTS[c + 1]) - 1) // (UP + DOWN)
    if differ >= SEGMENTS:
        s = s[(s & np.uint64(0xFFFFFF)) < np.uint64((DEALT << 24) // (differ + 1))]
    m = min(SEGMENTS, differ + 1)
    return _mixed(s + _MIX[8]), ((s >> np.uint64(24) & np.uint64(0xFFFFFFFF)) * np.uint64(m) >> np.uint64(32)).astype(np.int64), m


def keys_of(s: np.ndarray, c: int, shared: set[int] | None = None) -> list[int]:
    """Buckets of a set in class c: a key of each segment's shingles; with `shared`, keys of the chains that start with one of those.

    A chain's keys have the first segment and the second, as it is and without each one of its shingles: sets that agree in the
    first and differ in one shingle at most in the second have one of those in common. An empty segment has its chain's keys at once.
    """
    h, at, m = _dealt(s, c)
    if m == 1:  # such sets are close only if they are equal
        return []
    sums, count = np.zeros(m, np.uint64), np.bincount(at, minlength=m)
    np.add.at(sums, at, h)
    tags = _mixed(np.arange(m, dtype=np.uint64) + _MIX[9] * np.arange(64 * c + 1, 64 * c + 2, dtype=np.uint64))
    first = _mixed(sums * _MIX[10] + tags).view(np.int64)
    out = []
    for k in range(m):
        if count[k] and (shared is None or int(first[k]) not in shared):
            out += [int(first[k])] if shared is None else []
            continue
        n = (k + 1) % m
        nexts = np.concatenate([sums[n : n + 1], sums[n] - h[at == n]])
        chain = _mixed(nexts * _MIX[11] + first[k : k + 1].view(np.uint64) * _MIX[12]).view(np.int64).tolist()
        out += chain if shared is None or count[k] else shared.intersection(chain)
    return out


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64()))


def _by_slice(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """by_batch() over few rows at a time: what a text makes may be larger than the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for at in range(0, b.num_rows, _SLICE):
                out = f(b.slice(at, _SLICE))
                if out.num_rows:
                    yield out
        trim()

    return df.mapInArrow(run, schema)


def _sets(rows: DataFrame, width: int) -> DataFrame:
    """(id, text_hash, node, n, fp, keys, own) for rows (id, text_hash, text).

    n: the set's size; fp: the fingerprint; keys: those of the size's class, `own` of them, then those of the class above, in which
    the set meets larger ones. fp and keys are empty where the task has had the node before.
    """

    def make():
        seen = set()

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            nodes, sizes, fps, keys, own = [], [], [], [], []
            for t in utf8(b.column(2)):
                s = shingles(t, width)
                i = _node(s)
                nodes.append(i)
                sizes.append(len(s))
                if i in seen:
                    fps.append(np.zeros(0, np.int64))
                    keys.append(np.zeros(0, np.int64))
                    own.append(0)
                    continue
                seen.add(i)
                fps.append(fingerprint(s))
                c = size_class(len(s))
                both = [keys_of(s, d) if len(s) else [] for d in (c, c + 1)]
                own.append(len(both[0]))
                keys.append(np.array(both[0] + both[1], np.int64))
            arrays = [b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), _lists(fps), _lists(keys), pa.array(own, pa.int32())]
            return pa.RecordBatch.from_arrays(arrays, ["id", "text_hash", "node", "n", "fp", "keys", "own"])

        return one

    return _by_slice(rows, make, f"id {rows.schema['id'].dataType.simpleString()}, text_hash long, node long, n int, fp array<long>, keys array<long>, own int")


def _key(i: str, h: str) -> Column:
    return F.xxhash64(F.col(i), F.col(h))


def _rooted(buckets: DataFrame, roots: DataFrame | None, salt: int) -> DataFrame:
    """The rows of buckets (key, node, n, own, weight) whose key has two components or more, with root, the key's rows (many) and a hub.

    weight: how much the set shares with others; the hub of salt 0 is the member with the most, later ones any.
    """
    rooted = buckets.withColumn("root", F.col("node")) if roots is None else buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by = F.xxhash64("node", F.lit(salt)) if salt else F.struct("weight", "node")
    # the sums of each task go to the shuffle, so a bucket of any size is no hot key there
    found = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("many"), F.max_by(F.struct("node", "n", "own", "root"), by).alias("hub"))
    return rooted.join(found.where("low < high").select("key", "many", "hub"), "key").select("key", "node", "n", "own", "weight", "root", "many", "hub")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (key, node, n, own) whose key has two nodes or more, and that key's rows (many)."""
    found = rows.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("many")).where("low < high").select("key", "many")
    out = written(rows.join(found, "key").select("key", "node", "n", "own", "many"), "shared")
    release(rows.sparkSession)
    return out


def _chains(shared: DataFrame, rows: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """(key, node, n, own) of the chains that start in the shared keys (key, node)."""

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            out = [np.zeros((4, 0), np.int64)]
            for t, node, keys in zip(utf8(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                s, keys = shingles(t, width), set(keys)
                if _node(s) != node:  # another row with the same key
                    continue
                c = size_class(len(s))
                for d in (c, c + 1):
                    found = np.array(keys_of(s, d, keys), np.int64)
                    out.append(np.stack([found, np.full(len(found), node), np.full(len(found), len(s)), np.full(len(found), d == c)]))
            key, node, n, own = np.concatenate(out, axis=1)
            return pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n.astype(np.int32)), pa.array(own.astype(bool))], ["key", "node", "n", "own"])

        return one

    wanted = shared.groupBy("node").agg(F.collect_set("key").alias("keys"))
    return _by_slice(_at(rows, sets, wanted).select("text", "node", "keys"), make, "key long, node long, n int, own boolean")


def _possible(a: str, b: str) -> Column:
    """Whether the sizes of two sets let them be close; they meet in the class of the larger one."""
    return (DOWN * F.least(f"{a}n", f"{b}n") >= UP * F.greatest(f"{a}n", f"{b}n")) & (F.col(f"{a}own") | F.col(f"{b}own")) & (F.col(f"{a}root") != F.col(f"{b}root"))


def chained(differ: Column, chain: int = CHAIN, bits: int = BITS) -> Column:
    """Whether the ring of segments' differences has a start from which 1, 2, ... chain segments differ in at most so many shares of bits.

    One pass over the ring and its beginning again: where a chain breaks, no chain that starts inside it is whole.
    """
    share = bits // RING
    start = F.struct(F.lit(0).alias("over"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(a: Column, d: Column) -> Column:
        over = a["over"] + d - share
        n = F.when(over <= 0, a["n"] + 1).otherwise(0)
        return F.struct(F.when(over <= 0, over).otherwise(0).alias("over"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

    return F.aggregate(F.flatten(F.array_repeat(differ, 2)), start, step, lambda a: a["most"]) >= chain


def _near(pairs: DataFrame, light: DataFrame) -> DataFrame:
    """(a, b, bits): the pairs (a, b), without repeats, that pass the chain and then the whole distance."""
    side = lambda c: light.select(F.col("node").alias(c), F.col("fp").alias(f"fp_{c}"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    differ = F.zip_with("fp_a", "fp_b", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    passed = both.where(chained(differ)).select("a", "b", F.aggregate(differ, F.lit(0), lambda m, x: m + x).alias("bits"))
    return passed.where(F.col("bits") <= BITS)


def _at(rows: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (node, ...) with the text of one row of each node."""
    nodes = wanted.select("node").distinct()
    first = sets.join(nodes, "node", "left_semi").groupBy("node").agg(F.min(_key("id", "text_hash")).alias("key"))
    places = written(wanted.join(first, "node"), "places")
    near = F.broadcast(places) if places.count() <= KEYS else places
    return rows.select(_key("id", "text_hash").alias("key"), "text").join(near, "key").drop("key")


def _verified(pairs: DataFrame, rows: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are close. b's texts go to a's, in parts of about GROUP_ROWS, each text once for a pair."""
    part = F.pmod(F.xxhash64("b"), F.ceil(F.col("m") / GROUP_ROWS)).cast("int").alias("part")
    pairs = written(pairs.join(pairs.groupBy("a").agg(F.count("*").alias("m")), "a").select("a", "b", part), "candidates")
    wanted = pairs.select(F.col("b").alias("node"), "a", "part").unionAll(pairs.select(F.col("a").alias("node"), "a", "part").distinct())
    met = _at(rows, sets, wanted).select("a", "part", "node", "text")
    dealt = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("node") != F.col("a"))

    def run(batches):
        a = hub = None
        for b in batches:
            out = []
            for x, node, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), utf8(b.column(3)), strict=True):
                s = shingles(t, width)
                if _node(s) != node:  # another row with the same key
                    continue
                if node == x:
                    a, hub = x, s
                elif x == a and (UP + DOWN) * len(np.intersect1d(s, hub, assume_unique=True)) >= UP * (len(s) + len(hub)):
                    out.append((x, node))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
        trim()

    out = written(dealt.mapInArrow(run, "a long, b long"), "close")
    release(rows.sparkSession)
    return out


def _start(n: Column) -> Column:
    """The smallest size in n's cell: 32 cells or more from each power of two to the next."""
    by = F.greatest(F.length(F.bin(n.cast("long"))) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", n, by), by)


def _by_rare(left: DataFrame, rows: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """Pairs (a, b) of left (node, root), of different roots, that share a rare shingle early enough to be close.

    Shingles go from rare to frequent among the sets of left. For each cell of sizes that the smaller one of a pair can have, a set sends as many
    as a partner from there on calls for; a set that has many shingles to itself thus sends nothing that others have.
    """

    def make():
        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [(s, n, r) for t, n, r in zip(utf8(b.column(0)), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True) if _node(s := shingles(t, width)) == n]
            return pa.RecordBatch.from_arrays([pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), _lists([f[0].view(np.int64) for f in found])], ["node", "root", "s"])

        return one

    tokens = _by_slice(_at(rows, sets, left).select("text", "node", "root"), make, "node long, root long, s array<long>").dropDuplicates(["node"])
    tokens = written(tokens.withColumn("i", F.monotonically_increasing_id()), "shingles")
    release(rows.sparkSession)
    each = tokens.select("i", F.explode("s").alias("tok"))
    times = each.groupBy("tok").agg(F.count("*").alias("times")).where("times > 1")
    # shingles that a set has to itself come first, so their number is enough
    others = each.join(times, "tok").groupBy("i").agg(F.array_sort(F.collect_list(F.struct("times", "tok"))).alias("others"))
    ordered = tokens.select("i", "node", "root", F.size("s").alias("n")).join(others, "i").withColumn("own", F.col("n") - F.size("others"))
    least = lambda n: F.ceil(n * UP / DOWN).cast("int")
    starts = F.array_distinct(F.transform(F.sequence(least(F.col("n")), F.col("n")), _start))
    cells = ordered.select("node", "root", "n", "own", "others", F.explode(starts).alias("cell"))
    must = F.ceil((F.col("n") + F.greatest("cell", least(F.col("n")))) * UP / (UP + DOWN)).cast("int")
    prefix = F.greatest(F.col("n") - must + 1 - F.col("own"), F.lit(0))
    sent = cells.select("node", "root", "n", "cell", "own", F.posexplode(F.slice("others.tok", 1, prefix)).alias("at", "tok")).withColumn("at", F.col("own") + F.col("at"))
    sent = written(sent, "rare")
    ends = sent.groupBy("cell", "tok").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("cell", "tok")
    some = sent.join(ends, ["cell", "tok"])
    x, y = (some.select("cell", "tok", *(F.col(c).alias(f"{p}{c}") for c in ("node", "root", "n", "at"))) for p in ("a_", "b_"))
    shared = 1 + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) - 1
    close = (F.col("a_root") != F.col("b_root")) & (F.col("cell") == _start(F.least("a_n", "b_n"))) & ((UP + DOWN) * shared >= UP * (F.col("a_n") + F.col("b_n")))
    return x.join(y, ["cell", "tok"]).where((F.col("a_node") < F.col("b_node")) & close).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, text_hash, fp, component_id, is_kept) for each row of docs, as simhash.near_duplicates() has them; fp is the hash of the set.

    Components are those of pairs of texts whose sets of shingles have a Jaccard similarity of 4/5 or more. Every link that is
    made is verified on the whole sets. Links of sets of up to 72 shingles are all found but where two segments in a row are empty
    or the bits are over BITS; larger sets deal a part of their shingles, which finds a link of similarity just 4/5 in about
    99 of 100 cases and closer ones in nearly all. Texts without words are one group. Null ids, repeated rows, empty tables and
    other columns: as simhash.near_duplicates().
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text_hash(text).alias("text_hash"), text.alias("text"))
    sets = written(_sets(rows, width), "sets")
    light = written(sets.where(F.size("fp") > 0).select("node", "fp").dropDuplicates(["node"]), "light")
    n = light.count()
    keyed = sets.select("node", "n", "own", F.posexplode("keys").alias("at", "key")).select("key", "node", "n", (F.col("at") < F.col("own")).alias("own")).distinct()
    shared = _shared(keyed)
    chains = _shared(written(_chains(shared, rows, sets, width), "chains"))
    weights = chains.groupBy("node").agg(F.sum(F.log2("many")).alias("weight"))
    buckets, links, roots = chains.join(weights, "node").select("key", "node", "n", "own", "weight"), None, None
    for salt in range(ROUNDS):
        buckets = written(_rooted(buckets, roots, salt), "buckets")
        release(spark)
        met = buckets.select("node", "n", "own", "root", *(F.col(f"hub.{c}").alias(f"hub_{c}") for c in ("node", "n", "own", "root"))).where(_possible("", "hub_"))
        near = _near(met.select(F.col("hub_node").alias("a"), F.col("node").alias("b")), light)
        close = _verified(near.groupBy("b").agg(F.min_by("a", F.struct("bits", "a")).alias("a")).select("a", "b"), rows, sets, width)
        buckets = buckets.select("key", "node", "n", "own", "weight")
        links = close if links is None else links.unionAll(close)
        roots = written(components(links), "roots", n)
    left = written(_rooted(buckets, roots, ROUNDS).select("key", "node", "n", "own", "root", "many"), "left")
    few = left.where(F.col("many") <= PAIR_ROWS)
    x, y = (few.select("key", *(F.col(c).alias(f"{p}{c}") for c in ("node", "n", "own", "root"))) for p in ("a_", "b_"))
    pairs = x.join(y, "key").where((F.col("a_node") < F.col("b_node")) & _possible("a_", "b_")).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))
    pairs = pairs.unionAll(_by_rare(left.where(F.col("many") > PAIR_ROWS).select("node", "root").distinct(), rows, sets, width))
    last = _verified(_near(pairs, light).select("a", "b"), rows, sets, width)
    release(spark)
    links = last if links is None else links.unionAll(last)
    return marked(sets.select("id", "text_hash", F.col("node").alias("fp")), links, n)
