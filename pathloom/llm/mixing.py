"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with weight w and n of the N rows has the mean repetition rate w * N / n (weights sum to 1). Each document's
number of copies is the inverse of that Poisson distribution at a uniform number that its id and the seed hash to: the
same on every run and after the loss of an executor. Means over ONE_TABLE are sums of draws with smaller means, each
with a hash of its own; that is Poisson too, and costs as much as the copies that come out. Copies are dealt over all partitions by a hash of id and copy and
sorted by it inside, which is a global shuffle without sampling.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Up to this mean one table serves: exp(-rate) is a normal double. Beyond, a draw has a mean of DRAW_RATE at most.
ONE_TABLE, DRAW_RATE = 700.0, 500.0
#: A row's copies are made in blocks of so many, so that no array grows with their number.
BLOCK = 10_000
#: Up to as many sources the table of sources is broadcast; with more it is joined by a shuffle.
BROADCAST_SOURCES = 5000


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of seed:key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as far as a double tells them from 1; empty at rate 0."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["c"])).otherwise(F.array().cast("array<double>"))


def rates(docs: DataFrame, weights: dict[str, float], source_col: str = "source", rest: float = 0.0, most_rate: float = math.inf) -> DataFrame:
    """(source, n, rate, draws, c) for each source of docs. A source (null is one too) that weights lacks has the weight rest.

    Weights are relative: they are scaled so that those of the sources present sum to 1. c is the table of one of the
    source's draws. A rate over most_rate, if one is given, is an error.
    """
    if any(not (w >= 0 and math.isfinite(w)) for w in [*weights.values(), rest]):
        raise ValueError("weights must be finite and not negative")
    named = F.element_at(F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))), F.col("source")) if weights else F.lit(None).cast("double")
    counts = written(docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n")), "sources").withColumn("w", F.coalesce(F.when(F.col("source").isNotNull(), named), F.lit(float(rest))))
    total = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w"), F.count("*").alias("sources")).first()
    rate = F.col("w") / F.lit(total.w) * F.lit(total.n) / F.col("n") if total.w else F.lit(0.0)
    draws = F.when(F.col("rate") > ONE_TABLE, F.ceil(F.col("rate") / DRAW_RATE)).otherwise(1).cast("int")
    out = counts.withColumn("rate", rate).withColumn("draws", draws)
    refused = F.raise_error(F.concat(F.lit("mean repetition rate over the limit: "), F.col("rate").cast("string")))
    out = out.select("source", "n", "rate", "draws", F.when(F.col("rate") > most_rate, refused).otherwise(cumulative(F.col("rate") / F.col("draws"))).alias("c"))
    return F.broadcast(out) if total.sources <= BROADCAST_SOURCES else out


def mix(docs: DataFrame, weights: dict[str, float], seed: int = 42, id_col: str = "doc_id", source_col: str = "source", rest: float = 0.0, partitions: int | None = None, most_rate: float = math.inf) -> DataFrame:
    """docs' columns and copy (from 1), shuffle_key: each row as often as its Poisson count says, in shuffled order.

    Rows with the same id have the same count and keys; a null id hashes as the empty text. Sources without weight and
    an empty table give no rows. Columns of docs named copy or shuffle_key are replaced.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in ("copy", "shuffle_key"))).alias("row"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("key"), F.col(source_col).cast("string").alias("source"))
    table = rates(docs, weights, source_col, rest, most_rate).select(F.col("source").alias("named"), "draws", "c")
    several = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(F.concat_ws(":", "key", F.lit("draw"), j.cast("string")), seed))
    us = F.when(F.col("draws") == 1, F.array(uniform(F.col("key"), seed))).otherwise(several)
    counted = rows.join(table, F.col("source").eqNullSafe(F.col("named"))).withColumn("us", us)
    counted = counted.withColumn("n", F.aggregate("us", F.lit(0), lambda n, u: n + F.size(F.filter("c", lambda c: c <= u)))).where("n > 0")
    blocks = counted.select("row", "key", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))).alias("block"))
    copies = blocks.select("row", "key", F.explode(F.sequence(F.col("block") * BLOCK + 1, F.least("n", (F.col("block") + 1) * BLOCK))).alias("copy"))
    copies = copies.select("row.*", "copy", F.md5(F.concat_ws(":", F.lit(str(seed)), "key", F.col("copy").cast("string")).cast("binary")).alias("shuffle_key"))
    dealt = copies.repartition(partitions, "shuffle_key") if partitions else copies.repartition("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key")
