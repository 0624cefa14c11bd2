"""Connected components by alternating stars (Kiveris et al., 2014), on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(a, b): root is the smallest node that can be reached.

    Each round is a groupBy and a join on the node, both split by the shuffle, so no task holds a
    component; the round's edges go to a table in the shared folder. Loops, repeated edges and rows
    with a null end add nothing. Empty edges give an empty table.
    """
    now = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"), F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    now = written(now.where(now[2]).select("v", "u").distinct(), "edges")
    size = lambda t: t.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("h")).first()
    n = size(now)
    while n.n:
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = now.select(F.col("v").alias("n"), F.col("u").alias("o")).unionAll(now.select(F.col("u").alias("n"), F.col("v").alias("o")))
        least = both.groupBy("n").agg(F.min("o").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("o > n").join(least, "n").select(F.col("o").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("v != u").distinct()
        then = written(small, "edges", n.n)
        discard(now)
        now = then
        before, n = n, size(now)
        if before == n:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("root")).unionAll(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
