"""Row numbers over whole tables without a task that sorts them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `place`, their number from 1 in an order that tells all of them apart, nulls first.

    Rows are cut into ranges and written once, with their range: a cut is sampled, so a plan that makes it twice may cut
    twice at other places. Places are counted in each range and shifted by the ranges before, so no task sorts all rows.
    """
    ranged = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each range
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    out = ranged.withColumn("at", place).join(F.broadcast(before), "part", "left").withColumn("place", F.col("before") + F.col("at"))
    return out.select(*rows.columns, "place")
