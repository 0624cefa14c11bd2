"""What the corpus operators share: written tables and Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import discard, new_path, shared_dir, written

__all__ = ["before_each", "by_batch", "discard", "let", "new_path", "release", "shared_dir", "trim", "utf8", "written"]

#: Elements of an array that before_each() takes at a time.
_BLOCK = 256


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow: make() runs once a task and returns the function that is applied to each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            out = f(b)
            if out is not None and out.num_rows:
                yield out
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give memory that is free back to the system: workers are used again, also by other operators."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The column's texts as bytes, one at a time."""
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    for x in column:
        yield x.as_py()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of plans that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def before_each(numbers: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of longs, merge() over 0 and the elements before it.

    Spark grows an array by copying it, so the array goes in blocks: the cost is linear but for a copy for each block.
    merge() is associative, as + and greatest are.
    """
    state = "struct<now:bigint,out:array<bigint>>"

    def scan(xs: Column, start: Column) -> Column:
        zero = F.struct(start.alias("now"), F.array().cast("array<bigint>").alias("out")).cast(state)
        step = lambda a, x: F.struct(merge(a["now"], x).alias("now"), F.concat(a["out"], F.array(a["now"])).alias("out"))
        return F.aggregate(xs, zero, step, lambda a: a["out"])

    def whole(xs: Column) -> Column:
        count = F.floor((F.size(xs) + _BLOCK - 1) / _BLOCK).cast("int")
        at = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(at, lambda k: F.slice(xs, k * _BLOCK + 1, _BLOCK))
        return let(blocks, lambda b: F.flatten(F.zip_with(b, scan(F.transform(b, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), merge)), F.lit(0).cast("bigint")), scan)))

    return let(numbers, whole)
