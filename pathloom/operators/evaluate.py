"""Evaluation: percentiles, recall and precision, size ratios, the controlled recall workload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import written


def percentiles(samples: DataFrame, value: str, by: list[str], shares: tuple[int, ...] = (50, 95, 99), floor_index: bool = False) -> DataFrame:
    """(*by, samples, pNN..., maximum): nearest rank ceil(p * n / 100), or the value at index (n - 1) * p / 100 rounded down.

    Equal values are counted first; the distinct ones are cut into ranges and written once, and their ranks are sums within a
    range, shifted by the ranges before: neither a group nor a value with very many samples is one task's. Nulls are no samples;
    a null group is one of its own.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranged = written(counted.repartitionByRange(*by, value).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("_part").agg(F.sum("_n").alias("_sum"))  # a row for each range
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum("_n").over(Window.partitionBy("_part").orderBy(*by, value))
    placed = ranged.withColumn("_in", within).join(F.broadcast(before), "_part").withColumn("_upto", F.col("_before") + F.col("_in"))
    groups = placed.groupBy(*(F.col(c).alias(f"_of_{c}") for c in by)).agg(F.sum("_n").alias("_samples"), F.min(F.col("_upto") - F.col("_n")).alias("_first"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    ranked = placed.join(groups, same).withColumn("_last", F.col("_upto") - F.col("_first"))

    def at(p: int) -> Column:
        place = F.floor((F.col("_samples") - 1) * p / 100) + 1 if floor_index else F.ceil(F.col("_samples") * p / 100)
        place = F.greatest(place, F.lit(1))
        return F.max(F.when((F.col("_last") - F.col("_n") < place) & (place <= F.col("_last")), F.col(value))).alias(f"p{p}")

    return ranked.groupBy(*by).agg(F.max("_samples").alias("samples"), *map(at, shares), F.max(value).alias("maximum"))


def recall_precision(truth: DataFrame, returned: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, relevant, returned, hits, recall, precision); pairs are (query_id, document_id). Nothing to find is full recall, nothing returned full precision."""
    pairs = lambda df: df.select("query_id", "document_id").distinct()
    both = pairs(truth).withColumn("t", F.lit(1)).join(pairs(returned).withColumn("r", F.lit(1)), ["query_id", "document_id"], "full_outer")
    counts = both.groupBy("query_id").agg(F.count("t").alias("relevant"), F.count("r").alias("returned"), F.count(F.when(F.col("t").isNotNull() & F.col("r").isNotNull(), 1)).alias("hits"))
    out = queries.select("query_id").join(counts, "query_id", "left").fillna(0, ["relevant", "returned", "hits"])
    share = lambda n, of: F.when(F.col(of) == 0, 1.0).otherwise(F.col(n) / F.col(of))
    return out.withColumns({"recall": share("hits", "relevant"), "precision": share("hits", "returned")})


def rejection_ratio(candidates: Column, verified: Column) -> Column:
    """Share of candidates that verification rejects; 0 without candidates."""
    return F.when(candidates == 0, 0.0).otherwise((candidates - verified) / candidates)


def build_metrics(documents: Column, index_bytes: Column, base_bytes: Column, seconds: Column) -> list[Column]:
    """bytes_per_document, amplification over a base and documents_per_second; null where the divisor is 0."""
    return [F.try_divide(index_bytes, documents).alias("bytes_per_document"), F.try_divide(base_bytes + index_bytes, base_bytes).alias("amplification"), F.try_divide(documents, seconds).alias("documents_per_second")]


def substring_truth(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, document_id) of all names that hold a query: the brute-force answer, by nested loops over a stated set of queries.

    queries has (query_id, q) and is a checked small set: it goes to every task.
    """
    if queries.count() > 10_000:
        raise ValueError("a brute-force truth takes at most 10000 queries")
    return documents.join(F.broadcast(queries), F.contains("name_norm", F.col("q"))).select("query_id", "document_id")


#: Names and the substrings by which they must be found.
CONTROLLED = (
    ("ZetaStartMarker-document.txt", "zetastart"),
    ("prefix-MidNeedle-suffix.txt", "midneedle"),
    ("archive-FinalMarker", "finalmarker"),
    ("budget Qzv Report 2026.txt", "qzv report"),
    ("under_QzvScore_Marker.txt", "qzvscore_mar"),
    ("dash-QzvSegment-Marker.txt", "qzvsegment-mar"),
    ("release.qzvnotes.final", "qzvnotes.fin"),
    ("draft (QzvApproved) copy.txt", "(qzvapproved)"),
    ("invoice-QZV60814-final.txt", "qzv60814"),
    ("qzvabababab-target.txt", "ababab"),
    ("RareQzvLatinNeedle.txt", "qzvlatin"),
    ("Проект_КюзОтчёт_Финал.txt", "кюзотчёт"),
    ("QzV-MiXeDCaSeMarker.txt", "qzv-mixedcase"),
    ("Qzv-Cafe\u0301-Resume\u0301.txt", "qzv-caf\u00e9"),
    ("Qzv-Caf\u00e9-R\u00e9sum\u00e9.txt", "qzv-cafe\u0301"),
    ("prefixaqv7bsuffix.txt", "qv7"),
)


def controlled_workload(spark: SparkSession, common: int = 250, collisions: int = 50) -> tuple[DataFrame, DataFrame]:
    """(documents: document_id, name, resolved_path; queries: query_id, query, q) of the recall contract.

    Beside the fixed cases: a long name, `common` names that share a marker, and `collisions` names that hold all of a query's grams but not the query.
    """
    cases = [*CONTROLLED, ("a" * 96 + "qzvlongmarker" + "b" * 96, "qzvlongmarker")]
    names = [n for n, _ in cases] + [f"common-{i}-qzvcommon-document.txt" for i in range(common)]
    pieces = ("qxz", "xzm", "zma", "mar", "ark", "rke", "ker")
    names += [f"collision-{i}-{'|'.join(pieces)}.txt" for i in range(collisions)] + ["target-qxzmarker-after-collisions.txt"]
    queries = [q for _, q in cases] + ["qzvcommon", "qxzmarker"]
    docs = spark.createDataFrame([(i, n, f"/controlled/{n}", None, "file", 0) for i, n in enumerate(names)], "document_id long, name string, resolved_path string, extension string, kind string, size long")
    return docs, spark.createDataFrame([(i, q, T.normalize_text(q)) for i, q in enumerate(queries)], "query_id long, query string, q string")
