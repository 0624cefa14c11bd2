"""The corpus pipeline: language, near-duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder
and reads them again, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import decontam, langid, mixing, ring, secrets, simhash
from pathloom.llm.shared import new_path, release, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A text whose best language is further away than this score is rejected, as are texts without letters.
LEAST_LANGUAGE_SCORE = 0.05
#: Relative target weights; a source that is not named gets REST.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}
REST = 1.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is identified; profiles come from all labelled rows."""
    found = langid.identify(docs.select(*COLUMNS), langid.learn(docs), keep=tuple(COLUMNS))
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the smallest id, of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return simhash.deduplicated(docs.select(*COLUMNS), find=ring.near_duplicates).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item."""
    found = decontam.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=tuple(COLUMNS))
    return found.where(F.size("items") == 0).select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by a mark; all documents stay."""
    ledger = written(secrets.scan(docs), "ledger")
    found = secrets.findings(docs, ledger, COLUMNS)
    changed = F.size("found") > 0
    clean = F.when(changed, secrets.redacted(F.col("text"), F.col("found"))).otherwise(F.col("text"))
    # a select of its own: beside an alias `text`, a lambda's `text` would mean the alias
    joined = found.select("doc_id", clean.alias("clean"), "lang", "source", changed.alias("changed"), "n_chars")
    n_chars = F.when(F.col("changed"), F.length("clean").cast("long")).otherwise(F.col("n_chars"))
    return joined.select("doc_id", F.col("clean").alias("text"), "lang", "source", n_chars.alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replicate by source to the target weights and shuffle."""
    return mixing.mix(docs.select(*COLUMNS), WEIGHTS, rest=REST, most_rate=math.inf)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secret_scan", secret_scan), ("mixture", mixture)]

#: Word profiles and XXH64 fingerprints have no SQL form; tests/llm/test_pipeline.py holds run() against plain Python.
ORACLE_SQL = None


#: Rows of an Arrow batch while the stages run: a worker holds a batch of texts and what it makes of them.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS))
    try:
        for name, stage in STAGES:
            path = new_path(spark, f"stage-{name}")
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
            release(spark)
    finally:
        spark.conf.set(_BATCH, before)
    return docs
