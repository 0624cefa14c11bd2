"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, grading, langid, licenses, mixing, rules, secrets, simhash, suffixes, warc
from .shared import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.learn(docs.where(~langid.held_out())))
    return out.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licenses.scan(table(spark, sf_dir, "documents"))
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"], m["stop"], F.round(m["coverage"], 4)))
    return out.select(F.col("id").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"), F.array_join(F.array_sort(F.array_distinct("matches.license")), ",").alias("licenses"), F.array_join(shown, ",").alias("spans"))


#: Relative weights of the production mixture; sources that are not named have weight 1.
WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), WEIGHTS, rest=1.0, most_rate=math.inf)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.deduplicated(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.withColumnRenamed("id", "doc_id")


def op7_grading(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", grading.grade_of(F.col("quality"), F.col("toxic")).alias("grade"))
    return grading.grade(table(spark, sf_dir, "documents"), labels).withColumnRenamed("id", "doc_id")


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("long")
    return out.select(number("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.findings(docs, written(secrets.scan(docs), "ledger"), ["doc_id"])
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.BASE))
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{k}") for k in secrets.BASE]
    return found.select("doc_id", *counts, F.sha2(secrets.shown(base), 256).alias("base_sha256"), secrets.shown(F.col("found")).alias("spans"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_langid, op3_licenses, op4_mixing, op5_suffixes, op6_rules, op7_grading, op8_decontam, op9_warc, op10_secrets)}

_WORDS8 = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op4_mixing": """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, CASE WHEN source = 'src0' THEN 4.0::DOUBLE WHEN source IN ('src1', 'src2') THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM documents GROUP BY source),
rates AS (SELECT source, w / (SELECT sum(w) FROM counts) * (SELECT sum(n)::DOUBLE FROM counts) / n AS rate FROM counts),
cdf AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
keyed AS (SELECT *, ('0x' || substr(md5('42:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM documents),
counted AS (SELECT keyed.*, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM keyed.source AND c <= u) AS n FROM keyed),
copies AS (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy, md5('42:' || doc_id || ':' || copy) AS shuffle_key FROM copies
""",
    "op8_decontam": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS8}, []) AS w FROM documents),
i AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS win
  FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(s) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') AS win
  FROM d, lengths, unnest(range(1, len(w) - n + 2)) AS t(s)),
hits AS (SELECT doc_id, s, n, item_id FROM places JOIN windows USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op9_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS target FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN target IS NOT NULL AND target <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
""",
}
