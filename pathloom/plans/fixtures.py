"""The engine's tables made from the star schema of the test data, as SQL text that any engine can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.graph import State

#: Catalog of parts: names of two words under brand and type.
PARTS = """
SELECT p_partkey AS document_id, 'v0' AS volume_id, p_partkey AS file_id, p_partkey AS file_link_id, p_name AS name,
  '/' || p_brand || '/' || p_type || '/' || p_name AS resolved_path, CAST(NULL AS STRING) AS extension,
  CASE WHEN p_size % 10 = 0 THEN 'directory' WHEN p_size % 10 = 1 THEN 'symlink' ELSE 'file' END AS kind,
  CAST(p_size AS BIGINT) AS size, CAST(p_partkey * 1000 AS BIGINT) AS modified_at_unix_ms, 'online' AS availability
FROM part
"""

#: Catalog of documents: files by source, with an extension.
FILES = """
SELECT doc_id AS document_id, 'v0' AS volume_id, doc_id AS file_id, doc_id AS file_link_id,
  'Doc-' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.png' WHEN 3 THEN '.tar.rs' WHEN 4 THEN '' ELSE '.' END AS name,
  '/' || source || '/Doc-' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.png' WHEN 3 THEN '.tar.rs' WHEN 4 THEN '' ELSE '.' END AS resolved_path,
  CASE doc_id % 6 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'png' WHEN 3 THEN 'rs' END AS extension,
  CASE WHEN doc_id % 13 = 0 THEN 'directory' ELSE 'file' END AS kind, n_chars AS size,
  CAST(doc_id * 1000 AS BIGINT) AS modified_at_unix_ms, CASE WHEN doc_id % 11 = 0 THEN 'offline' ELSE 'online' END AS availability, text
FROM documents
"""

#: The namespace: region, nation, customer, order; with links that are missing, doubled, or boundaries.
VOLUMES = """
SELECT 'v' || CAST(r_regionkey AS STRING) AS volume_id, r_name AS display_name,
  CASE r_regionkey % 5 WHEN 3 THEN 'offline' WHEN 4 THEN 'needs_reconciliation' ELSE 'online' END AS state,
  CAST(NULL AS STRING) AS reconciliation_reason, CAST(7 AS BIGINT) AS generation
FROM region
"""
OBJECTS = """
SELECT 'v' || CAST(r_regionkey AS STRING) AS volume_id, 'r' || CAST(r_regionkey AS STRING) AS file_id, 'directory' AS kind, CAST(0 AS BIGINT) AS size,
  CAST(NULL AS BIGINT) AS created_at_unix_ms, CAST(NULL AS BIGINT) AS modified_at_unix_ms, false AS hidden, 'online' AS availability, false AS tombstoned, CAST(6 AS BIGINT) AS observation_generation
FROM region
UNION ALL SELECT 'v' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING), 'directory', CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, 'online', false, CAST(6 AS BIGINT) FROM nation
UNION ALL SELECT 'v' || CAST(n_regionkey AS STRING), 'c' || CAST(c_custkey AS STRING), 'directory', CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), false, 'online', false, CAST(5 + c_custkey % 2 AS BIGINT)
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'v' || CAST(n_regionkey AS STRING), 'o' || CAST(o_orderkey AS STRING), 'file', CAST(floor(o_totalprice) AS BIGINT), CAST(NULL AS BIGINT), CAST(o_orderkey * 1000 AS BIGINT), o_orderkey % 10 = 0,
  CASE o_orderstatus WHEN 'P' THEN 'unknown' WHEN 'F' THEN 'offline' ELSE 'online' END, o_orderkey % 50 = 0, CAST(o_orderkey % 7 AS BIGINT)
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
"""
LINKS = """
SELECT 'l-r' || CAST(r_regionkey AS STRING) AS file_link_id, 'v' || CAST(r_regionkey AS STRING) AS volume_id, 'r' || CAST(r_regionkey AS STRING) AS file_id,
  CAST(NULL AS STRING) AS parent_volume_id, CAST(NULL AS STRING) AS parent_file_id, r_name AS name, false AS traversal_boundary, CAST(6 AS BIGINT) AS observation_generation
FROM region
UNION ALL SELECT 'l-n' || CAST(n_nationkey AS STRING), 'v' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING), 'v' || CAST(n_regionkey AS STRING), 'r' || CAST(n_regionkey AS STRING), n_name, n_nationkey = 24, CAST(6 AS BIGINT) FROM nation
UNION ALL SELECT 'l-c' || CAST(c_custkey AS STRING), 'v' || CAST(n_regionkey AS STRING), 'c' || CAST(c_custkey AS STRING), 'v' || CAST(n_regionkey AS STRING), 'n' || CAST(n_nationkey AS STRING), c_name, false, CAST(5 + c_custkey % 2 AS BIGINT)
  FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'm-c' || CAST(c_custkey AS STRING), 'v' || CAST(n_regionkey AS STRING), 'c' || CAST(c_custkey AS STRING), 'v' || CAST(n_regionkey AS STRING), 'r' || CAST(n_regionkey AS STRING), c_name || '-alias', false, CAST(6 AS BIGINT)
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 50 = 49
UNION ALL SELECT 'l-o' || CAST(o_orderkey AS STRING), 'v' || CAST(n_regionkey AS STRING), 'o' || CAST(o_orderkey AS STRING), 'v' || CAST(n_regionkey AS STRING),
  CASE WHEN o_orderkey % 101 = 0 THEN 'missing' ELSE 'c' || CAST(c_custkey AS STRING) END, 'order-' || CAST(o_orderkey AS STRING) || '.json', false, CAST(o_orderkey % 7 AS BIGINT)
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 97 <> 0
"""

#: The outbox: events in order; errors delete.
OUTBOX = """
SELECT event_id + 1 AS sequence, user_id AS document_id, event_id + 1 AS document_version, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS mutation, value FROM events
"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of the texts over the Parquet tables of a folder."""
    tables = "region nation customer supplier part orders lineitem events documents pages labels".split()
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables if f"FROM {t}" in sql or f"JOIN {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(sql, **used)


def state(spark: SparkSession, sf_dir: str) -> State:
    return State(*(frame(spark, sf_dir, s) for s in (VOLUMES, OBJECTS, LINKS)))
