"""Registered queries of the engine's operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import values as V
from ..operators import catalog, content, evaluate, governor, graph
from ..sources import generator, journal
from ..sources.scratch import written
from ..sources.tables import garbage
from ..streaming import stateful
from . import fixtures as X
from . import search as S
from . import strategies as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _projected(documents: DataFrame) -> DataFrame:
    """Documents as a projection stores them: searches read the columns that were normalized when they were written."""
    return written(S.with_search_columns(documents), "projection")


_SPLIT = r"[t FOR t IN regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+') IF t <> '']"
_D = "WITH base AS ({base}), d AS (SELECT *, lower(name) AS nn, lower(resolved_path) AS pn, " + _SPLIT.format("lower(name)") + " AS nt, " + _SPLIT.format("lower(resolved_path)") + " AS pt FROM base)"
_MODES = {
    "exact": "nn = '{q}'",
    "token": "list_contains(nt, '{q}')",
    "prefix": "len([t FOR t IN nt IF starts_with(t, '{q}')]) > 0 AND length('{q}') <= 32",
    "path": "list_contains(pt, '{q}')",
    "substring": "length('{q}') >= 3 AND contains(nn, '{q}')",
}
_CLASS = "CASE WHEN nn = '{q}' THEN 0 WHEN starts_with(nn, '{q}') THEN 1 WHEN list_contains(nt, '{q}') THEN 2 WHEN length('{q}') >= 3 AND contains(nn, '{q}') THEN 3 WHEN contains(pn, '{q}') THEN 4 END"


def _search_sql(base: str, q: str, where: str = "true", k: int = 20, modes=S.MODES) -> str:
    found = " OR ".join(f"({_MODES[m].format(q=q)})" for m in modes)
    return f"""{_D.replace("{base}", base)},
c AS (SELECT *, {_CLASS.format(q=q)} AS match_class FROM d WHERE ({found}) AND ({where})),
r AS (SELECT *, row_number() OVER (ORDER BY match_class, nn, pn, document_id) AS rank FROM c WHERE match_class IS NOT NULL)
SELECT document_id, name, resolved_path, kind, size, ['exact', 'prefix', 'token', 'substring', 'path'][match_class + 1] AS match_type, rank::INTEGER AS rank FROM r WHERE rank <= {k}"""


def _add_search(name: str, base: str, q: str, where: str = "true", k: int = 20, modes=S.MODES, **request) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = _projected(X.frame(spark, sf_dir, base))
        hits = S.search(docs, S.SearchRequest(q, top_k=k, modes=tuple(modes), **request))
        return hits.select("document_id", "name", "resolved_path", "kind", "size", "match_type", "rank")

    register(name, _search_sql(base, q.lower(), where, k, modes))(run)


_add_search("search_exact", X.PARTS, "Red Widget", modes=("exact",))
_add_search("search_prefix", X.PARTS, "wid", modes=("prefix",))
_add_search("search_token", X.PARTS, "ring", modes=("token",))
_add_search("search_substring", X.PARTS, "d w", modes=("substring",))
_add_search("search_path", X.PARTS, "economy", modes=("path",))
_add_search("search_all_modes", X.PARTS, "rin", k=100)
_add_search("search_short_query", X.PARTS, "wi", k=50)
_add_search("search_multi_token", X.PARTS, "blue bolt")
_add_search("search_scope_files", X.PARTS, "ring", "kind <> 'directory'", scope="files")
_add_search("search_scope_folders", X.PARTS, "ring", "kind = 'directory'", scope="folders")
_add_search("search_ext_filter", X.FILES, "doc", "extension IN ('txt', 'rs')", k=100, extensions=("TXT", "rs"))
_add_search("search_dir_prefix", X.FILES, "doc", "starts_with(pn, '/src1')", k=100, directory_prefix="/SRC1")
_add_search("search_size_range", X.FILES, "doc", "size >= 500 AND size <= 2000", k=100, minimum_size=500, maximum_size=2000)

_BATCH = ["ring", "red", "wid", "economy", "d w", "bolt", "small ring", "x", "brand", "2", "olt"]


@register("search_batch", _D.replace("{base}", X.PARTS) + """,
q AS (SELECT (i - 1)::BIGINT AS query_id, ['""" + "', '".join(_BATCH) + """'][i] AS q FROM range(1, """ + str(len(_BATCH) + 1) + """) t(i)),
c AS (SELECT query_id, d.*, CASE WHEN nn = q THEN 0 WHEN starts_with(nn, q) THEN 1 WHEN list_contains(nt, q) THEN 2 WHEN length(q) >= 3 AND contains(nn, q) THEN 3 WHEN contains(pn, q) THEN 4 END AS match_class
  FROM d, q WHERE nn = q OR list_contains(nt, q) OR len([t FOR t IN nt IF starts_with(t, q)]) > 0 OR list_contains(pt, q) OR (length(q) >= 3 AND contains(nn, q))),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY match_class, nn, pn, document_id) AS rank FROM c WHERE match_class IS NOT NULL)
SELECT query_id, document_id, rank::INTEGER AS rank, ['exact', 'prefix', 'token', 'substring', 'path'][match_class + 1] AS match_type FROM r WHERE rank <= 10""")  # fmt: skip
def search_batch(spark, sf_dir):
    docs = _projected(X.frame(spark, sf_dir, X.PARTS))
    return S.search_many(docs, S.query_frame(spark, _BATCH), 10).select("query_id", "document_id", "rank", "match_type")


@register("lookup_items", f"WITH base AS ({X.PARTS}), w AS (SELECT * FROM (VALUES (0, 7), (1, 3), (2, -1), (3, 150)) t(o, i)) SELECT document_id, name, resolved_path FROM base JOIN w ON document_id = i")
def lookup_items(spark, sf_dir):
    return S.lookup(X.frame(spark, sf_dir, X.PARTS), [7, 3, -1, 150], ["document_id", "name", "resolved_path"])


@register("point_lookup", f"WITH base AS ({X.PARTS}) SELECT document_id, name, size FROM base WHERE document_id = 42")
def point_lookup(spark, sf_dir):
    return S.lookup(X.frame(spark, sf_dir, X.PARTS), [42], ["document_id", "name", "size"])


@register("keyset_page", f"WITH base AS ({X.PARTS}) SELECT document_id, name FROM base WHERE document_id > 40 ORDER BY document_id LIMIT 25")
def keyset_page(spark, sf_dir):
    return S.page(X.frame(spark, sf_dir, X.PARTS), 40, 25).select("document_id", "name")


@register("full_scan", f"WITH base AS ({X.PARTS}) SELECT * FROM base")
def full_scan(spark, sf_dir):
    return X.frame(spark, sf_dir, X.PARTS)


_STATE = f"v AS ({X.VOLUMES}), o AS ({X.OBJECTS}), l AS ({X.LINKS})"
_WALK = f"""WITH RECURSIVE {_STATE},
sole AS (SELECT volume_id, file_id, count(*) AS n, min(file_link_id) AS up FROM l GROUP BY ALL),
walk AS (
  SELECT file_link_id, parent_volume_id, parent_file_id, name AS path, 1 AS depth, NULL::VARCHAR AS error, NULL::VARCHAR AS subject FROM l
  UNION ALL
  SELECT w.file_link_id, u.parent_volume_id, u.parent_file_id, u.name || '/' || w.path, depth + 1,
    CASE WHEN n IS NULL THEN 'missing_parent' WHEN n > 1 THEN 'ambiguous_parent' WHEN u.traversal_boundary THEN 'traversal_boundary' END,
    CASE WHEN n IS NULL OR n > 1 THEN w.parent_volume_id || '/' || w.parent_file_id WHEN u.traversal_boundary THEN u.file_link_id END
  FROM walk w LEFT JOIN sole ON sole.volume_id = w.parent_volume_id AND sole.file_id = w.parent_file_id LEFT JOIN l u ON u.file_link_id = sole.up
  WHERE w.parent_file_id IS NOT NULL AND w.error IS NULL),
p AS (SELECT file_link_id, CASE WHEN error IS NULL THEN path END AS resolved_path, CASE WHEN error IS NULL THEN depth END AS depth, error, subject AS error_subject
  FROM walk WHERE parent_file_id IS NULL OR error IS NOT NULL)"""


@register("resolve_paths", _WALK + " SELECT file_link_id, resolved_path, depth::INTEGER AS depth FROM p WHERE error IS NULL")
def resolve_paths(spark, sf_dir):
    return graph.resolve_paths(X.frame(spark, sf_dir, X.LINKS)).where("error is null").select("file_link_id", "resolved_path", "depth")


@register("path_errors", _WALK + " SELECT file_link_id, error, error_subject FROM p WHERE error IS NOT NULL")
def path_errors(spark, sf_dir):
    return graph.resolve_paths(X.frame(spark, sf_dir, X.LINKS)).where("error is not null").select("file_link_id", "error", "error_subject")


_DESIRED = _WALK + """, desired AS (
SELECT l.file_link_id AS document_id, l.volume_id, l.file_id, name, resolved_path, CASE WHEN contains(name, '.') THEN nullif(lower(string_split(name, '.')[-1]), '') END AS extension, kind, size, modified_at_unix_ms, hidden,
  CASE v.state WHEN 'online' THEN availability WHEN 'offline' THEN 'offline' ELSE 'unknown' END AS availability
FROM l JOIN p ON p.file_link_id = l.file_link_id AND error IS NULL JOIN o ON o.volume_id = l.volume_id AND o.file_id = l.file_id AND NOT tombstoned JOIN v ON v.volume_id = l.volume_id)"""
_DESIRED_COLUMNS = ["document_id", "volume_id", "file_id", "name", "resolved_path", "extension", "kind", "size", "modified_at_unix_ms", "hidden", "availability"]


@register("desired_catalog", _DESIRED + " SELECT * FROM desired")
def desired_catalog(spark, sf_dir):
    return catalog.desired(X.state(spark, sf_dir)).select(*_DESIRED_COLUMNS)


@register("desired_catalog_page", _DESIRED + " SELECT document_id, resolved_path FROM desired WHERE document_id > 'l-o2' ORDER BY document_id LIMIT 100")
def desired_catalog_page(spark, sf_dir):
    return S.page(catalog.desired(X.state(spark, sf_dir)), "l-o2", 100).select("document_id", "resolved_path")


@register("volume_identities", _DESIRED + " SELECT document_id, volume_id, file_id FROM desired WHERE volume_id = 'v1'")
def volume_identities(spark, sf_dir):
    return catalog.identities(catalog.desired(X.state(spark, sf_dir)), "v1").select("document_id", "volume_id", "file_id")


@register("effective_availability", f"WITH {_STATE} SELECT v.volume_id, state, availability, CASE state WHEN 'online' THEN availability WHEN 'offline' THEN 'offline' ELSE 'unknown' END AS effective, count(*) AS n FROM o JOIN v ON v.volume_id = o.volume_id GROUP BY ALL")
def effective_availability(spark, sf_dir):
    s = X.state(spark, sf_dir)
    return s.objects.join(s.volumes.select("volume_id", "state"), "volume_id").groupBy("volume_id", "state", "availability", graph.effective_availability(F.col("state"), F.col("availability")).alias("effective")).agg(F.count("*").alias("n"))


@register("graph_stats", f"""WITH {_STATE} SELECT count(*) FILTER (NOT tombstoned) AS live_objects, count(*) FILTER (NOT tombstoned AND kind = 'file') AS live_files,
coalesce(sum(size) FILTER (NOT tombstoned AND kind = 'file'), 0)::BIGINT AS live_file_bytes, count(*) FILTER (tombstoned) AS tombstoned_objects, (SELECT count(*) FROM v) AS volumes, (SELECT count(*) FROM l) AS links, 0::BIGINT AS pending_jobs FROM o""")
def graph_stats(spark, sf_dir):
    return graph.stats(X.state(spark, sf_dir))


_ORPHANS = "SELECT volume_id, file_id FROM o WHERE NOT tombstoned AND NOT EXISTS (SELECT 1 FROM l WHERE l.volume_id = o.volume_id AND l.file_id = o.file_id)"


@register("audit_integrity", f"""WITH {_STATE} SELECT 'orphan_object' AS issue, volume_id || '/' || file_id AS subject FROM ({_ORPHANS}) UNION ALL
SELECT 'missing_parent', file_link_id FROM l WHERE parent_file_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.volume_id = parent_volume_id AND o.file_id = parent_file_id)""")
def audit_integrity(spark, sf_dir):
    return graph.audit(X.state(spark, sf_dir))


@register("link_counts", f"WITH {_STATE} SELECT volume_id, file_id, count(*) AS links FROM l GROUP BY ALL")
def link_counts(spark, sf_dir):
    return graph.link_counts(X.frame(spark, sf_dir, X.LINKS))


@register("hard_links", "SELECT l_partkey AS file_id, count(*) AS links FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def hard_links(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.lit("v").alias("volume_id"), F.col("l_partkey").alias("file_id"))
    return graph.link_counts(rows).where("links > 1").select("file_id", "links")


@register("duplicate_names", f"WITH base AS ({X.PARTS}) SELECT resolved_path AS name, count(*) AS n FROM base GROUP BY ALL HAVING count(*) > 1")
def duplicate_names(spark, sf_dir):
    null = F.lit(None).cast("string")
    rows = X.frame(spark, sf_dir, X.PARTS).select("volume_id", null.alias("parent_volume_id"), null.alias("parent_file_id"), F.col("resolved_path").alias("name"))
    return graph.duplicate_names(rows).select("name", "n")


@register("rename_subtree", f"""WITH RECURSIVE {_STATE}, t AS (SELECT file_link_id, volume_id, file_id FROM l WHERE parent_volume_id = 'v1' AND parent_file_id = 'n3' OR volume_id = 'v1' AND file_id = 'r1'
UNION SELECT l.file_link_id, l.volume_id, l.file_id FROM t JOIN l ON l.parent_volume_id = t.volume_id AND l.parent_file_id = t.file_id) SELECT file_link_id FROM t""")
def rename_subtree(spark, sf_dir):
    links = X.frame(spark, sf_dir, X.LINKS)
    return graph.subtree(links, links.where("file_id = 'r1' and volume_id = 'v1'"))


@register("affected_links", f"WITH {_STATE} SELECT file_link_id FROM l WHERE EXISTS (SELECT 1 FROM o WHERE o.volume_id = l.volume_id AND o.file_id = l.file_id AND size > 400000)")
def affected_links(spark, sf_dir):
    s = X.state(spark, sf_dir)
    return graph.affected_links(s.links, s.objects.where("size > 400000")).select("file_link_id")


# --- outbox ---------------------------------------------------------------------------------------------------------

_CONSUMERS = [("catalog", 4000, 3), ("content", 2500, 1), ("late", 99_999_999, 1)]
_C = "c AS (SELECT * FROM (VALUES ('catalog', 4000), ('content', 2500), ('late', 99999999)) t(consumer_id, last_sequence))"


def _outbox(spark, sf_dir):
    return X.frame(spark, sf_dir, X.OUTBOX), spark.createDataFrame(_CONSUMERS, "consumer_id string, last_sequence bigint, index_generation bigint")


@register("outbox_lww", f"WITH b AS ({X.OUTBOX}) SELECT document_id, max(sequence) AS sequence, arg_max(mutation, sequence) AS mutation, arg_max(value, sequence) AS value FROM b GROUP BY document_id")
def outbox_lww(spark, sf_dir):
    return catalog.last_writes(_outbox(spark, sf_dir)[0]).select("document_id", "sequence", "mutation", "value")


@register("outbox_range", f"WITH b AS ({X.OUTBOX}) SELECT sequence, document_id, mutation FROM b WHERE sequence > 500 ORDER BY sequence LIMIT 200")
def outbox_range(spark, sf_dir):
    return catalog.read_outbox(_outbox(spark, sf_dir)[0], 500, 200).select("sequence", "document_id", "mutation")


@register("outbox_gaps", f"WITH b AS (SELECT sequence FROM ({X.OUTBOX}) WHERE document_id % 10 <> 3), g AS (SELECT sequence, lag(sequence) OVER (ORDER BY sequence) AS previous FROM b) SELECT sequence, previous FROM g WHERE sequence <> previous + 1")
def outbox_gaps(spark, sf_dir):
    return catalog.gaps(_outbox(spark, sf_dir)[0].where("document_id % 10 <> 3").select("sequence"))


@register("outbox_backlog", f"WITH b AS ({X.OUTBOX}), {_C} SELECT consumer_id, greatest((SELECT greatest((SELECT max(sequence) FROM b), (SELECT max(last_sequence) FROM c))) - last_sequence, 0)::BIGINT AS backlog FROM c")
def outbox_backlog(spark, sf_dir):
    return catalog.backlog(*_outbox(spark, sf_dir))


@register("outbox_high_water", f"WITH b AS ({X.OUTBOX}), {_C} SELECT greatest((SELECT max(sequence) FROM b), (SELECT max(last_sequence) FROM c))::BIGINT AS latest")
def outbox_high_water(spark, sf_dir):
    return catalog.high_water(*_outbox(spark, sf_dir))


@register("outbox_prune_bound", f"WITH {_C} SELECT min(last_sequence)::BIGINT AS safe FROM c")
def outbox_prune_bound(spark, sf_dir):
    return catalog.prune_bound(_outbox(spark, sf_dir)[1])


@register("outbox_pruned", f"WITH b AS ({X.OUTBOX}) SELECT sequence, document_id FROM b WHERE sequence > least(2500, 1000)")
def outbox_pruned(spark, sf_dir):
    return catalog.pruned(*_outbox(spark, sf_dir), limit=1000).select("sequence", "document_id")


_OLD = f"SELECT document_id, sha256(concat_ws('|', document_id, CASE WHEN document_id % 7 = 0 THEN 'old' ELSE name END, size)) AS fingerprint FROM ({X.PARTS}) WHERE document_id % 5 <> 0"
_NEW = f"SELECT document_id, sha256(concat_ws('|', document_id, name, size)) AS fingerprint FROM ({X.PARTS}) WHERE document_id % 9 <> 0"


def _versions(spark, sf_dir):
    rows = X.frame(spark, sf_dir, X.PARTS)
    mark = lambda name: F.sha2(F.concat_ws("|", "document_id", name, "size"), 256).alias("fingerprint")
    old = rows.where("document_id % 5 <> 0").select("document_id", mark(F.when(F.col("document_id") % 7 == 0, "old").otherwise(F.col("name"))))
    return old, rows.where("document_id % 9 <> 0").select("document_id", mark(F.col("name")))


@register("fingerprint_diff", f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(a.document_id, b.document_id) AS document_id, CASE WHEN b.document_id IS NULL THEN 'delete' ELSE 'upsert' END AS mutation FROM a FULL JOIN b ON a.document_id = b.document_id WHERE a.fingerprint IS DISTINCT FROM b.fingerprint")
def fingerprint_diff(spark, sf_dir):
    return catalog.difference(*_versions(spark, sf_dir)).select("document_id", "mutation")


@register("outbox_append", f"WITH a AS ({_OLD}), b AS ({_NEW}), x AS (SELECT coalesce(a.document_id, b.document_id) AS document_id, CASE WHEN b.document_id IS NULL THEN 'delete' ELSE 'upsert' END AS mutation FROM a FULL JOIN b ON a.document_id = b.document_id WHERE a.fingerprint IS DISTINCT FROM b.fingerprint) SELECT 100 + row_number() OVER (ORDER BY document_id) AS sequence, document_id, mutation FROM x")
def outbox_append(spark, sf_dir):
    return catalog.outbox_rows(catalog.difference(*_versions(spark, sf_dir)), 100, 9).select("sequence", "document_id", "mutation")


@register("catalog_drift", f"WITH a AS ({_OLD}), b AS ({_NEW}) SELECT coalesce(a.document_id, b.document_id) AS document_id, CASE WHEN a.document_id IS NULL THEN 'lost' WHEN b.document_id IS NULL THEN 'stale' ELSE 'changed' END AS drift FROM a FULL JOIN b ON a.document_id = b.document_id WHERE a.fingerprint IS DISTINCT FROM b.fingerprint")
def catalog_drift(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return catalog.drift(new, old)


@register("convergence_counts", _DESIRED + " SELECT count(*) AS documents, count(DISTINCT document_id) AS distinct_ids, count(*) - count(DISTINCT document_id) AS duplicates FROM desired")
def convergence_counts(spark, sf_dir):
    return catalog.fingerprint(catalog.desired(X.state(spark, sf_dir))).select("documents", "distinct_ids", "duplicates")


@register("convergence_fingerprint")
def convergence_fingerprint(spark, sf_dir):
    return catalog.fingerprint(catalog.desired(X.state(spark, sf_dir)))


# --- reconciliation -------------------------------------------------------------------------------------------------


@register("reconcile_stale_links", f"WITH {_STATE} SELECT file_link_id, observation_generation FROM l WHERE volume_id = 'v2' AND observation_generation < 4")
def reconcile_stale_links(spark, sf_dir):
    return graph.stale_links(X.frame(spark, sf_dir, X.LINKS), "v2", 4).select("file_link_id", "observation_generation")


@register("reconcile_sweep", f"""WITH {_STATE}, g AS (SELECT * FROM l WHERE volume_id = 'v2' AND observation_generation < 4), k AS (SELECT * FROM l WHERE file_link_id NOT IN (SELECT file_link_id FROM g))
SELECT o.volume_id, o.file_id FROM o WHERE volume_id = 'v2' AND (tombstoned OR (NOT EXISTS (SELECT 1 FROM k WHERE k.volume_id = o.volume_id AND k.file_id = o.file_id) AND (observation_generation < 4 OR EXISTS (SELECT 1 FROM g WHERE g.file_id = o.file_id))))""")
def reconcile_sweep(spark, sf_dir):
    return graph.sweep(X.state(spark, sf_dir), "v2", 4).objects.where("tombstoned and volume_id = 'v2'").select("volume_id", "file_id")


@register("reconcile_stale_objects", f"WITH {_STATE} SELECT volume_id, file_id FROM o WHERE volume_id = 'v0' AND NOT tombstoned AND observation_generation < 5 AND NOT EXISTS (SELECT 1 FROM l WHERE l.volume_id = o.volume_id AND l.file_id = o.file_id)")
def reconcile_stale_objects(spark, sf_dir):
    return graph.stale_objects(X.state(spark, sf_dir), "v0", 5).select("volume_id", "file_id")


@register("namespace_conflicts", f"WITH {_STATE} SELECT file_link_id AS old_link_id, 'x' || file_link_id AS new_link_id FROM l WHERE observation_generation < 3 AND file_link_id LIKE 'l-o%5'")
def namespace_conflicts(spark, sf_dir):
    links = X.frame(spark, sf_dir, X.LINKS)
    seen = links.where("file_link_id like 'l-o%5'").withColumns({"file_link_id": F.concat(F.lit("x"), "file_link_id"), "observation_generation": F.lit(9)})
    return graph.namespace_conflicts(links, seen, 3)


@register("scoped_removals", f"WITH {_STATE} SELECT file_link_id, volume_id, file_id FROM l WHERE volume_id = 'v3' AND observation_generation <> 2")
def scoped_removals(spark, sf_dir):
    links = X.frame(spark, sf_dir, X.LINKS)
    return graph.scoped_removals(links, links.where("observation_generation = 2"), links.where("volume_id = 'v3'"), True).select("file_link_id", "volume_id", "file_id")


@register("root_revocation", f"""WITH {_STATE}, g AS (SELECT * FROM l WHERE volume_id = 'v4' AND file_link_id LIKE 'l-o1%'),
e AS (SELECT 'link_removed' AS event, 0 AS o, volume_id, file_id, file_link_id FROM g UNION ALL SELECT DISTINCT 'object_removed', 1, volume_id, file_id, NULL FROM g)
SELECT event, volume_id, file_id, file_link_id, (row_number() OVER (PARTITION BY volume_id ORDER BY o, file_link_id, file_id) - 1)::INTEGER AS sequence FROM e""")
def root_revocation(spark, sf_dir):
    return graph.removal_events(X.frame(spark, sf_dir, X.LINKS).where("volume_id = 'v4' and file_link_id like 'l-o1%'")).select("event", "volume_id", "file_id", "file_link_id", "sequence")


_FOLD = f"""{_STATE}, e AS (
  SELECT o_orderkey * 2 AS sequence, CASE WHEN o_orderkey % 3 = 0 THEN 'link_removed' ELSE 'object_observed' END AS event, o_orderkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey % 97 <> 0)"""


@register("graph_fold", f"""WITH {_FOLD} SELECT o.volume_id, o.file_id, CASE WHEN e.event = 'object_observed' THEN 5 ELSE size END::BIGINT AS size, CASE WHEN e.event = 'link_removed' THEN true WHEN e.event = 'object_observed' THEN false ELSE tombstoned END AS tombstoned,
CASE WHEN e.event = 'object_observed' THEN 11 ELSE observation_generation END::BIGINT AS observation_generation FROM o LEFT JOIN e ON o.file_id = 'o' || e.o_orderkey""")
def graph_fold(spark, sf_dir):
    s = X.state(spark, sf_dir)
    null = F.lit(None)
    keys = s.objects.where("file_id like 'o%'").withColumn("k", F.substring("file_id", 2, 20).cast("long")).where("k % 4 = 0 and k % 97 <> 0")
    gone = F.col("k") % 3 == 0
    events = keys.select((F.col("k") * 2).alias("sequence"), F.when(gone, "link_removed").otherwise("object_observed").alias("event"), "volume_id", "file_id", F.when(gone, F.concat(F.lit("l-"), "file_id")).alias("file_link_id"), null.cast("string").alias("parent_volume_id"), null.cast("string").alias("parent_file_id"), null.cast("string").alias("name"), null.cast("boolean").alias("traversal_boundary"), F.lit("file").alias("kind"), F.lit(5).cast("long").alias("size"), null.cast("long").alias("created_at_unix_ms"), null.cast("long").alias("modified_at_unix_ms"), F.lit(False).alias("hidden"), F.lit("online").alias("availability"), null.cast("string").alias("reason"))
    return graph.fold(s, events, 11).objects.select("volume_id", "file_id", "size", "tombstoned", "observation_generation")


# --- content --------------------------------------------------------------------------------------------------------

_LINE = r"' ' || array_to_string([CASE WHEN strlen(t) < 40 THEN t ELSE chr(1) END FOR t IN regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+') IF t <> ''], ' ') || ' '"
_I = f"WITH base AS ({X.FILES}), i AS (SELECT *, {_LINE} AS line FROM base)"


def _indexed(spark, sf_dir):
    return content.index(X.frame(spark, sf_dir, X.FILES))


def _add_content(name: str, query: str, where: str, limit: int = 100) -> None:
    register(name, f"{_I} SELECT document_id FROM i WHERE {where} ORDER BY document_id LIMIT {limit}")(lambda spark, sf_dir: content.search(_indexed(spark, sf_dir), query, limit))


_add_content("content_term", "idiot", "contains(line, ' idiot')")
_add_content("content_or", "zu moron", "contains(line, ' zu ') OR contains(line, ' moron ')")
_add_content("content_and_not", "the AND moron NOT zu", "contains(line, ' the ') AND contains(line, ' moron ') AND NOT contains(line, ' zu ')")
_add_content("content_signs", "+of +this -moron", "contains(line, ' of ') AND contains(line, ' this ') AND NOT contains(line, ' moron ')")
_add_content("content_phrase", '"mit license"', "contains(line, ' mit license ')")
_add_content("content_prefix", "licen", "contains(line, ' licen')")
_add_content("content_groups", "(mit OR apache) AND license", "(contains(line, ' mit ') OR contains(line, ' apache ')) AND contains(line, ' license ')")


@register("content_reresolve", f"{_I}, h AS (SELECT document_id FROM i WHERE contains(line, ' the ') ORDER BY document_id LIMIT 50) SELECT document_id, name, row_number() OVER (ORDER BY document_id)::INTEGER AS rank FROM h JOIN base USING (document_id) WHERE document_id % 4 <> 0")
def content_reresolve(spark, sf_dir):
    current = X.frame(spark, sf_dir, X.FILES).where("document_id % 4 <> 0")
    return content.resolved_hits(content.search(_indexed(spark, sf_dir), "the", 50), current).select("document_id", "name", "rank")


@register("content_phrase_postings", f"{_I} SELECT document_id FROM i WHERE contains(line, ' under the ')")
def content_phrase_postings(spark, sf_dir):
    return content.phrase_postings(content.postings(_indexed(spark, sf_dir)), ["under", "the"])


@register("content_document_frequency", f"{_I}, t AS (SELECT DISTINCT document_id, unnest(string_split(trim(line), ' ')) AS term FROM i) SELECT term, count(*) AS documents FROM t WHERE term NOT IN ('', chr(1)) GROUP BY term HAVING count(*) > 20")
def content_document_frequency(spark, sf_dir):
    return content.postings(_indexed(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("documents")).where("documents > 20")


_POLICY = content.Policy(("/src0", "/src1/", "/src12"), 4000)
_REASON = "CASE WHEN kind <> 'file' OR availability <> 'online' THEN 'unavailable' WHEN extension IS NULL OR extension NOT IN ('txt', 'md', 'rs') THEN 'extension' WHEN size > 4000 THEN 'too_large' WHEN NOT (starts_with(resolved_path, '/src0/') OR starts_with(resolved_path, '/src1/') OR starts_with(resolved_path, '/src12/')) THEN 'outside_roots' END"


@register("content_eligibility", f"WITH base AS ({X.FILES}) SELECT document_id, {_REASON} AS skip_reason FROM base")
def content_eligibility(spark, sf_dir):
    return content.eligibility(X.frame(spark, sf_dir, X.FILES), _POLICY).select("document_id", "skip_reason")


@register("content_build_summary", f"""WITH base AS ({X.FILES}), r AS (SELECT {_REASON} AS s FROM base) SELECT count(*) AS catalog_documents, count(*) FILTER (s IS NULL) AS indexed_documents,
{', '.join(f"count(*) FILTER (s = '{n}') AS skipped_{n}" for n in ('unavailable', 'extension', 'too_large', 'io', 'outside_roots', 'non_text'))} FROM r""")
def content_build_summary(spark, sf_dir):
    return content.summary(content.eligibility(X.frame(spark, sf_dir, X.FILES), _POLICY))


@register("content_declared_bytes", f"WITH base AS ({X.FILES}), s AS (SELECT coalesce(sum(size) FILTER (kind = 'file' AND availability = 'online' AND size <= 4000 AND extension IN ('txt', 'md', 'rs')), 0)::BIGINT AS eligible_bytes, count(*) AS documents FROM base) SELECT *, 2 * eligible_bytes + 1024 * documents AS forecast_bytes FROM s")
def content_declared_bytes(spark, sf_dir):
    return content.declared_bytes(X.frame(spark, sf_dir, X.FILES), _POLICY)


@register("content_delta", f"""WITH base AS ({X.FILES}),
p AS (SELECT document_id, 'f' || document_id % 7 AS fingerprint, 'h' || document_id % 4 AS content_hash, size FROM base WHERE document_id % 5 <> 0),
u AS (SELECT document_id, {_REASON} AS skip_reason, CASE WHEN document_id % 2 = 0 THEN 'f' || document_id % 7 ELSE 'g' END AS fingerprint, CASE WHEN document_id % 3 = 0 THEN 'h' || document_id % 4 ELSE 'z' END AS content_hash, size + (document_id % 4 = 1)::INTEGER AS size, document_id % 10 <> 3 AS timed FROM base WHERE document_id % 6 <> 2)
SELECT u.document_id, CASE WHEN skip_reason IS NOT NULL THEN CASE WHEN p.document_id IS NOT NULL THEN 'evicted' ELSE 'skipped' END WHEN p.document_id IS NULL THEN 'added' WHEN p.fingerprint = u.fingerprint THEN 'unchanged'
  WHEN p.size = u.size AND timed THEN 'metadata_only' WHEN p.content_hash = u.content_hash THEN 'unchanged_hash' ELSE 'updated' END AS outcome FROM u LEFT JOIN p ON p.document_id = u.document_id
UNION ALL SELECT b.document_id, CASE WHEN p.document_id IS NOT NULL THEN 'removed' ELSE 'absent' END FROM base b LEFT JOIN p ON p.document_id = b.document_id WHERE b.document_id % 6 = 2""")
def content_delta(spark, sf_dir):
    base = X.frame(spark, sf_dir, X.FILES)
    i = F.col("document_id")
    mark = lambda letter, n: F.concat(F.lit(letter), (i % n).cast("string"))
    prior = base.where("document_id % 5 <> 0").withColumns({"fingerprint": mark("f", 7), "content_hash": mark("h", 4), "modified_at_unix_ms": F.lit(1000).cast("long")})
    new = content.eligibility(base.where("document_id % 6 <> 2"), _POLICY).withColumns({"fingerprint": F.when(i % 2 == 0, mark("f", 7)).otherwise("g"), "content_hash": F.when(i % 3 == 0, mark("h", 4)).otherwise("z"), "size": F.col("size") + (i % 4 == 1).cast("int"), "modified_at_unix_ms": F.when(i % 10 != 3, F.lit(1000).cast("long"))})
    return content.delta(prior, new, base.where("document_id % 6 = 2"))


# --- functions ------------------------------------------------------------------------------------------------------


@register("normalize_names", f"WITH base AS ({X.FILES}) SELECT document_id, lower(name) AS name_norm, lower(resolved_path) AS path_norm FROM base")
def normalize_names(spark, sf_dir):
    return S.with_search_columns(X.frame(spark, sf_dir, X.FILES)).select("document_id", "name_norm", "path_norm")


@register("tokens", f"{_D.replace("{base}", X.FILES)} SELECT document_id, array_to_string(nt, ' ') AS tokens FROM d")
def tokens(spark, sf_dir):
    return S.with_search_columns(X.frame(spark, sf_dir, X.FILES)).select("document_id", F.array_join("name_tokens", " ").alias("tokens"))


@register("prefixes", "SELECT p_partkey, array_to_string([left(p_name, i) FOR i IN range(1, least(length(p_name), 4) + 1)], ',') AS prefixes FROM part")
def prefixes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.prefixes(F.col("p_name"), 4), ",").alias("prefixes"))


@register("grams", "SELECT p_partkey, array_to_string([substr(p_name, i, 3) FOR i IN range(1, length(p_name) - 1)], ',') AS grams FROM part")
def grams(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.grams(F.col("p_name"), 3), ",").alias("grams"))


@register("hex_terms", "SELECT p_partkey, lower(hex(left(p_name, 4))) AS term FROM part")
def hex_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.hex_term(F.left("p_name", F.lit(4))).alias("term"))


@register("extension", f"WITH base AS ({X.FILES}) SELECT document_id, CASE WHEN contains(name, '.') THEN nullif(lower(string_split(name, '.')[-1]), '') END AS ext FROM base")
def extension(spark, sf_dir):
    return X.frame(spark, sf_dir, X.FILES).select("document_id", T.extension(F.col("name")).alias("ext"))


@register("parent_path", "SELECT page_id, CASE WHEN length(p) > 2 THEN p END AS parent FROM (SELECT page_id, regexp_extract(url, '^(.*)[\\\\/][^\\\\/]*$', 1) AS p FROM pages)")
def parent_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.parent_path(F.col("url")).alias("parent"))


@register("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))


@register("id_codec", "SELECT p_partkey, 'document:' || md5(p_name) AS id, md5(p_name) AS value, NULL::VARCHAR AS error FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'link:' || md5(p_name), NULL, 'prefix' FROM part WHERE p_partkey % 3 = 1 UNION ALL SELECT p_partkey, 'document:' || left(md5(p_name), 31), NULL, 'length' FROM part WHERE p_partkey % 3 = 2")
def id_codec(spark, sf_dir):
    k = F.col("p_partkey") % 3
    ids = F.when(k == 0, V.format_id("document", F.unhex(F.md5("p_name")))).when(k == 1, F.concat(F.lit("link:"), F.md5("p_name"))).otherwise(F.concat(F.lit("document:"), F.left(F.md5("p_name"), F.lit(31))))
    out = table(spark, sf_dir, "part").select("p_partkey", ids.alias("id")).withColumn("parsed", V.parse_id("document", F.col("id")))
    return out.select("p_partkey", "id", F.lower(F.hex("parsed.value")).alias("value"), "parsed.error")


@register("numbers", "SELECT p_partkey, (p_partkey * 1234567 // 10000)::BIGINT AS unix_ms, (least(p_size, p_size - 1) * 10000 // nullif(p_size - 1, 0))::INTEGER AS share, ceil(p_size / 7.0)::BIGINT AS up, 'generation-' || lpad(p_partkey::VARCHAR, 20, '0') AS generation, greatest(p_size - 25, 0)::BIGINT AS rest, greatest(10, p_size * 20 // 100)::BIGINT AS reserve FROM part")
def numbers(spark, sf_dir):
    n = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", V.filetime_ms(F.col("p_partkey") * 1234567 + V.FILETIME_EPOCH).alias("unix_ms"), V.basis_points(n, n - 1).alias("share"), F.ceil(n / F.lit(7)).alias("up"), V.generation_name(F.col("p_partkey")).alias("generation"), V.subtract_saturating(n, F.lit(25).cast("long")).alias("rest"), V.disk_reserve(n, 10, 20).alias("reserve"))


@register("journal_page", "WITH e AS (SELECT event_id // 3 AS position, (event_id % 3)::INTEGER AS part, event_type FROM events) SELECT position, part, event_type FROM e WHERE position > 40 OR position = 40 AND part > 0 ORDER BY position, part LIMIT 100")
def journal_page(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 3).alias("position"), (F.col("event_id") % 3).cast("int").alias("part"), "event_type")
    return journal.bounded(rows, (40, 0), 100)[0]


@register("outbox_append_wide", "SELECT row_number() OVER (ORDER BY event_id) AS sequence, event_id AS document_id, sha256(repeat(md5(event_id::VARCHAR), 60)) AS text_sha256 FROM events")
def outbox_append_wide(spark, sf_dir):
    text = F.repeat(F.md5(F.col("event_id").cast("string").cast("binary")), F.lit(60))
    changes = table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.lit("upsert").alias("mutation"), F.struct("event_id", text.alias("text")).alias("document"))
    rows = written(catalog.outbox_rows(changes, 0, 1), "outbox")
    return rows.select("sequence", "document_id", F.sha2(F.get_json_object("payload", "$.text"), 256).alias("text_sha256"))


# --- evaluation -----------------------------------------------------------------------------------------------------


@register("latency_percentiles_nearest_rank", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS samples, max(value) FILTER (r = ceil(n * 50 / 100)) AS p50, max(value) FILTER (r = ceil(n * 95 / 100)) AS p95, max(value) FILTER (r = ceil(n * 99 / 100)) AS p99, max(value) AS maximum FROM r GROUP BY event_type""")
def latency_percentiles_nearest_rank(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"])


@register("latency_percentiles_floor_index", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS samples, max(value) FILTER (r = floor((n - 1) * 50 / 100) + 1) AS p50, max(value) FILTER (r = floor((n - 1) * 95 / 100) + 1) AS p95, max(value) FILTER (r = floor((n - 1) * 99 / 100) + 1) AS p99, max(value) AS maximum FROM r GROUP BY event_type""")
def latency_percentiles_floor_index(spark, sf_dir):
    return evaluate.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"], floor_index=True)


@register("recall_precision", "WITH t AS (SELECT DISTINCT o_custkey % 40 AS query_id, o_orderkey % 100 AS document_id FROM orders WHERE o_custkey % 40 <> 7), r AS (SELECT DISTINCT o_custkey % 40 AS query_id, o_orderkey % 90 AS document_id FROM orders WHERE o_custkey % 40 <> 9 AND o_orderkey % 3 = 0), q AS (SELECT range AS query_id FROM range(40)), b AS (SELECT coalesce(t.query_id, r.query_id) AS query_id, t.document_id AS a, r.document_id AS b FROM t FULL JOIN r ON t.query_id = r.query_id AND t.document_id = r.document_id), c AS (SELECT q.query_id, count(a) AS relevant, count(b) AS returned, count(a + b) AS hits FROM q LEFT JOIN b ON b.query_id = q.query_id GROUP BY ALL) SELECT *, CASE WHEN relevant = 0 THEN 1.0::DOUBLE ELSE hits / relevant END AS recall, CASE WHEN returned = 0 THEN 1.0::DOUBLE ELSE hits / returned END AS precision FROM c")
def recall_precision(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("query_id", F.col("o_custkey") % 40)
    truth = o.where("query_id <> 7").select("query_id", (F.col("o_orderkey") % 100).alias("document_id"))
    returned = o.where("query_id <> 9 and o_orderkey % 3 = 0").select("query_id", (F.col("o_orderkey") % 90).alias("document_id"))
    return evaluate.recall_precision(truth, returned, spark.range(40).withColumnRenamed("id", "query_id"))


@register("substring_recall", "SELECT i::BIGINT AS query_id, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS precision FROM range(19) t(i)")
def substring_recall(spark, sf_dir):
    """Recall and precision of the gram index on the controlled names, against brute force: all must be 1."""
    docs, queries = evaluate.controlled_workload(spark)
    docs = _projected(docs)
    found = S.search_many(docs, queries, 100_000).where(F.contains("name_norm", F.col("q"))).select("query_id", "document_id")
    return evaluate.recall_precision(evaluate.substring_truth(docs, queries), found, queries).select("query_id", "recall", "precision")


@register("build_metrics", "SELECT p_brand, sum(p_size) / count(*) AS bytes_per_document, (sum(p_size) + 1000) / 1000 AS amplification, count(*) / 4 AS documents_per_second FROM part GROUP BY p_brand")
def build_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("b"))
    return rows.select("p_brand", *evaluate.build_metrics(F.col("n"), F.col("b"), F.lit(1000), F.lit(4)))


@register("gc_candidates", "WITH g AS (SELECT o_orderkey AS generation, ['retired', 'failed', 'active', 'ready'][o_orderkey % 4 + 1] AS state, o_custkey AS updated_at FROM orders), r AS (SELECT *, row_number() OVER (ORDER BY updated_at DESC, generation DESC) AS n FROM g WHERE state = 'retired') SELECT generation FROM r WHERE n > 10 UNION ALL SELECT generation FROM g WHERE state = 'failed'")
def gc_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("generation"), F.element_at(F.array(*map(F.lit, ("retired", "failed", "active", "ready"))), (F.col("o_orderkey") % 4 + 1).cast("int")).alias("state"), F.col("o_custkey").alias("updated_at"))
    return garbage(rows, 10)


# --- sources and streams --------------------------------------------------------------------------------------------


@register("select_volumes", f"WITH v AS ({X.VOLUMES}) SELECT volume_id FROM v WHERE display_name IN ('ASIA', 'EUROPE') OR volume_id = 'v0'")
def select_volumes(spark, sf_dir):
    v = X.frame(spark, sf_dir, X.VOLUMES).withColumns({"mount_points": F.array(F.concat(F.lit("C:\\"), "display_name", F.lit("\\"))), "local": F.lit(True), "filesystem": F.lit("NTFS")})
    return graph.select_volumes(v, ["c:\\asia", "C:\\Europe\\", "v0"]).select("volume_id")


@register("journal_event_kinds", "SELECT event_id, array_to_string(CASE WHEN event_id % 19 = 0 THEN ['reconciliation_required'] WHEN event_type = 'signup' THEN [] WHEN event_type = 'error' THEN ['link_removed', 'object_removed'] WHEN event_type = 'click' THEN ['link_observed'] WHEN event_type = 'view' THEN ['object_observed'] ELSE ['object_observed', 'link_observed'] END, ',') AS kinds FROM events")
def journal_event_kinds(spark, sf_dir):
    reason = F.create_map(*(F.lit(x) for pair in (("signup", journal.RENAME_OLD), ("error", journal.FILE_DELETE), ("click", journal.HARD_LINK), ("view", journal.DATA_CHANGE), ("purchase", journal.FILE_CREATE)) for x in pair))
    rows = table(spark, sf_dir, "events").select("event_id", F.element_at(reason, F.col("event_type")).cast("long").alias("reason"), (F.col("event_id") % 19 == 0).alias("had_invalid_utf16"))
    return journal.event_kinds(rows).select("event_id", F.array_join("kinds", ",").alias("kinds"))


@register("journal_checkpoint_gaps", "SELECT 'v' || n_nationkey AS volume_id FROM nation WHERE n_regionkey = 1 OR n_nationkey * 10 < 55")
def journal_checkpoint_gaps(spark, sf_dir):
    n = table(spark, sf_dir, "nation").withColumn("volume_id", F.concat(F.lit("v"), F.col("n_nationkey").cast("string")))
    saved = n.select("volume_id", F.lit(1).alias("journal"), (F.col("n_nationkey") * 10).alias("position"))
    return journal.checkpoint_gaps(saved, n.select("volume_id", F.when(F.col("n_regionkey") == 1, 2).otherwise(1).alias("journal"), F.lit(55).alias("lowest")))


@register("journal_correlation")
def journal_correlation(spark, sf_dir):
    """Events as journals: users are volumes; creations, renames in two halves and deletions."""
    e = table(spark, sf_dir, "events")
    reason = F.create_map(*(F.lit(x) for pair in (("signup", journal.FILE_CREATE), ("click", journal.RENAME_OLD), ("view", journal.RENAME_NEW), ("purchase", journal.DATA_CHANGE), ("error", journal.FILE_DELETE)) for x in pair))
    rows = e.select(F.unhex(F.md5(F.col("user_id").cast("string"))).alias("volume_id"), (F.col("event_id") % 5).alias("file_reference"), F.lit(5).cast("long").alias("parent_reference"), F.col("event_id").alias("position"), F.element_at(reason, F.col("event_type")).cast("long").alias("reason"), F.lit(0).cast("long").alias("attributes"), F.concat(F.lit("f"), (F.col("event_id") % 3).cast("string")).alias("name"), F.lit(False).alias("had_invalid_utf16"))
    out = stateful.correlate_batch(rows)
    return out.select(F.lower(F.hex("volume_id")).alias("volume_id"), "position", "part", "event", "file_reference", F.lower(F.hex("file_link_id")).alias("file_link_id"), "name")


@register("governor_decisions")
def governor_decisions(spark, sf_dir):
    """Users as machines, events as signals: samples with the event's value as load, searches, windows."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for pair in (("signup", "interactive"), ("click", "sample"), ("view", "window"), ("purchase", "backlog"), ("error", "sample")) for x in pair))
    rows = e.select(F.col("user_id").cast("string").alias("machine"), F.col("event_id").alias("sequence"), F.element_at(kind, F.col("event_type")).alias("kind"), F.least(F.col("value") * 100, F.lit(10000)).cast("int").alias("cpu"), F.lit(5000).alias("memory"), F.lit(None).cast("int").alias("disk"), F.lit("ac").alias("power"), F.lit(False).alias("energy_saver"), F.col("event_id").alias("backlog"))
    return stateful.govern_batch(rows)


# The budgets, written out beside governor.BUDGETS so that the comparison can fail.
@register("governor_budgets", """SELECT * FROM (VALUES
('active', 0, 0, 0, 33554432, 1000, 0, 'paused', true),
('balanced', 5000, 20, 5000, 67108864, 5000, 1, 'normal', false),
('idle_boost', 10000, 100, 30000, 134217728, 10000, 1, 'elevated', false),
('pressure', 128, 0, 0, 33554432, 500, 0, 'paused', true),
('battery', 256, 1, 250, 33554432, 1000, 1, 'minimal', false),
('battery_saver', 0, 0, 0, 33554432, 1000, 0, 'paused', true)
) t(mode, maximum_batch_mutations, maximum_batches, maximum_run_time_millis, writer_heap_bytes, rebuild_page_size, projection_concurrency, maintenance_intensity, background_paused)""")
def governor_budgets(spark, sf_dir):
    rows = pd.DataFrame([{"mode": k, **dict(zip(governor.BUDGET_FIELDS, v, strict=True))} for k, v in governor.BUDGETS.items()])
    return spark.createDataFrame(rows, "mode string, maximum_batch_mutations int, maximum_batches int, maximum_run_time_millis int, writer_heap_bytes int, rebuild_page_size int, projection_concurrency int, maintenance_intensity string, background_paused boolean")


@register("synthetic_catalog")
def synthetic_catalog(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").count()
    return generator.catalog(spark, n, 20260814)


@register("synthetic_queries")
def synthetic_queries(spark, sf_dir):
    return generator.retrieval_queries(spark, table(spark, sf_dir, "lineitem").count(), 200, 20260814)


@register("synthetic_search")
def synthetic_search(spark, sf_dir):
    """The generator's workload on its own catalog, all queries at once."""
    n = table(spark, sf_dir, "lineitem").count()
    docs = _projected(generator.as_documents(generator.catalog(spark, n, 20260814)))
    asked = generator.retrieval_queries(spark, n, 30, 20260814).select(F.col("place").alias("query_id"), T.normalize(F.col("text")).alias("q"))
    return S.search_many(docs, asked, 10).select("query_id", "document_id", "rank", "match_type")


# --- strategies of the evaluation harness ---------------------------------------------------------------------------

_LEX = "(nn = '{q}' OR list_contains(nt, '{q}') OR (length('{q}') <= {p} AND starts_with(nn, '{q}')))"
_GRAMS = "len([g FOR g IN [substr('{q}', i, {w}) FOR i IN range(1, length('{q}') - {w} + 2)] IF NOT contains(nn, g)]) = 0"


def _add_strategy(name: str, strategy: str, q: str, priority: str, limit: int = 40) -> None:
    sql = _D.replace("{base}", X.PARTS) + f""",
c AS (SELECT *, {priority} AS priority FROM d), k AS (SELECT * FROM c WHERE priority IS NOT NULL ORDER BY priority, document_id LIMIT {limit}),
m AS (SELECT *, {_CLASS.format(q=q).replace(f"length('{q}') >= 3 AND ", "")} AS match_class FROM k)
SELECT document_id, priority::INTEGER AS priority, ['exact', 'prefix', 'token', 'substring', 'path'][match_class + 1] AS match_type, row_number() OVER (ORDER BY match_class, nn, pn, document_id)::INTEGER AS rank FROM m WHERE match_class IS NOT NULL"""
    register(name, sql)(lambda spark, sf_dir: R.run(R.with_columns(X.frame(spark, sf_dir, X.PARTS)), q, strategy, candidates=limit).select("document_id", "priority", "match_type", "rank"))


_add_strategy("strategy_trigram", "trigram", "widg", "CASE WHEN " + _GRAMS.format(q="widg", w=3) + " THEN 1 END")
_add_strategy("strategy_lexical_then_trigram", "lexical_then_trigram", "ring", "CASE WHEN " + _LEX.format(q="ring", p=16) + " THEN 0 WHEN " + _GRAMS.format(q="ring", w=3) + " THEN 1 END", 500)
_add_strategy("strategy_four_gram", "four_gram", "l ring", "CASE WHEN " + _GRAMS.format(q="l ring", w=4) + " THEN 1 END")
_add_strategy("strategy_four_gram_short", "four_gram", "red", "CASE WHEN " + _LEX.format(q="red", p=16) + " THEN 0 END")
_add_strategy("strategy_lexical", "lexical", "bolt", "CASE WHEN " + _LEX.format(q="bolt", p=16) + " THEN 0 END", 500)


@register("strategy_plain", _D.replace("{base}", X.PARTS) + " SELECT document_id, name FROM d WHERE " + _LEX.format(q="small", p=32) + " ORDER BY document_id LIMIT 30")
def strategy_plain(spark, sf_dir):
    return R.plain_search(X.frame(spark, sf_dir, X.PARTS), "Small", 30).select("document_id", "name")
