"""Plaintext content: which documents are read, their index, its search and its changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import CapacityExceeded, InvalidRequest, InvariantViolation
from ..functions import text as T
from ..plans import content_query
from .catalog import duplicates

#: Extensions whose files are read as text.
EXTENSIONS = (
    "bat", "c", "cc", "cfg", "cmd", "conf", "cpp", "css", "csv", "cs", "cxx", "go", "h",
    "hpp", "htm", "html", "ini", "java", "js", "json", "jsx", "kt", "kts", "log",
    "markdown", "md", "php", "ps1", "py", "rb", "rs", "sh", "sql", "swift", "toml", "ts",
    "tsx", "txt", "vue", "xml", "yaml", "yml",
)
#: Fixed value: the largest limit that a policy may set on a file's bytes.
MOST_BYTES = 16 * 1024 * 1024


@dataclass(frozen=True)
class Policy:
    """What may be read: folders (that don't hold each other), a limit of bytes and extensions."""

    roots: tuple[str, ...]
    max_file_bytes: int
    extensions: tuple[str, ...] = EXTENSIONS

    def __post_init__(self):
        roots = sorted({r.rstrip("/") for r in self.roots})
        if not 0 < self.max_file_bytes <= MOST_BYTES:
            raise InvalidRequest(f"a file's limit is 1 to {MOST_BYTES} bytes")
        if not roots or any(b.startswith(a + "/") for a in roots for b in roots):
            raise InvalidRequest("roots are needed, and none inside another")
        object.__setattr__(self, "roots", tuple(roots))


def declared_reason(policy: Policy) -> Column:
    """Why a document isn't read, as far as the catalog tells; null if it may be: unavailable, extension, too_large, outside_roots."""
    path = F.col("resolved_path")
    inside = F.lit(False)
    for r in policy.roots:
        inside = inside | (path == r) | F.startswith(path, F.lit(r + "/"))
    return (
        F.when((F.col("kind") != "file") | (F.col("availability") != "online"), "unavailable")
        .when(F.col("extension").isNull() | ~F.lower("extension").isin(*policy.extensions), "extension")
        .when(F.col("size") > policy.max_file_bytes, "too_large")
        .when(~inside, "outside_roots")
    )


def read_reason(policy: Policy) -> Column:
    """Why bytes that were read (content, null if unreadable) aren't indexed: io, too_large, non_text; null if they are."""
    content = F.col("content")
    return F.when(content.isNull(), "io").when(F.octet_length(content) > policy.max_file_bytes, "too_large").when(_has_nul(content) | ~F.is_valid_utf8(content.cast("string")), "non_text")


def _has_nul(content: Column) -> Column:
    return F.contains(content, F.unhex(F.lit("00")))


def eligibility(documents: DataFrame, policy: Policy) -> DataFrame:
    """Documents with skip_reason: what the catalog tells first, then the bytes, if there is a column content."""
    reason = declared_reason(policy)
    if "content" in documents.columns:
        reason = F.coalesce(reason, read_reason(policy))
    return documents.withColumn("skip_reason", reason)


def declared_bytes(documents: DataFrame, policy: Policy) -> DataFrame:
    """(eligible_bytes, documents, forecast_bytes): what a build will read and take; 2 bytes for each byte and 1 KiB a document."""
    good = (F.col("kind") == "file") & (F.col("availability") == "online") & (F.col("size") <= policy.max_file_bytes) & F.coalesce(F.lower("extension").isin(*policy.extensions), F.lit(False))
    out = documents.agg(F.coalesce(F.sum(F.when(good, F.col("size"))), F.lit(0)).alias("eligible_bytes"), F.count("*").alias("documents"))
    return out.withColumn("forecast_bytes", 2 * F.col("eligible_bytes") + 1024 * F.col("documents"))


def summary(rows: DataFrame, column: str = "skip_reason", names: tuple[str, ...] = ("unavailable", "extension", "too_large", "io", "outside_roots", "non_text")) -> DataFrame:
    """One row of counts: all documents, those indexed, and those skipped for each reason."""
    counts = [F.coalesce(F.sum((F.col(column) == n).cast("long")), F.lit(0)).alias(f"skipped_{n}") for n in names]
    return rows.agg(F.count("*").alias("catalog_documents"), F.coalesce(F.sum(F.col(column).isNull().cast("long")), F.lit(0)).alias("indexed_documents"), *counts)


def index(documents: DataFrame) -> DataFrame:
    """Eligible documents (with text, or content) as index rows: document_id, source columns, content_hash and the line that is searched."""
    text = F.col("text") if "text" in documents.columns else F.col("content").cast("string")
    source = [c for c in ("volume_id", "file_id", "kind", "size", "modified_at_unix_ms", "availability", "fingerprint") if c in documents.columns]
    return documents.select("document_id", *source, F.sha2(text, 256).alias("content_hash"), T.content_line(text).alias("line"))


def postings(indexed: DataFrame) -> DataFrame:
    """(term, document_id, positions): the inverted form of an index, for storage by term."""
    words = indexed.select("document_id", F.posexplode(F.split(F.trim("line"), " ")).alias("position", "term")).where("term != '' and term != '\\0'")
    return words.groupBy("term", "document_id").agg(F.array_sort(F.collect_list("position")).alias("positions"))


def search(indexed: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """(document_id): the first `limit` matches by id. Content hits have no score."""
    if not 1 <= limit <= content_query.LIMIT:
        raise InvalidRequest(f"limit is 1 to {content_query.LIMIT}")
    tree = content_query.plan(query)
    return indexed.where(content_query.predicate(tree, F.col("line"))).select("document_id").orderBy("document_id").limit(limit)


def phrase_postings(posted: DataFrame, tokens: list[str]) -> DataFrame:
    """(document_id): documents with the tokens in a row, from postings; one join for each further token, on the document."""
    if not tokens:
        raise InvalidRequest("a phrase has a token")
    out = posted.where(F.col("term") == tokens[0]).select("document_id", "positions")
    for n, t in enumerate(tokens[1:], 1):
        after = posted.where(F.col("term") == t).select("document_id", F.col("positions").alias("next"))
        out = out.join(after, "document_id").select("document_id", F.filter("positions", _followed(n)).alias("positions")).where(F.size("positions") > 0)
    return out.select("document_id")


def _followed(n: int):
    return lambda p: F.array_contains(F.col("next"), p + n)


def resolved_hits(hits: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits with their current documents; those gone since drop out, ranks are dense after that, the limit held before it."""
    rows = hits.join(documents, "document_id")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("document_id")))  # over `limit` rows


def delta(prior: DataFrame, upserts: DataFrame, deletions: DataFrame) -> DataFrame:
    """(document_id, outcome) of a batch against the index.

    prior: index rows. upserts: eligibility() rows with fingerprint and content_hash (the hash may be null for skipped rows).
    Outcomes by the first that holds: skipped or evicted (not eligible, not or yet indexed), unchanged (same document),
    metadata_only (same object, kind, size, known mtime and availability), unchanged_hash, updated, added; and removed
    for deletions of what is indexed, absent for others.
    """
    p = prior.select("document_id", F.lit(True).alias("was"), *(F.col(c).alias(f"p_{c}") for c in ("volume_id", "file_id", "kind", "size", "modified_at_unix_ms", "availability", "fingerprint", "content_hash")))
    same = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in ("volume_id", "file_id", "kind", "size", "availability")]
    source = same[0]
    for s in same[1:]:
        source = source & s
    source = source & F.col("modified_at_unix_ms").isNotNull() & (F.col("modified_at_unix_ms") == F.col("p_modified_at_unix_ms"))
    outcome = (
        F.when(F.col("skip_reason").isNotNull(), F.when(F.col("was"), "evicted").otherwise("skipped"))
        .when(F.col("was") & (F.col("fingerprint") == F.col("p_fingerprint")), "unchanged")
        .when(F.col("was") & source, "metadata_only")
        .when(F.col("was") & (F.col("content_hash") == F.col("p_content_hash")), "unchanged_hash")
        .when(F.col("was"), "updated")
        .otherwise("added")
    )
    changed = upserts.join(p, "document_id", "left").select("document_id", outcome.alias("outcome"))
    gone = deletions.select("document_id").join(p.select("document_id", "was"), "document_id", "left").select("document_id", F.when(F.col("was"), "removed").otherwise("absent").alias("outcome"))
    return changed.unionAll(gone)


def check_batch(upserts: DataFrame, deletions: DataFrame) -> None:
    """Raise if a batch names a document twice, in whatever way."""
    twice = duplicates(upserts.select("document_id").unionAll(deletions.select("document_id"))).limit(3).collect()
    if twice:
        raise InvariantViolation(f"named twice in a batch: {', '.join(str(r.document_id) for r in twice)}")


def apply_delta(prior: DataFrame, upserts: DataFrame, deletions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The index after a batch: rows evicted, removed or rewritten go, new texts come. upserts: index() rows of eligible documents."""
    gone = outcomes.where(F.col("outcome").isin("evicted", "removed", "updated"))
    new = outcomes.where(F.col("outcome").isin("updated", "added"))
    return prior.join(gone.select("document_id"), "document_id", "left_anti").unionByName(upserts.join(new.select("document_id"), "document_id", "left_semi").select(*prior.columns))


def sync_outcomes(prior: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(document_id, outcome) of a whole snapshot: delta() where what the snapshot lacks is removed. One full outer join on the id."""
    there = snapshot.select("document_id")
    return delta(prior, snapshot, prior.select("document_id").join(there, "document_id", "left_anti"))


def check_capacity(bytes_now: int, documents_now: int, forecast: int, free_bytes: int, reserve: int, max_bytes: int, max_documents: int) -> None:
    """Refuse a page that would pass a limit of bytes, of documents or of the disk."""
    for what, over in (("bytes", bytes_now + forecast > max_bytes), ("documents", documents_now > max_documents), ("disk", free_bytes - forecast < reserve)):
        if over:
            raise CapacityExceeded(f"the limit of {what} is reached", limit=what)
