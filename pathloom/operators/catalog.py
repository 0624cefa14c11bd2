"""The desired catalog as a materialized view: documents, their fingerprints, the outbox and its consumers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvariantViolation
from ..functions import text as T
from ..functions import values as V
from .graph import KEY, State, effective_availability, resolve_paths
from .numbering import numbered

#: What a document's fingerprint covers: all but its version.
CONTENT = ["document_id", "volume_id", "file_id", "file_link_id", "name", "resolved_path", "extension", "kind", "size", "created_at_unix_ms", "modified_at_unix_ms", "hidden", "availability"]


def desired(state: State, version: int = 0, paths: DataFrame | None = None) -> DataFrame:
    """The catalog that the state calls for: a document for each link of a live object whose path resolves.

    paths: of resolve_paths(), if there already. Volumes are few; the join with them is left to the optimizer's size check.
    """
    paths = resolve_paths(state.links) if paths is None else paths
    good = paths.where("error is null").select("file_link_id", "resolved_path")
    live = state.objects.where(~F.col("tombstoned")).drop("tombstoned", "observation_generation")
    rows = state.links.select("file_link_id", *KEY, "name").join(good, "file_link_id").join(live, KEY).join(state.volumes.select("volume_id", F.col("state").alias("volume_state")), "volume_id")
    out = rows.select(
        F.col("file_link_id").alias("document_id"), *KEY, "file_link_id", F.lit(version).cast("long").alias("document_version"), "name", "resolved_path", T.extension(F.col("name")).alias("extension"),
        "kind", "size", "created_at_unix_ms", "modified_at_unix_ms", "hidden", effective_availability(F.col("volume_state"), F.col("availability")).alias("availability"),
    )
    return out.withColumn("fingerprint", V.payload_fingerprint(*CONTENT))


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """(document_id, mutation, document): upserts of documents that are new or whose fingerprint changed, deletes of those gone."""
    n = new.select("document_id", F.col("fingerprint").alias("now"), F.struct(*new.columns).alias("document"))
    o = old.select("document_id", F.col("fingerprint").alias("was"))
    both = o.join(n, "document_id", "full_outer")
    kind = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull() | (F.col("was") != F.col("now")), "upsert")
    return both.select("document_id", kind.alias("mutation"), "document").where("mutation is not null")


def outbox_rows(changes: DataFrame, high_water: int, version: int) -> DataFrame:
    """Log rows of a batch's changes: sequences follow high_water without gaps, in the order of ids, none lost however large the batch."""
    return numbered(changes, "document_id").select((F.lit(high_water) + F.col("place")).cast("long").alias("sequence"), "document_id", F.lit(version).cast("long").alias("document_version"), "mutation", F.to_json("document").alias("payload"))


def read_outbox(outbox: DataFrame, after: int | None, limit: int) -> DataFrame:
    """The next `limit` rows after a sequence, in order."""
    rows = outbox if after is None else outbox.where(F.col("sequence") > after)
    return rows.orderBy("sequence").limit(limit)


def gaps(outbox: DataFrame) -> DataFrame:
    """(sequence, previous): rows that don't follow the one before by one. A batch that is applied must have none.

    The row before is found by a join on the sequence, not by a window over the whole log.
    """
    follows = outbox.select((F.col("sequence") + 1).alias("sequence"))
    first = outbox.agg(F.min("sequence").alias("first"))
    open_ends = outbox.select("sequence").join(follows, "sequence", "left_anti").join(F.broadcast(first), F.col("sequence") != F.col("first"))
    before = outbox.select(F.col("sequence").alias("previous")).join(outbox.select((F.col("sequence") - 1).alias("previous")), "previous", "left_anti")
    numbered = lambda df, by: df.withColumn("n", F.row_number().over(Window.orderBy(by)))  # noqa: E731 - a row for each gap
    return numbered(open_ends.select("sequence"), "sequence").join(numbered(before, "previous"), "n").select("sequence", "previous")


def last_writes(mutations: DataFrame, key: str = "document_id", sequence: str = "sequence") -> DataFrame:
    """Each document's last mutation: partial aggregation keeps one row a document and task before the shuffle."""
    rest = [c for c in mutations.columns if c != key]
    return mutations.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("last")).select(key, *(F.col(f"last.{c}").alias(c) for c in rest))


def duplicates(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Keys that come twice or more: a batch that must name a document once has none."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def merge(documents: DataFrame, mutations: DataFrame) -> DataFrame:
    """Documents after a batch's mutations (sequence, document_id, mutation, document): the last one of each decides; applying it again changes nothing."""
    last = last_writes(mutations.select("sequence", "document_id", "mutation", "document"))
    kept = documents.join(last.select("document_id"), "document_id", "left_anti")
    return kept.unionByName(last.where("mutation = 'upsert'").select("document.*").select(*documents.columns))


def high_water(outbox: DataFrame, consumers: DataFrame, retired: DataFrame | None = None) -> DataFrame:
    """(latest): the largest sequence that was ever handed out, by the log, its consumers or what was pruned; 0 if none."""
    parts = outbox.agg(F.max("sequence").alias("s")).unionAll(consumers.agg(F.max("last_sequence").alias("s")))
    if retired is not None:
        parts = parts.unionAll(retired.agg(F.max("sequence").alias("s")))
    return parts.agg(F.coalesce(F.max("s"), F.lit(0)).alias("latest"))


def backlog(outbox: DataFrame, consumers: DataFrame) -> DataFrame:
    """(consumer_id, backlog): rows that a consumer has yet to apply, never below 0."""
    latest = high_water(outbox, consumers).withColumn("one", F.lit(1))
    return consumers.withColumn("one", F.lit(1)).join(F.broadcast(latest), "one").select("consumer_id", V.subtract_saturating(F.col("latest"), F.col("last_sequence")).alias("backlog"))


def combined_backlog(catalog: int, content: int, maintenance_pending: bool) -> int:
    """What the governor is told: the largest of the two and of pending maintenance."""
    return max(catalog, content, int(maintenance_pending))


def prune_bound(consumers: DataFrame) -> DataFrame:
    """(safe): the sequence up to which every consumer is done; null without consumers: then nothing may go."""
    return consumers.agg(F.min("last_sequence").alias("safe"))


def pruned(outbox: DataFrame, consumers: DataFrame, limit: int | None = None) -> DataFrame:
    """The log without rows that all consumers are past; with a limit (1 to 100000), only the oldest of them go."""
    if limit is not None and not 1 <= limit <= 100_000:
        raise InvariantViolation("a bounded prune takes 1 to 100000 rows")
    safe = prune_bound(consumers)
    gone = outbox.join(F.broadcast(safe), F.col("sequence") <= F.col("safe"), "left_semi")
    if limit is not None:
        gone = gone.orderBy("sequence").limit(limit)
    return outbox.join(gone.select("sequence"), "sequence", "left_anti")


def acknowledge(consumers: DataFrame, consumer_id: str, sequence: int, durable: int, generation: int) -> DataFrame:
    """Consumers with one's checkpoint moved on: it never goes back and never past the log's durable end."""
    row = consumers.where(F.col("consumer_id") == consumer_id).first()
    if row is not None and sequence < row.last_sequence:
        raise InvariantViolation("a checkpoint doesn't go back", rule="regressed")
    if sequence > durable:
        raise InvariantViolation("a checkpoint isn't past the log", rule="ahead")
    new = consumers.sparkSession.createDataFrame([(consumer_id, sequence, generation)], consumers.schema)
    return consumers.where(F.col("consumer_id") != consumer_id).unionByName(new)


def fingerprint(documents: DataFrame) -> DataFrame:
    """(documents, distinct_ids, xor_hash, sum_hash, duplicates): equal for two catalogs with the same rows, in any order."""
    h = F.xxhash64("document_id", "document_version", *[c for c in CONTENT if c != "document_id"])
    out = documents.agg(F.count("*").alias("documents"), F.count_distinct("document_id").alias("distinct_ids"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor_hash"), F.coalesce(V.wrapped_sum(h), F.lit(0).cast("decimal(38,0)")).alias("sum_hash"))
    return out.withColumn("duplicates", F.col("documents") - F.col("distinct_ids"))


def converged(left: DataFrame, right: DataFrame) -> bool:
    """Whether two catalogs hold the same rows."""
    return fingerprint(left).first() == fingerprint(right).first()


def drift(want: DataFrame, have: DataFrame) -> DataFrame:
    """(document_id, drift): lost (wanted, not there), stale (there, not wanted) or changed."""
    n = want.select("document_id", F.col("fingerprint").alias("now"))
    o = have.select("document_id", F.col("fingerprint").alias("was"))
    what = F.when(F.col("was").isNull(), "lost").when(F.col("now").isNull(), "stale").when(F.col("was") != F.col("now"), "changed")
    return o.join(n, "document_id", "full_outer").select("document_id", what.alias("drift")).where("drift is not null")


def identities(documents: DataFrame, volume_id: str) -> DataFrame:
    """Ids of a volume's documents, in order."""
    return documents.where(F.col("volume_id") == volume_id).select("document_id", *KEY, "file_link_id").orderBy("document_id")
