"""Consumers of the outbox as streams: the catalog's projection, the content index's, and their recovery.

The log is a folder of Parquet files that batches append to. A micro-batch is checked, merged into the next generation,
activated and only then acknowledged, so a batch that is cut off anywhere is applied again with the same result.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import InvariantViolation, NotFound
from ..operators import catalog, content
from ..sources.scratch import written
from ..sources.tables import Folder, Generations, read_slots, write_slots


class OutboxLog:
    """Append-only log of mutations; sequences are never used twice, also after pruning."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, root)

    def append(self, rows: DataFrame, batch: int) -> None:
        """Add a batch's rows (layout OUTBOX). The folder has the batch's name: written again after a failure, it replaces itself."""
        rows.write.mode("overwrite").parquet(f"{self.root}/log/batch-{batch:020d}")
        top = self.spark.read.parquet(f"{self.root}/log/batch-{batch:020d}").agg(F.max("sequence")).first()[0]
        write_slots(self.folder, "high-water", {"sequence": max(top or 0, self.high_water())})

    def stage(self, rows: DataFrame, batch: int) -> tuple[int, int | None]:
        """Write a batch's rows where no consumer sees them; returns their number and last sequence."""
        rows.write.mode("overwrite").parquet(f"{self.root}/staged/batch-{batch:020d}")
        return tuple(self.spark.read.parquet(f"{self.root}/staged/batch-{batch:020d}").agg(F.count("*"), F.max("sequence")).first())

    def settle(self, batch: int, sequence: int) -> None:
        """Move the staged batch into the log, whose end is `sequence` then; drop what else is staged: its publication was cut off."""
        for name in Folder(self.spark, f"{self.root}/staged").names() if self.folder.exists("staged") else []:
            if name == f"batch-{batch:020d}":
                if sequence > self.high_water():
                    write_slots(self.folder, "high-water", {"sequence": sequence})
                self.folder.move(f"staged/{name}", f"log/{name}")
            else:
                self.folder.delete(f"staged/{name}")

    def read(self) -> DataFrame:
        if not self.folder.exists("log"):
            return self.spark.createDataFrame([], schemas.OUTBOX)
        return self.spark.read.schema(schemas.OUTBOX).option("recursiveFileLookup", "true").parquet(f"{self.root}/log")

    def stream(self, files: int = 16) -> DataFrame:
        return self.spark.readStream.schema(schemas.OUTBOX).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).parquet(f"{self.root}/log")

    def high_water(self) -> int:
        return (read_slots(self.folder, "high-water") or {"sequence": 0})["sequence"]

    def prune(self, safe: int | None) -> list[str]:
        """Delete the batches whose rows all consumers are past; nothing without consumers."""
        gone = []
        if safe is not None and self.folder.exists("log"):
            for name in Folder(self.spark, f"{self.root}/log").names():
                if name.startswith("batch-") and self.spark.read.parquet(f"{self.root}/log/{name}").where(F.col("sequence") > safe).isEmpty():
                    self.folder.delete(f"log/{name}")
                    gone.append(name)
        return gone


class Consumer:
    """A consumer's durable checkpoint: last sequence and generation. It never goes back and never past the log."""

    def __init__(self, spark: SparkSession, root: str, name: str):
        self.folder, self.name = Folder(spark, root), f"consumer-{name}"

    def state(self) -> dict:
        return read_slots(self.folder, self.name) or {"sequence": 0, "generation": None}

    def acknowledge(self, sequence: int, generation: int, durable: int) -> None:
        now = self.state()
        if sequence < now["sequence"]:
            raise InvariantViolation("a checkpoint doesn't go back", rule="regressed")
        if sequence > durable:
            raise InvariantViolation("a checkpoint isn't past the log", rule="ahead")
        write_slots(self.folder, self.name, {"sequence": sequence, "generation": generation})


class Projector:
    """Keeps generations of a table of documents level with an outbox."""

    def __init__(self, spark: SparkSession, log: OutboxLog, root: str, name: str = "catalog", schema: str = schemas.DOCUMENTS):
        self.spark, self.log, self.schema, self.name = spark, log, schema, name
        self.generations = Generations(spark, f"{root.rstrip('/')}/{name}")
        self.consumer = Consumer(spark, root, name)
        self.stream_checkpoint = f"{root.rstrip('/')}/stream-{name}"

    def apply(self, mutations: DataFrame) -> dict:
        """Merge mutations after the checkpoint, activate and acknowledge. Rows at or before it were applied already and are passed over."""
        after = self.consumer.state()["sequence"]
        batch = mutations.where(F.col("sequence") > after)
        ends = batch.agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.count("*").alias("n")).first()
        if not ends.n:
            return {"applied": 0, "sequence": after}
        if ends.a != after + 1 or ends.b - ends.a + 1 != ends.n:
            raise InvariantViolation("the log has a gap", after=after, first=ends.a, last=ends.b, rows=ends.n)
        parsed = batch.select("sequence", "document_id", "mutation", F.from_json("payload", self.schema).alias("document"))
        number = self.generations.create(self._merged(catalog.last_writes(parsed)))
        self.generations.activate(number)
        self.consumer.acknowledge(ends.b, number, self.log.high_water())
        self.generations.collect_garbage(1)
        return {"applied": ends.n, "sequence": ends.b, "generation": number}

    def _project(self, rows: DataFrame) -> DataFrame:
        return rows

    def _merged(self, last: DataFrame) -> DataFrame:
        """The next generation: the active one with each document's last mutation (document_id, mutation, document)."""
        try:
            now = self.generations.read()
        except NotFound:
            now = self._project(self.spark.createDataFrame([], self.schema))
        fresh = self._project(last.where("mutation = 'upsert'").select("document.*"))
        return now.join(last.select("document_id"), "document_id", "left_anti").unionByName(fresh)

    def run(self, files_per_batch: int = 16, most_seconds: float | None = None) -> int:
        """Consume what the log has now, as a stream of bounded micro-batches; returns the sequence reached.

        The stream's own checkpoint finds new files, the consumer's decides what is applied, so a replayed batch does nothing.
        """
        query = self.log.stream(files_per_batch).writeStream.foreachBatch(lambda rows, _: self.apply(rows) and None).option("checkpointLocation", self.stream_checkpoint).trigger(availableNow=True).start()
        if most_seconds is None:
            query.awaitTermination()
        else:
            end = time.monotonic() + most_seconds
            while query.isActive and time.monotonic() < end:
                query.awaitTermination(1)
            query.stop()
        return self.consumer.state()["sequence"]

    def recover(self, desired: DataFrame) -> int:
        """The active generation's number; if it can't be read or was never acknowledged, or if the log has a gap after the
        checkpoint, all is rebuilt from the desired catalog first."""
        state = self.consumer.state()
        active = self.generations.active()
        ahead = self.log.read().where(F.col("sequence") > state["sequence"]).agg(F.min("sequence").alias("a"), F.max("sequence").alias("b"), F.count("*").alias("n")).first()
        whole = not ahead.n or (ahead.a == state["sequence"] + 1 and ahead.b - ahead.a + 1 == ahead.n)
        if whole and active is not None and state["generation"] == active and self.generations.folder.exists(self.generations.path(active).rpartition("/")[2]):
            return active
        return self.rebuild(desired)

    def rebuild(self, desired: DataFrame) -> int:
        """Write the desired catalog as the next unused generation and acknowledge the log's end: it holds all of that."""
        number = self.generations.create(self._project(desired.select(*self.spark.createDataFrame([], self.schema).columns)))
        self.generations.activate(number)
        self.consumer.acknowledge(self.log.high_water(), number, self.log.high_water())
        return number


class ContentProjector(Projector):
    """Keeps the content index level with the outbox: a batch's documents are read only if they may be indexed, and only those that changed are written anew."""

    def __init__(self, spark: SparkSession, log: OutboxLog, root: str, read_texts: Callable[[DataFrame], DataFrame], policy: content.Policy):
        super().__init__(spark, log, root, "content")
        self.read_texts, self.policy = read_texts, policy

    def _project(self, rows: DataFrame) -> DataFrame:
        return content.index(self._read(rows).where("skip_reason is null"))

    def _read(self, documents: DataFrame) -> DataFrame:
        """Documents with text, content_hash and skip_reason."""
        declared = content.eligibility(documents, self.policy)
        texts = self.read_texts(declared.where("skip_reason is null")).select(F.col("path").alias("resolved_path"), "text", F.col("skip_reason").alias("read_reason"))
        rows = declared.join(texts, "resolved_path", "left")
        reason = F.coalesce("skip_reason", "read_reason", F.when(F.col("text").isNull(), "io"))
        return rows.withColumns({"skip_reason": reason, "content_hash": F.sha2("text", 256)})

    def _merged(self, last: DataFrame) -> DataFrame:
        rows = written(self._read(last.where("mutation = 'upsert'").select("document.*")), "texts")
        gone = last.where("mutation = 'delete'").select("document_id")
        fresh = content.index(rows.where("skip_reason is null"))
        try:
            prior = self.generations.read()
        except NotFound:
            prior = self.spark.createDataFrame([], fresh.schema)
        content.check_batch(rows, gone)
        outcomes = written(content.delta(prior, rows, gone), "outcomes")
        return content.apply_delta(prior, fresh, gone, outcomes)


def catalog_stream_counts(events: DataFrame, key: str, delete: str) -> DataFrame:
    """Running last writes of a change stream, for update or complete output: (key, sequence, mutation)."""
    return events.groupBy(key).agg(F.max("sequence").alias("sequence"), F.max_by(F.when(F.col("event") == delete, "delete").otherwise("upsert"), "sequence").alias("mutation"))


def admitted(requests: DataFrame, time_col: str = "ts", id_col: str = "request_id", delay: str = "10 minutes") -> DataFrame:
    """A request stream without those whose id came before, as far back as the watermark."""
    return requests.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([id_col])
