"""Observation of volumes: sessions of scans, page by page, and incremental changes, on durable state."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..errors import CheckpointGap, InvariantViolation, NotFound
from ..operators import catalog, graph
from ..sources.tables import Folder, Generations, read_slots, write_slots
from .projector import OutboxLog


@dataclass(frozen=True)
class Step:
    """What one step of a volume did."""

    volume_id: str
    kind: str
    events: int = 0
    done: bool = False


class Store:
    """The durable graph: generations of volumes, objects, links and desired documents, switched over together, and the outbox."""

    TABLES = {"volumes": schemas.VOLUMES, "objects": schemas.OBJECTS, "links": schemas.LINKS, "documents": schemas.DOCUMENTS}

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, root)
        self.tables = {n: Generations(spark, f"{self.root}/{n}") for n in self.TABLES}
        self.log = OutboxLog(spark, f"{self.root}/outbox")

    def book(self) -> dict:
        """Numbers of the current tables, the graph's generation, checkpoints and sessions: one small value, so a batch is published by one write."""
        return read_slots(self.folder, "graph") or {"generation": 0, "tables": {}, "checkpoints": {}, "sessions": {}}

    def _table(self, name: str, book: dict) -> DataFrame:
        n = book["tables"].get(name)
        return self.tables[name].read(n) if n else self.spark.createDataFrame([], self.TABLES[name])

    def state(self) -> graph.State:
        book = self.book()
        return graph.State(*(self._table(n, book) for n in ("volumes", "objects", "links")))

    def documents(self) -> DataFrame:
        return self._table("documents", self.book())

    def flags(self) -> DataFrame:
        """One row of what is pending: scans, rows staged for the log, and generations that wait for collection."""
        kept = [r["state"] for t in self.tables.values() for r in t.records().values()]
        row = (bool(self.book()["sessions"]), bool(Folder(self.spark, f"{self.root}/outbox/staged").names()), kept.count("retired") > len(self.tables) or "failed" in kept)
        return self.spark.createDataFrame([row], "scan_pending boolean, publication_pending boolean, maintenance_pending boolean")

    def publish(self, state: graph.State, *, durable: bool = True, **changes) -> dict:
        """Write the state's tables, the documents that it calls for and the outbox rows of the difference; then the book; then the rows move to the log.

        The book has the last sequence, so a publication that was cut off before its book takes the same ones when it is run again, and
        one that was cut off after it is completed by settle(). Consumers never see rows of a batch that isn't in the book. durable=False, for a first load, writes no outbox rows; it is refused once a consumer is registered.
        """
        self.settle()
        book = self.book()
        generation = book["generation"] + 1
        if not durable and any(n.startswith("consumer-") for n in self.folder.names()):
            raise InvariantViolation("consumers are registered: changes must go through the outbox")
        numbers = {n: self.tables[n].create(getattr(state, n).select(*self.spark.createDataFrame([], self.TABLES[n]).columns)) for n in ("volumes", "objects", "links")}
        fresh = graph.State(*(self.tables[n].read(numbers[n]) for n in ("volumes", "objects", "links")))
        wanted = catalog.desired(fresh, generation)
        old = self._table("documents", book)
        # an unchanged document keeps its version
        changes_of = catalog.difference(old, wanted)
        merged = catalog.merge(old, changes_of.withColumn("sequence", F.lit(0)).select("sequence", "document_id", "mutation", "document"))
        numbers["documents"] = self.tables["documents"].create(merged)
        upserts = 0
        if durable:
            delta = catalog.difference(old, self.tables["documents"].read(numbers["documents"]))
            upserts, top = self.log.stage(catalog.outbox_rows(delta, self._sequence(book), generation), generation)
            changes |= {"sequence": self._sequence(book) if top is None else top}
        for n, number in numbers.items():
            self.tables[n].activate(number)
        book = book | {"generation": generation, "tables": numbers} | changes
        write_slots(self.folder, "graph", book)
        self.settle()
        for n in numbers:
            self.tables[n].collect_garbage(1)
        return {"generation": generation, "outbox_rows": upserts}

    def _sequence(self, book: dict) -> int:
        return book.get("sequence", self.log.high_water())

    def settle(self) -> None:
        """Complete the last publication: rows that its book speaks of go to the log, others that are staged are dropped."""
        book = self.book()
        self.log.settle(book["generation"], self._sequence(book))

    def apply(self, volume_id: str, events: DataFrame, checkpoint: dict | None = None, durable: bool = True) -> dict:
        """A batch of one volume's events, whole or not at all; the checkpoint is published with it. An empty batch may move the checkpoint."""
        book, state = self.book(), self.state()
        session = book["sessions"].get(volume_id)
        at = session["generation"] if session and session["phase"] == 0 else None
        new = graph.apply_batch(state, events, volume_id, book["generation"] + 1, at)
        checkpoints = book["checkpoints"] | ({volume_id: checkpoint} if checkpoint is not None else {})
        return self.publish(new, durable=durable, checkpoints=checkpoints)

    def register(self, volumes: DataFrame) -> None:
        state = self.state()
        self.publish(graph.State(graph.upsert_volumes(state.volumes, volumes), state.objects, state.links), durable=bool(self.book()["tables"]))

    def begin_scan(self, volume_id: str, reason: str = "initial_scan") -> int:
        """Open a session: the volume needs reconciliation until it is finalized. Returns the scan's generation; an open scan is begun anew."""
        state = self.state()
        volumes = graph.set_volume_state(state.volumes, volume_id, "needs_reconciliation", reason)
        generation = self.book()["generation"] + 1
        self.publish(graph.State(volumes, state.objects, state.links), sessions=self.book()["sessions"] | {volume_id: {"generation": generation, "phase": 0}})
        return generation

    def stage_checkpoint(self, volume_id: str, checkpoint: dict) -> None:
        """The scan saw everything: what it didn't see may be swept."""
        book = self.book()
        session = book["sessions"].get(volume_id)
        if session is None:
            raise NotFound("no scan is open")
        write_slots(self.folder, "graph", book | {"sessions": book["sessions"] | {volume_id: session | {"phase": 1, "checkpoint": checkpoint}}})

    def finalize(self, volume_id: str, rows: int) -> dict:
        """One bounded step of a staged session: stale links, then stale objects, then the checkpoint takes effect.

        A phase ends with the step that finds fewer rows than it may take.
        """
        book, state = self.book(), self.state()
        session = book["sessions"].get(volume_id)
        if session is None:
            raise NotFound("no scan is open")
        if session["phase"] == 0:
            raise InvariantViolation("the scan has no checkpoint yet")
        if rows == 0:
            return {"links": 0, "objects": 0, "done": False}
        if session["phase"] == 1:
            n = graph.stale_links(state.links, volume_id, session["generation"], rows).count()
            phase = 1 if n == rows else 2
            self.publish(graph.sweep(state, volume_id, session["generation"], rows), sessions=book["sessions"] | {volume_id: session | {"phase": phase}})
            return {"links": n, "objects": 0, "done": False}
        stale = graph.stale_objects(state, volume_id, session["generation"], rows)
        n = stale.count()
        dead = stale.select(*graph.KEY).withColumn("dead", F.lit(True))
        objects = state.objects.join(dead, graph.KEY, "left").withColumn("tombstoned", F.col("tombstoned") | F.coalesce("dead", F.lit(False))).select(*state.objects.columns)
        if n == rows:
            self.publish(graph.State(state.volumes, objects, state.links))
            return {"links": 0, "objects": n, "done": False}
        volumes = graph.set_volume_state(state.volumes, volume_id, "online")
        sessions = {k: v for k, v in book["sessions"].items() if k != volume_id}
        self.publish(graph.State(volumes, objects, state.links), sessions=sessions, checkpoints=book["checkpoints"] | {volume_id: session["checkpoint"]})
        return {"links": 0, "objects": n, "done": True}


class Controller:
    """Takes turns over volumes. An open session goes on first; a volume without a checkpoint is scanned; others read their changes.

    source has scan_pages(volume_id) -> pages of events, checkpoint(volume_id) and changes(volume_id, checkpoint) -> (events, checkpoint, more).
    """

    def __init__(self, store: Store, source, volumes: list[str], rows: int = 100_000):
        self.store, self.source, self.volumes, self.rows = store, source, list(volumes), rows
        self.turn = 0

    def step(self) -> Step:
        volume = self.volumes[self.turn % len(self.volumes)]
        self.turn += 1
        book = self.store.book()
        try:
            if volume in book["sessions"] or volume not in book["checkpoints"]:
                return self._scan(volume, book["sessions"].get(volume))
            events, checkpoint, more = self.source.changes(volume, book["checkpoints"][volume])
            done = self.store.apply(volume, events, checkpoint)
            return Step(volume, "changes", done["outbox_rows"], not more)
        except CheckpointGap:
            self.store.begin_scan(volume, "journal_gap")
            return Step(volume, "gap")
        except ConnectionError:
            state = self.store.state()
            self.store.publish(graph.State(graph.set_volume_state(state.volumes, volume, "offline"), state.objects, state.links))
            return Step(volume, "offline")

    def watch(self, iterations: int | None = None, pause_seconds: float = 1.0, stop: Callable[[], bool] = lambda: False) -> list[Step]:
        """Steps until stop() holds or there were so many; pauses after a turn over all volumes in which nothing was left to do. Returns the last turn's steps."""
        turn: list[Step] = []
        n = 0
        while not stop() and (iterations is None or n < iterations):
            turn = [*turn, self.step()][-len(self.volumes) :]
            n += 1
            if self.turn % len(self.volumes) == 0 and all(s.done and not s.events for s in turn) and (iterations is None or n < iterations):
                time.sleep(pause_seconds)
        return turn

    def _scan(self, volume: str, session: dict | None) -> Step:
        if session is None:
            self.store.begin_scan(volume)
            return Step(volume, "begin")
        if session["phase"] == 0:
            n = 0
            for page in self.source.scan_pages(volume):
                n += self.store.apply(volume, page)["outbox_rows"]
            self.store.stage_checkpoint(volume, self.source.checkpoint(volume))
            return Step(volume, "scan", n)
        return Step(volume, "finalize", done=self.store.finalize(volume, self.rows)["done"])
