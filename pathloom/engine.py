"""SearchEngine: the operations of the service as methods that return DataFrames."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CatalogError, NotFound
from .operators import catalog, content
from .plans import search as S
from .sources.tables import Generations
from .streaming.observe import Store
from .streaming.projector import ContentProjector, Projector

CAPABILITIES = ("catalog_search", "content_search", "catalog_get_item", "catalog_get_items", "index_get_status", "agent_get_capabilities", "agent_get_health")


#: Fixed value: ids of requests that are remembered.
REPLAY_IDS = 4096


class ReplayWindow:
    """Refuses a request whose id is among the last ones that were taken; the oldest are forgotten first."""

    def __init__(self, size: int = REPLAY_IDS):
        self.size, self.seen = size, OrderedDict()

    def take(self, request_id: str) -> bool:
        if request_id in self.seen:
            return False
        self.seen[request_id] = None
        if len(self.seen) > self.size:
            self.seen.popitem(last=False)
        return True


class CatalogProjector(Projector):
    """Projects documents with the columns that search reads."""

    def _project(self, rows: DataFrame) -> DataFrame:
        base = rows.select(*(c for c in rows.columns if c not in ("name_norm", "path_norm", "extension_norm", "name_tokens", "path_tokens")))
        return S.with_search_columns(base)


class SearchEngine:
    """A catalog under a root folder: its store, its projections and queries over the active generation."""

    def __init__(self, spark: SparkSession, root: str, granted: tuple[str, ...] = CAPABILITIES):
        self.spark, self.granted = spark, granted
        self.store = Store(spark, root)
        self.projector = CatalogProjector(spark, self.store.log, root)
        self.contents = Generations(spark, f"{root.rstrip('/')}/content")

    def _allowed(self, name: str) -> None:
        if name not in self.granted:
            error = CatalogError(f"{name} isn't granted")
            error.code = "capability_denied"
            raise error

    def documents(self) -> DataFrame:
        """The active generation, followed at each query."""
        return self.projector.generations.read()

    def search(self, request: S.SearchRequest | str, **rest) -> DataFrame:
        self._allowed("catalog_search")
        request = S.SearchRequest(request, **rest) if isinstance(request, str) else request
        return S.search(self.documents(), request).select(*S.HIT).orderBy("rank")

    def search_many(self, queries: list[str], top_k: int = 10) -> DataFrame:
        self._allowed("catalog_search")
        return S.search_many(self.documents(), S.query_frame(self.spark, queries), top_k)

    def item(self, document_id, authoritative: bool = False) -> DataFrame:
        """A document as the active generation has it, or, authoritative, as the state of the store does."""
        self._allowed("catalog_get_item")
        out = S.lookup(self.store.documents() if authoritative else self.documents(), [document_id], S.ITEM)
        if out.isEmpty():
            raise NotFound(f"no document {document_id}")
        return out

    def items(self, ids: list) -> DataFrame:
        self._allowed("catalog_get_items")
        return S.lookup(self.documents(), ids, S.ITEM)

    def page(self, after=None, limit: int = 1000) -> DataFrame:
        return S.page(self.documents(), after, limit)

    def content_search(self, query: str, limit: int = 10) -> DataFrame:
        """Content hits with their current documents; no text, no score."""
        self._allowed("content_search")
        hits = content.search(self.contents.read(), query, limit)
        return content.resolved_hits(hits, self.store.documents()).select(*S.ITEM, "rank").orderBy("rank")

    def content_projector(self, read_texts: Callable[[DataFrame], DataFrame], policy: content.Policy) -> ContentProjector:
        """The content index's consumer of the outbox. read_texts: eligible documents -> (path, text, skip_reason)."""
        return ContentProjector(self.spark, self.store.log, self.store.root, read_texts, policy)

    def project_content(self, read_texts: Callable[[DataFrame], DataFrame], policy: content.Policy) -> int:
        """Bring the content index level with the outbox; returns the sequence reached."""
        self.store.settle()
        return self.content_projector(read_texts, policy).run()

    def build_content(self, texts: DataFrame, policy: content.Policy, documents: DataFrame | None = None) -> DataFrame:
        """Index texts (path, text, skip_reason) of the documents as a new generation; returns the summary of what was skipped."""
        docs = self.store.documents() if documents is None else documents
        declared = content.eligibility(docs, policy)
        rows = declared.join(texts.select(F.col("path").alias("resolved_path"), "text", F.col("skip_reason").alias("read_reason")), "resolved_path", "left")
        reason = F.coalesce("skip_reason", "read_reason", F.when(F.col("text").isNull(), "io"))
        rows = rows.withColumn("skip_reason", reason)
        number = self.contents.create(content.index(rows.where("skip_reason is null")))
        self.contents.activate(number)
        self.contents.collect_garbage(1)
        return content.summary(rows)

    def status(self) -> DataFrame:
        """One row: generations, documents and what is yet to be applied."""
        self._allowed("index_get_status")
        state = self.projector.consumer.state()
        active = self.projector.generations.active()
        n = self.documents().count() if active is not None else 0
        row = (active, n, state["sequence"], self.store.log.high_water(), max(0, self.store.log.high_water() - state["sequence"]), self.contents.active())
        return self.spark.createDataFrame([row], "index_generation long, documents long, applied_sequence long, durable_sequence long, backlog long, content_generation long")

    def capabilities(self) -> DataFrame:
        return self.spark.createDataFrame([(c, c in self.granted) for c in CAPABILITIES], "capability string, granted boolean")

    def health(self) -> DataFrame:
        """Whether the projection is level with the state and both hold the same rows."""
        self._allowed("agent_get_health")
        have = self.documents()
        same = catalog.converged(self.store.documents(), have.select(*self.store.documents().columns))
        return self.spark.createDataFrame([(same, self.projector.consumer.state()["sequence"] == self.store.log.high_water())], "converged boolean, level boolean")
