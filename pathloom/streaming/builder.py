"""Builds of a generation page by page, which go on where they were cut off."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CapacityExceeded, SchemaMismatch
from ..operators import content
from ..plans import search
from ..sources.tables import Generations


@dataclass(frozen=True)
class Limits:
    """Bounds of a build: bytes and documents of the index, bytes of the disk to leave free."""

    page_documents: int = 100_000
    max_bytes: int = 1 << 40
    max_documents: int = 1 << 40
    reserve_bytes: int = 0


class ResumableBuild:
    """Writes make(page) for pages of documents in the order of ids into a building generation.

    Each page is a folder of its own and the cursor after it is recorded with it, so a build that stops anywhere loses its last page
    at most, and that is written over. After the last page the rows are counted; the generation is then activated, and
    retired ones beyond one are deleted.
    """

    def __init__(self, generations: Generations, make: Callable[[DataFrame], DataFrame], limits: Limits | None = None, free_bytes: Callable[[], int] = lambda: 1 << 62):
        self.generations, self.make, self.limits, self.free_bytes = generations, make, limits or Limits(), free_bytes

    def state(self) -> dict:
        """number, page, cursor, documents and bytes of the build that is under way; of a new one if there is none."""
        found = self.generations.building()
        number = found[-1] if found else self.generations.next_number()
        return {"page": -1, "cursor": None, "documents": 0, "bytes": 0} | self.generations.info(number) | {"number": number}

    def run(self, documents: DataFrame, pages: int | None = None) -> dict:
        """Go on for `pages` pages, or to the end. Returns the state; done tells whether the generation is active.

        A page that would pass a limit raises CapacityExceeded before it is written; the build stays and can go on with other limits.
        """
        at, left = self.state(), pages
        while left is None or left > 0:
            page = search.page(documents, at["cursor"], self.limits.page_documents)
            ends = page.agg(F.count("*").alias("n"), F.max("document_id").alias("last"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
            if not ends.n:
                return self._finish(at)
            forecast = 2 * ends.bytes + 1024 * ends.n
            content.check_capacity(at["bytes"], at["documents"] + ends.n, forecast, self.free_bytes(), self.limits.reserve_bytes, self.limits.max_bytes, self.limits.max_documents)
            at |= {"page": at["page"] + 1, "cursor": ends.last, "documents": at["documents"] + ends.n, "bytes": at["bytes"] + forecast}
            self.generations.append_page(self.make(page), at["number"], at["page"], cursor=at["cursor"], documents=at["documents"], bytes=at["bytes"])
            left = None if left is None else left - 1
        return at | {"done": False}

    def _finish(self, at: dict) -> dict:
        number = at["number"]
        if at["page"] < 0:
            raise CapacityExceeded("there are no documents to build from", limit="documents")
        rows = self.generations.read(number).count()
        if rows > at["documents"]:
            self.generations.fail(number)
            raise SchemaMismatch(f"generation {number} has {rows} rows of {at['documents']} documents")
        self.generations.ready(number)
        self.generations.activate(number)
        self.generations.collect_garbage(1)
        return at | {"done": True, "rows": rows}
