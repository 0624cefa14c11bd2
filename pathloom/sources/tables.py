"""Generations of tables, pointers to the active one, and reports."""

from __future__ import annotations

import csv
import hashlib
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import AlreadyExists, NotFound, SchemaMismatch
from ..functions.values import generation_name_of

LAYOUT = 1
STATES = ("building", "ready", "active", "retired", "failed")


class Folder:
    """A folder on any file system that Spark reaches, through its own file layer."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def at(self, name: str):
        return self._path(f"{self.root}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self.at(name))

    def read(self, name: str) -> bytes | None:
        if not self.exists(name):
            return None
        stream = self._fs.open(self.at(name))
        try:
            return bytes(self._io.toByteArray(stream))
        finally:
            stream.close()

    def write(self, name: str, data: bytes, overwrite: bool = True) -> None:
        if not overwrite and self.exists(name):
            raise AlreadyExists(f"{name} is there already")
        stream = self._fs.create(self.at(name), overwrite)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def names(self) -> list[str]:
        root = self._path(self.root)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def move(self, name: str, to: str) -> None:
        """Rename name; what is at the new name is replaced."""
        self._fs.mkdirs(self.at(to).getParent())
        self._fs.delete(self.at(to), True)
        if not self._fs.rename(self.at(name), self.at(to)):
            raise OSError(f"{name} can't be moved")

    def delete(self, name: str) -> None:
        self._fs.delete(self.at(name), True)


def write_slots(folder: Folder, name: str, value: dict) -> int:
    """Store a small value durably: it goes, with its checksum and the next number, to the older of two slots, so a torn write leaves the last one whole."""
    number = 1 + max((n for n, _ in _slots(folder, name)), default=0)
    body = json.dumps({"number": number, "value": value}, sort_keys=True)
    folder.write(f"{name}.{number % 2}", json.dumps({"sha256": hashlib.sha256(body.encode()).hexdigest(), "body": body}).encode())
    return number


def read_slots(folder: Folder, name: str) -> dict | None:
    """The newest value whose checksum holds; None if there is none."""
    return max(_slots(folder, name), key=lambda s: s[0], default=(0, None))[1]


def _slots(folder: Folder, name: str) -> list[tuple[int, dict]]:
    out = []
    for k in (0, 1):
        try:
            outer = json.loads(folder.read(f"{name}.{k}") or b"")
            if hashlib.sha256(outer["body"].encode()).hexdigest() == outer["sha256"]:
                inner = json.loads(outer["body"])
                out.append((inner["number"], inner["value"]))
        except (ValueError, KeyError, TypeError, AttributeError):
            continue
    return out


class Generations:
    """Versions of one table under a root: generation-<20 digits> folders, their states, and a pointer to the active one.

    A generation is written once and never changed; readers follow the pointer at each query. The states of all
    generations are one small value in two slots.
    """

    def __init__(self, spark: SparkSession, root: str, layout: int = LAYOUT):
        self.spark, self.root, self.layout = spark, root.rstrip("/"), layout
        self.folder = Folder(spark, root)

    def _book(self) -> dict:
        book = read_slots(self.folder, "generations") or {"layout": self.layout, "active": None, "records": {}}
        if book["layout"] != self.layout:
            raise SchemaMismatch("the table was written with another layout")
        return book

    def path(self, number: int) -> str:
        return f"{self.root}/{generation_name_of(number)}"

    def next_number(self) -> int:
        """The first number above all that were ever used, by the book or by folders."""
        used = [int(n) for n in self._book()["records"]] + [int(n[11:]) for n in self.folder.names() if n.startswith("generation-") and n[11:].isdigit()]
        return 1 + max(used, default=0)

    def create(self, rows: DataFrame, number: int | None = None, expected: int | None = None, partition_by: list[str] | None = None, **info) -> int:
        """Write rows as a new generation and mark it ready; one whose count isn't the expected is marked failed."""
        number = self.next_number() if number is None else number
        if self.folder.exists(generation_name_of(number)):
            raise AlreadyExists(f"generation {number} is there already")
        self._mark(number, "building", **info)
        writer = rows.write.mode("error")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(number))
        if expected is not None and (n := self.spark.read.parquet(self.path(number)).count()) != expected:
            self._mark(number, "failed")
            raise SchemaMismatch(f"generation {number} has {n} rows and not {expected}")
        self._mark(number, "ready")
        return number

    def append_page(self, rows: DataFrame, number: int, page: int, **info) -> None:
        """Add a page to a building generation and then note it; pages have folders of their own, so one that was cut off is written anew."""
        if str(number) not in self._book()["records"]:
            self._mark(number, "building")
        rows.write.mode("overwrite").parquet(f"{self.path(number)}/page={page}")
        self._mark(number, "building", page=page, **info)

    def ready(self, number: int) -> None:
        self._mark(number, "ready")

    def fail(self, number: int) -> None:
        self._mark(number, "failed")

    def _mark(self, number: int, state: str, **info) -> None:
        book = self._book()
        book["records"][str(number)] = book["records"].get(str(number), {}) | info | {"state": state, "updated": book.get("clock", 0) + 1}
        book["clock"] = book.get("clock", 0) + 1
        write_slots(self.folder, "generations", book)

    def activate(self, number: int) -> None:
        """Switch readers over; the generation before is retired. One write of the book does both."""
        book = self._book()
        record = book["records"].get(str(number))
        if not record or record["state"] not in ("ready", "retired", "active"):
            raise NotFound(f"generation {number} isn't ready")
        clock = book["clock"] = book.get("clock", 0) + 1
        if book["active"] not in (None, number):
            book["records"][str(book["active"])] |= {"state": "retired", "updated": clock}
        record |= {"state": "active", "updated": clock}
        book["active"] = number
        write_slots(self.folder, "generations", book)

    def active(self) -> int | None:
        return self._book()["active"]

    def building(self) -> list[int]:
        return sorted(int(n) for n, r in self._book()["records"].items() if r["state"] == "building")

    def info(self, number: int) -> dict:
        return self.records().get(str(number), {})

    def records(self) -> dict[str, dict]:
        """What the book says of each generation."""
        return self._book()["records"]

    def read(self, number: int | None = None) -> DataFrame:
        number = self.active() if number is None else number
        if number is None:
            raise NotFound("no generation is active")
        return self.spark.read.parquet(self.path(number))

    def collect_garbage(self, keep: int = 1) -> list[int]:
        """Delete failed generations and all but the newest retired ones; never the active one."""
        records = self.spark.createDataFrame([(int(n), r["state"], r["updated"]) for n, r in self._book()["records"].items()], "generation long, state string, updated_at long")
        gone = sorted(r.generation for r in garbage(records, keep).collect())
        book = self._book()
        for n in gone:
            self.folder.delete(generation_name_of(n))
            book["records"].pop(str(n), None)
        write_slots(self.folder, "generations", book)
        return gone


def garbage(records: DataFrame, keep: int = 1) -> DataFrame:
    """(generation): of (generation, state, updated_at) the failed ones, and the retired ones but for the `keep` newest.

    A generation has one record; the newest are a top-k, so the retired ones are not sorted in one task.
    """
    retired = records.where("state = 'retired'")
    newest = retired.orderBy(F.desc("updated_at"), F.desc("generation")).limit(keep).select("generation")
    return retired.join(newest, "generation", "left_anti").select("generation").unionAll(records.where("state = 'failed'").select("generation"))


#: A report row; dimensions is a map as JSON.
REPORT = ("name", "unit", "value", "dimensions", "samples")


def write_report(folder: Folder, name: str, rows: list[dict], title: str = "Report") -> list[str]:
    """Write rows as JSON, CSV and Markdown; nothing is written if one of the files is there."""
    names = [f"{name}.{x}" for x in ("json", "csv", "md")]
    for n in names:
        if folder.exists(n):
            raise AlreadyExists(f"{n} is there already")
    cells = [[r.get(c) if c != "dimensions" else json.dumps(r.get(c) or {}, sort_keys=True) for c in REPORT] for r in rows]
    table = io.StringIO()
    csv.writer(table, lineterminator="\n").writerows([REPORT, *cells])
    marks = [f"# {title}", "", "| " + " | ".join(REPORT) + " |", "|" + "---|" * len(REPORT), *("| " + " | ".join(str(c).replace("|", "\\|") for c in r) + " |" for r in cells), ""]
    for n, text in zip(names, (json.dumps([dict(zip(REPORT, (r.get(c) for c in REPORT), strict=True)) for r in rows], indent=1, ensure_ascii=False), table.getvalue(), "\n".join(marks)), strict=True):
        folder.write(n, text.encode(), overwrite=False)
    return names


def encode_frame(value: dict, most: int = 1 << 20) -> bytes:
    """A message: four bytes of length, little-endian, and JSON."""
    body = json.dumps(value, separators=(",", ":"), ensure_ascii=False).encode()
    if len(body) > most:
        raise ValueError("the message is too long")
    return len(body).to_bytes(4, "little") + body


def decode_frame(frame: bytes, most: int = 1 << 20) -> dict:
    n = int.from_bytes(frame[:4], "little")
    if len(frame) < 4 or n > most or len(frame) != 4 + n:
        raise ValueError("the message's length is wrong")
    return json.loads(frame[4:])
