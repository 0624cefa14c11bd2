"""WARC archives of pages, and a global capture index merged from the archives' sorted runs.

Each record is a gzip member of its own, so an index's offset is where a reader can start. Archives are written by Spark's text
writer, whose rows are bytes here: a row is some members, and the line separator is the member of an empty text. They are read as
bytes, member by member, and parsed by Content-Length. Each archive gives a run, sorted by URL key and timestamp; the key space
is cut into ranges of about RANGE_ROWS rows, and in each range a loser tree merges the runs' parts.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, utf8, written

#: Payloads of fewer bytes are always written in full.
REVISIT_BYTES = 1000
#: Bytes of records that a row of members holds at least, unless its batch ends; rows in an archive; records over LARGE have archives of their own.
#: An archive thus has at most ROWS_PER_FILE * (ROW_BYTES + LARGE) bytes, or one record.
ROW_BYTES, ROWS_PER_FILE, LARGE = 1 << 18, 64, 1 << 20
#: Rows of the index that a task merges, about: it holds them.
RANGE_ROWS = 200_000
#: Up to so many payloads that come twice or more, their digests are broadcast; beyond, rows meet them by digest and one of SALTS numbers.
BROADCAST_DIGESTS, SALTS = 500_000, 32
_LEVEL = 6
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "url_key string, timestamp string, id string, record_type string, refers_to string, url string, payload_bytes long, payload_digest string, archive string, offset long"


def _line(text: Column) -> Column:
    """A header's value: control characters and blanks are percent-encoded."""
    out = F.coalesce(text, F.lit(""))
    for c in "\r\n\t \0":
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def records(pages: DataFrame, id_col: str, url_col: str, payload_col: str, time_col: str | None) -> DataFrame:
    """(record): a WARC record for each page, a response or a revisit of the response with the equal payload."""
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"), (F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.coalesce(F.col(id_col).cast("long"), F.lit(0)))).alias("time"))
    digest, size = F.sha1(F.col("payload").cast("binary")), F.octet_length("payload")
    # the sums of each task go to the shuffle, so a payload that many pages share is no hot key there
    shared = picked.where(size >= REVISIT_BYTES).groupBy(digest.alias("of")).agg(F.max("id").alias("to"), F.count("*").alias("n")).where("n > 1 and to is not null").select("of", "to")
    shared = written(shared, "digests")
    full = picked.withColumn("digest", digest)
    if shared.count() <= BROADCAST_DIGESTS:
        full = full.join(F.broadcast(shared), (F.col("digest") == F.col("of")) & (size >= REVISIT_BYTES), "left")
    else:  # a payload's rows spread over SALTS tasks
        salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        full = full.join(salted, (F.col("digest") == F.col("of")) & (F.pmod(F.xxhash64("id"), F.lit(SALTS)) == F.col("salt")) & (size >= REVISIT_BYTES), "left")
    full = full.withColumn("to", F.when(F.col("id").eqNullSafe(F.col("to")), None).otherwise(F.col("to")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    revisit = F.col("to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(_line(c.cast("string")), F.lit("")), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("\r\nWARC-Date: "), F.date_format(F.to_utc_timestamp("time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Target-URI: "), _line(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block), F.lit(END), block,
    )
    return full.select(F.concat(head, F.lit(END)).alias("record"))


def member(record: bytes) -> bytes:
    """record as a gzip member, the same at every time."""
    z = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


#: What separates rows in an archive: nothing, compressed.
SEPARATOR = member(b"")


def _members(recs: DataFrame) -> DataFrame:
    """(value): the records' members, those of about ROW_BYTES of records in a row, as bytes that Spark takes for a text."""

    def run(batches):
        for b in batches:
            row, size, out = [], 0, []
            for r in utf8(b.column(0)):
                row.append(member(r))
                size += len(r)
                if size >= ROW_BYTES:
                    out.append(b"".join(row))
                    row, size = [], 0
                if sum(map(len, out[-1:])) > LARGE or len(out) >= 16:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out = []
            if row:
                out.append(b"".join(row))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return recs.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None) -> None:
    """Write archives, with a gzip member for each record, to the new folder path.

    Of pages whose payloads are equal and have REVISIT_BYTES or more, that with the largest id is written in full and the others refer
    to it (rows with that id, repeated or not, are all in full; without a non-null id all are). A null payload is empty,
    a null url is empty. Without time_col a page's capture time is its id in seconds from 1970. Other columns are not looked at.
    Payloads over LARGE bytes have archives of their own, so no archive is large but for one record.
    """
    recs = records(pages, id_col, url_col, payload_col, time_col)
    large = F.octet_length("record") > LARGE
    there = not pages.where(F.octet_length(F.col(payload_col).cast("string")) > LARGE // 2).isEmpty()
    for part, rows in ((recs.where(~large), ROWS_PER_FILE), (recs.where(large), 1)) if there else ((recs, ROWS_PER_FILE),):
        out = _members(part).write.mode("append").option("lineSep", SEPARATOR.decode("latin-1")).option("encoding", "ISO-8859-1")
        out.option("maxRecordsPerFile", rows).text(path)


def parse(data) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of each record of an archive's bytes; offset is where the record's member starts."""
    data, at = memoryview(data), 0
    while at < len(data):
        start, z, parts, size = at, zlib.decompressobj(31), [], 1 << 12
        while not z.eof:
            if at >= len(data):
                raise ValueError(f"the member at byte {start} is cut off")
            piece = data[at : at + size]  # what stands behind the member is copied, so small pieces first
            size = min(2 * size, 1 << 20)
            try:
                parts.append(z.decompress(piece))
            except zlib.error as e:
                raise ValueError(f"no member at byte {start}") from e
            at += len(piece) - len(z.unused_data)
        record = b"".join(parts)
        if record:
            yield start, *parse_record(record, start)


def parse_record(record: bytes, at: int = 0) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a record's bytes."""
    stream = io.BytesIO(record)
    if not stream.readline().startswith(b"WARC/"):
        raise ValueError(f"no record at byte {at}")
    headers = {}
    while (line := stream.readline()).strip():
        k, _, v = line.decode().partition(":")
        headers[k.strip().lower()] = v.strip()
    n = int(headers["content-length"])
    block = stream.read(n)
    if len(block) != n or stream.read() != END.encode():
        raise ValueError(f"the record at byte {at} has another length")
    return headers, block


def url_key(url: str) -> str:
    """Sort-friendly key: host labels from the right, then the path and query, without scheme, fragment or www."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?([^/?#]*)([^#]*)", url)
    host = m[1].rpartition("@")[2].lower().removesuffix(":80").removesuffix(":443")
    host, _, port = host.partition(":")
    return ",".join(reversed(re.sub(r"^www\d*\.", "", host).split("."))) + (":" + port if port else "") + ")" + (m[2] or "/").lower()


def runs(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS, run and place: a row for each record of the archives in path; a run is an archive's rows, sorted."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for archive, content in zip(b.column(0), b.column(1), strict=True):
                archive = archive.as_py().rpartition("/")[2]
                rows = []
                data = memoryview(content.as_buffer())
                for offset, h, block in parse(data):
                    head, _, body = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
                    digest = h["warc-payload-digest"].partition(":")[2]
                    if h["warc-type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
                        raise ValueError(f"the payload of {h['warc-record-id']} is not what its record says")
                    uri = h.get("warc-target-uri", "")
                    name = lambda k: h[k][len("<urn:page:") : -1] if k in h else None  # noqa: B023, E731
                    rows.append((url_key(uri), re.sub(r"\D", "", h["warc-date"]), name("warc-record-id"), h["warc-type"], name("warc-refers-to"), uri, size, digest, archive, offset))
                rows.sort()
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c) if n not in (4,) else pa.array(c, pa.string()) for n, c in enumerate(zip(*part, strict=True))), pa.array([archive] * len(part)), pa.array(range(k, k + len(part)), pa.int64())], [x.split()[0] for x in COLUMNS.split(", ")] + ["run", "place"])

    return files.mapInArrow(run, COLUMNS + ", run string, place long")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so a step replays one path."""

    def __init__(self, parts: list[Iterator]):
        self.parts = parts
        k = self.k = max(1, len(parts))
        self.heads = [next(p, None) for p in parts] or [None]
        self.losers = [-1] * k
        for i in range(k):
            self._replay(i, fill=True)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b))

    def _replay(self, i: int, fill: bool = False) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0 and fill:
                self.losers[node] = i
                return
            if self._less(other, i):
                self.losers[node], i = i, other
            node //= 2
        self.losers[0] = i

    def __iter__(self):
        while (head := self.heads[i := self.losers[0]]) is not None:
            yield head
            self.heads[i] = next(self.parts[i], None)
            self._replay(i)


def merged(rows: DataFrame) -> DataFrame:
    """COLUMNS of runs() in the order of URL key, timestamp and the rest: each partition is sorted and before the next.

    Ranges are cut over the whole key, so many captures of one URL spread over partitions. A task holds its range's rows, about RANGE_ROWS.
    """
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    dealt = rows.repartitionByRange(ranges, "url_key", "timestamp", "id", "archive", "offset").sortWithinPartitions("run", "place")

    def run(batches):
        parts: list[list] = []
        before = None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for name, *row in zip(columns[len(names)], *columns[: len(names)], strict=True):
                if name != before:
                    parts.append([])
                    before = name
                # nulls never decide: archive and offset tell all rows apart
                parts[-1].append((row[0], row[1], row[2], row[8], row[9], row))
        out = []
        for x in LoserTree([iter(p) for p in parts]):
            out.append(x[-1])
            if len(out) == 10_000:
                yield _rows(out, names)
                out = []
        if out:
            yield _rows(out, names)

    return dealt.mapInArrow(run, COLUMNS)


def _rows(rows: list[list], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.int64() if n in ("payload_bytes", "offset") else pa.string() for n in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time_col: str | None = None, path: str | None = None) -> DataFrame:
    """Write pages to archives in path (a new folder in the shared one if None), read them back and return the merged capture index."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, id_col, url_col, payload_col, time_col)
    return merged(written(runs(spark, path), "runs"))
