"""A volume's change journal: decoding pages of records, their canonical events, and checkpoints."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CatalogError, CheckpointGap
from ..functions.values import link_id_of

#: The record's head and the bits of its reason.
HEAD, MOST_BYTES = 60, 1 << 20
DATA_CHANGE, FILE_CREATE, FILE_DELETE, RENAME_OLD, RENAME_NEW, BASIC_INFO, HARD_LINK = 0x7, 0x100, 0x200, 0x1000, 0x2000, 0x8000, 0x10000
REPARSE_POINT = 0x400
RECORD = "file_reference long, parent_reference long, position long, reason long, attributes long, name string, had_invalid_utf16 boolean"


class MalformedRecord(CatalogError):
    code = "corrupt"


class UnsupportedRecord(CatalogError):
    code = "unsupported"


def decode(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """(record, length) of the version 2 record at a place: little-endian, a multiple of 8 bytes, names in UTF-16 with bad units replaced."""
    if len(data) - at < HEAD:
        raise MalformedRecord("a record's head is cut off")
    length, major = struct.unpack_from("<IH", data, at)
    if not HEAD <= length <= MOST_BYTES or length % 8 or at + length > len(data):
        raise MalformedRecord("a record's length is invalid")
    if major != 2:
        raise UnsupportedRecord("records of version 2 are read")
    file, parent, position = struct.unpack_from("<QQq", data, at + 8)
    (reason,), (attributes, size, offset) = struct.unpack_from("<I", data, at + 40), struct.unpack_from("<IHH", data, at + 52)
    if size % 2 or offset < HEAD or offset + size > length:
        raise MalformedRecord("a name lies outside its record")
    raw = data[at + offset : at + offset + size]
    try:
        name, bad = raw.decode("utf-16-le"), False
    except UnicodeDecodeError:
        name, bad = raw.decode("utf-16-le", "replace"), True
    return (file, parent, position, reason, attributes, name, bad), length


def decode_page(page: bytes) -> tuple[int, list[tuple]]:
    """(next position, records) of a page: 8 bytes, then records without gaps."""
    if len(page) < 8:
        raise MalformedRecord("a page's head is cut off")
    records, at = [], 8
    while at < len(page):
        record, n = decode(page, at)
        records.append(record)
        at += n
    return struct.unpack_from("<q", page)[0], records


def records(pages: DataFrame, page: str = "page") -> DataFrame:
    """The records of a column of pages."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for p in parts:
            rows = [r for data in p[page] for r in decode_page(bytes(data))[1]]
            out = pd.DataFrame(rows, columns=names)
            for c in ("file_reference", "parent_reference"):  # unsigned in the journal
                out[c] = out[c].astype("uint64").astype("int64")
            yield out

    return pages.select(page).mapInPandas(run, RECORD)


def _has(bits: int) -> Column:
    return F.col("reason").bitwiseAND(F.lit(bits).cast("long")) != 0


class Correlator:
    """Maps one volume's records, in order, to events; it remembers renames under way and links that renames moved.

    `there` tells of a record's target: observed, missing or unavailable.
    """

    def __init__(self, volume: bytes, pending: dict[int, bytes] | None = None, known: dict[tuple[int, str], bytes] | None = None):
        self.volume, self.pending, self.known = volume, pending or {}, known or {}

    def events(self, record: tuple, there: str = "observed") -> list[dict]:
        file, parent, _, reason, _, name, bad = record
        if bad:
            return [{"event": "reconciliation_required", "reason": "provider_requested"}]
        place = (parent, name)
        own = self.known.get(place) or link_id_of(self.volume, parent.to_bytes(16, "big"), name)
        if reason & RENAME_OLD:
            self.known.pop(place, None)
            self.pending[file] = own
            return []
        if reason & RENAME_NEW:
            own = self.known[place] = self.pending.pop(file, own)
        link = {"file_reference": file, "file_link_id": own}
        full = link | {"event": "link_observed", "parent_reference": parent, "name": name}
        if reason & FILE_DELETE:
            self.known.pop(place, None)
            return [link | {"event": "link_removed"}, {"event": "object_removed", "file_reference": file}]
        if there == "unavailable":
            return []
        made = bool(reason & (FILE_CREATE | RENAME_NEW))
        if reason & HARD_LINK and not made:
            return [full if there == "observed" else link | {"event": "link_removed"}]
        out = []
        if reason & (FILE_CREATE | BASIC_INFO | DATA_CHANGE) and there == "observed":
            out.append({"event": "object_observed", "file_reference": file})
        return out + [full] * made


def event_kinds(rows: DataFrame) -> DataFrame:
    """Records with the kinds of events that each gives when its target is observed: what needs no memory of renames."""
    made = _has(FILE_CREATE | RENAME_NEW)
    kinds = (
        F.when(F.col("had_invalid_utf16"), F.array(F.lit("reconciliation_required")))
        .when(_has(RENAME_OLD), F.array().cast("array<string>"))
        .when(_has(FILE_DELETE), F.array(F.lit("link_removed"), F.lit("object_removed")))
        .when(_has(HARD_LINK) & ~made, F.array(F.lit("link_observed")))
        .otherwise(F.array_compact(F.array(F.when(_has(FILE_CREATE | BASIC_INFO | DATA_CHANGE), "object_observed"), F.when(made, "link_observed"))))
    )
    return rows.withColumn("kinds", kinds)


def validate_checkpoint(journal: int, position: int, current_journal: int, lowest: int) -> None:
    """A checkpoint holds while its journal is the same and still has what follows it."""
    if journal != current_journal or position < lowest:
        raise CheckpointGap("the journal doesn't reach back to the checkpoint")


def checkpoint_gaps(checkpoints: DataFrame, journals: DataFrame) -> DataFrame:
    """(volume_id): checkpoints (volume_id, journal, position) that their journals (volume_id, journal, lowest) no longer serve."""
    now = journals.select("volume_id", F.col("journal").alias("now"), "lowest")
    return checkpoints.join(now, "volume_id", "left").where("now is null or journal != now or position < lowest").select("volume_id")


def bounded(rows: DataFrame, after: int | tuple[int, int], limit: int) -> tuple[DataFrame, DataFrame]:
    """(page, has_more): `limit` events (position, part) after a cursor; a record's events that don't fit come next time.

    The cursor is the last event's (position, part), so a page may end inside a record; a position alone means all of its events.
    """
    position, part = after if isinstance(after, tuple) else (after, None)
    behind = F.col("position") > position
    if part is not None:
        behind = behind | ((F.col("position") == position) & (F.col("part") > part))
    found = rows.where(behind).orderBy("position", "part").limit(limit + 1)
    return found.orderBy("position", "part").limit(limit), found.agg((F.count("*") > limit).alias("has_more"))
