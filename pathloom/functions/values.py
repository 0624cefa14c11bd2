"""Small scalar functions: ids, hashes, clocks, shares and sizes."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType

from ..errors import InvalidRequest

ID_KINDS = ("machine", "volume", "file", "link", "document")
_MASK = (1 << 128) - 1
#: Offset and prime of the 128-bit FNV-1a hash.
FNV_OFFSET = 0x6C62272E07BB014262B821756295C58D
FNV_PRIME = 0x0000000001000000000000000000013B
#: Fixed value: what a volume's id is combined with for the id of its root link.
ROOT_LINK = 0x006C732D726F6F742D6C696E6B2D7631
#: Fixed value: 1970 in 100-nanosecond ticks since 1601.
FILETIME_EPOCH = 116444736000000000


def format_id(kind: str, value: Column) -> Column:
    """`kind:` and 32 lower-case hex digits of a 16-byte id."""
    return F.concat(F.lit(f"{kind}:"), F.lower(F.hex(value)))


def parse_id(kind: str, text: Column) -> Column:
    """(value, error): the 16 bytes, or prefix, length or digit for what is wrong."""
    body = F.substring(text, len(kind) + 2, 1 << 30)
    error = F.when(~F.startswith(text, F.lit(f"{kind}:")), "prefix").when(F.char_length(body) != 32, "length").when(~F.rlike(body, F.lit("^[0-9a-fA-F]*$")), "digit")
    return F.struct(F.when(error.isNull(), F.unhex(F.when(error.isNull(), body))).alias("value"), error.alias("error"))


def parse_id_text(kind: str, text: str) -> bytes:
    if not text.startswith(f"{kind}:"):
        raise InvalidRequest("the id has another prefix", error="prefix")
    body = text[len(kind) + 1 :]
    if len(body) != 32:
        raise InvalidRequest("the id hasn't 32 digits", error="length")
    if not re.fullmatch("[0-9a-fA-F]*", body):
        raise InvalidRequest("the id has a digit that isn't hexadecimal", error="digit")
    return bytes.fromhex(body)


def stable_hash(data: bytes) -> int:
    """FNV-1a with 128 bits."""
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & _MASK
    return h


def link_id_of(parent_volume: bytes | None, parent_file: bytes | None, name: str) -> bytes:
    """A link's id from its parent's key and its name."""
    key = b"" if parent_volume is None or parent_file is None else parent_volume + parent_file
    return stable_hash(key + name.encode()).to_bytes(16, "big")


def root_link_id_of(volume: bytes) -> bytes:
    return (int.from_bytes(volume, "big") ^ ROOT_LINK).to_bytes(16, "big")


def scoped_volume_id_of(volume: bytes, root: str) -> bytes:
    """The id of a root folder taken as a volume of its own."""
    return stable_hash(volume + stable_hash(root.lower().encode()).to_bytes(16, "big")).to_bytes(16, "big")


@F.pandas_udf(BinaryType())
def _link_ids(volume: pd.Series, file: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([link_id_of(v, f, n) for v, f, n in zip(volume, file, name, strict=True)])


def link_id(parent_volume: Column, parent_file: Column, name: Column) -> Column:
    return _link_ids(parent_volume, parent_file, name)


def mix64(z: np.ndarray) -> np.ndarray:
    """SplitMix64's step on unsigned 64-bit numbers."""
    with np.errstate(over="ignore"):
        z = z + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@F.pandas_udf(LongType())
def _mixed(z: pd.Series) -> pd.Series:
    return pd.Series(mix64(z.to_numpy(np.int64).view(np.uint64)).view(np.int64))


def splitmix64(value: Column) -> Column:
    """SplitMix64 of a long's 64 bits, as a signed long."""
    return _mixed(value)


def filetime_ms(ticks: Column) -> Column:
    """Unix milliseconds of 100-nanosecond ticks since 1601; null before 1970."""
    return F.when(ticks >= FILETIME_EPOCH, F.floor((ticks - FILETIME_EPOCH) / F.lit(10000).cast("decimal(20,0)")).cast("long"))


def basis_points(part: Column, total: Column) -> Column:
    """part of total in ten-thousandths, at most 10000; null where total is 0."""
    n = F.least(part, total).cast("decimal(38,0)") * 10000
    return F.floor(F.try_divide(n, total.cast("decimal(20,0)"))).cast("int")


def ceil_millis(nanos: Column) -> Column:
    """Whole milliseconds, started ones counted."""
    return F.ceil(nanos / F.lit(1_000_000).cast("decimal(10,0)")).cast("long")


def ceil_millis_of(nanos: int) -> int:
    return -(-nanos // 1_000_000)


def add_saturating(a: Column, b: Column) -> Column:
    """The sum of two counts, or the largest long."""
    return F.coalesce(F.try_add(a, b), F.lit((1 << 63) - 1))


def subtract_saturating(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0).cast("long"))


def wrapped_sum(value: Column) -> Column:
    """Sum modulo 2^64 of longs taken as unsigned, as decimal(38,0)."""
    return F.pmod(F.sum(value.cast("decimal(38,0)")), F.lit(str(1 << 64)).cast("decimal(38,0)"))


def disk_reserve(total: Column, least_bytes: int, percent: int) -> Column:
    """Bytes to keep free: a fixed least or a share of the disk."""
    return F.greatest(F.lit(least_bytes).cast("long"), F.floor(total.cast("decimal(20,0)") * percent / 100).cast("long"))


def generation_name(number: Column) -> Column:
    return F.concat(F.lit("generation-"), F.lpad(number.cast("string"), 20, "0"))


def generation_name_of(number: int) -> str:
    return f"generation-{number:020d}"


def payload_fingerprint(*columns: Column | str) -> Column:
    """SHA-256 of the columns as canonical JSON, fields in the given order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
