"""Synthetic catalog: records that depend on seed and ordinal alone, so any range can be made anywhere."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import mix64

#: Pools that names and paths are drawn from, likeliest extension first.
EXTENSIONS = ("txt", "pdf", "docx", "xlsx", "jpg", "png", "rs", "toml", "json", "ts", "tsx", "js", "py", "md", "zip", "mp4", "log", "csv", "dll", "exe")
ASCII_STEMS = ("report", "invoice", "project", "meeting", "notes", "archive", "backup", "photo", "document", "presentation", "budget", "contract", "release", "readme", "config", "source", "customer", "analysis", "design", "schedule")
UNICODE_STEMS = ("отчёт", "договор", "проект", "заметки", "фотография", "résumé", "café", "überblick", "東京", "資料", "δοκιμή", "mañana")
DIRECTORIES = ("Users", "Documents", "Downloads", "Pictures", "Projects", "src", "target", "node_modules", ".git", "vendor", "archive", "clients", "2024", "2025", "2026", "Работа", "Документы", "Фото", "資料", "shared")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "ordinal long, name string, path string, extension string, size long, modified_at_unix_ms long"


def _draw(state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    state = mix64(state)
    return state, state


def records(ordinals: np.ndarray, seed: int) -> pd.DataFrame:
    """The records of the ordinals, vectorized: each draw is one step of every record's own generator."""
    n = ordinals.astype(np.uint64)
    with np.errstate(over="ignore"):
        state = np.uint64(seed) ^ (n * _GOLD)
    pick = lambda pool, r: np.array(pool, object)[(r % np.uint64(len(pool))).astype(np.int64)]
    state, r = _draw(state)
    stem = np.where(n % np.uint64(29) == 0, pick(UNICODE_STEMS, r), pick(ASCII_STEMS, r))
    state, r = _draw(state)
    second = pick(ASCII_STEMS, r)
    state, r = _draw(state)
    draw = r % np.uint64(10_000)
    extension = np.array(EXTENSIONS, object)[np.minimum((draw * draw // np.uint64(10_000)).astype(np.int64) * len(EXTENSIONS) // 10_000, len(EXTENSIONS) - 1)]
    name = [f"{s}_{q}_{i:08d}.{e}" if i % 11 == 0 else f"{s}-{i:08d}.{e}" if i % 7 == 0 else f"{s}_{i % 10_000:04d}.{e}" for s, q, i, e in zip(stem, second, n.tolist(), extension, strict=True)]
    state, r = _draw(state)
    depth = 2 + (r % np.uint64(6)).astype(np.int64)
    path = np.full(len(n), "/catalog", object)
    for level in range(7):  # records of less depth keep their state
        on = depth > level
        state[on], r = _draw(state[on])
        path[on] = path[on] + "/" + pick(DIRECTORIES, r)
    path = path + "/" + np.array(name, object) if len(n) else path
    state, r = _draw(state)
    size = 128 + (r % np.uint64(8 << 30)).astype(np.int64)
    state, r = _draw(state)
    return pd.DataFrame({"ordinal": n.astype(np.int64), "name": name, "path": path, "extension": extension, "size": size, "modified_at_unix_ms": 1_577_836_800_000 + (r % np.uint64(220_752_000_000)).astype(np.int64)})


def catalog(spark: SparkSession, count: int, seed: int, start: int = 0) -> DataFrame:
    """Records of the ordinals start to start + count."""
    return spark.range(start, start + count).mapInPandas(lambda parts: (records(p["id"].to_numpy(), seed) for p in parts), SCHEMA)


def retrieval_queries(spark: SparkSession, record_count: int, per_kind: int, seed: int) -> DataFrame:
    """(place, text, kind, expected_ordinal): for each draw a record's name, its first name part and up to four characters of that."""
    if not record_count:
        return spark.createDataFrame([], "place long, text string, kind string, expected_ordinal long")

    def make(parts):
        for p in parts:
            with np.errstate(over="ignore"):
                at = mix64(np.uint64(seed) + p["id"].to_numpy().astype(np.uint64)) % np.uint64(record_count)
            stem = records(at, seed)["name"].str.split(r"[_.-]", n=1, regex=True).str[0]
            yield pd.DataFrame({"id": p["id"], "ordinal": at.astype(np.int64), "name": records(at, seed)["name"], "stem": stem, "prefix": stem.str[:4]})

    rows = spark.range(per_kind).mapInPandas(make, "id long, ordinal long, name string, stem string, prefix string")
    texts = F.array(*(F.struct((F.col("id") * 3 + k).alias("place"), F.col(c).alias("text"), F.lit(kind).alias("kind")) for k, (c, kind) in enumerate((("name", "exact"), ("stem", "token"), ("prefix", "prefix")))))
    return rows.select(F.explode(texts).alias("q"), F.col("ordinal").alias("expected_ordinal")).select("q.*", "expected_ordinal")


def as_documents(rows: DataFrame) -> DataFrame:
    """Generated records as catalog documents, online files with their ordinal as id."""
    return rows.select(F.col("ordinal").alias("document_id"), F.lit("synthetic").alias("volume_id"), F.col("ordinal").alias("file_id"), F.col("ordinal").alias("file_link_id"), "name", F.col("path").alias("resolved_path"), "extension", F.lit("file").alias("kind"), "size", "modified_at_unix_ms", F.lit("online").alias("availability"))
