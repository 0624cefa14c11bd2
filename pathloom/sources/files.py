"""Files as a source: snapshot scans of folders, scoped scans, incremental listings, and texts with their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import content

#: Folders whose descendants a scan leaves out by default.
EXCLUDED = ("$Recycle.Bin", ".cache", ".git", ".hg", ".svn", ".venv", "__pycache__", "build", "dist", "node_modules", "Program Files", "Program Files (x86)", "ProgramData", "System Volume Information", "target", "venv", "Windows")
LISTING = "path string, modificationTime timestamp, length long"


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path, modified_at_unix_ms, size) of the files below root; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", F.unix_millis("modificationTime").alias("modified_at_unix_ms"), F.col("length").alias("size"))


def scoped(files: DataFrame, root: str, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Files that are not below an excluded folder's name, in whatever case. A file of that name itself stays."""
    below = F.split(F.substring("path", len(root.rstrip("/")) + 2, 1 << 30), "/")
    names = [n.lower() for n in excluded]
    parents = F.slice(below, 1, F.greatest(F.size(below) - 1, F.lit(0)))
    return files.where(~F.exists(parents, lambda p: F.lower(p).isin(names)))


def observations(files: DataFrame, root: str, volume_id: str) -> tuple[DataFrame, DataFrame]:
    """(objects, links) events of a listing: files, and the folders on their paths; ids are digests of the path, and of parent and name."""
    head = root.rstrip("/")
    parts = F.split(F.substring("path", len(head) + 2, 1 << 30), "/")
    levels = files.select("size", "modified_at_unix_ms", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("at"), F.element_at(parts, n).alias("name"), (n == F.size(parts)).alias("file")))).alias("level", "e"))
    node = lambda p: F.left(F.sha2(F.concat(F.lit(volume_id + "/"), p), 256), F.lit(32))
    rows = levels.select("level", "e.*", F.when(F.col("e.file"), F.col("size")).otherwise(0).alias("size"), F.when(F.col("e.file"), F.col("modified_at_unix_ms")).alias("modified_at_unix_ms")).dropDuplicates(["at"])
    objects = rows.select(F.lit("object_observed").alias("event"), F.lit(volume_id).alias("volume_id"), node(F.col("at")).alias("file_id"), F.when(F.col("file"), "file").otherwise("directory").alias("kind"), "size", "modified_at_unix_ms")
    parent = F.when(F.col("level") > 0, node(F.regexp_replace("at", r"/[^/]*$", "")))
    links = rows.select(F.lit("link_observed").alias("event"), F.lit(volume_id).alias("volume_id"), node(F.col("at")).alias("file_id"), F.left(F.sha2(F.concat(F.lit("link/" + volume_id + "/"), F.col("at")), 256), F.lit(32)).alias("file_link_id"), F.when(F.col("level") > 0, F.lit(volume_id)).alias("parent_volume_id"), parent.alias("parent_file_id"), "name")
    return objects, links


def changes(spark: SparkSession, root: str, per_batch: int = 1000) -> DataFrame:
    """A stream of new files' (path, modified_at_unix_ms, size), a bounded number in each batch; its place is in the stream's checkpoint."""
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return rows.select("path", F.unix_millis("modificationTime").alias("modified_at_unix_ms"), F.col("length").alias("size"))


def texts(spark: SparkSession, paths: str | list[str], policy: content.Policy) -> DataFrame:
    """(path, text, skip_reason): contents that a policy lets through, as texts; others with the reason and no text.

    Only files that pass the declared checks are opened: the size filter reaches the file listing.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    plain = F.regexp_replace("path", "^file:/+", "/")
    rows = raw.select(plain.alias("resolved_path"), F.col("length").alias("size"), T.extension(F.element_at(F.split("path", "/"), -1)).alias("extension"), F.lit("file").alias("kind"), F.lit("online").alias("availability"), F.when(F.col("length") <= policy.max_file_bytes, F.col("content")).alias("content"))
    judged = content.eligibility(rows, policy)
    return judged.select(F.col("resolved_path").alias("path"), F.when(F.col("skip_reason").isNull(), F.col("content").cast("string")).alias("text"), "skip_reason")
