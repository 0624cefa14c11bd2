"""Secret scans over a ledger of blobs, in DataFrame functions only.

Every version of a text is addressed by its SHA-256. The ledger has a row for each (blob, rule, version of the rule)
that was scanned, with the spans found. A scan takes only the pairs that the ledger lacks, each blob once however many
paths hold it; findings are joined back to all paths.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import before_each, let, written


@dataclass(frozen=True)
class Rule:
    """pattern has two groups that make up the match: what leads to the secret, and the secret. Matches whose group
    `measured` (0: the whole) has fewer than `least` characters are dropped after matching."""

    kind: str
    pattern: str
    least: int
    measured: int = 0
    version: int = 1


_BREAK = r"(?:[\x20\t]*+(?:\r\n|\n|\r|\\r\\n|\\n|\\r))++[\x20\t]*+"
_BASE64 = r"[A-Za-z0-9+/]"
#: A key from BEGIN over all that stands before its END. Where that is missing or another BEGIN comes first: over the
#: lines of headers and those of base64, escaped line breaks too, if the first of base64 has 16 characters or more.
_PEM = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \3PRIVATE KEY-----"
    rf"|(?:{_BREAK}[A-Za-z-]+:[^\r\n\\]*+)*+(?:{_BREAK}|[\x20\t]++){_BASE64}{{16,}}+={{0,2}}+"
    rf"(?:\s++{_BASE64}{{16,}}+={{0,2}}+|{_BREAK}{_BASE64}++={{0,2}}+(?=[\x20\t]*+(?:[\r\n\\]|-----|$)))*+)?"
)

#: In the order in which kinds are listed.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"()(AKIA[A-Z0-9]+)", 20),
    Rule("hex", r"()([0-9a-f]{24,})", 24),
    Rule("pem", rf"()({_PEM})", 1, version=3),  # 1: the BEGIN line only; 2 is not used
)
BASE = ("assign", "access", "hex")
#: Characters that mark matches; those of a text are replaced first, which moves nothing and touches no match.
_EDGE, _MIDDLE, _OTHER = "\x01", "\x02", "\x03"
#: Up to so many blobs that the ledger lacks, their ids are broadcast; beyond, the join is a shuffle.
BROADCAST_BLOBS = 250_000
_SPANS = "array<struct<start:bigint,stop:bigint>>"


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, stop) of the rule's matches in text: code points from 0, stop exclusive."""
    marked = F.regexp_replace(F.translate(text, _EDGE + _MIDDLE, _OTHER * 2), F.lit(rule.pattern), F.lit(f"{_EDGE}$1{_MIDDLE}$2{_EDGE}"))
    parts = F.transform(F.split(marked, _EDGE), lambda p: F.struct((F.length(p) - F.instr(p, _MIDDLE).cast("boolean").cast("int")).cast("long").alias("n"), F.instr(p, _MIDDLE).cast("long").alias("mid")))
    measured = {0: lambda p: p["n"], 2: lambda p: p["n"] - p["mid"] + 1}[rule.measured]

    def found(ps: Column) -> Column:
        starts = before_each(F.transform(ps, lambda p: p["n"]), lambda a, n: a + n)
        placed = F.zip_with(ps, starts, lambda p, at: F.when((p["mid"] > 0) & (measured(p) >= rule.least), F.struct(at.alias("start"), (at + p["n"]).alias("stop"))))
        return F.array_compact(placed)

    return F.when(F.rlike(text, F.lit(rule.pattern)), let(parts, found)).otherwise(F.array().cast(_SPANS))


def address(text_col: str) -> Column:
    """The address of a text; a null one has that of the empty one."""
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def addressed(docs: DataFrame, path_cols: list[str], text_col: str = "text") -> DataFrame:
    """(*path_cols, blob)."""
    return docs.select(*path_cols, address(text_col).alias("blob"))


def scan(docs: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows (blob, rule, version, spans): for each text of docs the rules that ledger lacks.

    Copies shrink to one row in each task before the shuffle, so a blob that makes up much of the table is no hot key.
    Empty tables and a full ledger give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    blobs = docs.select(F.sha2(text, 256).alias("blob"), text.alias("text"))
    known = F.array().cast("array<string>")
    names = [f"{r.kind}@{r.version}" for r in rules]
    if ledger is None:
        blobs = blobs.dropDuplicates(["blob"])
    else:
        pair = F.concat_ws("@", "rule", "version")
        done = ledger.where(pair.isin(names)).groupBy("blob").agg(F.collect_set(pair).alias("known"))
        # ids of blobs first: texts that are wholly known never leave their task
        lacking = blobs.select("blob").distinct().join(done, "blob", "left").where(F.coalesce(F.size("known"), F.lit(0)) < len(names))
        lacking = written(lacking, "lacking")
        near = F.broadcast(lacking) if lacking.count() <= BROADCAST_BLOBS else lacking
        blobs = blobs.join(near.select("blob"), "blob", "left_semi").dropDuplicates(["blob"]).join(lacking, "blob")
        known = F.coalesce("known", known)
    rows = [F.when(~F.array_contains(known, n), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r, n in zip(rules, names, strict=True)]
    return blobs.select("blob", F.explode(F.array_compact(F.array(*rows))).alias("row")).select("blob", "row.*")


def update(docs: DataFrame, path: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger table at path lacks, append it, and return the ledger. Safe to run again after a failure."""
    spark = docs.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    new = scan(docs, text_col, spark.read.parquet(path) if there else None, rules)
    new.write.mode("append").parquet(path)
    return spark.read.schema(new.schema).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, path_cols: list[str], text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(*path_cols, blob, found) for each row of docs: found has (start, n, stop, kind) by start, then by the rules' order (n)."""
    numbers = F.create_map(*(x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))))
    versions = reduce(lambda a, b: a | b, ((F.col("rule") == r.kind) & (F.col("version") == r.version) for r in rules), F.lit(False))
    span = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.element_at(numbers, F.col("rule")).alias("n"), s["stop"].alias("stop"), F.col("rule").alias("kind")))
    rows = ledger.where(versions & (F.size("spans") > 0)).dropDuplicates(["blob", "rule"]).select("blob", span.alias("some"))
    by_blob = rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("found"))
    empty = F.array().cast("array<struct<start:bigint,n:int,stop:bigint,kind:string>>")
    # in a struct, path columns may have any names
    paths = docs.select(F.struct(*(F.col(f"`{c}`") for c in path_cols)).alias("path"), address(text_col).alias("blob"))
    out = paths.join(by_blob, "blob", "left").withColumn("found", F.coalesce("found", empty))
    return out.select("path.*", *(c for c in ("blob", "found") if c not in path_cols))


def shown(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redacted(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """text with each span of found (by start), overlaps as one, replaced by mark. Without spans the text stays as it is.

    Pieces are cut out of four bytes for each code point, where a place is found without reading what stands before it.
    """
    wide = F.encode(text, "UTF-32")
    # a byte order mark in front, so that one in the text isn't taken for it
    piece = lambda w, a, b: F.decode(F.concat(F.lit(bytearray(b"\0\0\xfe\xff")), F.substring(w, (4 * a + 1).cast("int"), (4 * (b - a)).cast("int"))), "UTF-32")

    def cut(w: Column, spans: Column) -> Column:
        ends = before_each(F.transform(spans, lambda s: s["stop"]), lambda a, b: F.greatest(a, b))
        pieces = F.array_compact(F.zip_with(spans, ends, lambda s, at: F.when(s["start"] >= at, piece(w, at, s["start"]))))
        last = F.array_max(F.transform(spans, lambda s: s["stop"]))
        return F.array_join(F.concat(pieces, F.array(piece(w, last, F.floor(F.octet_length(w) / 4)))), mark)

    return F.when(F.size(found) > 0, let(wide, lambda w: let(found, lambda spans: cut(w, spans)))).otherwise(text)
