"""The state graph: volumes, objects and links; folding events into it; paths; audits.

State is immutable tables. A batch of events becomes the next version of the tables by joins and aggregations over the
keys it touches; its rules are checked by queries that must find nothing before anything is published.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvariantViolation
from ..functions import text as T
from ..sources.scratch import written
from .numbering import numbered

#: Fixed value: path components that a projected document has at most.
DEPTH = 512
KEY = ["volume_id", "file_id"]
PARENT = ["parent_volume_id", "parent_file_id"]


@dataclass(frozen=True)
class State:
    """The three tables of a graph. Layouts are in schemas."""

    volumes: DataFrame
    objects: DataFrame
    links: DataFrame


def violations(state: State, events: DataFrame, volume_id: str | None = None) -> DataFrame:
    """(rule, sequence, subject) for each event that the state or the batch's earlier events forbid.

    Rules: volume (one and known), object (a link's object exists by then), rebind (a link keeps its object), parent (no
    other volume), mismatch (a removed link belongs to the object named), links (no object is removed while it has links).
    """
    def rule(name: str, rows: DataFrame, subject: str) -> DataFrame:
        return rows.select(F.lit(name).alias("rule"), F.col("sequence"), F.col(subject).cast("string").alias("subject"))

    unknown = rule("volume", events.join(state.volumes.select("volume_id"), "volume_id", "left_anti"), "volume_id")
    out = unknown if volume_id is None else unknown.unionAll(rule("volume", events.where(F.col("volume_id") != volume_id), "volume_id"))
    links = events.where("event = 'link_observed'")
    out = out.unionAll(rule("parent", links.where("parent_volume_id is not null and parent_volume_id != volume_id or parent_volume_id is null and parent_file_id is not null"), "file_link_id"))

    # objects that exist by a link event: in the state, or observed earlier in the batch
    first = events.where("event = 'object_observed'").groupBy(*KEY).agg(F.min("sequence").alias("first"))
    there = state.objects.select(*KEY, F.lit(-1).cast("long").alias("first")).unionByName(first).groupBy(*KEY).agg(F.min("first").alias("first"))
    out = out.unionAll(rule("object", links.join(there, KEY, "left").where("first is null or first > sequence"), "file_link_id"))
    gone = events.where("event = 'object_removed'")
    out = out.unionAll(rule("object", gone.join(there, KEY, "left").where("first is null or first > sequence"), "file_id"))

    # a link's history: the state's row, then the batch's events; each event sees what stands before it
    touched = events.where("event in ('link_observed', 'link_removed')").select("file_link_id").distinct()
    history = (
        state.links.join(touched, "file_link_id", "left_semi").select("file_link_id", *KEY, F.lit(-1).cast("long").alias("sequence"), F.lit(True).alias("observed"))
        .unionAll(events.where("event in ('link_observed', 'link_removed')").select("file_link_id", *KEY, "sequence", (F.col("event") == "link_observed").alias("observed")))
    )
    before = Window.partitionBy("file_link_id").orderBy("sequence")
    seen = history.withColumns({"was": F.lag("observed").over(before), "was_volume": F.lag("volume_id").over(before), "was_file": F.lag("file_id").over(before)})
    other = F.col("was") & ~(F.col("was_volume").eqNullSafe(F.col("volume_id")) & F.col("was_file").eqNullSafe(F.col("file_id")))
    out = out.unionAll(rule("rebind", seen.where(F.col("observed") & (F.col("sequence") >= 0) & other), "file_link_id"))
    out = out.unionAll(rule("mismatch", seen.where(~F.col("observed") & other), "file_link_id"))

    # links that an object still has when it is removed
    owned = state.links.join(gone.select(*KEY).distinct(), KEY, "left_semi").select("file_link_id", *KEY, F.lit(-1).cast("long").alias("at"), F.lit(True).alias("on"))
    owned = owned.unionAll(events.where("event in ('link_observed', 'link_removed')").join(gone.select(*KEY).distinct(), KEY, "left_semi").select("file_link_id", *KEY, F.col("sequence").alias("at"), (F.col("event") == "link_observed").alias("on")))
    last = gone.select("sequence", *KEY).join(owned, KEY).where("at < sequence").groupBy("sequence", *KEY, "file_link_id").agg(F.max_by("on", "at").alias("on"))
    out = out.unionAll(rule("links", last.where("`on`").select("sequence", *KEY).distinct(), "file_id"))
    return out


def check(found: DataFrame) -> None:
    """Raise InvariantViolation with up to ten of the rows found."""
    some = found.orderBy("sequence", "rule").limit(10).collect()
    if some:
        raise InvariantViolation("; ".join(f"{r.rule} at {r.sequence}: {r.subject}" for r in some), rules=sorted({r.rule for r in some}))


def fold(state: State, events: DataFrame, generation: int, session_generation: int | None = None) -> State:
    """The state after the events, last write wins by sequence. Checks nothing: see violations().

    Observed objects and links are stamped with `generation` and live again. A removed link is gone; the object that
    loses its last link is tombstoned, as is one that is removed. While a scan is on (session_generation), an observed link
    takes the place of older ones with its parent and name.
    """
    w = lambda *by: Window.partitionBy(*by).orderBy(F.desc("sequence"))
    last = events.where("event in ('link_observed', 'link_removed')").withColumn("n", F.row_number().over(w("file_link_id"))).where("n = 1")
    new = last.where("event = 'link_observed'").select("file_link_id", *KEY, *PARENT, "name", F.coalesce("traversal_boundary", F.lit(False)).alias("traversal_boundary"), F.lit(generation).cast("long").alias("observation_generation"))
    kept = state.links.join(last.select("file_link_id"), "file_link_id", "left_anti")
    if session_generation is not None:
        kept = kept.join(namespace_conflicts(kept, new, session_generation).select("old_link_id").withColumnRenamed("old_link_id", "file_link_id"), "file_link_id", "left_anti")
    links = kept.unionByName(new.select(*state.links.columns))

    observed = events.where("event = 'object_observed'").withColumn("n", F.row_number().over(w(*KEY))).where("n = 1")
    fresh = observed.select(*KEY, "kind", "size", "created_at_unix_ms", "modified_at_unix_ms", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("availability", F.lit("online")).alias("availability"), F.lit(False).alias("tombstoned"), F.lit(generation).cast("long").alias("observation_generation"))
    objects = state.objects.join(observed.select(*KEY), KEY, "left_anti").unionByName(fresh.select(*state.objects.columns))
    # what last touched each object decides whether it lives
    touch = events.where("event != 'reconciliation_required'").groupBy(*KEY).agg(F.max_by("event", "sequence").alias("event"))
    before, after = (x.groupBy(*KEY).agg(F.count("*").alias(n)) for x, n in ((state.links, "links_before"), (links, "links_after")))
    lost = F.coalesce("links_after", F.lit(0)) == 0
    had = (F.coalesce("links_before", F.lit(0)) > 0) | (F.col("event") == "link_removed")
    dead = F.when(F.col("event") == "object_removed", True).when(F.col("event").isin("object_observed", "link_observed") & ~(lost & (F.coalesce("links_before", F.lit(0)) > 0)), False).when(lost & had, True).otherwise(F.col("tombstoned"))
    objects = objects.join(touch, KEY, "left").join(before, KEY, "left").join(after, KEY, "left").withColumn("tombstoned", dead).select(*state.objects.columns)

    required = events.where("event = 'reconciliation_required'").groupBy("volume_id").agg(F.max_by("reason", "sequence").alias("new_reason"))
    bump = events.select("volume_id").distinct().withColumn("touched", F.lit(True))
    volumes = state.volumes.join(required, "volume_id", "left").join(bump, "volume_id", "left").withColumns(
        {
            "state": F.when(F.col("new_reason").isNotNull(), "needs_reconciliation").otherwise(F.col("state")),
            "reconciliation_reason": F.coalesce("new_reason", "reconciliation_reason"),
            "generation": F.when(F.col("touched"), F.greatest("generation", F.lit(generation).cast("long"))).otherwise(F.col("generation")),
        }
    )
    return State(volumes.select(*state.volumes.columns), objects, links)


def apply_batch(state: State, events: DataFrame, volume_id: str, generation: int, session_generation: int | None = None) -> State:
    """fold() after violations() found nothing: a batch takes effect as a whole or not at all."""
    found = violations(state, events, volume_id)
    if session_generation is not None:  # a scan may meet a link's id under a new object
        found = found.where("rule != 'rebind'")
    check(found)
    return fold(state, events, generation, session_generation)


def upsert_volumes(volumes: DataFrame, new: DataFrame) -> DataFrame:
    """Volumes with those of `new` online, without a reason, their generation kept."""
    old = volumes.select("volume_id", F.col("generation").alias("old"))
    fresh = new.join(old, "volume_id", "left").withColumns({"state": F.lit("online"), "reconciliation_reason": F.lit(None).cast("string"), "generation": F.coalesce("old", "generation", F.lit(0))})
    return volumes.join(new.select("volume_id"), "volume_id", "left_anti").unionByName(fresh.select(*volumes.columns))


def set_volume_state(volumes: DataFrame, volume_id: str, state: str, reason: str | None = None) -> DataFrame:
    """Volumes with one's state set; an unknown volume is an error."""
    if volumes.where(F.col("volume_id") == volume_id).isEmpty():
        raise InvariantViolation(f"unknown volume {volume_id}")
    mine = F.col("volume_id") == volume_id
    return volumes.withColumns({"state": F.when(mine, state).otherwise(F.col("state")), "reconciliation_reason": F.when(mine, F.lit(reason)).otherwise(F.col("reconciliation_reason"))})


def select_volumes(volumes: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Local NTFS volumes, or those named by id or by mount point; case of A-Z and a trailing separator don't count."""
    if wanted is None:
        return volumes.where(F.col("local") & (F.lower("filesystem") == "ntfs"))
    names = [x.rstrip("\\/").lower() for x in wanted]
    mounted = F.exists("mount_points", lambda m: F.lower(F.regexp_replace(m, r"[\\/]+$", "")).isin(names))
    return volumes.where(F.col("volume_id").isin(wanted) | mounted)


def events_to_mutations(events: DataFrame) -> DataFrame:
    """Each event's mutation of the graph, one for one."""
    names = F.create_map(*(F.lit(x) for pair in (("object_observed", "upsert_object"), ("link_observed", "upsert_link"), ("link_removed", "remove_link"), ("object_removed", "tombstone_object"), ("reconciliation_required", "require_reconciliation")) for x in pair))
    return events.withColumn("mutation", F.element_at(names, F.col("event")))


def resolve_paths(links: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(file_link_id, resolved_path, depth, error, error_subject) for each link.

    A link's path hangs on its parent object alone, so walks start at the distinct parents, not at each link, and links join them
    at the end, once; a folder with very many links is split there by the skew join. A walk goes from an object to its only link's
    parent, level by level: a round is one join for all walks that are still on, so rounds follow the tree's depth and not its
    size. Errors, by what a step meets first: depth_limit, traversal_boundary (an ancestor's), parent_cycle, missing_parent,
    ambiguous_parent (an ancestor with two links or more). Parents' links and each round's walks are written to the shared folder,
    so rounds don't run again those before them.
    """
    if depth < 1:
        raise InvariantViolation("a path has one component at least")
    below = links.where("parent_file_id is not null")
    parents = written(below.select(*PARENT).distinct(), "parents")
    named = parents.select(*(F.col(f"parent_{c}").alias(c) for c in KEY))
    own = links.join(named, KEY, "left_semi").groupBy(*(F.col(c).alias(f"parent_{c}") for c in KEY))
    only = written(own.agg(F.count("*").alias("n"), F.first("file_link_id").alias("up"), F.first("name").alias("up_name"), F.first("traversal_boundary").alias("up_boundary"), F.first("parent_volume_id").alias("up_volume"), F.first("parent_file_id").alias("up_file")), "only")
    subject = F.concat_ws("/", *PARENT)
    start = ["start_volume", "start_file"]
    none = F.lit(None).cast("string")
    walks = parents.select(*(F.col(c).alias(s) for c, s in zip(PARENT, start, strict=True)), *PARENT, F.array().cast("array<string>").alias("names"), F.array().cast("array<string>").alias("seen"), none.alias("error"), none.alias("error_subject"))
    on = F.col("parent_file_id").isNotNull() & F.col("error").isNull()
    done = None
    for step in range(1, depth + 2):
        ended = walks.where(~on)
        done = ended if done is None else done.unionAll(ended)
        walks = walks.where(on)
        if walks.isEmpty():
            break
        met = walks.join(only, PARENT, "left")
        cycle = F.array_contains("seen", subject)
        error = F.when(cycle, "parent_cycle").when(F.col("n").isNull(), "missing_parent").when(F.col("n") > 1, "ambiguous_parent").when(F.lit(step >= depth), "depth_limit").when(F.coalesce("up_boundary", F.lit(False)), "traversal_boundary")
        what = F.when(error.isin("parent_cycle", "missing_parent", "ambiguous_parent"), subject).when(error == "depth_limit", F.lit(str(depth))).when(error == "traversal_boundary", F.col("up").cast("string"))
        walks = met.select(*start, F.col("up_volume").alias("parent_volume_id"), F.col("up_file").alias("parent_file_id"), F.concat("names", F.array("up_name")).alias("names"), F.concat("seen", F.array(subject)).alias("seen"), error.alias("error"), what.alias("error_subject"))
        walks = written(walks, "walks")
    same = F.col("start_file").eqNullSafe(F.col("parent_file_id")) & F.col("start_volume").eqNullSafe(F.col("parent_volume_id"))
    found = below.select("file_link_id", *PARENT, "name").join(done.select(*start, "names", "error", "error_subject"), same)
    roots = links.where("parent_file_id is null").select("file_link_id", "name", F.array().cast("array<string>").alias("names"), none.alias("error"), none.alias("error_subject"))
    walked = roots.unionAll(found.select(*roots.columns)).withColumn("names", F.concat(F.array("name"), "names"))
    good = F.col("error").isNull()
    return walked.select("file_link_id", F.when(good, T.display_path(F.reverse("names"))).alias("resolved_path"), F.when(good, F.size("names")).alias("depth"), "error", "error_subject")


def affected_links(links: DataFrame, changed: DataFrame) -> DataFrame:
    """Links of the changed objects (volume_id, file_id)."""
    return links.join(changed.select(*KEY).distinct(), KEY, "left_semi")


def subtree(links: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Ids of the links below the root objects (volume_id, file_id), level by level: what a directory's rename touches."""
    level = written(links.join(roots.select(*KEY).distinct(), KEY, "left_semi").select("file_link_id", *KEY), "level")
    out = level.select("file_link_id")
    for _ in range(depth):
        above = level.select(*(F.col(c).alias(f"parent_{c}") for c in KEY)).distinct()
        level = written(links.join(above, PARENT, "left_semi").join(out, "file_link_id", "left_anti").select("file_link_id", *KEY), "level")
        if level.isEmpty():
            break
        out = out.unionAll(level.select("file_link_id"))
    return out.distinct()


def stats(state: State, pending_jobs: DataFrame | None = None) -> DataFrame:
    """One row: live objects, files and their bytes, tombstones, volumes, links, pending jobs."""
    live = ~F.col("tombstoned")
    file = live & (F.col("kind") == "file")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    objects = state.objects.agg(count(live)("live_objects"), count(file)("live_files"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("live_file_bytes"), count(~live)("tombstoned_objects"))
    parts = [state.volumes.agg(F.count("*").alias("volumes")), state.links.agg(F.count("*").alias("links"))]
    parts.append(pending_jobs.agg(F.count("*").alias("pending_jobs")) if pending_jobs is not None else state.volumes.sparkSession.range(1).select(F.lit(0).cast("long").alias("pending_jobs")))
    out = objects.withColumn("one", F.lit(1))
    for p in parts:  # each side is one row
        out = out.join(p.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def audit(state: State, limit: int | None = None) -> DataFrame:
    """(issue, subject): live objects without a link, then links whose parent object is missing."""
    orphans = state.objects.where(~F.col("tombstoned")).join(state.links.select(*KEY).distinct(), KEY, "left_anti")
    missing = state.links.where("parent_file_id is not null").join(state.objects.select(*(F.col(c).alias(f"parent_{c}") for c in KEY)), PARENT, "left_anti")
    out = orphans.select(F.lit(0).alias("o"), F.lit("orphan_object").alias("issue"), F.concat_ws("/", *KEY).alias("subject")).unionAll(missing.select(F.lit(1).alias("o"), F.lit("missing_parent").alias("issue"), F.col("file_link_id").cast("string").alias("subject")))
    out = out.orderBy("o", "subject")
    return (out.limit(limit) if limit is not None else out).select("issue", "subject")


def link_counts(links: DataFrame) -> DataFrame:
    """Links of each object."""
    return links.groupBy(*KEY).agg(F.count("*").alias("links"))


def duplicate_names(links: DataFrame) -> DataFrame:
    """Names that one parent, or one volume's roots, has twice or more: must be none."""
    return links.groupBy("volume_id", *PARENT, "name").agg(F.count("*").alias("n")).where("n > 1")


def namespace_conflicts(links: DataFrame, observed: DataFrame, cutoff: int) -> DataFrame:
    """(old_link_id, new_link_id): links last seen before the scan's generation that stand where an observed link stands now,
    or carry its id for another object."""
    old = links.where(F.col("observation_generation") < cutoff)
    o = old.select(F.col("file_link_id").alias("old_link_id"), F.col("volume_id").alias("old_volume"), F.col("file_id").alias("old_file"), F.col("volume_id").alias("v"), F.coalesce("parent_volume_id", F.lit("")).alias("pv"), F.coalesce("parent_file_id", F.lit("")).alias("pf"), "name")
    n = observed.select(F.col("file_link_id").alias("new_link_id"), F.col("volume_id").alias("v"), F.coalesce("parent_volume_id", F.lit("")).alias("pv"), F.coalesce("parent_file_id", F.lit("")).alias("pf"), "name", F.col("file_id").alias("new_file"))
    places = o.join(n, ["v", "pv", "pf", "name"]).where("old_link_id != new_link_id").select("old_link_id", "new_link_id")
    ids = o.join(n.select("new_link_id", F.col("v").alias("new_volume"), "new_file"), F.col("old_link_id") == F.col("new_link_id")).where("old_file != new_file or old_volume != new_volume").select("old_link_id", "new_link_id")
    return places.unionAll(ids).distinct()


def stale_links(links: DataFrame, volume_id: str, scan_generation: int, limit: int | None = None) -> DataFrame:
    """Links of the volume that the scan didn't see, oldest first."""
    rows = links.where((F.col("volume_id") == volume_id) & (F.col("observation_generation") < scan_generation))
    return rows if limit is None else rows.orderBy("observation_generation", "file_link_id").limit(limit)


def stale_objects(state: State, volume_id: str, scan_generation: int, limit: int | None = None) -> DataFrame:
    """Live objects of the volume that the scan didn't see and that have no link, oldest first."""
    rows = state.objects.where((F.col("volume_id") == volume_id) & ~F.col("tombstoned") & (F.col("observation_generation") < scan_generation)).join(state.links.select(*KEY).distinct(), KEY, "left_anti")
    return rows if limit is None else rows.orderBy("observation_generation", "file_id").limit(limit)


def sweep(state: State, volume_id: str, scan_generation: int, links: int | None = None) -> State:
    """The state without the links that a scan didn't see; objects that lose their last link are tombstoned, as are live ones without links that weren't seen."""
    gone = stale_links(state.links, volume_id, scan_generation, links)
    left = state.links.join(gone.select("file_link_id"), "file_link_id", "left_anti")
    bare = gone.select(*KEY).distinct().join(left.select(*KEY).distinct(), KEY, "left_anti")
    middle = State(state.volumes, state.objects, left)
    dead = bare.unionAll(stale_objects(middle, volume_id, scan_generation).select(*KEY)) if links is None else bare
    dead = dead.distinct().withColumn("dead", F.lit(True))
    objects = state.objects.join(dead, KEY, "left").withColumn("tombstoned", F.col("tombstoned") | F.coalesce("dead", F.lit(False))).select(*state.objects.columns)
    return State(state.volumes, objects, left)


def scoped_removals(links: DataFrame, observed: DataFrame, scope: DataFrame, complete: bool) -> DataFrame:
    """Links in the scope (file_link_id) that a scan of it didn't observe; none after a partial scan, whose silence means nothing."""
    rows = links.join(scope.select("file_link_id"), "file_link_id", "left_semi").join(observed.select("file_link_id"), "file_link_id", "left_anti")
    return rows if complete else rows.limit(0)


def removal_events(links: DataFrame, first_sequence: int = 0) -> DataFrame:
    """Events that take links away and then their objects: links first, in the order of ids."""
    a = links.select(F.lit("link_removed").alias("event"), F.lit(0).alias("o"), *KEY, "file_link_id")
    b = links.select(*KEY).distinct().select(F.lit("object_removed").alias("event"), F.lit(1).alias("o"), *KEY, F.lit(None).cast("string").alias("file_link_id"))
    placed = numbered(a.unionByName(b), "volume_id", "o", "file_link_id", "file_id")
    first = placed.groupBy("volume_id").agg(F.min("place").alias("first"))  # a row for each volume
    return placed.join(F.broadcast(first), "volume_id").withColumn("sequence", (F.col("place") - F.col("first") + first_sequence).cast("int")).drop("o", "place", "first")


def effective_availability(volume_state: Column, availability: Column) -> Column:
    """An online volume shows its objects' own availability; an offline one offline; any other unknown."""
    return F.when(volume_state == "online", availability).when(volume_state == "offline", "offline").otherwise("unknown")
