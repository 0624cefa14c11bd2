import random

import pytest
from pyspark.sql import functions as F

from pathloom import schemas
from pathloom.errors import CheckpointGap, InvariantViolation, NotFound
from pathloom.operators import catalog, graph
from pathloom.streaming.observe import Controller, Store

V = "volume:600"


def event(sequence, kind, file=None, link=None, parent=None, name=None, boundary=False, size=None, mtime=None, what="file", volume=V, reason=None):
    return (sequence, kind, volume, file, link, volume if parent else None, parent, name, boundary, what if kind == "object_observed" else None, size, None, mtime, False, "online", reason)


def obj(s, file, size=0, what="file"):
    return event(s, "object_observed", file, size=size, what=what)


def link(s, file, at, name, parent=None, boundary=False):
    return event(s, "link_observed", file, at, parent, name, boundary)


def events(spark, rows):
    return spark.createDataFrame(rows, schemas.EVENT_ROWS)


def state(spark, rows=(), volumes=(V,)):
    empty = graph.State(spark.createDataFrame([(v, v, [], "ntfs", False, True, "online", None, 0) for v in volumes], schemas.VOLUMES), spark.createDataFrame([], schemas.OBJECTS), spark.createDataFrame([], schemas.LINKS))
    return graph.fold(empty, events(spark, list(rows)), 1) if rows else empty


def tree(n=3):
    rows = [obj(0, "1", what="directory"), link(1, "1", "101", "root")]
    for i in range(2, n + 1):
        rows += [obj(2 * i, str(i), i), link(2 * i + 1, str(i), str(100 + i), f"file-{i}.txt", "1")]
    return rows


def paths(df):
    return {r.file_link_id: (r.resolved_path, r.error, r.error_subject) for r in graph.resolve_paths(df).collect()}


def test_paths_and_each_error(spark):
    d = {"what": "directory"}
    s = state(spark, [obj(0, "1", **d), link(1, "1", "101", "root"), obj(2, "2"), link(3, "2", "102", "a", "1"), obj(4, "3"), link(5, "3", "103", "lost", "99"), obj(6, "4", **d), link(7, "4", "104", "x", "1"), link(8, "4", "105", "y", "1"), obj(9, "5"), link(10, "5", "106", "child", "4"), obj(11, "6", **d), link(12, "6", "107", "edge", "1", True), obj(13, "7"), link(14, "7", "108", "in", "6"), obj(15, "8", **d), link(16, "8", "109", "p", "9"), obj(17, "9", **d), link(18, "9", "110", "q", "8"), obj(19, "10", **d), link(20, "10", "111", "self", "10")])
    got = paths(s.links)
    assert got["101"][0] == "root" and got["102"][0] == "root/a" and got["104"][0] == "root/x" and got["107"][0] == "root/edge"
    assert got["103"][1:] == ("missing_parent", f"{V}/99")
    assert got["106"][1:] == ("ambiguous_parent", f"{V}/4")
    assert got["108"][1:] == ("traversal_boundary", "107")
    assert got["109"][1] == got["110"][1] == got["111"][1] == "parent_cycle"
    assert graph.resolve_paths(s.links, 1).where("file_link_id = '102'").first().error == "depth_limit"


def test_paths_of_random_trees_against_walks(spark):
    rng = random.Random(2)
    rows, parent, names = [], {}, {}
    for i in range(60):
        up = str(rng.randrange(i)) if i and rng.random() < 0.9 else None
        parent[str(i)], names[str(i)] = up, f"n{i}"
        rows += [obj(2 * i, str(i), what="directory"), link(2 * i + 1, str(i), f"l{i}", f"n{i}", up)]
    got = paths(state(spark, rows).links)
    for i in parent:
        want, at = [], i
        while at is not None:
            want.append(names[at])
            at = parent[at]
        assert got[f"l{i}"][0] == "/".join(reversed(want))


def test_fold_tombstones_and_brings_back(spark):
    s = state(spark, [*tree(3), link(20, "2", "202", "hard.txt", "1")])
    live = lambda x: {r.file_id for r in x.objects.where("not tombstoned").collect()}
    one = graph.fold(s, events(spark, [event(30, "link_removed", "2", "102")]), 2)
    assert live(one) == {"1", "2", "3"}
    two = graph.fold(one, events(spark, [event(31, "link_removed", "2", "202")]), 3)
    assert live(two) == {"1", "3"}
    three = graph.fold(two, events(spark, [link(32, "2", "302", "back.txt", "1")]), 4)
    assert live(three) == {"1", "2", "3"} and three.links.count() == 3
    assert graph.fold(s, events(spark, [event(40, "reconciliation_required", reason="journal_gap")]), 5).volumes.first().state == "needs_reconciliation"


def test_stats_and_audit(spark):
    s = graph.fold(state(spark, tree(4)), events(spark, [event(50, "link_removed", "4", "104"), obj(51, "9", 7), obj(52, "8"), link(53, "8", "108", "lost", "77")]), 2)
    assert graph.stats(s).first().asDict() == {"live_objects": 5, "live_files": 4, "live_file_bytes": 2 + 3 + 7 + 0, "tombstoned_objects": 1, "volumes": 1, "links": 4, "pending_jobs": 0}
    assert [tuple(r) for r in graph.audit(s).collect()] == [("orphan_object", f"{V}/9"), ("missing_parent", "108")]
    assert graph.audit(s, 1).count() == 1


@pytest.mark.parametrize(
    ("rows", "rule"),
    [
        ([link(60, "77", "177", "x", "1")], "object"),
        ([link(60, "3", "102", "x", "1")], "rebind"),
        ([event(60, "link_removed", "3", "102")], "mismatch"),
        ([event(60, "object_removed", "2")], "links"),
        ([obj(60, "5"), event(61, "object_observed", "6", volume="volume:other")], "volume"),
        ([event(60, "object_removed", "55")], "object"),
    ],
)
def test_batches_that_break_a_rule(spark, rows, rule):
    s = state(spark, tree(3), (V,))
    with pytest.raises(InvariantViolation) as e:
        graph.apply_batch(s, events(spark, rows), V, 2)
    assert rule in e.value.details["rules"]


def test_order_inside_a_batch_counts(spark):
    s = state(spark, tree(3))
    fine = [event(60, "link_removed", "2", "102"), event(61, "object_removed", "2"), event(62, "link_removed", "3", "999"), obj(63, "7"), link(64, "7", "107", "new", "1")]
    out = graph.apply_batch(s, events(spark, fine), V, 2)
    assert {r.file_link_id for r in out.links.collect()} == {"101", "103", "107"}
    with pytest.raises(InvariantViolation):
        graph.apply_batch(s, events(spark, [event(60, "object_removed", "2"), event(61, "link_removed", "2", "102")]), V, 2)


def test_volumes(spark):
    s = state(spark, (), ("v1", "v2"))
    off = graph.set_volume_state(s.volumes, "v1", "offline", "gone")
    assert {r.volume_id: r.state for r in off.collect()} == {"v1": "offline", "v2": "online"}
    again = graph.upsert_volumes(off, off.where("volume_id = 'v1'"))
    assert {r.volume_id: (r.state, r.reconciliation_reason) for r in again.collect()} == {"v1": ("online", None), "v2": ("online", None)}
    with pytest.raises(InvariantViolation):
        graph.set_volume_state(s.volumes, "v9", "offline")


def test_difference_ignores_versions_and_gaps_are_found(spark):
    a = catalog.desired(state(spark, tree(3)), 1)
    b = catalog.desired(state(spark, [*tree(3), link(70, "2", "102", "renamed.txt", "1"), obj(71, "4"), link(72, "4", "104", "new.md", "1"), event(73, "link_removed", "3", "103")]), 9)
    assert {(r.document_id, r.mutation) for r in catalog.difference(a, b).collect()} == {("102", "upsert"), ("104", "upsert"), ("103", "delete")}
    assert catalog.difference(a, catalog.desired(state(spark, tree(3)), 5)).count() == 0
    assert catalog.converged(a, a) and not catalog.converged(a, b)
    assert b.where("document_id = '104'").first().extension == "md"
    seqs = spark.createDataFrame([(1,), (2,), (5,), (6,), (9,)], "sequence long")
    assert {tuple(r) for r in catalog.gaps(seqs).collect()} == {(5, 2), (9, 6)}
    rows = catalog.outbox_rows(catalog.difference(a, b), 7, 2).orderBy("sequence").collect()
    assert [r.sequence for r in rows] == [8, 9, 10] and [r.document_id for r in rows] == ["102", "103", "104"]


def test_consumers(spark):
    c = spark.createDataFrame([("a", 5, 1), ("b", 3, 1)], schemas.CONSUMERS)
    assert catalog.prune_bound(c).first().safe == 3
    assert {tuple(r) for r in catalog.acknowledge(c, "b", 9, 10, 2).collect()} == {("a", 5, 1), ("b", 9, 2)}
    for bad, rule in ((2, "regressed"), (11, "ahead")):
        with pytest.raises(InvariantViolation) as e:
            catalog.acknowledge(c, "b", bad, 10, 2)
        assert e.value.details["rule"] == rule
    with pytest.raises(InvariantViolation):
        catalog.pruned(c, c, 0)


def test_scan_restart_and_sweep(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/graph")
    store.register(state(spark).volumes)
    store.apply(V, events(spark, [obj(0, "1", what="directory"), link(1, "1", "101", "root"), obj(2, "2"), link(3, "2", "102", "a", "1"), obj(4, "3")]), durable=True)
    assert store.documents().count() == 2
    store.begin_scan(V)
    store.apply(V, events(spark, [obj(5, "1", what="directory")]))
    store.begin_scan(V)
    assert {r.availability for r in store.documents().collect()} == {"unknown"}
    with pytest.raises(InvariantViolation):
        store.finalize(V, 1)
    store.apply(V, events(spark, [obj(6, "1", what="directory"), link(7, "1", "101", "root")]))
    store.stage_checkpoint(V, {"position": 9})
    steps = [store.finalize(V, 1) for _ in range(4)]
    assert [(s["links"], s["objects"], s["done"]) for s in steps] == [(1, 0, False), (0, 0, False), (0, 1, False), (0, 0, True)]
    stats = graph.stats(store.state()).first()
    assert (store.documents().count(), stats.links, stats.live_objects, stats.tombstoned_objects) == (1, 1, 1, 2)
    assert store.book()["checkpoints"] == {V: {"position": 9}} and store.documents().first().availability == "online"
    with pytest.raises(NotFound):
        store.finalize(V, 1)


def test_scan_replaces_names_under_new_identities(spark):
    s = state(spark, tree(3))
    new = events(spark, [obj(80, "20"), link(81, "20", "120", "file-2.txt", "1"), link(82, "30", "103", "file-3.txt", "1"), obj(79, "30")])
    out = graph.apply_batch(s, new, V, 5, session_generation=5)
    assert {(r.file_link_id, r.file_id) for r in out.links.collect()} == {("101", "1"), ("120", "20"), ("103", "30")}


def test_scoped_removals_need_a_complete_scan(spark):
    s = state(spark, tree(4))
    seen = s.links.where("file_link_id = '102'")
    scope = s.links.where("parent_file_id = '1'")
    assert {r.file_link_id for r in graph.scoped_removals(s.links, seen, scope, True).collect()} == {"103", "104"}
    assert graph.scoped_removals(s.links, seen, scope, False).count() == 0
    order = graph.removal_events(scope, 10).orderBy("sequence").collect()
    assert [r.event for r in order] == ["link_removed"] * 3 + ["object_removed"] * 3 and order[0].sequence == 10


def test_controller(spark, tmp_path):
    class Source:
        calls = 0

        def scan_pages(self, v):
            yield events(spark, tree(3))

        def checkpoint(self, v):
            return {"position": 1}

        def changes(self, v, checkpoint):
            Source.calls += 1
            if Source.calls == 2:
                raise CheckpointGap("gone")
            if Source.calls == 3:
                raise ConnectionError
            return events(spark, [event(90, "link_removed", "3", "103")]), {"position": 2}, False

    store = Store(spark, f"file://{tmp_path}/graph")
    store.register(state(spark).volumes)
    c = Controller(store, Source(), [V])
    assert [c.step().kind for _ in range(4)] == ["begin", "scan", "finalize", "finalize"]
    assert store.book()["checkpoints"] == {V: {"position": 1}}
    assert c.step().kind == "changes" and store.documents().count() == 2 and store.book()["checkpoints"] == {V: {"position": 2}}
    assert c.step().kind == "gap" and V in store.book()["sessions"]
