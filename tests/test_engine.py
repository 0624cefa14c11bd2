import struct

import pytest
from pyspark.sql import functions as F

from pathloom import schemas
from pathloom.engine import SearchEngine
from pathloom.errors import AlreadyExists, CapacityExceeded, CatalogError, CheckpointGap, InvalidRequest, InvariantViolation, NotFound
from pathloom.operators import catalog, content
from pathloom.operators.governor import Governor, Sample, run
from pathloom.sources import files, journal
from pathloom.sources import tables as G
from pathloom.streaming import builder, projector, stateful
from test_graph import V, event, events, link, state, tree


@pytest.fixture
def engine(spark, tmp_path):
    e = SearchEngine(spark, f"file://{tmp_path}/engine")
    e.store.register(state(spark).volumes)
    return e


def names(e, q, **k):
    return [r.document_id for r in e.search(q, **k).collect()]


def test_events_to_search_and_back(spark, engine):
    engine.store.apply(V, events(spark, tree(3)))
    assert engine.projector.run() == engine.store.log.high_water() == 3
    assert names(engine, "file-2.txt") == ["102"]
    engine.store.apply(V, events(spark, [link(50, "2", "102", "renamed.txt", "1")]))
    assert names(engine, "renamed.txt") == []
    engine.projector.run()
    assert names(engine, "renamed.txt") == ["102"] and names(engine, "named") == ["102"]
    engine.store.apply(V, events(spark, [event(51, "link_removed", "3", "103")]))
    engine.projector.run()
    assert engine.documents().count() == 2
    status = engine.status().first()
    assert status.backlog == 0 and status.documents == 2
    assert engine.health().first().converged
    before = engine.projector.generations.active()
    engine.projector.run()
    assert engine.projector.generations.active() == before
    hit = engine.search("renamed").first()
    assert (hit["rank"], hit.ranking_version, hit.resolved_path, hit.size) == (1, 1, "root/renamed.txt", 2)
    assert [r.document_id for r in engine.items(["102", "nope", "101"]).collect()] == ["102", "101"]
    with pytest.raises(NotFound):
        engine.item("nope")
    few = SearchEngine(spark, engine.store.root, ("content_search",))
    with pytest.raises(CatalogError) as e:
        few.search("a")
    assert e.value.code == "capability_denied"


def test_directory_rename_moves_children(spark, engine):
    rows = [*tree(1), event(10, "object_observed", "2", what="directory"), link(11, "2", "102", "before", "1"), event(12, "object_observed", "3"), link(13, "3", "103", "child.txt", "2")]
    engine.store.apply(V, events(spark, rows))
    engine.store.apply(V, events(spark, [event(20, "link_removed", "2", "102"), link(21, "2", "202", "after", "1")]))
    engine.projector.run()
    assert {r.document_id: r.resolved_path for r in engine.documents().collect()} == {"101": "root", "202": "root/after", "103": "root/after/child.txt"}


def test_replayed_batches_and_crashes_change_nothing(spark, engine):
    engine.store.apply(V, events(spark, tree(4)))
    rows = engine.store.log.read()
    first = engine.projector.apply(rows)
    assert first["applied"] == 4
    once = catalog.fingerprint(engine.documents()).first()
    assert engine.projector.apply(rows)["applied"] == 0
    assert catalog.fingerprint(engine.documents()).first() == once
    # a crash between activation and acknowledgement: the batch comes again
    engine.store.apply(V, events(spark, [link(60, "2", "102", "moved.txt", "1")]))
    real, engine.projector.consumer.acknowledge = engine.projector.consumer.acknowledge, lambda *a: (_ for _ in ()).throw(RuntimeError)
    with pytest.raises(RuntimeError):
        engine.projector.apply(engine.store.log.read())
    engine.projector.consumer.acknowledge = real
    assert engine.projector.apply(engine.store.log.read())["applied"] == 1
    assert catalog.converged(engine.store.documents(), engine.documents().select(*engine.store.documents().columns))
    # a lost generation is rebuilt from the desired catalog
    active = engine.projector.generations.active()
    engine.projector.generations.folder.delete(engine.projector.generations.path(active).rpartition("/")[2])
    number = engine.projector.recover(engine.store.documents())
    assert number > active and engine.projector.recover(engine.store.documents()) == number and names(engine, "moved.txt") == ["102"]


def test_gaps_and_no_ops(spark, engine):
    engine.store.apply(V, events(spark, tree(3)))
    with pytest.raises(InvariantViolation):
        engine.projector.apply(engine.store.log.read().where("sequence != 2"))
    top = engine.store.log.high_water()
    engine.store.apply(V, events(spark, [event(70, "object_observed", "2", size=2)]))
    assert engine.store.log.high_water() == top
    with pytest.raises(InvariantViolation):
        engine.store.apply(V, events(spark, [event(71, "object_removed", "2")]))
    assert engine.store.log.high_water() == top and engine.store.documents().count() == 3


def test_prune(spark, engine):
    engine.store.apply(V, events(spark, tree(3)))
    engine.store.apply(V, events(spark, [link(60, "2", "102", "m.txt", "1")]))
    assert engine.store.log.prune(None) == []
    assert len(engine.store.log.prune(3)) >= 1
    assert engine.store.log.read().agg(F.min("sequence")).first()[0] == 4 and engine.store.log.high_water() == 4


def test_content_build_and_search(spark, engine, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "meeting-notes.md").write_text("The launch codeword is ultramarine-constellation")
    (root / "sub" / "bin.txt").write_bytes(b"a\0b")
    (root / "sub" / "bad.txt").write_bytes(b"\xff\xfe")
    (root / "big.md").write_text("x" * 100)
    (root / "image.png").write_bytes(b"png")
    policy = content.Policy((str(root),), 64)
    texts = files.texts(spark, str(root), policy)
    assert {r.path.rpartition("/")[2]: r.skip_reason for r in texts.collect()} == {"meeting-notes.md": None, "bin.txt": "non_text", "bad.txt": "non_text", "big.md": "too_large", "image.png": "extension"}
    docs = spark.createDataFrame([(str(i), V, str(i), str(i), 1, p.rpartition("/")[2], p, p.rpartition(".")[2], "file", 10, None, 5, False, "online", "f") for i, p in enumerate([f"{root}/meeting-notes.md", f"{root}/sub/bin.txt", "/elsewhere/outside.md"])], schemas.DOCUMENTS)
    s = engine.build_content(texts, policy, docs).first()
    assert (s.catalog_documents, s.indexed_documents, s.skipped_non_text, s.skipped_outside_roots) == (3, 1, 1, 1)
    indexed = engine.contents.read()
    assert content.search(indexed, "ultramarine").count() == content.search(indexed, "ultram").count() == 1 and content.search(indexed, "ult").count() == 0
    for bad in (((), 10), (("/a", "/a/b"), 10), (("/a",), 0), (("/a",), content.MOST_BYTES + 1)):
        with pytest.raises(InvalidRequest):
            content.Policy(*bad)
    assert len(content.EXTENSIONS) == 42
    with pytest.raises(CapacityExceeded):
        content.check_capacity(90, 1, 20, 1000, 10, 100, 10)
    content.check_capacity(10, 1, 20, 1000, 10, 100, 10)
    listed = files.scoped(files.listing(spark, str(root)), f"file:{root}", ("SUB",))
    assert listed.count() == 3
    objects, links = files.observations(files.listing(spark, str(root)).withColumn("path", F.regexp_replace("path", "^file:/*", "/")), str(root), "v")
    assert links.count() == objects.count() == 6 and {r.name for r in links.where("parent_file_id is not null").collect()} == {"bin.txt", "bad.txt"}


def test_content_delta_applies(spark):
    make = lambda rows: spark.createDataFrame(rows, "document_id string, volume_id string, file_id string, kind string, size long, modified_at_unix_ms long, availability string, fingerprint string, text string, skip_reason string")
    row = lambda i, text, fp, mtime=1, size=1, skip=None: (i, "v", i, "file", size, mtime, "online", fp, text, skip)
    prior = content.index(make([row("a", "one", "f1"), row("b", "two", "f1"), row("c", "three", "f1"), row("d", "four", "f1"), row("e", "five", "f1"), row("f", "six", "f1")]))
    new = make([row("a", "one", "f1"), row("b", "two!", "f2"), row("c", "three", "f2", 2), row("d", "changed", "f2", 2), row("e", None, "f2", skip="extension"), row("g", "seven", "f1"), row("h", None, "f", skip="io")])
    hashed = new.withColumn("content_hash", F.sha2("text", 256))
    gone = make([row("f", None, "f"), row("z", None, "f")]).select("document_id")
    content.check_batch(hashed, gone)
    with pytest.raises(InvariantViolation):
        content.check_batch(hashed, hashed.select("document_id"))
    out = content.delta(prior, hashed, gone)
    assert {r.document_id: r.outcome for r in out.collect()} == {"a": "unchanged", "b": "metadata_only", "c": "unchanged_hash", "d": "updated", "e": "evicted", "g": "added", "h": "skipped", "f": "removed", "z": "absent"}
    after = content.apply_delta(prior, content.index(new.where("skip_reason is null")), gone, out)
    assert {r.document_id for r in after.collect()} == {"a", "b", "c", "d", "g"}
    assert {r.document_id for r in content.search(after, "changed seven four five", 10).collect()} == {"d", "g"}
    assert {r.document_id: r.outcome for r in content.sync_outcomes(prior, hashed.where("document_id in ('a', 'g')")).where("outcome != 'removed'").collect()} == {"a": "unchanged", "g": "added"}


def test_generations(spark, tmp_path):
    g = G.Generations(spark, f"file://{tmp_path}/t")
    with pytest.raises(NotFound):
        g.read()
    for k in range(4):
        n = g.create(spark.range(k + 1))
        g.activate(n)
    assert g.read().count() == 4 and g.active() == 4
    with pytest.raises(AlreadyExists):
        g.create(spark.range(1), number=2)
    with pytest.raises(CatalogError):
        g.create(spark.range(3), expected=5)
    assert g.collect_garbage(1) == [1, 2, 5] and g.read(3).count() == 3
    number = g.next_number()
    assert number == 5 or number == 6
    for page in range(3):
        g.append_page(spark.range(page * 10, page * 10 + 10), number, page)
    g.append_page(spark.range(20, 30), number, 2)
    assert g.building() == [number] and g.info(number)["page"] == 2
    g.ready(number)
    g.activate(number)
    assert g.read().select("id").distinct().count() == 30
    with pytest.raises(NotFound):
        g.activate(99)


def test_slots_survive_a_torn_write(spark, tmp_path):
    f = G.Folder(spark, f"file://{tmp_path}/s")
    assert G.read_slots(f, "x") is None
    G.write_slots(f, "x", {"v": 1})
    G.write_slots(f, "x", {"v": 2})
    f.write("x.0", b'{"sha256": "torn')
    assert G.read_slots(f, "x") == {"v": 1}
    G.write_slots(f, "x", {"v": 3})
    assert G.read_slots(f, "x") == {"v": 3}


def test_reports_and_frames(spark, tmp_path):
    f = G.Folder(spark, f"file://{tmp_path}/r")
    names_ = G.write_report(f, "bench", [{"name": "a|b", "unit": "s", "value": 1.5, "dimensions": {"n": 1}, "samples": 3}])
    assert names_ == ["bench.json", "bench.csv", "bench.md"] and b"a\\|b" in f.read("bench.md")
    with pytest.raises(AlreadyExists):
        G.write_report(f, "bench", [])
    assert G.decode_frame(G.encode_frame({"é": 1})) == {"é": 1}
    for bad in (b"", b"\x05\0\0\0{}", G.encode_frame({})[:-1]):
        with pytest.raises(ValueError):
            G.decode_frame(bad)
    with pytest.raises(ValueError):
        G.encode_frame({"a": "x" * 2_000_000})


def record(file, parent, position, reason, name, attributes=0, version=2):
    raw = name if isinstance(name, bytes) else name.encode("utf-16-le")
    n = (60 + len(raw) + 7) // 8 * 8
    return (struct.pack("<IHHQQqqIIIIHH", n, version, 0, file, parent, position, 0, reason, 0, 0, attributes, len(raw), 60) + raw).ljust(n, b"\0")


def test_journal(spark):
    page = struct.pack("<q", 99) + record(5, 1, 10, journal.FILE_CREATE, "é.txt") + record(2**63 + 7, 1, 20, journal.DATA_CHANGE, b"\x00\xd8", journal.REPARSE_POINT)
    position, rows = journal.decode_page(page)
    assert position == 99 and rows[0] == (5, 1, 10, journal.FILE_CREATE, 0, "é.txt", False) and rows[1][5:] == ("�", True)
    got = journal.records(spark.createDataFrame([(page,)], "page binary")).orderBy("position").collect()
    assert [r.name for r in got] == ["é.txt", "�"] and got[1].file_reference == -(2**63) + 7
    with pytest.raises(journal.UnsupportedRecord):
        journal.decode(record(1, 1, 1, 1, "a", version=3))
    for bad in (page[:40], record(1, 1, 1, 1, "a")[:-8], record(1, 1, 1, 1, b"abc")):
        with pytest.raises(journal.MalformedRecord):
            journal.decode(bad[8:] if bad is page[:40] else bad)
    c = journal.Correlator(b"v" * 16)
    made = c.events((5, 1, 1, journal.FILE_CREATE, 0, "a", False))
    assert [e["event"] for e in made] == ["object_observed", "link_observed"]
    assert c.events((5, 1, 2, journal.RENAME_OLD, 0, "a", False)) == []
    moved = c.events((5, 2, 3, journal.RENAME_NEW, 0, "b", False))
    assert [e["event"] for e in moved] == ["link_observed"] and moved[0]["file_link_id"] == made[1]["file_link_id"]
    gone = c.events((5, 2, 4, journal.FILE_DELETE, 0, "b", False))
    assert [e["event"] for e in gone] == ["link_removed", "object_removed"] and gone[0]["file_link_id"] == made[1]["file_link_id"]
    assert c.events((6, 1, 5, journal.HARD_LINK, 0, "h", False), "missing")[0]["event"] == "link_removed"
    assert c.events((6, 1, 6, journal.DATA_CHANGE, 0, "h", False), "unavailable") == []
    assert c.events((6, 1, 7, 0, 0, "�", True)) == [{"event": "reconciliation_required", "reason": "provider_requested"}]
    journal.validate_checkpoint(1, 5, 1, 5)
    for bad in ((1, 5, 2, 0), (1, 5, 1, 6)):
        with pytest.raises(CheckpointGap):
            journal.validate_checkpoint(*bad)
    parts = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "position long, part int")
    page, more = journal.bounded(parts, 0, 2)
    assert page.count() == 2 and more.first().has_more


JOURNAL = "volume_id binary, file_reference long, parent_reference long, position long, reason long, attributes long, name string, had_invalid_utf16 boolean"


def test_renames_meet_across_batches_of_a_stream(spark, tmp_path):
    rows = [(b"v" * 16, 5, 1, 1, journal.FILE_CREATE, 0, "a", False), (b"v" * 16, 5, 1, 2, journal.RENAME_OLD, 0, "a", False), (b"v" * 16, 5, 2, 3, journal.RENAME_NEW, 0, "b", False)]
    whole = stateful.correlate_batch(spark.createDataFrame(rows, JOURNAL)).orderBy("position", "part").collect()
    for k, r in enumerate(rows):
        spark.createDataFrame([r], JOURNAL).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(JOURNAL).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stateful.correlate(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("position", "part").collect()
    key = lambda rs: [(r.position, r.part, r.event, bytes(r.file_link_id or b"")) for r in rs]
    assert key(got) == key(whole) and len(got) == 3 and got[1].file_link_id == got[2].file_link_id


def test_governor(spark, tmp_path):
    g = Governor()
    assert g.mode == "balanced" and not g.budget()["background_paused"]
    g = g.interactive().latency(4_000_000)
    assert (g.mode, g.reason, g.budget()["background_paused"]) == ("active", "user_active", True)
    modes = []
    for _ in range(7):
        g = g.window()
        modes.append(g.mode)
    assert modes == ["active"] * 6 + ["balanced"] and g.transitions == 2
    assert Governor().latency(75_000_001).reason == "search_sla"
    low = Governor().sampled(Sample(400, 500, 500, "ac"))
    assert (low.mode, low.reason) == ("pressure", "critical_memory")
    saver = low.sampled(Sample(power="battery", energy_saver=True))
    assert saver.mode == "battery" and saver.budget()["background_paused"]
    battery = Governor().sampled(Sample(power="battery"))
    assert battery.budget()["maximum_batch_mutations"] == 256 and not battery.budget()["background_paused"]
    busy = Sample(9000, 9500, 0, "ac")
    assert [x.mode for x in run([{"kind": "sample", "memory": 9000, "cpu": 9500, "disk": 0, "power": "ac"}] * 2)] == ["balanced", "pressure"]
    assert Governor().sampled(busy).sampled(busy).sampled(Sample(9000, 0, 0, "ac")).mode == "pressure"
    lost = Governor().unavailable()
    for k in range(6):
        assert lost.mode == ("pressure" if k <= 4 else "balanced")
        lost = lost.sampled(Sample(9000, 0, 0, "ac"))
    idle = Governor().pending(5).idle(400_000)
    for _ in range(5):
        idle = idle.sampled(Sample(9000, 0, 0, "ac"))
    assert idle.mode == "idle_boost" and idle.pending(0).mode == "balanced" and idle.idle(0).mode == "balanced"


SIGNALS = "machine string, sequence long, kind string, memory int, cpu int, disk int, power string, energy_saver boolean, backlog long"


def test_governor_stream_keeps_its_state(spark, tmp_path):
    rows = [("m", i, k, 9000, c, 0, "ac", False, None) for i, (k, c) in enumerate([("interactive", None), ("sample", 100), ("window", None), ("sample", 9500), ("sample", 9500), ("window", None)])]
    whole = stateful.govern_batch(spark.createDataFrame(rows, SIGNALS)).orderBy("sequence").collect()
    for k in (0, 3):
        spark.createDataFrame(rows[k : k + 3], SIGNALS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(SIGNALS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stateful.govern(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").orderBy("sequence").collect() == whole and whole[-1].mode == "pressure"


def test_replayed_requests_are_dropped(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "request_id string, s long").withColumn("ts", F.timestamp_seconds("s")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("request_id string, s long, ts timestamp").parquet(f"{tmp_path}/in")
    q = projector.admitted(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.request_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_builds_go_on_where_they_were_cut_off(spark, tmp_path):
    docs = spark.createDataFrame([(i, i * 10, f"text {i}") for i in range(25)], "document_id long, size long, text string")
    g = G.Generations(spark, f"file://{tmp_path}/c")
    small = builder.Limits(page_documents=10)
    make = lambda page: content.index(page.where("document_id != 3"))
    first = builder.ResumableBuild(g, make, small).run(docs, pages=2)
    assert not first["done"] and g.active() is None and g.building() == [1]
    # a page that was written but not noted is written over
    make(docs.limit(5)).write.parquet(f"{g.path(1)}/page=2")
    tight = builder.Limits(page_documents=10, max_documents=22)
    with pytest.raises(CapacityExceeded):
        builder.ResumableBuild(g, make, tight).run(docs)
    last = builder.ResumableBuild(g, make, small).run(docs)
    assert last["done"] and last["number"] == 1 and last["rows"] == 24 and g.active() == 1
    assert {r.document_id for r in g.read().collect()} == set(range(25)) - {3}
    again = builder.ResumableBuild(g, make, small).run(docs)
    assert again["number"] == 2 and g.active() == 2 and g.info(1)["state"] == "retired"
