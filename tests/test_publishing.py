"""Publications that are cut off, large batches, pages of the journal, and the content index's consumer."""

import pytest
from pyspark.sql import functions as F

from pathloom import schemas
from pathloom.engine import ReplayWindow, SearchEngine
from pathloom.operators import catalog, content, graph
from pathloom.sources import journal
from pathloom.streaming import observe
from pathloom.streaming.projector import OutboxLog

VOLUME = ("v", "V", ["C:\\"], "ntfs", False, True, "online", None, 0)


def events(spark, names, kind="file", first=3):
    """Files f1, f2, ... in the folder docs."""
    rows = [(1, "object_observed", "v", "f0", None, None, None, None, None, "directory", 0, 1, 1, False, "online", None), (2, "link_observed", "v", "f0", "l0", None, None, "docs", False, *[None] * 7)]
    for k, (i, name) in enumerate(names):
        rows.append((first + 2 * k, "object_observed", "v", f"f{i}", None, None, None, None, None, kind, 10 + i, 1, 1, False, "online", None))
        rows.append((first + 2 * k + 1, "link_observed", "v", f"f{i}", f"l{i}", "v", "f0", name, False, None, None, None, None, None, None, None))
    return spark.createDataFrame(rows, schemas.EVENT_ROWS)


def store(spark, tmp_path):
    out = SearchEngine(spark, f"file://{tmp_path}/catalog")
    out.store.register(spark.createDataFrame([VOLUME], schemas.VOLUMES))
    return out


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_no_row_of_a_large_batch_is_lost(spark, tmp_path, adaptive):
    n = 150_000
    changes = spark.range(0, n, 1, 24).select(F.md5(F.col("id").cast("string").cast("binary")).alias("document_id"), F.lit("upsert").alias("mutation"), F.struct("id", F.repeat(F.md5(F.col("id").cast("string").cast("binary")), F.lit(60)).alias("text")).alias("document"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        path = f"file://{tmp_path}/rows"
        catalog.outbox_rows(changes, 5, 1).write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = spark.read.parquet(path)
    assert rows.agg(F.count("*"), F.count_distinct("sequence"), F.count_distinct("document_id"), F.min("sequence"), F.max("sequence")).first() == (n, n, n, 6, n + 5)
    ordered = [r.document_id for r in rows.orderBy("sequence").select("document_id").collect()]
    assert ordered == sorted(ordered)


def test_pages_of_the_journal_lose_nothing(spark):
    parts = spark.createDataFrame([(10, 0), (10, 1), (11, 0), (12, 0), (12, 1), (12, 2)], "position long, part int")
    for limit in (1, 2, 4):
        got, at = [], (0, 0)
        while True:
            page, more = journal.bounded(parts, at, limit)
            got += [tuple(r) for r in page.collect()]
            at = got[-1]
            if not more.first().has_more:
                break
        assert got == [(10, 0), (10, 1), (11, 0), (12, 0), (12, 1), (12, 2)]


@pytest.mark.parametrize("at", ["stage", "book", "move"])
def test_a_publication_that_is_cut_off(spark, tmp_path, monkeypatch, at):
    engine = store(spark, tmp_path)
    engine.store.apply("v", events(spark, [(1, "a.txt")]))
    engine.projector.run()

    def fail(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if at == "stage":
            whole = OutboxLog.stage
            m.setattr(OutboxLog, "stage", lambda *a: (whole(*a), fail()))
        elif at == "book":
            m.setattr(observe, "write_slots", fail)
        else:
            whole, calls = OutboxLog.settle, []
            m.setattr(OutboxLog, "settle", lambda *a: calls.append(1) or (fail() if len(calls) > 1 else whole(*a)))
        with pytest.raises(KeyboardInterrupt):
            engine.store.apply("v", events(spark, [(2, "b.txt"), (3, "c.txt")]))
    assert engine.store.flags().first().publication_pending
    seen = engine.projector.run()  # a consumer sees nothing of the batch yet
    assert seen == 2
    again = SearchEngine(spark, f"file://{tmp_path}/catalog")
    again.store.apply("v", events(spark, [(2, "b.txt"), (3, "c.txt")]))
    again.store.apply("v", events(spark, [(4, "d.txt")]))
    log = again.store.log.read()
    assert catalog.gaps(log.select("sequence")).isEmpty() and log.count() == log.select("sequence").distinct().count()
    assert again.projector.run() == again.store.log.high_water() == log.count()
    assert again.health().first() == (True, True) and again.documents().count() == 5
    assert not again.store.flags().first().publication_pending


def test_a_gap_is_healed_by_a_rebuild(spark, tmp_path):
    engine = store(spark, tmp_path)
    engine.store.apply("v", events(spark, [(1, "a.txt")]))
    engine.projector.run()
    number = engine.projector.recover(engine.store.documents())
    engine.store.apply("v", events(spark, [(2, "b.txt")]))
    engine.store.apply("v", events(spark, [(3, "c.txt")]))
    names = engine.store.log.folder
    names.delete("log/" + sorted(observe.Folder(spark, f"{engine.store.log.root}/log").names())[-2])
    assert engine.projector.recover(engine.store.documents()) > number
    assert engine.health().first() == (True, True)
    engine.store.apply("v", events(spark, [(4, "d.txt")]))
    engine.projector.run()
    assert engine.documents().count() == 5


def test_content_follows_the_outbox(spark, tmp_path):
    engine = store(spark, tmp_path)
    root = "docs"
    texts = {f"{root}/a.txt": "alpha beta", f"{root}/b.txt": "beta gamma", f"{root}/c.png": "alpha"}
    read = []

    def read_texts(documents):
        rows = [(r.resolved_path, texts.get(r.resolved_path), None) for r in documents.collect()]
        read.append(sorted(r[0] for r in rows))
        return spark.createDataFrame(rows, "path string, text string, skip_reason string")

    policy = content.Policy((root,), 1 << 20)
    engine.store.apply("v", events(spark, [(1, "a.txt"), (2, "b.txt"), (3, "c.png")]))
    assert engine.project_content(read_texts, policy) == 4
    assert engine.contents.read().count() == 2
    assert {r.name for r in engine.content_search("beta").collect()} == {"a.txt", "b.txt"}
    assert len(read[-1]) == 2  # the image isn't read
    engine.store.apply("v", spark.createDataFrame([(1, "link_removed", "v", "f1", "l1", *[None] * 11)], schemas.EVENT_ROWS))
    assert engine.project_content(read_texts, policy) == engine.store.log.high_water()
    assert {r.name for r in engine.content_search("beta").collect()} == {"b.txt"}
    engine.projector.run()
    assert engine.item("l2", authoritative=True).first().name == "b.txt"


def test_revocation_numbers_each_volume(spark):
    rows = [(f"l{i}", f"v{i % 3}", f"f{i // 2}", None, None, "n", False, 1) for i in range(30)]
    links = spark.createDataFrame(rows, schemas.LINKS)
    got = graph.removal_events(links, 7).collect()
    for v in ("v0", "v1", "v2"):
        mine = sorted((r for r in got if r.volume_id == v), key=lambda r: r.sequence)
        assert [r.sequence for r in mine] == list(range(7, 7 + len(mine)))
        kinds = [r.event for r in mine]
        assert kinds == sorted(kinds) and kinds.count("link_removed") == 10


def test_replay_window_forgets_the_oldest():
    w = ReplayWindow(3)
    assert [w.take(x) for x in ("a", "b", "a", "c", "d", "a", "d")] == [True, True, False, True, True, True, False]


def test_watch_takes_turns_until_nothing_is_left(spark):
    class Two(observe.Controller):
        def __init__(self):
            super().__init__(None, None, ["a", "b"])
            self.left = {"a": 2, "b": 0}

        def step(self):
            v = self.volumes[self.turn % 2]
            self.turn += 1
            self.left[v] -= 1
            return observe.Step(v, "changes", max(0, self.left[v]), self.left[v] <= 0)

    c = Two()
    assert len(c.watch(iterations=6, pause_seconds=0)) == 2 and c.turn == 6
    c.watch(stop=lambda: c.turn >= 9, pause_seconds=0)
    assert c.turn == 9
