import gzip
import hashlib
import random
import zlib
from pathlib import Path

import pytest

from pathloom.llm import warc


def pages():
    big, other = "é" * 600, "<p>" + "x" * 1200
    rows = [(i, f"http://www.Host{i % 3}.example.com/a{i % 5}?q={i}#f", random.Random(i).choice([big, other, "small", "", None, f"own {i} " * 300, "line\r\n\r\nWARC/1.1\r\n\r\n" * 80])) for i in range(60)]
    rows += [(60, None, big), (61, "http://a b\r\nX: y/", other), (None, "http://n/", other), (None, None, None), (7, "http://again/", big), (7, "http://again/", big)]
    return rows


def test_round_trip(spark, tmp_path):
    rows = pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = warc.round_trip(df, path=f"file://{tmp_path}/w").collect()
    largest = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000 and i is not None:
            largest[b] = max(i, largest.get(b, -1))
    want = []
    for i, url, html in rows:
        b = (html or "").encode()
        to = largest.get(b) if len(b) >= 1000 else None
        to = None if to == i else to
        want.append(("" if i is None else str(i), len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", None if to is None else str(to)))
    assert sorted((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got if r.id) == sorted(w for w in want if w[0])
    assert sorted((r.payload_bytes, r.record_type, r.refers_to or "") for r in got if not r.id) == sorted((w[1], w[3], w[4] or "") for w in want if not w[0])
    keys = [(r.url_key, r.timestamp) for r in got]
    assert keys == sorted(keys)
    assert any(r.url == "http://a%20b%0D%0AX:%20y/" for r in got)
    files = list(Path(tmp_path, "w").glob("part-*"))
    assert sum(sum(1 for _ in warc.parse(f.read_bytes())) for f in files) == len(rows)
    assert sum(gzip.open(f).read().count(b"WARC-Record-ID: ") for f in files) == len(rows)
    for r in got:  # an offset is a place in the file, from which a record can be read alone
        data = (tmp_path / "w" / r.archive).read_bytes()[r.offset :]
        z = zlib.decompressobj(31)
        headers, _ = warc.parse_record(z.decompress(data))
        assert headers["warc-record-id"] == f"<urn:page:{r.id or ''}>" and z.eof


def test_archives_are_bounded_and_large_records_alone(spark, tmp_path, monkeypatch):
    for name, value in (("ROW_BYTES", 2000), ("ROWS_PER_FILE", 3), ("LARGE", 5000), ("RANGE_ROWS", 7), ("BROADCAST_DIGESTS", 0)):
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 4}/", "é" * 700 if i % 3 == 0 else "".join(rng.choices("abcdefgh \u4e2d", k=rng.choice([10, 900, 20_000])))) for i in range(90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    got = warc.round_trip(df, path=f"file://{tmp_path}/w").collect()
    assert {(r.id, r.payload_digest) for r in got} == {(str(i), hashlib.sha1(t.encode()).hexdigest()) for i, _, t in rows}
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {"87"} and sum(r.record_type == "revisit" for r in got) == 29
    for f in Path(tmp_path, "w").glob("part-*"):
        blocks = [len(b) for _, _, b in warc.parse(f.read_bytes())]
        assert len(blocks) == 1 or sum(blocks) < 3 * (2000 + 5000)


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8])
def test_loser_tree(k):
    rng = random.Random(k)
    parts = [sorted(rng.choices(range(20), k=rng.randint(0, 12))) for _ in range(k)]
    assert list(warc.LoserTree([iter(p) for p in parts])) == sorted(x for p in parts for x in p)


def test_url_key():
    assert warc.url_key("http://www.Example.com:80/A?b=C#d") == "com,example)/a?b=c"
    assert warc.url_key("https://u@a.b:8080") == "b,a:8080)/"
    assert warc.url_key("") == ")/"


def test_cut_off_record():
    whole = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(o, b) for o, _, b in warc.parse(warc.SEPARATOR + warc.member(whole))] == [(len(warc.SEPARATOR), b"abc")]
    bad = [warc.member(whole)[:-3], warc.member(whole.replace(b"3", b"9")), warc.member(whole.replace(b"3", b"2")), warc.member(b"x"), b"WARC/1.1\r\n"]
    for data in bad:
        with pytest.raises(ValueError):
            list(warc.parse(data))


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df, path=f"file://{tmp_path}/w").count() == 0
