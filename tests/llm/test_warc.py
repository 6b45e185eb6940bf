import gzip
import hashlib

import duckdb
from mnemosaic.llm import warc
from mnemosaic.llm.common import Scratch, table

SCHEMA = "page_id long, url string, html string, key string, row string"


def plain(rows):
    first = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= 100:
            first.setdefault(html, []).append((page is None, page or 0))
    out, used = [], set()
    for page, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw, rest = (html or "").encode(), (None, None)
        kind, refers = "response", None
        if len(raw) >= 100:
            if html in used:
                kind, none = "revisit", min(first[html])
                refers = None if none[0] else none[1]
            used.add(html)
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), kind, refers))
    return sorted(out, key=repr)


def test_roundtrip_matches_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    found = con.execute(warc.ORACLE)
    names = [d[0] for d in found.description]
    got = warc.roundtrip(table(spark, sf, "pages"), Scratch(spark, "t"))
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())


def odd_rows():
    big = "é" * 60 + "\r\n\r\nWARC/1.1\r\n"
    urls = ["http://a.example.com/x", "https://A.Example.com:443/x#top", "http://b.example.com", None, "", "no url", "http://[::1", "http://a.example.com/" + "long" * 900, "http://c.example.com/\r\nWARC-Type: revisit", "http://é.example.com/ü?ß=1"]
    rows = [(k, urls[k % len(urls)], big if k % 3 else f"page {k}") for k in range(60)]
    return [*rows, (61, "http://a.example.com/x", None), (62, None, ""), (None, None, big), (5, urls[5], big), (5, urls[5], big), (None, "http://n.example.com", "n" * 200), (None, "http://n.example.com", "n" * 200), (70, "http://e.example.com", "edge" * 25), (71, "http://e.example.com", "edge" * 25), (72, "http://e.example.com", "s" * 99), (73, "http://e.example.com", "s" * 99)]


def test_nulls_repeats_and_odd_urls(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 4)
    rows = odd_rows()
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    scratch = Scratch(spark, "t")
    archive = warc.Archive(spark, f"{scratch.root}/warc")
    captures = archive.write(frame, scratch, shard=8)
    assert len(warc.read_shards(f"{archive.root}/index")) > 3
    records = archive.read(archive.lookup(frame)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in records), key=repr) == plain(rows)
    assert {r.payload for r in records if r.record_type == "response"} == {r[2] or "" for r in rows}
    assert captures.count() == len(rows)


def test_lookup_finds_the_captures_of_a_url_and_no_others(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK", 3)
    rows = [(k, f"http://h{k % 7}.example.com/{k % 11}", f"p{k}") for k in range(300)] + [(1000 + k, "http://hot.example.com/", f"q{k}") for k in range(150)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    scratch = Scratch(spark, "t")
    archive = warc.Archive(spark, f"{scratch.root}/warc")
    archive.write(frame, scratch, shard=20)
    asked = spark.createDataFrame([("http://HOT.example.com:80/#x",), ("https://h3.example.com/4",), ("http://absent.example.com/",), ("",)], "url string")
    got = archive.lookup(asked).collect()
    want = [p for p, u, _ in rows if u in ("http://hot.example.com/", "http://h3.example.com/4")]
    assert sorted(r.page_id for r in got) == sorted(want)


def test_archives_are_plain_gzip_members(spark, tmp_path):
    scratch = Scratch(spark, "t")
    archive = warc.Archive(spark, f"file://{tmp_path}/w")
    archive.write(spark.createDataFrame([(1, "http://a.example.com/", "<p>a</p>", "", "")], SCHEMA), scratch)
    files = list((tmp_path / "w/archives").iterdir())
    raw = gzip.decompress(files[0].read_bytes())
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"<p>a</p>\r\n\r\n") and len(files) == 1


def test_empty_table(spark):
    scratch = Scratch(spark, "t")
    empty = spark.createDataFrame([], SCHEMA)
    assert warc.roundtrip(empty, scratch).count() == 0


def test_keys():
    assert warc.url_key("https://www.A.example.com/x?y=1#z") == "com,example,a,www)/x?y=1"
    assert warc.url_key("http://a.example.com:8080") == "com,example,a:8080)/"
    assert warc.url_key(None) == "" and len(warc.url_key("http://a.example.com/" + "x" * 9999)) < 1100
