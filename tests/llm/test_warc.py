import base64
import gzip
import hashlib

from pyspark.sql import functions as F

from twinframe.llm import warc
from twinframe.session import materialise, work_root

SCHEMA = "page_id long, url string, html string, offset string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        f = first.get(h or "")
        refers = None if f is None or f == i else f
        out.append((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a.example.com/x", "<p>é</p>"), (3, "http://a.example.com/x", "<p>é</p>"), (9, None, None), (2, "not a url", ""),
    (7, "https://b.example.org:8080/q?x=1#y", "\r\n\r\nWARC/1.1\r\n"), (8, "http://[bad", "z" * 50_000), (3, "http://a.example.com/x", "<p>é</p>"),
    (11, "http://a.example.com/ü \n\t", "unique"), (None, "http://a.example.com/", "<p>é</p>"),
]


def test_round_trip(spark):
    got = warc.archived(pages(spark, ROWS)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected(ROWS)
    assert warc.archived(pages(spark, ROWS).limit(0)).collect() == []


def test_index_over_many_blocks(spark, tmp_path):
    rows = [(k, f"http://h{k % 7}.example.com/{'same' if k % 3 else k}", f"t{k % 50}") for k in range(300)]
    folder = str(tmp_path)
    captures = materialise(warc.write_archives(pages(spark, rows), folder), "captures")
    directory = materialise(warc.build_index(captures, folder, block=8), "directory")
    assert directory.count() > 30
    asked = captures.select("url_key", "page_id").union(spark.createDataFrame([("com,example,none)/", 1), ("", 5), ("zzz", 9)], "url_key string, page_id long"))
    found = warc.locate(asked, directory, folder)
    assert found.exceptAll(captures).isEmpty() and captures.exceptAll(found).isEmpty()
    assert warc.read_records(found, folder).count() == 300


def test_records_are_gzip_members_of_their_own(spark, tmp_path):
    captures = materialise(warc.write_archives(pages(spark, ROWS[:3]), str(tmp_path)), "captures")
    for r in captures.collect():
        with open(tmp_path / r.file, "rb") as f:
            f.seek(r.offset)
            record = gzip.decompress(f.read(r.length))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")


def test_short_payloads_can_stay_responses(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "long enough"), (4, "u", "long enough")]
    got = {r.page_id: r.record_type for r in warc.archived(pages(spark, rows), min_bytes=5).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_keys():
    assert warc.url_key("http://www.Example.com/a?b=1") == "com,example,www)/a?b=1"
    assert warc.url_key(None) == "" and warc.url_key("mailto:x") == "mailto:x" and "\t" not in warc.url_key("http://a.b/\tc")
    assert work_root and F
