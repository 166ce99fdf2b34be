import gzip
import hashlib

import pytest

from cohortlab.llm import warc
from cohortlab.llm._common import fresh_path
from cohortlab.llm.queries import ORACLE, QUERIES

from ..oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


def pages(spark):
    big, rows = "x" * 200, []
    rows += [(3, "http://B.example.com:80/p?q=1#f", big), (1, "https://user@b.example.com/", big), (2, None, big), (4, "http://a.example.com/é", "short"), (5, "http://a.example.com", "short")]
    rows += [(6, "", None), (1, "https://user@b.example.com/", big), (None, "http://z.example/", big), (7, "http://é.example/\r\nX: y", "é" * 99)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def test_records_and_revisits(spark):
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_pages(pages(spark)).collect()), key=repr)
    want = [(1, 200, "response", None), (1, 200, "response", None), (2, 200, "revisit", 1), (3, 200, "revisit", 1), (4, 5, "response", None), (5, 5, "response", None), (6, 0, "response", None), (7, 198, "response", None), (None, 200, "revisit", 1)]
    assert got == sorted(want, key=repr)
    assert warc.archive_pages(pages(spark).where("false")).count() == 0


def test_keys(spark):
    got = {r.page_id: r.url_key for r in warc.archive_pages(pages(spark)).collect()}
    assert got[3] == "com,example,b)/p?q=1" and got[1] == "com,example,b)/" and got[5] == "com,example,a)" and got[2] == ""


def test_look_up_reads_one_block(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    root = fresh_path(spark, "warc-test")
    rows = [(i, f"http://h{i % 7}.example.com/{i}", f"page {i} " * 30) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    directory = warc.write_archives(df, root, archives=3)
    assert directory.count() >= 60 / 512
    keys = spark.createDataFrame([("com,example,h3)/3",), ("com,example,h0)/0",), ("com,nothing)/",), (None,)], "key string")
    got = {r.key: (r.page_id, bytes(r.payload).decode()) for r in warc.look_up(directory, root, keys).collect()}
    assert got == {"com,example,h3)/3": (3, "page 3 " * 30), "com,example,h0)/0": (0, "page 0 " * 30)}


def test_query_goes_by_the_directory(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    rows = [(i if i % 9 else None, None if i % 3 == 0 else f"http://h{i % 7}.example.com/{i % 20}", f"page {i} " * 30) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = fresh_path(spark, "warc-test")
    directory = warc.write_archives(df, root, archives=3)
    got = [r.payload_digest for r in warc.resolve(directory, root, df).collect()]
    assert sorted(got) == sorted(hashlib.sha256(h.encode()).hexdigest() for _, _, h in rows)
    stray = spark.createDataFrame([(500, "http://h1.example.com/1")], "page_id long, url string")
    with pytest.raises(Exception, match="not in the index"):
        warc.resolve(directory, root, stray).collect()


def test_damage_is_found():
    member = warc._record("response", 1, "http://a/", hashlib.sha256(b"abc").hexdigest(), b"abc", 3, None)
    assert gzip.decompress(member).startswith(b"WARC/1.1\r\n") and warc.parse_record(member)["payload"] == b"abc"
    with pytest.raises(Exception):
        warc.parse_record(member[:-9] + b"\0" * 9)


def test_equals_sql(spark):
    assert_same(QUERIES["op10_warc"](spark, SF), connect(SF), ORACLE["op10_warc"])
