from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from wickline.llm.scratch import fresh_path
from wickline.llm.warc import BREAK, LoserTree, RecordStream, archive_pages, capture_index, read_archives, url_key, write_archives

SCHEMA = "page_id long, url string, html string"
LONG = "<p>" + "é" * 600 + "</p>"
ODD = [
    (1, "http://www.a.com/x", None),
    (2, "http://a.com/y", ""),
    (3, None, "x" + BREAK),
    (4, "http://b.org/\r\nWARC/1.1", BREAK * 3 + "WARC/1.1" + BREAK),
    (5, "http://b.org/", "ends\r\n"),
    (6, "http://b.org/", "\r\n\r\n\r\nodd\r"),
    (7, "not a url [", LONG),
    (8, "http://a.com/y", LONG),
    (9, "http://a.com/y", LONG),
    (9, "http://a.com/y", LONG),
    (None, "http://a.com/y", LONG),
    (10, "http://a.com/y", "short"),
    (11, "http://a.com/y", "short"),
    (12, "http://long.com", "<b>" + BREAK + "y" * 300_000),
]


@pytest.mark.parametrize("parts", [1, 4])
def test_pages_come_back(spark, parts):
    pages = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", "1 AS sha1", "'z' AS payload").repartition(parts)
    got = archive_pages(pages).collect()
    want = []
    for i, _, html in ODD:
        data = (html or "").encode()
        revisit = html == LONG and i != 9
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", 9 if revisit else None))
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=str) == sorted(want, key=str)
    order = [(r.url_key, r.captured, r.page_id or -1) for r in got]
    assert order == sorted(order)


def test_files_are_warc(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(spark.createDataFrame(ODD[:3], SCHEMA).coalesce(1), path)
    (file,) = (tmp_path / "w").glob("*.gz")
    data = gzip.decompress(file.read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    rows = {r.page_id: r for r in read_archives(spark, path).collect()}
    for i, r in rows.items():
        assert f"<urn:page:{i}>".encode() in data[r.offset : r.offset + 200].split(b"WARC-Date")[0]


def test_broken_archives_are_an_error():
    stream = RecordStream("f")
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:0\r\nWARC-Target-URI: u\r\nContent-Length: 9"
    assert list(stream.feed(f"{head}{BREAK}abc".encode())) == []
    with pytest.raises(ValueError):
        stream.close()
    with pytest.raises(ValueError):
        list(stream.feed(f"defghi{BREAK}".encode()))


def test_loser_tree():
    rng = random.Random(1)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted(rng.randrange(50) for _ in range(rng.choice([0, 1, 30]))) for _ in range(k)]
        assert list(LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)
    assert list(LoserTree([], lambda x: x)) == []


def test_ranges_are_in_global_order(spark):
    rows = [(i % 97, f"http://h{i % 5}.com/{i % 3}", "t") for i in range(900)]
    path = fresh_path(spark, "w")
    write_archives(spark.createDataFrame(rows, SCHEMA).repartition(6), path)
    index = capture_index(read_archives(spark, path), range_rows=100)
    assert index.rdd.getNumPartitions() > 4
    order = [(r.url_key, r.captured, r.page_id) for r in index.collect()]
    assert len(order) == 900 and order == sorted(order)


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_url_keys():
    assert url_key("HTTPS://www.News.Example.com:8080/A?b=1#c") == "com,example,news:8080)/a?b=1"
    assert url_key("http://x.org") == "org,x)/"


def test_large_and_negative_ids(spark):
    """The clock that stands in for dates starts again; ids come back whole."""
    rows = [(i, f"http://h.com/{k}", "t" * k) for k, i in enumerate([10**12, 2**62, -5, 10**11, None])]
    got = archive_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.payload_bytes for r in got) == [0, 1, 2, 3, 4]
    assert {r.page_id for r in got} == {r[0] for r in rows}
