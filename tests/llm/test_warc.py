"""WARC archives: round trip, revisits, order of the merged index."""

from __future__ import annotations

import gzip
import hashlib
import random

import pytest

from proxima.llm import warc as W

PAGES = "page_id bigint, url string, html string, range int"


def page_rows():
    long, tricky = "same payload " * 100, "q\r\n\r\n\r\n" + "x\r\n\r\n" * 600
    return [(1, "http://b.example.com/x?y=1#f", long, 1), (2, "https://www.b.example.com/x?y=1", long, 1),
            (7, "http://a.example.com", long, 1), (3, "u\r\nv", None, 1), (4, None, "", 1), (5, "http://[bad", tricky, 1),
            (6, "http://c.d/", tricky, 1), (8, "http://c.d/", "short", 1), (9, "http://c.d/", "short", 1),
            (10, "http://c.d/é", "ä" * 500, 1), (11, "http://c.d/é", "ä" * 500, 1), (12, "x", "ä" * 499, 1), (13, "x", "ä" * 499, 1),
            (7, "http://a.example.com", long, 1), (None, "n", long, 1), (None, "n", "end\r\n", 1), (14, "http://c.d/", "big" * 200_000, 1)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(W, "RANGE_ROWS", 4)
    rows = page_rows()
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    got = W.archive_pages(pages).collect()
    best = {}
    for i, _, h, _ in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            best[b] = max(best.get(b, i), i)
    want = []
    for i, _, h, _ in rows:
        b = (h or "").encode()
        to = best.get(b)
        to = None if to == i else to
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    assert sorted(map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    order = sorted(got, key=lambda r: (r.range, r.seq))
    keys = [(r.url_key, r.captured, r.page_id is None, r.page_id or 0) for r in order]
    assert keys == sorted(keys) and len({r.range for r in got}) > 1


def test_files_are_gzip_warc(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), PAGES).coalesce(1)
    path = W.write_archives(W.decided(pages), str(tmp_path / "w"))
    data = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "w").glob("part-*.gz")))
    at = n = 0
    while at < len(data):
        head, _, _ = data[at:].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
        at += len(head) + 4 + size
        assert data[at: at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(page_rows()) == W.read_archives(spark, path).count()
    with pytest.raises(Exception):
        W.write_archives(W.decided(pages), path)


def test_damage_is_found():
    record = (b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Date: 2024-01-01T00:00:01Z\r\n"
              b"WARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:" + hashlib.sha1(b"abc").hexdigest().encode() +
              b"\r\nX-Payload-Length: 3\r\nContent-Length: 7\r\n\r\n\r\n\r\n")
    assert len(list(W._Stream("f").feed(record + b"abc"))) == 1
    with pytest.raises(ValueError, match="digest"):
        list(W._Stream("f").feed(record + b"abd"))
    cut = W._Stream("f")
    assert list(cut.feed((record + b"abc")[:-9])) == []
    with pytest.raises(ValueError, match="cut off"):
        W._ended(cut)
    with pytest.raises(ValueError, match="no length"):
        list(W._Stream("f").feed(record[:60]))


@pytest.mark.parametrize("runs", [0, 1, 2, 3, 5, 8])
def test_loser_tree_merges(runs):
    rng = random.Random(runs)
    rows = [[(rng.choice("abc"), rng.randrange(5), rng.choice([None, 1, 2]), "", 0, "", "", None, "f", rng.randrange(99))
             for _ in range(rng.randrange(12))] for _ in range(runs)]
    merged = list(W.LoserTree([sorted(r, key=W._order) for r in rows])) if runs else []
    assert [W._order(r) for r in merged] == sorted(W._order(x) for r in rows for x in r)


def test_url_keys():
    assert W.url_key("http://www.b.Example.com:80/x?y=1#f") == "com,example,b)/x?y=1"
    assert W.url_key("https://a.org:8080") == "org,a:8080)/"


def test_no_pages(spark):
    assert W.capture_report(spark.createDataFrame([], PAGES)).collect() == []
