from __future__ import annotations

import base64
import gzip
import hashlib
from collections import defaultdict

from gasflow.llm import warc
from gasflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def through(spark, rows, path, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int").drop("record_type") if rows else spark.createDataFrame(
        [], "page_id long, url string, html string"
    )
    warc.write_archives(pages, path, **options)
    return warc.resolved(warc.read_archives(spark, path)).collect()


def test_odd_payloads_come_back(spark, tmp_path):
    odd = ["a\r\n\r\nWARC/1.1\r\n\r\nb", "", None, "é" * 5000, "same", "same", "same", "x\r\n\r\n", "\r\n"]
    rows = [(i, f"http://h/{i}", h, 1) for i, h in enumerate(odd)] + [(None, None, "same", 1), (5, None, "null url", 1)]
    got = through(spark, rows, str(tmp_path / "w"), per_file=3)
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    by_page = defaultdict(list)
    for r in got:
        by_page[r.page_id].append(r)
    for i, h in enumerate(odd):
        r = next(r for r in by_page[i] if r.payload_digest == digest(h))
        assert r.payload_bytes == len((h or "").encode())
        want = ("revisit", 6) if i in (4, 5) else ("revisit", 2) if i == 1 else ("response", None)
        assert (r.record_type, r.refers_to) == want
    assert (by_page[None][0].record_type, by_page[None][0].refers_to) == ("revisit", 6)
    assert all(f.read_bytes()[:2] == b"\x1f\x8b" and gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in (tmp_path / "w").glob("*.gz") if f.stat().st_size > 30)


def test_repeated_rows_and_smallest(spark, tmp_path):
    rows = [(1, "u", "hello", 1)] * 3 + [(1, "v", "hello", 1), (None, "n", "only null", 1), (None, "n", "only null", 1)]
    got = through(spark, rows, str(tmp_path / "a"))
    assert len(got) == 6
    hello = [r for r in got if r.payload_digest == digest("hello")]
    assert sorted(r.record_type for r in hello) == ["response", "revisit", "revisit", "revisit"]
    assert next(r for r in hello if r.record_type == "response").url == "v"
    assert sorted(r.record_type for r in got if r.page_id is None) == ["response", "revisit"]
    got = through(spark, rows, str(tmp_path / "b"), smallest=6)
    assert [r.record_type for r in got if r.payload_digest == digest("hello")] == ["response"] * 4
    assert through(spark, [], str(tmp_path / "c")) == []


def test_query_against_plain_version(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    latest = {}
    for p in pages:
        latest[digest(p.html)] = max(latest.get(digest(p.html), p.page_id), p.page_id)
    got = {r.page_id: r for r in QUERIES["op2_warc"](spark, FOLDER).collect()}
    assert len(got) == len(pages)
    for p in pages:
        r, d = got[p.page_id], digest(p.html)
        revisit = latest[d] != p.page_id
        assert (r.payload_bytes, r.payload_digest) == (len((p.html or "").encode()), d)
        assert (r.record_type, r.refers_to) == (("revisit", latest[d]) if revisit else ("response", None))
