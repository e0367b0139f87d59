"""WARC: revisits, exact payload round trip, resolution, hot payloads."""

import base64
import hashlib

from epilake.llm import tables
from epilake.llm import warc as W

SCHEMA = "page_id long, url string, html string, payload string, value int"


def _rows():
    rows = [(i, f"http://h{i % 3}.example/{i}", f"<p>page {i}</p>", "", 0) for i in range(40)]
    rows += [(100 + i, "http://hot.example/a b\n", "<p>the same page\r\n\r\nWARC/1.1\r\nWARC-Type: x</p>", "", 0) for i in range(60)]
    rows += [(200, None, None, None, None), (201, "u", "", "", 0), (202, "u", "", "", 0), (300, "ü", "é\r\n\r\n" * 5, "", 0),
             (301, "u", "é\r\n\r\n" * 5, "", 0), (301, "u", "é\r\n\r\n" * 5, "", 0), (400, "long", "x" * 500_000, "", 0), (None, "n", "null id", "", 0)]
    return rows


def test_round_trip(spark, monkeypatch):
    rows = _rows()
    for limit in (tables.BROADCAST_BYTES, 0):  # by broadcast, and by the hot-key split
        monkeypatch.setattr(tables.lookup, "__defaults__", (*tables.lookup.__defaults__[:-1], limit))
        path = tables.fresh_path(spark, "w")
        W.write_archives(spark.createDataFrame(rows, SCHEMA), path, file_records=25)
        records = W.read_archives(spark, path)
        got = records.collect()
        last = {}
        for i, _, h, *_ in rows:
            last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
        want = sorted((-1 if i is None else i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(),
                       "response" if i is None or last[h or ""] == i else "revisit") for i, _, h, *_ in rows)
        assert sorted((-1 if r.page_id is None else r.page_id, r.payload_bytes, r.payload_digest, r.record_type) for r in got) == want
        html = {i: (h or "").encode() for i, _, h, *_ in rows}
        for r in got:
            if r.record_type == "response":
                assert bytes(r.payload) == html[r.page_id] and r.refers_to is None
            else:
                assert r.payload is None and r.refers_to == last[html[r.page_id].decode()]
        full = {r.page_id: bytes(r.payload) for r in W.resolve(records).collect()}
        assert full == html


def test_min_bytes_and_empty(spark):
    path = tables.fresh_path(spark, "w")
    W.write_archives(spark.createDataFrame(_rows(), SCHEMA), path, min_bytes=10**6)
    assert W.read_archives(spark, path).where("record_type = 'revisit'").count() == 0
    path = tables.fresh_path(spark, "w")
    W.write_archives(spark.createDataFrame([], SCHEMA), path)
    assert W.read_archives(spark, path).count() == 0
