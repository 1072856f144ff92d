import base64
import glob
import hashlib
import random
import tempfile

import zstandard
from pyspark.sql import functions as F

from strataloom.llm import queries, warc


def expected(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload]
        last = max((p for p in same if p is not None), default=None)
        again = last is not None and page != last
        out.append((page, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if again else "response", last if again else None))
    return sorted(out, key=str)


def test_round_trip_with_nulls_ties_and_copies(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>one</p>"), (6, "u", "é" * 70_000), (7, "u", "z\r\n\r\nWARC/1.1"), (7, "u", "z\r\n\r\nWARC/1.1"), (None, "n", "only")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(df, path, frame_bytes=200, bundle_bytes=400)
    got = warc.read_records(spark, path)
    assert sorted([tuple(r) for r in got.select("source_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str) == expected(rows)
    assert {(r.source_id, bytes(r.block).decode()) for r in got.where("record_type = 'response'").collect()} == {(4, ""), (2, "<p>one</p>"), (6, "é" * 70_000), (7, "z\r\n\r\nWARC/1.1"), (None, "only")}
    index = warc.read_index(spark, path).collect()
    assert len(index) == len(rows) == len({r.record_id for r in index})
    one = random.Random(1).choice(index)
    found = warc.read_records(spark, path, [one.record_id]).collect()
    assert {(r.frame, r.offset) for r in found} <= {(r.frame, r.offset) for r in index if r.record_id == one.record_id}
    # any decoder reads a bundle whole, as a row of WARC records
    for name in glob.glob(path + "/part-*"):
        data = open(name, "rb").read()
        whole = b"".join(zstandard.ZstdDecompressor().decompressobj().decompress(data[a : a + n]) for a, n, _ in warc.seek_table(data)[:-1])
        at = 0
        while at < len(whole):
            headers, block, at = warc.parse(whole, at)
            if headers["warc-type"] == "response":
                assert block.startswith(b"HTTP/1.1 200 OK") and headers["content-type"] == "application/http; msgtype=response"
            else:
                assert "warc-refers-to-date" in headers
        assert at == len(whole)


def test_empty_table(spark):
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_records(spark, path).count() == 0


def test_query(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    assert sorted([tuple(r) for r in queries.op5_warc(spark, "/root/testdata/sf0.001").collect()], key=str) == expected(rows)


def test_revisits_tell_the_date_of_what_they_refer_to_and_long_payloads_are_whole(spark):
    long = "x" * 3_000_000
    rows = [(1, "a", "same", "2020-01-01", 9), (2, "b", "same", "2021-02-03", 9), (3, "c", long, None, 9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, day string, _first long").withColumn("day", F.to_timestamp("day"))
    path = tempfile.mkdtemp() + "/w"
    warc.write_archives(df, path, date_col="day")
    dates = {}
    for name in glob.glob(path + "/part-*"):
        data = open(name, "rb").read()
        for _, k, offset, _ in warc.record_index(data):
            headers, _, _ = warc.parse(warc.frame(data, k), offset)
            dates[headers["x-source-id"]] = headers["warc-date"], headers.get("warc-refers-to-date")
    assert dates == {"1": ("2020-01-01T00:00:00Z", "2021-02-03T00:00:00Z"), "2": ("2021-02-03T00:00:00Z", None), "3": ("2024-01-01T00:00:00Z", None)}
    assert {r.source_id: len(r.block) for r in warc.read_records(spark, path).where("block IS NOT NULL").collect()} == {2: 4, 3: len(long)}
