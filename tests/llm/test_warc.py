import gzip
import hashlib
import os
from collections import defaultdict

from pyspark.sql import functions as F

from corpuswright.llm import common, queries, warc

SCHEMA = "page_id long, url string, html string"
BIG = "<html>" + "x" * 200 + "ü</html>"
ODD = [(5, "https://A.example.com/x?q=1#f", BIG), (3, "http://b.example.com/", BIG), (3, "http://b.example.com/", BIG), (9, None, BIG), (None, "no scheme", BIG), (7, "http://b.example.com/", "short"), (8, "http://b.example.com/", "short"), (10, "ftp://h/\r\n x", None), (11, "", ""), (12, "http://b.example.com/", "é" * 50)]


def slow(rows):
    first = defaultdict(list)
    for r in rows:
        raw = (r.html or "").encode()
        if r.page_id is not None and len(raw) >= 100:
            first[raw].append(r.page_id)
    out = []
    for r in rows:
        raw = (r.html or "").encode()
        least = min(first[raw]) if len(raw) >= 100 and first[raw] and sum((x.html or "").encode() == raw for x in rows) > 1 else None
        refers = least if least is not None and r.page_id != least and r.page_id is not None else None
        if r.page_id is None and least is not None:
            refers = least
        out.append((r.page_id, len(raw), hashlib.sha256(raw).hexdigest(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert rows_of(queries.op1_warc(spark, sf)) == slow(pages)


def test_odd_rows(spark):
    pages = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "salt", "key", "path", "at", "original")})
    got = warc.archive_and_read(pages, block_lines=2)
    assert rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == slow(pages.collect())
    assert warc.archive_and_read(pages.limit(0)).collect() == []


def test_archives_and_lookups(spark):
    """Archives are readable as plain gzip members; a lookup gives the key's captures only,
    however many blocks they fill, with their payloads."""
    pages = spark.range(300).selectExpr("id page_id", "CASE WHEN id % 3 = 0 THEN 'http://hot.example.com/' ELSE concat('http://h', id % 7, '.example.com/', id) END url", "concat(repeat('y', 120), id % 50) html")
    folder = common.scratch_path(spark, "warc")
    captures = warc.write_archives(pages, folder)
    index = warc.build_index(captures, folder, block_lines=8)
    local = folder.removeprefix("file://") + "/archives"
    raw = b"".join(gzip.open(f"{local}/{n}").read() for n in sorted(os.listdir(local)))
    assert raw.count(b"WARC/1.1\r\n") == 300 and raw.count(b"WARC-Type: response") == 50
    keys = pages.select(warc.url_key(F.col("url")).alias("key"))
    hot = keys.filter("key LIKE '%hot%'").union(spark.sql("SELECT 'no,such)/' key UNION ALL SELECT null"))
    found = warc.locate(index, hot).cache()
    assert {r.page_id for r in found.collect()} == set(range(0, 300, 3)) and found.count() == 100
    records = warc.read_records(found, folder).collect()
    want = {r.page_id: r.html for r in pages.collect()}
    assert all(r.payload is None if r.record_type == "revisit" else r.payload.decode() == want[r.page_id] for r in records)
    assert all(r.payload_digest == hashlib.sha256(want[r.page_id].encode()).hexdigest() for r in records)


def test_url_key(spark):
    rows = [("https://www.Example.org/a/B?x=1#y", "org,example,www)/a/B?x=1"), ("example.org", "org,example)"), (None, ""), ("", ")")]
    df = spark.createDataFrame(rows, "url string, want string")
    assert all(r.key == r.want for r in df.withColumn("key", warc.url_key(F.col("url"))).collect())
