import base64
import hashlib

from pyspark.sql import functions as F

from attestor.llm import warc

ROWS = [
    (1, "http://a.example/x", "<p>one</p>"), (2, "http://a.example/y", "<p>one</p>"), (3, "http://b.example/", None), (4, None, ""), (5, "http://b.example/é", "<p>zwölf 🙂</p>\r\n\r\nx"),
    (6, "http://c.example/", "z" * 50_000), (7, "http://c.example/2", "<p>one</p>"), (7, "http://c.example/2", "<p>one</p>"), (8, "http://d.example/\r\nX: y", "plain"), (None, "http://e.example/", "plain"),
]
SCHEMA = "page_id long, url string, html string"


def brute(rows, least):
    groups = {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append(i)
    out = []
    for payload, at in groups.items():
        raw = payload.encode()
        best = max(at, key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
        for i in at:
            again = len(raw) >= least and i != best
            out.append((rows[i][0], len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", rows[best][0] if again else None))
    return sorted(out, key=str)


def read(index, **more):
    return sorted((tuple(r) for r in warc.read_records(index, **more).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)


def test_round_trip_and_revisits(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).withColumn("file", F.lit("clash")).withColumn("_row", F.lit("clash"))
    for least in (0, 6, 10**6):
        assert read(warc.write_archives(pages, warc.Archive(least_bytes=least))) == brute(ROWS, least)


def test_small_ranges_give_the_same(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA).repartition(2))
    assert read(index, archive=warc.Archive(gap=0, range_bytes=1)) == brute(ROWS, 0)
    assert warc.ranges(index, warc.Archive()).count() < warc.ranges(index, warc.Archive(range_bytes=1)).count()


def test_selected_records_only(spark):
    index = warc.write_archives(spark.createDataFrame(ROWS, SCHEMA))
    got = {(r.page_id, bytes(r.payload)) for r in warc.read_records(warc.by_url(index, "http://c.example/").where("record_type = 'response'"), payloads=True).collect()}
    assert got == {(6, b"z" * 50_000), (7, b"<p>one</p>")}


def test_sample(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert read(warc.write_archives(pages)) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()], 0)


def test_no_pages(spark):
    assert read(warc.write_archives(spark.createDataFrame([], SCHEMA))) == []
