"""WARC archives with an index made as they are written, and reads by coalesced byte ranges.

The index has a row per record: file, offset, length, url, payload digest and type.  A reader picks index rows, sorts
them by file and offset, joins neighbours whose gap is small into one byte range of bounded size, and reads each range
once.  Each record is a gzip member, so any range of whole records can be read alone.

Of records with equal payloads of ``least_bytes`` or more, the one with the largest page_id is a response and the
others are revisits that refer to it; smaller ones are all responses.

Defined results: a null html is an empty payload, a null url is written as an empty target; null page ids lose against
any other; of repeated rows one is the response; an empty table writes no file and gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attestor.llm.files import opened, whole_file
from attestor.llm.frames import fresh_path, keep

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string, record_type string, refers_to long"


@dataclass(frozen=True)
class Archive:
    least_bytes: int = 0
    #: Gaps that a range may span, its size, and the bytes that one task reads.
    gap: int = 64 << 10
    range_bytes: int = 8 << 20
    task_bytes: int = 16 << 20
    date: str = "2024-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, url: str, payload: bytes, archive: Archive, refers_to: int | None, page_id: int | None, seed: str) -> bytes:
    """One gzip member with one record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    heads = [
        ("WARC-Type", kind), ("WARC-Target-URI", "".join(url.split("\r")).replace("\n", "")), ("WARC-Date", archive.date),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, seed)}>"), ("WARC-Payload-Digest", "sha1:" + digest_of(payload)),
        ("X-Page-ID", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        heads[4:4] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", compresslevel=3, mtime=0)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member; a response's payload is checked against its digest."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    heads = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(heads["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if heads["WARC-Type"] == "response" and "sha1:" + digest_of(payload) != heads["WARC-Payload-Digest"]:
        raise ValueError("a payload differs from its digest")
    return heads, payload


def _kinds(pages: DataFrame, archive: Archive) -> DataFrame:
    """pages (page_id, url, html) with record_type and refers_to.

    Digests are grouped, so a payload that many pages share is one row before it is joined back; ties on the largest
    page_id go to one row by its number within equal (digest, page_id).
    """
    slim = pages.withColumn("_digest", F.sha1(F.col("html").cast("binary")))
    enough = F.octet_length("html") >= archive.least_bytes
    best = slim.where(enough).groupBy("_digest").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("order"), F.col("page_id").alias("page_id"), F.col("_row").alias("row"))).alias("best"), F.count("*").alias("n")).where("n > 1").select("_digest", "best")
    joined = slim.join(best, "_digest", "left")
    again = F.col("best").isNotNull() & enough & (F.col("best.row") != F.col("_row"))
    return joined.select("page_id", "url", "html", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("best.page_id")).alias("refers_to"), "_row")


def write_archives(pages: DataFrame, archive: Archive = Archive(), folder: str | None = None) -> DataFrame:
    """Writes one archive per task and returns the index."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    rows = pages.select(F.col("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    # a number for each row that stays the same however often its task runs: rows are equal where it is equal
    own = Window.partitionBy("page_id", F.xxhash64("url", "html")).orderBy("page_id")
    twice = rows.groupBy("page_id").count().where("count > 1").limit(1).count() > 0
    numbered = rows.withColumn("_row", F.concat_ws("|", F.col("page_id").cast("string"), F.sha2(F.concat_ws("\n", "url", "html"), 256), F.row_number().over(own) if twice else F.lit(1)))
    kinds = _kinds(numbered, archive)

    def run(batches):
        from attestor.llm.text import chunks

        name, found, at = f"{folder}/{uuid.uuid4().hex}.warc.gz", [], 0
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with whole_file(name) as out:
            for batch in _after(first, batches):
                for part in chunks(batch, "html"):
                    for page, url, html, kind, refers, row in zip(*(part.column(i).to_pylist() for i in range(6))):
                        payload = html.encode()
                        data = record(kind, url, payload, archive, refers, page, row)
                        out.write(data)
                        found.append((page, name, at, len(data), url, digest_of(payload), kind, refers))
                        at += len(data)
        for i in range(0, len(found), 10_000):
            cols = list(zip(*found[i : i + 10_000]))
            kinds_ = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_)], names=[x.split()[0] for x in INDEX.split(", ")])

    return keep(kinds.mapInArrow(run, INDEX), "warc-index")


def _after(first, rest):
    yield first
    yield from rest


def ranges(index: DataFrame, archive: Archive = Archive()) -> DataFrame:
    """(file, start, stop, parts): byte ranges that hold the selected records, with each record's offset and length.

    Records in order of offset join the range before them unless the gap is large or they begin another step of
    range_bytes; parts of a file are ranked apart, so a large file is not one task.
    """
    step = F.floor(F.col("offset") / archive.range_bytes)
    w = Window.partitionBy("file", "step").orderBy("offset")
    marked = index.select("file", "offset", "length", step.alias("step")).withColumn("before", F.lag(F.col("offset") + F.col("length")).over(w))
    cut = (F.col("before").isNull() | (F.col("offset") - F.col("before") > archive.gap)).cast("int")
    runs = marked.withColumn("run", F.sum(cut).over(w))
    return runs.groupBy("file", "step", "run").agg(
        F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.array_sort(F.collect_list(F.struct("offset", "length"))).alias("parts")
    ).drop("step", "run")


def read_records(index: DataFrame, archive: Archive = Archive(), payloads: bool = False) -> DataFrame:
    """The selected records: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload)."""
    # index rows are small beside what they stand for: the number of tasks follows the bytes to be read
    wanted = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    picked = ranges(index, archive).repartition(max(1, -(-wanted // archive.task_bytes)), "file", "start")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 + payloads]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for file, start, stop, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                system, path = opened(file)
                with system.open_input_file(path) as source:
                    data = source.read_at(stop - start, start)
                out = []
                for part in parts:
                    at = part["offset"] - start
                    heads, payload = parse(data[at : at + part["length"]])
                    refers, page = heads.get("X-Refers-To-Page-ID"), heads["X-Page-ID"]
                    row = (int(page) if page else None, heads["WARC-Target-URI"], int(heads["X-Payload-Length"]), heads["WARC-Payload-Digest"].removeprefix("sha1:"), heads["WARC-Type"], int(refers) if refers else None)
                    out.append((*row, payload) if payloads else row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return picked.mapInArrow(run, schema)


def by_url(index: DataFrame, prefix: str) -> DataFrame:
    """Index rows of urls that begin with prefix."""
    return index.where(F.startswith("url", F.lit(prefix)))


