"""WARC archives: written by Spark's text writer, indexed first, read by coalesced byte ranges."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

#: A record ends with two line ends, which the text writer puts after each row.
END = "\r\n\r\n"
SMALLEST = 100
#: Revisits of up to this many bytes are broadcast to the pages; more are joined by a shuffle.
BROADCAST_BYTES = 1 << 25
#: Ranges with a gap of so many bytes at most are read at once, up to so many bytes.
GAP, READ = 1 << 16, 1 << 22
#: Bytes of a file that are read by one task.
STRETCH, MOST_TASKS = 8 * READ, 100_000
URN = "urn:x-page:"
INDEX = "path string, offset long, length long, page string, url string, digest string, kind string"


def revisits(pages: DataFrame, smallest: int = SMALLEST) -> DataFrame:
    """``(page_id, digest, refers_to)``: pages whose payload, if not under ``smallest`` bytes, a smaller page_id has."""
    x = pages.select("page_id", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("n")).where(F.col("n") >= smallest)
    first = x.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return x.drop("n").join(first, "digest").where("page_id is null or page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def records(pages: DataFrame) -> Column:
    """The text of a record, but for the two line ends after it."""
    html = F.coalesce("html", F.lit(""))
    size = F.octet_length(html)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, html)).otherwise(http)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"),
        F.lit(f"\r\nWARC-Record-ID: <{URN}"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.sha2(html, 256),
        F.coalesce(F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n" + f"WARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"), F.lit(">")), F.lit("")),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, block)


def write(pages: DataFrame, folder: str) -> None:
    """A record per row, in files of the pages' own partitions; no page is shuffled but where revisits are many."""
    again = written(revisits(pages), "warc-revisits")
    wide = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    n = again.agg(F.coalesce(F.sum(wide("page_id") + wide("digest") + wide("refers_to") + 48), F.lit(0))).first()[0]
    x = pages.select("page_id", "url", "html")
    if n == 0:
        x = x.withColumn("refers_to", F.lit(None).cast(dict(pages.dtypes)["page_id"]))
    else:
        x = x.withColumn("digest", F.sha2(F.coalesce("html", F.lit("")), 256))
        small = F.broadcast(again) if n <= BROADCAST_BYTES else again
        small = small.withColumnRenamed("page_id", "_page").withColumnRenamed("digest", "_digest")
        x = x.join(small, (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page")), "left")
    x.select(records(x).alias("value")).write.option("lineSep", END).text(folder)


def opened(path: str):
    """An input file in any store that Arrow opens."""
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return where.open_input_file(name)


def head_of(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "surrogatepass").split("\r\n")
    return {"": lines[0]} | {k: v for k, _, v in (line.partition(": ") for line in lines[1:])}


def _indexed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for path, size in zip(frame["path"], frame["length"], strict=True):
            rows, at = [], 0
            with opened(path) as f:
                held, start = b"", 0
                while at < size:
                    f_at = at - start
                    end = held.find(b"\r\n\r\n", f_at) if 0 <= f_at < len(held) else -1
                    if end < 0:
                        more = READ
                        while True:
                            held, start = f.read_at(min(more, size - at), at), at
                            end = held.find(b"\r\n\r\n")
                            if end >= 0 or at + more >= size:
                                break
                            more *= 2
                        f_at = 0
                    head = head_of(held[f_at:end])
                    length = end - f_at + 4 + int(head["Content-Length"])
                    rows.append((path, at, length, head["WARC-Record-ID"][1:-1].removeprefix(URN), head.get("WARC-Target-URI"), head["WARC-Payload-Digest"].removeprefix("sha256:"), head["WARC-Type"]))
                    at += length + len(END)
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=["path", "offset", "length", "page", "url", "digest", "kind"])
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=["path", "offset", "length", "page", "url", "digest", "kind"])


def tasks(rows: DataFrame) -> int:
    """One for each file and each stretch of it; the rows are small, so Spark could not tell from them."""
    files, size = rows.agg(F.count_distinct("path"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return max(1, min(files + size // STRETCH, MOST_TASKS))


def index(spark: SparkSession, folder: str) -> DataFrame:
    """Offset, length, URL and digest of each record: one walk along the heads of each file, written as a table."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "length").where("length > 0")
    return written(files.repartition(tasks(files), "path").mapInPandas(_indexed, INDEX), "warc-index")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by file and offset."""
    for frame in frames:
        rows, out, k = list(frame.itertuples(index=False)), [], 0
        while k < len(rows):
            path, low, end, j = rows[k].path, rows[k].offset, rows[k].offset + rows[k].length, k + 1
            while j < len(rows) and rows[j].path == path and rows[j].offset <= end + GAP and rows[j].offset + rows[j].length - low <= READ:
                end = max(end, rows[j].offset + rows[j].length)
                j += 1
            with opened(path) as f:
                held = f.read_at(int(end - low), int(low))
            for r in rows[k:j]:
                raw = held[r.offset - low : r.offset - low + r.length]
                head, _, block = raw.partition(b"\r\n\r\n")
                http, _, payload = block.partition(b"\r\n\r\n")
                head, size = head_of(head), int(head_of(http)["Content-Length"])
                digest, refers = head["WARC-Payload-Digest"].removeprefix("sha256:"), head.get("WARC-Refers-To")
                if refers is None and (len(payload) != size or sha256(payload).hexdigest() != digest):
                    raise ValueError(f"a record of {path} at {r.offset} does not have its digest")
                out.append((r.page, size, digest, head["WARC-Type"], refers and refers[1:-1].removeprefix(URN), None if refers else payload))
            k = j
        yield pd.DataFrame(out, columns=["page", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read(selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of selected index rows: sorted byte ranges, coalesced, a stretch of a file to a task."""
    stretch = F.floor(F.col("offset") / F.lit(STRETCH))
    sorted_rows = selected.select("path", "offset", "length", "page").withColumn("stretch", stretch).repartition(tasks(selected), "path", "stretch").sortWithinPartitions("path", "offset").drop("stretch")
    fields = "page string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    if payloads:
        return sorted_rows.mapInPandas(_read, fields + ", payload binary")
    return sorted_rows.mapInPandas(lambda frames: (f.drop(columns="payload") for f in _read(frames)), fields)


def round_trip(pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row, as read back from the archives.

    A null html is an empty payload, a null url has no target. Equal payloads of at least 100
    bytes have one response, that of the smallest page_id (rows that repeat this page_id are
    responses too); others revisit it, a null page_id among them. Smaller payloads are all
    responses. Control characters and blanks of a url are written as %20. An empty table gives no rows.
    """
    spark, kind = pages.sparkSession, dict(pages.dtypes)["page_id"]
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder)
    x = read(index(spark, folder), payloads=False)
    own = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind).alias("page_id" if c == "page" else c)
    return x.select(own("page"), "payload_bytes", "payload_digest", "record_type", own("refers_to"))


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select p.page_id, p.n::bigint as payload_bytes, p.d as payload_digest,
       case when f.first_id is not null and f.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id <> p.page_id then f.first_id end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""
