"""WARC records as a chunked table: oversized payloads are rows of (record id, chunk number), each with the digest so far.

Concatenating header, data and trailer of a record's chunks in order gives the WARC/1.1 record. No step holds a whole
record in Python: payloads are cut on the JVM side, digests advance chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payload bytes of one chunk row.
CHUNK = 1 << 15
#: Payloads of at least so many bytes are stored once.
REVISIT_MIN = 1000
#: The date that every record states; a fixed value keeps archives reproducible.
DATE = "2024-01-01T00:00:00Z"
#: Profile of a revisit record, and the header block that stands before a payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the SHA-1 of all payload bytes up to each chunk; a record's chunks come in order."""
    state, of = hashlib.sha1(), None
    for b in batches:
        out = []
        for rid, no, data in zip(b.column("record_id").to_pylist(), b.column("chunk_no").to_pylist(), b.column("data"), strict=True):
            if rid != of or no == 0:
                state, of = hashlib.sha1(), rid
            state.update(data.as_buffer())
            out.append(state.hexdigest())
        yield b.append_column("running_sha1", pa.array(out, pa.string()))


def to_records(pages: DataFrame, chunk_bytes: int = CHUNK, revisit_min: int = REVISIT_MIN) -> DataFrame:
    """Chunk rows of the archive from (page_id, url, html).

    Of equal payloads of at least `revisit_min` bytes the one with the largest page_id is the response, others revisit
    it by its record id, urn:page:<page_id>:<digest>. A null html is an empty payload, a null url an empty one; equal rows
    that share the largest id are all responses and share that record id; a null page_id never is the largest, and stays
    a response where no other id has its payload. Very long payloads are cut into chunks; an empty table gives no rows;
    other columns aren't read, whatever their names.
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.translate(F.coalesce("url", F.lit("")), "\r\n", "  ").alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    first = base.filter(F.col("size") >= revisit_min).groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("_n")).filter("_n > 1 AND target IS NOT NULL").drop("_n")
    # Targets are found on narrow rows; payloads meet them by page, so copies of one payload don't gather in a task.
    narrow = base.select("page_id", "digest").join(first, "digest").distinct().select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "target")
    rows = base.join(narrow, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left").withColumn("revisit", F.coalesce(~F.col("page_id").eqNullSafe(F.col("target")) & F.col("target").isNotNull(), F.lit(False)))
    name = lambda page: F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col("digest"))
    rows = rows.withColumn("record_id", F.concat(name("page_id"), F.lit(":"), F.monotonically_increasing_id().cast("string")))  # of the chunk table alone
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit("\r\nWARC-Record-ID: <"),
        name("page_id"),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit("\r\nPayload-Length: "),
        F.col("size").cast("string"),
        F.when(F.col("revisit"), F.concat(F.lit("\r\nWARC-Refers-To: <"), name("target"), F.lit(f">\r\nWARC-Profile: {PROFILE}"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.when(F.col("revisit"), F.lit(0).cast("long")).otherwise(F.col("size")) + len(HTTP)).cast("string"),
        F.lit(f"\r\n\r\n{HTTP}"),
    )
    stored = F.when(F.col("revisit"), F.lit(0).cast("long")).otherwise(F.col("size"))
    rows = rows.select("record_id", "page_id", header.alias("_h"), stored.alias("_n"), "payload")
    starts = F.when(F.col("_n") > 0, F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(chunk_bytes).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.select("record_id", "page_id", "_h", "_n", "payload", F.posexplode(starts).alias("chunk_no", "_at"))
    size = F.greatest(F.lit(0).cast("long"), F.least(F.lit(chunk_bytes).cast("long"), F.col("_n") - F.col("_at"))).cast("int")
    last = F.col("_at") + chunk_bytes >= F.col("_n")
    return rows.select(
        "record_id",
        "page_id",
        "chunk_no",
        last.alias("is_last"),
        F.when(F.col("chunk_no") == 0, F.encode("_h", "UTF-8")).alias("header"),
        F.substring("payload", (F.col("_at") + 1).cast("int"), size).alias("data"),
        F.when(last, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("trailer"),
    )


def write_archive(pages: DataFrame, path: str, chunk_bytes: int = CHUNK, revisit_min: int = REVISIT_MIN) -> None:
    chunks = to_records(pages, chunk_bytes, revisit_min)
    schema = chunks.schema.simpleString()[7:-1] + ",running_sha1:string"
    chunks.mapInArrow(_running, schema.replace(":", " ")).write.parquet(path)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes and digests of records from their chunks in order; a chunk whose running digest differs makes the record bad."""
    state, of, size, good = hashlib.sha1(), None, 0, True
    for b in batches:
        out: list[tuple] = []
        cols = (b.column(c) for c in ("record_id", "chunk_no", "is_last", "data", "running_sha1"))
        for rid, no, last, data, told in zip(*cols, strict=True):
            rid, no = rid.as_py(), no.as_py()
            if rid != of or no == 0:
                state, of, size, good = hashlib.sha1(), rid, 0, no == 0
            buf = data.as_buffer()
            state.update(buf)
            size += buf.size
            good = good and state.hexdigest() == told.as_py()
            if last.as_py():
                out.append((rid, size, state.hexdigest(), good))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.bool_()))], names=["record_id", "stored_bytes", "stored_digest", "intact"])


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Records of one chunk are checked where they lie; only those of several chunks are brought together, in order.
    """
    rows = spark.read.parquet(path)
    head = F.decode("header", "UTF-8")
    field = lambda name, pattern: F.regexp_extract("_h", rf"\r\n{name}: {pattern}\r\n", 1)
    info = rows.filter("chunk_no = 0").select("record_id", "page_id", "is_last", "data", "running_sha1", head.alias("_h"))
    info = info.select(
        "record_id",
        "page_id",
        "is_last",
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        field("WARC-Refers-To", "<urn:page:(-?[0-9]+):[0-9a-f]{40}>").try_cast("long").alias("refers_to"),
        field("Payload-Length", "([0-9]+)").try_cast("long").alias("_told"),
        field("WARC-Payload-Digest", "sha1:([0-9a-f]{40})").alias("_digest"),
        F.octet_length("data").cast("long").alias("_bytes"),
        F.sha1("data").alias("_sha"),
        F.col("running_sha1").alias("_run"),
    )
    revisit = F.col("record_type") == "revisit"
    one = info.filter("is_last").select(
        "page_id",
        F.when(revisit, F.col("_told")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("_digest")).otherwise(F.col("_sha")).alias("payload_digest"),
        "record_type",
        "refers_to",
        F.when(revisit, F.col("_bytes") == 0).otherwise((F.col("_sha") == F.col("_digest")) & (F.col("_sha") == F.col("_run")) & (F.col("_bytes") == F.col("_told"))).alias("intact"),
    )
    parts = rows.filter("chunk_no > 0 OR NOT is_last").select("record_id", "chunk_no", "is_last", "data", "running_sha1")
    whole = parts.repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_verified, "record_id string, stored_bytes long, stored_digest string, intact boolean")
    many = info.filter("NOT is_last").join(whole, "record_id").select(
        "page_id",
        F.col("stored_bytes").alias("payload_bytes"),
        F.col("stored_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
        (F.col("intact") & (F.col("stored_bytes") == F.col("_told")) & (F.col("stored_digest") == F.col("_digest"))).alias("intact"),
    )
    return one.unionByName(many)


SQL = f"""
WITH b AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
d AS (SELECT page_id, octet_length(p) AS n, sha1(p) AS h FROM b),
m AS (SELECT h, max(page_id) AS target FROM d WHERE n >= {REVISIT_MIN} GROUP BY h)
SELECT d.page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
 CASE WHEN target IS NULL OR target = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN target <> d.page_id THEN target END AS refers_to, true AS intact FROM d LEFT JOIN m ON d.h = m.h"""
