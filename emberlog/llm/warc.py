"""WARC archives as a table of chunks.

A payload becomes rows of a record identifier, a chunk number and at most ``chunk`` bytes, so the reader never holds
a large record as one value, and the writer only as the cell that it came from: that is digested and cut as a whole. On disk a chunk is a WARC 1.1 record
of its own: the first has the record's type and ``WARC-Segment-Number: 1``, the others are ``continuation`` records,
as the format has for records that are cut. Short records are one plain record.

A chunk never contains the version line ``WARC/1.1`` with its line end: a payload that has one is cut inside it. So
that line separates the records of an archive, Spark's text source splits archives by it, and nothing is ever read
as a whole archive. Records whose block doesn't have the length that its header says fail the read.

Digests of payloads in one chunk are taken where the chunk is; those of longer ones are carried from chunk to chunk,
over rows that come sorted by record and chunk number.

Of records with equal payloads (by SHA-1 and length) the one with the smallest identifier is a ``response`` and the
others are ``revisit`` records without payload.

Defined cases: a null payload counts as empty; a null address is left out of the header, line ends in it become
blanks; rows that repeat the smallest identifier are all responses; a row without identifier is a revisit of the
smallest identifier, or a response if there is none; an empty table gives archives without records and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.common import cut, let, partitions, running, shared_dir

VERSION = "WARC/1.1\r\n"
#: Bytes of a chunk at most.
CHUNK = 1 << 18
#: Payloads of at least so many bytes are compared with others.
LEAST = 0
#: A fixed date, so that a second run writes the same archives.
DATE = "2024-01-01T00:00:00Z"
PAGES = "page_id long, url string, html string"


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of 40 hex digits: five hex digits are four of base32."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def payload(pages: DataFrame) -> DataFrame:
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("body"),
    )


def typed(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``payload(pages)`` with ``bytes``, ``digest`` and ``refers_to`` (null for responses).

    Equal payloads are found by digest, on rows without payload. Rows then look up the first of several equal ones by
    digest, payloads with them where those digests are too many to be broadcast.
    """
    rows = payload(pages).withColumn("bytes", F.length("body").cast("long")).withColumn("digest", base32(F.sha1("body")))
    first = cut(rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    kind = F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first"))
    return rows.join(first, ["digest", "bytes"], "left").withColumn("refers_to", kind)


def starts(body: Column, chunk: int) -> Column:
    """Where chunks begin: every ``chunk`` bytes, and inside each version line. Ascending, the first is 0."""
    even = F.sequence(F.lit(0), F.greatest(F.length(body) - 1, F.lit(0)), F.lit(chunk))
    between = F.split(F.decode(body, "ISO-8859-1"), "WARC/1[.]1\r\n", -1)
    # what stands before a version line, and that line; the last piece has none after it
    steps = F.transform(between, lambda part: F.length(part) + len(VERSION))
    places = let(running(steps), lambda ends: F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda end: (end - len(VERSION) + 4).cast("int")))
    return F.when(F.contains(body, F.lit(VERSION.encode())), F.sort_array(F.array_union(even, places))).otherwise(even)


def chunks(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk table: ``record_id``, ``chunk_no`` (from 1), ``n_chunks``, ``data`` and what ``records`` has but ``body``."""
    kept = [c for c in records.columns if c != "body"]
    body = F.when(F.col("refers_to").isNull(), F.col("body")).otherwise(F.lit(b""))
    return (
        records.withColumn("body", body)
        .withColumn("record_id", F.expr("uuid()"))
        .withColumn("at", starts(F.col("body"), chunk))
        .select("record_id", *kept, F.col("body"), F.col("at"), F.posexplode("at").alias("no", "begin"))
        .withColumn("end", F.coalesce(F.try_element_at("at", F.col("no") + 2), F.length("body")))
        .select(
            "record_id",
            (F.col("no") + 1).alias("chunk_no"),
            F.size("at").alias("n_chunks"),
            *kept,
            F.substring("body", F.col("begin") + 1, F.col("end") - F.col("begin")).alias("data"),
        )
    )


def record_text(table: DataFrame) -> DataFrame:
    """A WARC record for each chunk, as one binary-safe string; the version line stands before it."""

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))

    whole, revisit = F.col("chunk_no") == 1, F.col("refers_to").isNotNull()
    kind = F.when(~whole, F.lit("continuation")).when(revisit, F.lit("revisit")).otherwise(F.lit("response"))
    http = F.when(whole, F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")).otherwise(F.lit(""))
    cut_up = F.col("n_chunks") > 1
    urn = F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))
    header = F.concat(
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.when(whole, urn).otherwise(F.concat(F.lit("<urn:uuid:"), F.md5(F.concat_ws("/", "record_id", "chunk_no")), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.when(whole, F.concat(F.lit("sha1:"), F.col("digest")))),
        line("WARC-Profile", F.when(whole & revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("X-Refers-To-Page", F.when(whole, F.col("refers_to"))),
        line("X-Page", F.col("page_id")),
        line("X-Payload-Length", F.when(whole, F.col("bytes"))),
        line("WARC-Segment-Number", F.when(cut_up, F.col("chunk_no"))),
        line("WARC-Segment-Origin-ID", F.when(~whole, urn)),
        line("WARC-Segment-Total-Length", F.when(cut_up & (F.col("chunk_no") == F.col("n_chunks")), F.col("bytes"))),
        line("Content-Type", F.when(whole, F.lit("application/http; msgtype=response"))),
        line("Content-Length", F.octet_length(http) + F.length("data")),
    )
    return table.select(F.concat(F.lit(VERSION), header, F.lit("\r\n"), http, F.col("data").cast("string")).alias("value"))


def write(pages: DataFrame, folder: str, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Archives ``*.txt.gz`` below ``folder``, one per task, compressed as a whole."""
    record_text(chunks(typed(pages, least), chunk)).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the archives: ``record_id``, ``page_id``, ``chunk_no``, ``n_chunks`` (null if not the last), header fields and ``data``."""
    rows = spark.read.schema("value string").option("lineSep", VERSION).text(folder).where("value <> ''")
    head = F.substring_index("value", "\r\n\r\n", 1)  # looks at bytes, so what follows may be any
    rows = rows.select(F.col("value").cast("binary").alias("raw"), F.octet_length(head).alias("gap"), F.concat(F.lit("\n"), head, F.lit("\r")).alias("header"))

    def field(name: str) -> Column:
        value = F.regexp_extract("header", f"\n{name}: ([^\r]*)\r", 1)
        return F.when(value != "", value)

    length = field("Content-Length").cast("int")
    rows = rows.withColumn("size", length).withColumn("block", F.substring("raw", F.col("gap") + 5, F.col("size")))
    right = (F.length("block") == F.col("size")) & (F.length("raw") == F.col("gap") + 4 + F.col("size") + 4)
    rows = rows.withColumn("block", F.when(right, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("damaged WARC record: "), F.col("header")))))
    first = field("WARC-Type") != "continuation"
    body = F.octet_length(F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)) + 5
    urn = F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID"))
    return rows.select(
        F.regexp_extract(urn, "<urn:uuid:([^>]*)>", 1).alias("record_id"),
        field("X-Page").cast("long").alias("page_id"),
        F.coalesce(field("WARC-Segment-Number").cast("int"), F.lit(1)).alias("chunk_no"),
        F.when(field("WARC-Segment-Number").isNull(), F.lit(True)).otherwise(F.lit(False)).alias("whole"),
        F.when(first, field("WARC-Type")).alias("record_type"),
        F.regexp_extract(field("WARC-Payload-Digest"), "sha1:(.*)", 1).alias("stated_digest"),
        field("X-Payload-Length").cast("long").alias("stated_bytes"),
        field("X-Refers-To-Page").cast("long").alias("refers_to"),
        F.when(first, F.substring("block", body, F.length("block"))).otherwise(F.col("block")).alias("data"),
    )


HEAD = ("record_id", "page_id", "record_type", "stated_digest", "stated_bytes", "refers_to")
NUMBERS = ("page_id", "stated_bytes", "refers_to", "payload_bytes")
SCHEMA = pa.schema([(n, pa.int64() if n in NUMBERS else pa.string()) for n in (*HEAD, "payload_bytes", "payload_digest")])
FOUND = ", ".join(f"{n} {'long' if n in NUMBERS else 'string'}" for n in SCHEMA.names)


def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Length and digest of each record, from its chunks in order. One chunk is in memory at a time, and a digest's state."""
    head, digest, length = None, None, 0

    def done() -> dict:
        return head | {"payload_bytes": length, "payload_digest": base64.b32encode(digest.digest()).decode()}

    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if head is None or row["record_id"] != head["record_id"]:
                if head is not None:
                    out.append(done())
                head = {k: row[k] for k in HEAD}
                digest, length = hashlib.sha1(), 0
            digest.update(row["data"])
            length += len(row["data"])
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=SCHEMA)
    if head is not None:
        yield pa.RecordBatch.from_pylist([done()], schema=SCHEMA)


def records(table: DataFrame) -> DataFrame:
    """A row for each record of the chunk table, with the length and digest of its full payload.

    A revisit has those that its header states; for a response they are taken from the payload that was read, and
    the read fails if they aren't those of the header.
    """
    short = table.where("whole").select(*HEAD, F.length("data").cast("long").alias("payload_bytes"), base32(F.sha1("data")).alias("payload_digest"))
    long = (
        table.where("not whole").select(*HEAD, "chunk_no", "data")
        .repartition(partitions(table.sparkSession), "record_id")
        .sortWithinPartitions("record_id", "chunk_no")
        .mapInArrow(carried, FOUND)
    )
    found = short.unionByName(long)
    revisit = F.col("record_type") == "revisit"
    fits = (F.col("payload_bytes") == F.col("stated_bytes")) & (F.col("payload_digest") == F.col("stated_digest"))
    return found.select(
        "page_id",
        F.when(revisit, F.col("stated_bytes")).when(fits, F.col("payload_bytes")).otherwise(F.raise_error(F.lit("a payload differs from its digest")).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def round_trip(pages: DataFrame, chunk: int = CHUNK, least: int = LEAST) -> DataFrame:
    """Writes ``pages`` to new archives in the shared folder and reads them back."""
    spark = pages.sparkSession
    write(pages, folder := f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", chunk, least)
    return records(read(spark, folder))
