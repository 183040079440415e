"""Web archives without repeated payloads: revisit records that refer to one original response.

Only headers (id, payload size, payload digest) are shuffled by digest; of records with equal payloads of at least
``MINIMUM_BYTES`` the one with the smallest id stays a response, the others become revisits of it. What a page refers to
comes back to it by (id, digest), so a payload that a third of all pages share meets nowhere. Archives are written by Spark's own text writer: a record's header, HTTP head and payload are one value, the two line breaks that end a
record are the separator, so every file is a plain (gzipped) WARC file and lost tasks are repeated by Spark. Reading
goes by ``Content-Length``, record by record, and joins revisits to their originals.

Defined results: a null payload is empty; payloads below the minimum are always responses, as are records with a null id
(written without a number, read back as null); repeated rows of the smallest id are all responses; control characters and blanks
in an address are percent-encoded, a null address is ``about:blank``; an empty table gives no records. Other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from archidex.session import cut_lineage

MINIMUM_BYTES = 100
# Payloads of up to so many bytes go so many into a file, larger ones alone: the payloads of a file stay within 256 MB.
FILE_CLASSES = ((64 << 10, 4_096), (4 << 20, 64))

# Fixed values of the archive format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"
ID_PREFIX = "urn:page:"


def headers(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """page_id, payload_bytes and payload_digest of each page."""
    body = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(
        F.col(key).alias("page_id"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.sha2(body, 256).alias("payload_digest"),
    )


def originals(heads: DataFrame) -> DataFrame:
    """payload_digest and the smallest id of each payload that occurs more than once and is large enough."""
    large = heads.where((F.col("payload_bytes") >= MINIMUM_BYTES) & F.col("page_id").isNotNull())
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("original"), F.max("page_id").alias("last"))
    return firsts.where("original < last").drop("last")


def _record(page_id: Column, url: Column, refers_to: Column, size: Column, digest: Column, body: Column) -> Column:
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = lambda number: F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(number.cast("string"), F.lit("")), F.lit(">"))
    address = F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20"), F.lit("about:blank"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit(RECORD_END))
    revisit = refers_to.isNotNull()
    content = F.when(revisit, F.lit("")).otherwise(body)
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), name(page_id)),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Date: "), now),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), digest),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}\r\nWARC-Refers-To: "), name(refers_to))),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(head) + F.octet_length(content)).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(RECORD_END), head, content)


def revisits(heads: DataFrame) -> DataFrame:
    """page_id, payload_digest and ``original``, once for each page whose payload an earlier id has."""
    large = heads.where((F.col("payload_bytes") >= MINIMUM_BYTES) & F.col("page_id").isNotNull())
    pages = large.select("page_id", "payload_digest").distinct()
    return pages.join(originals(heads), "payload_digest").where("original < page_id")


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """Deduplicated archives of all pages below ``path``, one write for each class of payload sizes that occurs."""
    heads = cut_lineage(headers(pages, key, payload))
    known = cut_lineage(revisits(heads))
    body = F.coalesce(F.col(payload), F.lit(""))
    full = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    # Pages without an id refer to nothing; they take no part in the join, where they would share one key.
    given = full.where("page_id is not null").withColumn("payload_digest", F.sha2("body", 256))
    rest = full.where("page_id is null").withColumn("payload_digest", F.sha2("body", 256))
    full = given.join(known, ["page_id", "payload_digest"], "left").unionByName(rest, allowMissingColumns=True)
    record = _record(F.col("page_id"), F.col("url"), F.col("original"), F.octet_length("body"), F.col("payload_digest"), F.col("body"))

    def class_of(size: Column) -> Column:
        kind = F.lit(len(FILE_CLASSES))
        for number, (most, _) in reversed(list(enumerate(FILE_CLASSES))):
            kind = F.when(size <= most, number).otherwise(kind)
        return kind

    present = sorted(r["kind"] for r in heads.select(class_of(F.col("payload_bytes")).alias("kind")).distinct().collect())
    for kind in present or [0]:
        records = FILE_CLASSES[kind][1] if kind < len(FILE_CLASSES) else 1
        values = full.where(class_of(F.octet_length("body")) == kind).select(record.alias("value"))
        writer = values.write.mode("append").option("lineSep", RECORD_END).option("compression", "gzip")
        writer.option("maxRecordsPerFile", records).text(path)


def _records(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record in a file."""
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, file.read(int(fields["content-length"]))


def _number(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{ID_PREFIX}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, url, record_type, refers_to, header_digest, and of responses the size, digest and,
    if wanted, bytes of the payload as read. A response whose payload differs from its header's digest is an error."""
    names = ["page_id", "url", "record_type", "refers_to", "header_digest", "payload_bytes", "payload_digest", "payload"]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    kinds = ["long", "string", "string", "long", "string", "long", "string", "binary"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for fields, block in _records(gzip.open(io.BytesIO(content.as_buffer()))):
                    revisit = fields["warc-type"] == "revisit"
                    body = b"" if revisit else block.partition(RECORD_END.encode())[2]
                    digest, said = hashlib.sha256(body).hexdigest(), fields["warc-payload-digest"].removeprefix("sha256:")
                    if not revisit and digest != said:
                        raise ValueError(f"damaged record {fields['warc-record-id']}")
                    own = (None, None, None) if revisit else (len(body), digest, body if payloads else None)
                    rows.append((_number(fields["warc-record-id"]), fields["warc-target-uri"], fields["warc-type"], _number(fields.get("warc-refers-to")), said, *own))
                    held += len(body) * payloads + 300
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(zip(*rows, strict=True), types, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with the payload size and digest of the response they refer to; responses as they are."""
    known = records.where("record_type = 'response' and page_id is not null and payload_bytes >= 0")
    # Repeated rows of an original are the same payload, so one row for each id and digest.
    known = known.groupBy(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("header_digest")).agg(
        F.max("payload_bytes").alias("original_bytes")
    )
    joined = records.join(known, ["refers_to", "header_digest"], "left")
    return joined.select(
        "page_id",
        F.coalesce("payload_bytes", "original_bytes").alias("payload_bytes"),
        F.col("header_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
