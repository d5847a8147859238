"""WARC archives with revisit records for repeated payloads.

Only narrow headers (row, page, digest, length) are shuffled by payload digest. The first record of
a digest becomes a ``response`` with the payload, every other a ``revisit`` that points to it.
Payloads are combined by digest within each task before they are shuffled, so of the copies of a
payload one leaves a task. The archives are gzipped WARC/1.1 files written by Spark's text writer,
whose line separator is the CRLF that ends a record, so they go wherever Spark can write. They are
read by Spark's text reader, which streams a file and splits it where a record may begin; parts are
joined again by Content-Length, so memory is bounded by a record, not by a file.

Defined cases: every row is a record, repeated ones too, and the first of a digest is that of the
smallest page id, then URL; a null payload is an empty one; a null URL is written as
``urn:unknown``; line breaks in a URL become spaces; a null page id sorts last; other columns,
whatever their names, are ignored; an empty table gives archives without a record.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

CRLF = "\r\n"
_HEADERS = (
    "record_id string, record_type string, page_id long, url string, payload_digest string, "
    "payload_bytes long, refers_to_id string, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: each 40 bits are 10 hex and 8 base32 digits."""
    digest = F.sha1(payload)
    parts = [
        F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)
    ]
    return F.translate(
        F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    )


def _record_id(digest: Column, row: Column) -> Column:
    h = F.md5(F.concat_ws("|", digest, row.cast("string")).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _with_digest(pages: DataFrame, payload_col: str) -> DataFrame:
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    return pages.select(base32_sha1(payload.cast("binary")).alias("payload_digest"), payload.alias("payload"))


def plan_records(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html", least_bytes=0) -> DataFrame:
    """Headers of the records to write, one for each row of ``pages``: page, digest, type, page referred to.

    ``row`` numbers the rows. Payloads of under ``least_bytes`` are always responses.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    heads = pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("urn:unknown")), r"[\r\n]+", " ").alias("url"),
        base32_sha1(payload.cast("binary")).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"),
    )
    heads = staged(heads, "heads")  # the numbers hold from here on
    first = heads.groupBy("payload_digest").agg(
        F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url", "row")).alias("first")
    )
    original = (F.col("row") == F.col("first.row")) | (F.col("payload_bytes") < least_bytes)
    return heads.join(first, "payload_digest").select(
        "row", "page_id", "url", "payload_digest", "payload_bytes",
        F.when(original, F.lit("response")).otherwise(F.lit("revisit")).alias("record_type"),
        *[F.when(~original, F.col(f"first.{c}")).alias(f"first_{c}") for c in ("row", "page_id", "url")],
    )


def write_archives(
    pages: DataFrame, path: str, id_col="page_id", url_col="url", payload_col="html",
    date="2024-01-01T00:00:00Z", least_bytes=0, records_per_file=5000,
) -> None:
    """Write deduplicated WARC files of ``pages`` to the new folder ``path``."""
    plan = plan_records(pages, id_col, url_col, payload_col, least_bytes)
    bodies = _with_digest(pages, payload_col).groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    revisits = plan.where("record_type = 'revisit'").withColumn("payload", F.lit(None).cast("string"))
    responses = plan.where("record_type = 'response'").join(bodies, "payload_digest")
    rows = responses.select(*revisits.columns).unionByName(revisits)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF),
    )
    block = F.concat(http, F.coalesce(F.col("payload"), F.lit("")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    revisit = F.col("record_type") == "revisit"
    record = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _record_id(F.col("payload_digest"), F.col("row"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        field("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.when(revisit, _record_id(F.col("payload_digest"), F.col("first_row")))),
        field("WARC-Refers-To-Target-URI", F.when(revisit, F.col("first_url"))),
        field("X-Page-Id", F.col("page_id").cast("string")),
        field("Content-Type", F.lit("application/http; msgtype=response")),
        field("Content-Length", F.octet_length("block").cast("string")),
        F.lit(CRLF), F.col("block"), F.lit(CRLF),
    )
    (
        rows.withColumn("block", block).select(record.alias("value"))
        .write.option("lineSep", CRLF).option("maxRecordsPerFile", records_per_file)
        .option("compression", "gzip").text(path)
    )


#: What stands between records; a payload may hold it too.
_BETWEEN = b"\r\n\r\nWARC/1.1\r\n"


def _records(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of archives cut at ``_BETWEEN``; parts are joined until a record has its length."""
    held: list[bytes] = []
    missing = 0
    fields: dict[str, str] = {}
    for part in parts:
        if missing <= 0:
            head, _, body = part.removeprefix(b"WARC/1.1\r\n").partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split(CRLF) if x)
            if not fields:
                continue
            held, missing = [body], int(fields["Content-Length"]) - len(body)
        else:
            held += [_BETWEEN, part]
            missing -= len(_BETWEEN) + len(part)
        if missing <= 0:
            yield fields, b"".join(held)[: int(fields["Content-Length"])]
    if missing > 0:
        raise ValueError("an archive ends within a record")


def _parse(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split(" ")[0] for x in _HEADERS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, kinds)))
    rows: list[tuple] = []
    held = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    for fields, block in _records(x.as_py() for batch in batches for x in batch.column("value")):
        payload = block.split(b"\r\n\r\n", 1)[1]
        first = fields["WARC-Type"] == "response"
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if first else fields["WARC-Payload-Digest"].removeprefix("sha1:")
        page = fields.get("X-Page-Id")
        rows.append((
            fields["WARC-Record-ID"], fields["WARC-Type"], page and int(page), fields["WARC-Target-URI"], digest,
            len(payload) if first else None, fields.get("WARC-Refers-To"), payload if first and payloads else None,
        ))
        held += len(payload) * payloads
        if len(rows) == 1000 or held > 8 << 20:
            yield made()
            rows, held = [], 0
    if rows:
        yield made()


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Read WARC files record by record, by Content-Length; digests are taken anew."""
    parts = spark.read.option("lineSep", _BETWEEN.decode()).option("pathGlobFilter", "part-*").text(path)
    return parts.select(F.col("value").cast("binary")).mapInArrow(lambda batches: _parse(batches, payloads), _HEADERS)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Give each revisit the payload length and page of the response that it refers to."""
    records = staged(records.drop("payload"), "records")  # the archives are read once
    originals = records.where("record_type = 'response'").select(
        F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"),
        F.col("payload_bytes").alias("original_bytes"),
    )
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(originals, "refers_to_id", "left")
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    responses = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    return revisits.withColumnRenamed("original_bytes", "payload_bytes").select(*names).unionByName(responses.select(*names))
