"""WARC archives: writing, reading, and revisit records for repeated payloads.

Archives are written by Spark's text sink, with the blank lines that end a record as line separator, so commits survive
lost executors; files hold a bounded number of records and are compressed as a whole. They are read as binary files and
parsed by Content-Length. To resolve revisits, headers alone are shuffled by payload digest; the least key of a digest is
the original, every other record becomes a revisit that names it, and new archives are written with fresh headers.
Fresh are the headers of the records; the server's answer, status line and all, stays as it came.

Digests are taken from the payloads as they are read, whatever a foreign archive states. Records that hold no HTTP answer
(``warcinfo``, ``metadata`` and so on) pass through whole. Plain archives (``.warc``) are read like compressed ones.

Fixed results: a null page counts as empty; a null key is written without the key header, sorts last and is read back as
null; a null address has no target header, line ends in addresses are percent-encoded; rows that repeat a key are
records of their own, of which one at most is an original; payloads under ``least`` bytes are never revisits; a revisit
in the input stays one, and its original is looked for anew if it states a SHA-256, kept as stated otherwise. No rows
make an archive without records. Files hold at most ``RECORDS_PER_FILE`` records and what one task writes; read back, a
file must stay under 2 GB.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marklake.storage import shared_dir, stage

END = "\r\n\r\n"
RECORDS_PER_FILE = 10_000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
FIELDS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "key": "x-record-key",
    "uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
}
HEADERS = ", ".join(f"{c} string" for c in FIELDS) + ", payload_bytes bigint"
BATCH_BYTES = 8 << 20
ANSWER = "application/http; msgtype=response"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for null."""
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def write_records(records: DataFrame, path: str) -> None:
    """Write archives of ``records``: the columns of ``FIELDS``, ``payload_bytes``, ``http`` (the answer's head; null where
    the record isn't one), ``payload`` (null for revisits), ``refers_to_uri``, ``refers_to_date``."""
    answer = F.when(F.col("http").isNotNull(), F.concat("http", F.lit(END))).otherwise("")
    block = F.concat(answer, F.coalesce("payload", F.lit("")))
    digest = F.when(F.contains("payload_digest", F.lit(":")), F.col("payload_digest")).otherwise(F.concat(F.lit("sha256:"), "payload_digest"))
    revisit = F.col("record_type") == "revisit"
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("uri")),
        _line("WARC-Payload-Digest", digest),
        _line("X-Record-Key", F.col("key")),
        _line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, F.col("refers_to"))),
        _line("WARC-Refers-To-Target-URI", F.when(revisit, F.col("refers_to_uri"))),
        _line("WARC-Refers-To-Date", F.when(revisit, F.col("refers_to_date"))),
        _line("Content-Type", F.col("content_type")),
        F.lit("Content-Length: "),
        F.octet_length(block).cast("string"),
        F.lit(END),
    )
    writer = records.select(F.concat(head, block).alias("value")).write
    writer.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def write_archives(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", date: str = EPOCH) -> None:
    """A response record for every row."""
    body = F.coalesce(payload, F.lit(""))
    name = F.md5(F.concat_ws("/", F.monotonically_increasing_id().cast("string"), F.col(key).cast("string")))
    rows = pages.select(
        F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col(key).cast("string").alias("key"),
        F.replace(F.replace(F.col(uri), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("uri"),
        F.lit(date).alias("date"),
        F.sha2(body, 256).alias("payload_digest"),
        F.lit(None).cast("string").alias("refers_to"),
        F.lit(None).cast("string").alias("refers_to_uri"),
        F.lit(None).cast("string").alias("refers_to_date"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        F.lit(ANSWER).alias("content_type"),
        F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string")).alias("http"),
        body.alias("payload"),
    )
    write_records(rows, path)


def _records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record."""
    raw = io.BytesIO(content)
    file = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
    while line := file.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        headers = {}
        while (line := file.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, file.read(int(headers["content-length"]))


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record: ``HEADERS`` and, if wanted, ``http`` (the head of the answer that a record holds, else null)
    and ``payload`` (null for revisits), both binary. ``payload_bytes`` is the length of the full payload, which revisits
    state in their HTTP header. Files named ``.gz`` or ``.warc`` are read."""
    kinds = [pa.string()] * len(FIELDS) + [pa.int64()] + [pa.binary(), pa.binary()] * payload
    names = [*FIELDS, "payload_bytes"] + ["http", "payload"] * payload

    def row_of(headers: dict[str, str], block: bytes) -> tuple:
        row = [headers.get(h) for h in FIELDS.values()]
        http, body = None, block
        if (headers.get("content-type") or "").lower().startswith("application/http"):
            http, _, body = block.partition(b"\r\n\r\n")
        if headers["warc-type"] == "revisit":
            stated = [x.partition(b":")[2] for x in (http or b"").split(b"\r\n") if x.lower().startswith(b"content-length:")]
            length, body = int(stated[0]) if stated else None, None
            row[5] = row[5] and row[5].removeprefix("sha256:")
        else:
            length, row[5] = len(body), hashlib.sha256(body).hexdigest()
        return (*row, length, http, body) if payload else (*row, length)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch["content"]:
                for headers, block in _records(content.as_py()):
                    rows.append(row_of(headers, block))
                    size += len(block) * payload + 400
                    if size > BATCH_BYTES:
                        yield made()
                        rows, size = [], 0
        if rows:
            yield made()

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc}").load(path).select("content")
    return files.mapInArrow(parse, HEADERS + ", http binary, payload binary" * payload)


def resolve_revisits(headers: DataFrame, least: int = 100) -> DataFrame:
    """``record_id`` of each record that becomes a revisit, with ``refers_to``, ``refers_to_uri``, ``refers_to_date``.

    Keys compare as whole numbers. Only responses can be originals, and only they and revisits can be revisits.
    """
    big = headers.where((F.col("payload_bytes") >= least) & F.col("record_type").isin("response", "revisit"))
    number = F.col("key").cast("decimal(38,0)")
    rank = F.struct(number.isNull().alias("no_key"), number.alias("number"), "record_id", "uri", "date")
    first = big.where("record_type = 'response'").groupBy("payload_digest").agg(F.min(rank).alias("first"))
    first = first.withColumnRenamed("payload_digest", "f_digest")
    again = big.join(first, (big["payload_digest"] == first["f_digest"]) & (big["record_id"] != F.col("first.record_id")))
    return again.select(
        F.col("record_id").alias("again_id"),
        F.col("first.record_id").alias("refers_to"),
        F.col("first.uri").alias("refers_to_uri"),
        F.col("first.date").alias("refers_to_date"),
    )


def deduplicate_archives(spark: SparkSession, source: str, target: str, least: int = 100) -> None:
    """Rewrite archives so that each payload is stored once."""
    again = resolve_revisits(stage(read_archives(spark, source, payload=False), "headers"), least)
    records = read_archives(spark, source)
    both = records.withColumnRenamed("refers_to", "stated").join(again, records["record_id"] == again["again_id"], "left")
    revisit = F.col("again_id").isNotNull()
    rows = both.withColumns(
        {
            "record_type": F.when(revisit, F.lit("revisit")).otherwise(F.col("record_type")),
            "refers_to": F.coalesce("refers_to", "stated"),
            "http": F.col("http").cast("string"),
            "payload": F.when(~revisit, F.col("payload")).cast("string"),
        }
    )
    write_records(rows, target)


def originals(records: DataFrame) -> DataFrame:
    """The records with ``original_key``, the key of the response that a revisit refers to."""
    responses = records.where("record_type = 'response'").select(F.col("record_id").alias("o_id"), F.col("key").alias("original_key"))
    return records.join(responses, records["refers_to"] == responses["o_id"], "left").drop("o_id")


def archive_pages(pages: DataFrame, least: int = 100) -> DataFrame:
    """Write ``pages`` as archives, deduplicate them, and return what the result says about each record."""
    spark = pages.sparkSession
    first, second = shared_dir(spark, "archives"), shared_dir(spark, "archives")
    write_archives(pages, first)
    deduplicate_archives(spark, first, second, least)
    return originals(read_archives(spark, second, payload=False))
