"""WARC archives of pages, with revisit records in place of repeated payloads.

Headers alone are shuffled by payload digest to find each payload's original. Payloads move once, in an aggregate by digest
that keeps one of equal payloads, so a repeated payload leaves a task at most once. Archives are written by Spark's text
writer, whose line separator is the end of a record, so any store works and a lost task is written anew; they are read back
as a stream by the lengths that the headers state.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gasflow.functions.sizing import materialize

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
EOL = "\r\n"
RECORD_END = EOL + EOL
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS_PER_FILE = 2000
HELD_BYTES = 1 << 24
HEADER = "record_id string, record_type string, page_id long, url string, refers_to_record string, refers_to long, payload_digest string, payload_bytes long"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: each five hexadecimal digits of the digest are four of base 32."""
    return _base32(F.sha1(payload))


def _base32(hexed: str | Column) -> Column:
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", ALPHABET)


def header_rows(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload_digest, payload_bytes`` of each page; null html is an empty payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", base32_sha1(payload).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))


def _newest(*more: str) -> Column:
    """Equal payloads are ordered by page id, nulls first, then by address, the greatest being the original."""
    return F.struct(F.col("page_id").isNotNull().alias("named"), "page_id", F.coalesce("url", F.lit("")).alias("address"), F.col("url").isNotNull().alias("told"), *more)


def resolve_revisits(headers: DataFrame, smallest: int = 0) -> DataFrame:
    """Headers of the records to write: ``page_id, url, copy, payload_digest, payload_bytes, record_type, refers_to``.

    Of the ``header_rows`` with equal payloads of at least ``smallest`` bytes, that with the largest ``page_id`` (nulls last, then by
    address) is a response and all others revisit it; smaller payloads are all responses.
    ``copy`` numbers repeated rows from 0; of those of the original, the first is the response.
    """
    heads = headers.groupBy("payload_digest", "payload_bytes", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
    originals = heads.filter(F.col("payload_bytes") >= smallest).groupBy("payload_digest").agg(
        F.max(_newest()).alias("original"), F.sum("copies").alias("group")
    )
    repeated = originals.filter("`group` > 1").select("payload_digest", "original")
    joined = heads.join(repeated, "payload_digest", "left").select("*", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy"))
    response = F.col("original").isNull() | ((_newest() == F.col("original")) & (F.col("copy") == 0))
    return joined.select(
        "page_id", "url", "copy", "payload_digest", "payload_bytes",
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("original.page_id")).alias("refers_to"),
        F.when(~response, _record_id(F.col("original.page_id"), F.when(F.col("original.told"), F.col("original.address")), "payload_digest", F.lit(0))).alias("refers_to_record"),
        F.when(~response & F.col("original.told"), F.col("original.address")).alias("refers_to_url"),
    )


def response_rows(pages: DataFrame, smallest: int = 0) -> DataFrame:
    """``page_id, url, copy, payload_digest, html`` of the records that carry a payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    keyed = rows.withColumns({"_sha1": F.sha1(F.col("html").cast("binary")), "_large": F.octet_length("html") >= smallest})
    found = keyed.filter("_large").groupBy("_sha1").agg(F.max(_newest("html")).alias("r")).select(
        "_sha1", "r.page_id", F.when(F.col("r.told"), F.col("r.address")).alias("url"), F.lit(0).alias("copy"), "r.html"
    )
    if smallest > 0:
        small = keyed.filter(~F.col("_large")).groupBy("_sha1", "page_id", "url").agg(F.count(F.lit(1)).alias("copies"), F.any_value("html").alias("html"))
        each = F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy")
        found = found.unionByName(small.select("_sha1", "page_id", "url", each, "html"))
    return found.withColumn("payload_digest", _base32("_sha1")).drop("_sha1")


def _record_id(page_id: Column, url: Column, digest: str, copy: Column) -> Column:
    told = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    h = F.sha1(F.concat_ws("\n", told(page_id), told(url), digest, copy.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-a"), parts[3], F.lit("-"), parts[4])


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", smallest: int = 0, per_file: int = RECORDS_PER_FILE) -> None:
    """Write one record per page as gzip archives of at most ``per_file`` records under ``path``, with fresh headers.

    Null html is an empty payload, null ids and addresses leave out their header, repeated rows are records of their own. A
    payload may be as long as a row can be. Other columns are not read. An empty table gives archives without records.
    """
    heads = resolve_revisits(materialize(header_rows(pages)), smallest)
    revisits = heads.filter("record_type = 'revisit'").withColumn("html", F.lit(""))
    none = {c: F.lit(None).cast(t) for c, t in (("refers_to", "long"), ("refers_to_record", "string"), ("refers_to_url", "string"))}
    responses = response_rows(pages, smallest).withColumns(
        {"payload_bytes": F.octet_length("html").cast("long"), "record_type": F.lit("response"), **none}
    )
    records = responses.unionByName(revisits)
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL))).otherwise("")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(RECORD_END))
    block = F.concat(http, F.col("html"))
    plain_url = F.regexp_replace("url", "[\\r\\n]", " ")
    head = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), F.col("url"), "payload_digest", F.col("copy")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", plain_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to_record"), F.lit(">"))),
        line("WARC-Refers-To-Target-URI", F.regexp_replace("refers_to_url", "[\\r\\n]", " ")),
        line("WARC-Refers-To-Date", F.when(F.col("record_type") == "revisit", F.lit(date))),
        line("X-Page-ID", F.col("page_id")),
        line("X-Refers-To-Page-ID", F.col("refers_to")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block)),
        F.lit(EOL),
    )
    records.select(F.concat(head, block).alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option(
        "maxRecordsPerFile", per_file
    ).text(path)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: its headers, and of responses the digest and bytes of the payload as read (with
    ``payloads``, the payload too). Archives are gzip files, which Spark reads from the first byte to the last; a task
    holds one record at a time."""
    schema = HEADER + (", payload binary" if payloads else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        lines = (line for batch in batches for line in batch.column(0).cast(pa.binary()).to_pylist())
        for row in parse_records(lines):
            rows.append([row.get(n) for n in names])
            held += len(row["payload"] or b"") if payloads else 0
            if len(rows) == 2000 or held > HELD_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return spark.read.option("lineSep", RECORD_END).text(path).mapInArrow(parse, schema)


def parse_records(lines: Iterator[bytes]) -> Iterator[dict]:
    """The records of archives that come cut at each ``RECORD_END``, wherever it stands; only stated lengths are
    followed, so payloads may hold anything."""
    import base64

    rest: list[bytes] = []  # the stream so far, from the first byte not yet taken

    def take(least: int) -> bytes:
        """What is held, once it has ``least`` bytes."""
        size = sum(map(len, rest))
        while size < least:
            line = next(lines, None)
            if line is None:
                raise ValueError("an archive ends inside a record")
            rest.append(line + b"\r\n\r\n")
            size += len(rest[-1])
        return b"".join(rest)

    for line in lines:
        rest.append(line + b"\r\n\r\n")
        while rest:
            held = take(1)
            end = held.find(b"\r\n\r\n")
            if end < 0:
                held = take(len(held) + 1)
                end = held.index(b"\r\n\r\n")
            version, *fields = held[:end].decode("utf-8", "replace").split(EOL)
            if not version.startswith("WARC/"):
                raise ValueError("no WARC record where one is due")
            head = dict(x.split(": ", 1) for x in fields)
            size = int(head["Content-Length"])
            held = take(end + 8 + size)
            block = held[end + 4 : end + 4 + size]
            rest = [held[end + 8 + size :]] if len(held) > end + 8 + size else []
            revisit = head["WARC-Type"] == "revisit"
            payload = b"" if revisit else block[block.index(b"\r\n\r\n") + 4 :]
            number = lambda k: int(head[k]) if k in head else None  # noqa: E731, B023
            yield {
                "record_id": head["WARC-Record-ID"].strip("<>"),
                "record_type": head["WARC-Type"],
                "page_id": number("X-Page-ID"),
                "url": head.get("WARC-Target-URI"),
                "refers_to_record": head["WARC-Refers-To"].strip("<>") if "WARC-Refers-To" in head else None,
                "refers_to": number("X-Refers-To-Page-ID"),
                "payload_digest": None if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                "payload_bytes": None if revisit else len(payload),
                "payload": None if revisit else payload,
            }


def resolved(records: DataFrame) -> DataFrame:
    """Give revisits the payload digest and length of the response that they refer to. The archives are read once: what
    was parsed is written to the checkpoint folder."""
    records = materialize(records.drop("payload"))
    responses = records.filter("record_type = 'response'")
    revisits = records.filter("record_type = 'revisit'").drop("payload_digest", "payload_bytes")
    targets = responses.select(F.col("record_id").alias("refers_to_record"), "payload_digest", "payload_bytes")
    return responses.unionByName(revisits.join(targets, "refers_to_record", "left"))
