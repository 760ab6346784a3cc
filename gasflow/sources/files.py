"""Reading and writing tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.functions.columns import nan_to_null

TEXT_SUFFIXES = (".csv", ".txt", ".csv.gz", ".txt.gz")
PARQUET_SUFFIXES = (".parquet", ".pq")
# How an HTML page served in place of a data file begins (case matters).
HTML_STARTS = ("<!DOCTYPE html", "<html")
HTML_HEAD_BYTES = 512


def read_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, malformed: str = "raise", header: bool = True
) -> DataFrame:
    """A CSV or Parquet table, chosen by suffix; NaN becomes null.

    A missing path raises ``FileNotFoundError``, an unknown suffix or an HTML page ``ValueError``.
    Pass ``schema`` for large CSV inputs: without it the types are inferred in an extra pass.
    A path without suffix, such as a folder that Spark wrote, is read as Parquet.

    A CSV line of too few fields is filled up with nulls. One of too many raises when the table is read, or with ``malformed``
    ``"leave"`` is left out; ``rejected_lines`` lists them. A surplus field that is empty does not count.
    """
    if malformed not in ("raise", "leave"):
        raise ValueError("malformed must be 'raise' or 'leave'")
    name = path.rstrip("/").lower()
    try:
        if name.endswith(TEXT_SUFFIXES):
            _refuse_html(spark, path)
            lines, line = _csv_lines(spark, path, schema, header)
            table = lines.filter(_in_place(lines, line, malformed)).drop(line)
        elif name.endswith(PARQUET_SUFFIXES) or "." not in os.path.basename(name):
            table = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        else:
            raise ValueError(f"unsupported file type: {path} (supported: .csv, .txt, .csv.gz, .parquet, .pq)")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from error
        raise
    return nan_to_null(table)


def rejected_lines(spark: SparkSession, path: str, schema: T.StructType | None = None, header: bool = True) -> DataFrame:
    """``file, line`` of the CSV lines that have more fields than the table has columns."""
    lines, line = _csv_lines(spark, path, schema, header)
    return lines.filter(_too_long(lines, line)).select(F.col("_metadata.file_path").alias("file"), F.col(line).alias("line"))


def _csv_lines(spark: SparkSession, path: str, schema: T.StructType | None, header: bool) -> tuple[DataFrame, str]:
    """The CSV table with the whole line in one more column, where it does not fit the schema, and that column's name."""
    reader = spark.read.option("header", header)
    schema = schema or reader.option("inferSchema", True).csv(path).schema
    line = "_line"
    while line in schema.names:
        line = "_" + line
    told = T.StructType([*schema.fields, T.StructField(line, T.StringType())])
    # a pruned line would not be told from one that fits
    whole = spark.read.option("header", header).option("columnNameOfCorruptRecord", line).option("columnPruning", False)
    return whole.schema(told).csv(path), line


def _too_long(lines: DataFrame, line: str) -> Column:
    names = [c for c in lines.columns if c != line]
    wide = ", ".join(f"c{i} string" for i in range(len(names) + 1))
    surplus = F.from_csv(F.col(line), wide)[f"c{len(names)}"].isNotNull()
    # Spark refuses to read the line without any column
    read = F.length(F.concat_ws("", F.col(f"`{names[0]}`").cast("string"))) >= 0
    return F.coalesce(surplus, F.lit(False)) & read


def _in_place(lines: DataFrame, line: str, malformed: str) -> Column:
    if malformed == "leave":
        return ~_too_long(lines, line)
    message = F.concat(F.lit("a line has too many fields: "), F.col(line))
    return F.when(_too_long(lines, line), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))


def starts_like_html(text: Column) -> Column:
    """True when a text begins, after white space, like an HTML page."""
    head = F.regexp_replace(text, r"^\s+", "")
    return F.startswith(head, F.lit(HTML_STARTS[0])) | F.startswith(head, F.lit(HTML_STARTS[1]))


def html_payload_scan(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """``path, length, is_html`` for all files under a path, looking at the first bytes of each, however long it is.

    Empty files are not listed.
    """
    heads = _heads(spark, path, pattern, unzip=False)
    return heads.select("path", "length", starts_like_html(F.decode("head", "ISO-8859-1")).alias("is_html"))


def _heads(spark: SparkSession, path: str, pattern: str | None, unzip: bool) -> DataFrame:
    """``path, length, head``: Spark lists the files, tasks open them and read no more than their first bytes."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [_first_bytes(p, unzip) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], names=["path", "length", "head"])

    return files.mapInArrow(read, "path string, length long, head binary")


def _first_bytes(path: str, unzip: bool) -> bytes:
    from pyarrow import fs

    if path.startswith("file:"):
        store, at = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, at = fs.FileSystem.from_uri(quote(path, safe=":/").replace("s3a://", "s3://", 1))
    packed = unzip and path.lower().endswith(".gz")
    with store.open_input_stream(at, compression="gzip" if packed else None) as file:
        return file.read(HTML_HEAD_BYTES)


def html_payload_rows(df: DataFrame, text: str) -> DataFrame:
    """The same test over a text column: adds ``is_html``."""
    return df.withColumn("is_html", F.coalesce(starts_like_html(F.substring(text, 1, HTML_HEAD_BYTES)), F.lit(False)))


def write_profile(sections: dict[str, DataFrame], path: str) -> None:
    """One Parquet table per profile section, and a table ``manifest`` that names the folder of each, under ``path``.

    The sections go to new folders beside those of an earlier profile; only when all are written does the manifest turn to
    them, so a section that fails leaves the earlier profile as it was.
    """
    if not sections:
        return
    base, made = path.rstrip("/"), uuid.uuid4().hex
    folders = [(name, f"{made}/{name}") for name in sections]
    for name, folder in folders:
        sections[name].write.parquet(f"{base}/{folder}")
    spark = next(iter(sections.values())).sparkSession
    turn = spark.createDataFrame([(name, folder) for name, folder in folders], "section string, folder string")
    turn.coalesce(1).withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(f"{base}/manifest")


def read_profile(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The sections that the last complete ``write_profile`` left under ``path``."""
    base = path.rstrip("/")
    manifest = spark.read.parquet(f"{base}/manifest")
    latest = manifest.filter(F.col("written_at") == manifest.agg(F.max("written_at")).scalar())
    return {r.section: spark.read.parquet(f"{base}/{r.folder}") for r in latest.orderBy("section").collect()}


def _refuse_html(spark: SparkSession, path: str) -> None:
    """Raise when one of the text files is an HTML page, by the first bytes of each."""
    heads = _heads(spark, path, None, unzip=True)
    pages = heads.filter(starts_like_html(F.decode("head", "ISO-8859-1"))).select("path").head(1)
    if pages:
        raise ValueError(f"{pages[0].path} is an HTML page, not a data file; fetch the data file itself")
