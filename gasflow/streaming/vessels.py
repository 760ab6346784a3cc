"""Vessel position messages, from a stream or a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from gasflow.operators.proximity import MAX_DISTANCE_KM, vessels_near_locations

# The fields of a message and the vessel types that are kept.
MESSAGE_SCHEMA = (
    "mmsi long, timestamp double, lat double, lon double, speed double, course double, "
    "navStatus string, typeCode string"
)
KEPT_TYPES = (70, 79)


def read_vessel_stream(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of raw messages, one JSON text per line in a column ``value``, from the files of a folder.

    A Kafka source gives the same column: ``select(col("value").cast("string"))``.
    """
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def decode_vessels(raw: DataFrame, value: str = "value", types: tuple[int, int] = KEPT_TYPES) -> DataFrame:
    """Positions from JSON messages; other columns are kept.

    Messages that are no JSON or whose type is missing, no integer or out of range are dropped. A
    missing time is the start of 1970. Works on a stream and on a table alike.
    """
    message = F.from_json(F.col(value), MESSAGE_SCHEMA, {"mode": "PERMISSIVE"})
    kind = F.col("_m.typeCode").try_cast("int")
    others = [c for c in raw.columns if c != value]
    seconds = F.coalesce(F.col("_m.timestamp"), F.lit(0.0))
    return (
        raw.withColumn("_m", message)
        .filter(kind.between(*types))
        .select(
            *others,
            F.col("_m.mmsi").alias("mmsi"),
            F.timestamp_seconds(seconds).alias("timestamp"),
            F.col("_m.lat").alias("latitude"),
            F.col("_m.lon").alias("longitude"),
            F.col("_m.speed").alias("speed"),
            F.col("_m.course").alias("course"),
            F.col("_m.navStatus").alias("status"),
            kind.alias("vessel_type"),
        )
    )


def collect_vessels(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all positions that are available now to Parquet, then stop; a later call takes the new ones.

    The caller waits with ``awaitTermination``; progress is kept in ``checkpoint``.
    """
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def tag_vessels(stream: DataFrame, locations: DataFrame, km: float = MAX_DISTANCE_KM) -> DataFrame:
    """Positions with the locations near them, as they arrive; ``locations`` is a table."""
    return vessels_near_locations(stream, locations, km)
