"""Views that give the driver's tables the shape of pipeline observations and vessel messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def gas_obs(spark: SparkSession, folder: str) -> DataFrame:
    """Daily observations: one row per order, with a unique ``obs_id``."""
    orders = load(spark, folder, "orders")
    customer = load(spark, folder, "customer")
    nation = load(spark, folder, "nation")
    region = load(spark, folder, "region")
    key = F.col("o_orderkey")
    cust = F.col("c_custkey")
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .select(
            key.alias("obs_id"),
            F.col("n_name").alias("pipeline_name"),
            F.col("c_mktsegment").alias("loc_name"),
            F.when(key % 4 == 0, F.col("c_name")).alias("connecting_pipeline"),
            F.when(key % 5 != 0, F.col("c_name")).alias("connecting_entity"),
            F.col("o_orderstatus").alias("rec_del_sign"),
            F.col("o_orderpriority").alias("category_short"),
            F.col("r_name").alias("country_name"),
            F.col("n_name").alias("state_abb"),
            (F.lit(25.0) + (cust % 200) / F.lit(10.0)).alias("latitude"),
            (F.lit(-125.0) + (cust * 7 % 600) / F.lit(10.0)).alias("longitude"),
            F.col("o_orderdate").cast("timestamp").alias("eff_gas_day"),
            F.when(key % 17 != 0, F.col("o_totalprice")).alias("scheduled_quantity"),
        )
    )


def vessels(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """Vessel positions: one row per event; ``events`` may be a stream of the event table."""
    event = F.col("event_id")
    source = load(spark, folder, "events") if events is None else events
    return source.select(
        event.alias("event_id"),
        F.col("user_id").alias("mmsi"),
        F.col("ts").alias("timestamp"),
        (F.lit(25.0) + (event * 13 % 2000) / F.lit(100.0)).alias("latitude"),
        (F.lit(-125.0) + (event * 29 % 6000) / F.lit(100.0)).alias("longitude"),
        (F.lit(60) + event % 30).cast("int").alias("vessel_type"),
    )


def vessel_messages(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    """The same positions as raw JSON messages in a column ``value``."""
    v = vessels(spark, folder, events)
    message = F.struct(
        F.col("mmsi"),
        F.unix_timestamp("timestamp").alias("timestamp"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
        F.col("vessel_type").alias("typeCode"),
    )
    return v.select("event_id", F.to_json(message).alias("value"))
