"""Capacity, utilization, bottlenecks and flow direction of pipelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gasflow.functions.chunks import CHUNK, into_chunks, last_of, with_trailing
from gasflow.functions.columns import holds, require
from gasflow.functions.quantiles import quantiles
from gasflow.functions.sizing import lookup_join, materialize

CAPACITY_QUANTILE = 0.95
HIGH_UTILIZATION = 0.85
BOTTLENECK_WINDOW = 30
BOTTLENECK_MIN = 10


def infer_capacity(
    df: DataFrame,
    q: float = CAPACITY_QUANTILE,
    pipeline: str = "pipeline_name",
    quantity: str = "scheduled_quantity",
    approximate: bool = False,
) -> DataFrame:
    """``pipeline, capacity``: a high quantile of the quantities of each pipeline.

    A pipeline without any quantity has a null capacity. ``approximate`` uses one sketch per pipeline.
    """
    require(df, pipeline, quantity)
    known = df.filter(F.col(pipeline).isNotNull()).select(pipeline, F.col(quantity).cast("double").alias(quantity))
    if approximate:
        return known.groupBy(pipeline).agg(F.percentile_approx(quantity, q, 10_000).alias("capacity"))
    found = quantiles(known, quantity, [q], [pipeline]).select(pipeline, F.col("q")[0].alias("capacity"))
    return known.select(pipeline).distinct().join(found, pipeline, "left")


def capacity_summary(capacity: DataFrame) -> DataFrame:
    """Pipelines analysed and their mean, least and largest capacity; zeros when there is none."""
    zero = F.lit(0.0)
    return capacity.agg(
        F.count(F.lit(1)).alias("pipelines_analyzed"),
        F.coalesce(F.avg("capacity"), zero).alias("avg_capacity"),
        F.coalesce(F.min("capacity"), zero).alias("min_capacity"),
        F.coalesce(F.max("capacity"), zero).alias("max_capacity"),
    )


def utilization(
    df: DataFrame, capacity: DataFrame, pipeline: str = "pipeline_name", quantity: str = "scheduled_quantity"
) -> DataFrame:
    """Add ``capacity`` and ``utilization``; unknown or zero capacity gives null."""
    require(df, pipeline, quantity)
    matched = lookup_join(df, capacity.select(pipeline, "capacity"), pipeline)
    return matched.withColumn("utilization", F.try_divide(F.col(quantity).cast("double"), F.col("capacity")))


def high_utilization(df: DataFrame, threshold: float = HIGH_UTILIZATION) -> DataFrame:
    """The rows whose utilization exceeds the threshold."""
    require(df, "utilization")
    return df.filter(F.col("utilization") > threshold)


def rolling_high_util(
    df: DataFrame,
    threshold: float = HIGH_UTILIZATION,
    window: int = BOTTLENECK_WINDOW,
    pipeline: str = "pipeline_name",
    day: str = "eff_gas_day",
    id: str = "obs_id",
    calendar_days: bool = False,
) -> DataFrame:
    """Add ``high_util`` and ``rolling_high_count``.

    The count covers the last ``window`` rows of the pipeline, ordered by day and then by the unique
    ``id``; with ``calendar_days`` it covers all rows of the last ``window`` days instead. Rows
    without a pipeline have no count. Rows with one are written out once, as their window reads them three times.
    """
    require(df, "utilization", pipeline, day, id)
    flagged = df.withColumn("high_util", holds(F.col("utilization") > threshold))
    high = F.col("high_util").cast("int")
    if calendar_days:
        daily = flagged.withColumn("_epoch", F.datediff(F.to_date(day), F.lit("1970-01-01")))
        per_day = daily.filter(F.col("_epoch").isNotNull()).groupBy(pipeline, "_epoch").agg(F.sum(high).alias("_high"))
        span = Window.partitionBy(pipeline).orderBy("_epoch").rangeBetween(1 - window, 0)
        counts = per_day.select(pipeline, "_epoch", F.sum("_high").over(span).alias("rolling_high_count"))
        return lookup_join(daily, counts, [pipeline, "_epoch"]).select(*flagged.columns, "rolling_high_count")
    known = into_chunks(materialize(flagged.filter(F.col(pipeline).isNotNull())), pipeline, day, id)
    carried = with_trailing(known, pipeline, day, id, F.col("high_util").cast("int"), window - 1, "_before")
    chunk = Window.partitionBy(pipeline, *CHUNK).orderBy(F.col(day).asc_nulls_last(), id)
    at = F.row_number().over(chunk)
    within = F.sum(high).over(chunk.rowsBetween(1 - window, 0))
    placed = carried.withColumns({"_at": at, "_within": within})
    add = F.aggregate(last_of(F.col("_before"), F.lit(window) - F.col("_at")), F.lit(0), lambda total, x: total + x)
    counted = placed.withColumn("rolling_high_count", (F.col("_within") + add).cast("long"))
    unknown = flagged.filter(F.col(pipeline).isNull()).withColumn("rolling_high_count", F.lit(None).cast("long"))
    names = [*flagged.columns, "rolling_high_count"]
    return counted.select(*names).unionByName(unknown.select(*names))


def detect_bottlenecks(
    df: DataFrame,
    threshold: float = HIGH_UTILIZATION,
    window: int = BOTTLENECK_WINDOW,
    min_days: int = BOTTLENECK_MIN,
    pipeline: str = "pipeline_name",
    location: str = "loc_name",
    day: str = "eff_gas_day",
    id: str = "obs_id",
    calendar_days: bool = False,
) -> DataFrame:
    """Places with sustained high utilization: peak, number of high rows, first and last day."""
    require(df, location)
    columns = ["utilization", pipeline, location, day, id]
    rolled = rolling_high_util(df.select(*columns), threshold, window, pipeline, day, id, calendar_days)
    sustained = rolled.filter((F.col("rolling_high_count") >= min_days) & F.col(location).isNotNull())
    return sustained.groupBy(pipeline, location).agg(
        F.max("utilization").alias("peak_utilization"),
        F.count_if("high_util").alias("high_util_days"),
        F.min(day).alias("first_bottleneck_date"),
        F.max(day).alias("last_bottleneck_date"),
    )


def flow_direction_changes(
    df: DataFrame,
    direction: str = "rec_del_sign",
    pipeline: str = "pipeline_name",
    day: str = "eff_gas_day",
    id: str = "obs_id",
    count_first: bool = True,
) -> DataFrame:
    """``pipeline, direction_changes``: rows whose direction differs from the row before.

    A null differs from everything. The first row of a pipeline has no row before it and counts as a
    change unless ``count_first`` is off. Pipelines without changes are left out.
    """
    require(df, direction, pipeline, day, id)
    known = materialize(df.select(pipeline, day, id, direction).filter(F.col(pipeline).isNotNull()))
    in_order = [F.col(day).asc_nulls_last(), F.col(id)]
    chunked = into_chunks(known, pipeline, day, id)
    carried = with_trailing(chunked, pipeline, day, id, F.col(direction), 1, "_before")
    rows = Window.partitionBy(pipeline, *CHUNK).orderBy(*in_order)
    placed = carried.withColumns({"_at": F.row_number().over(rows), "_lag": F.lag(direction).over(rows)})
    opens = F.col("_at") == 1
    seen = placed.withColumns(
        {
            "_prev": F.when(opens, F.get("_before", F.lit(0))).otherwise(F.col("_lag")),
            "_first": opens & (F.size("_before") == 0),
        }
    )
    differs = F.when(F.col("_prev").isNull() | F.col(direction).isNull(), True).otherwise(F.col(direction) != F.col("_prev"))
    changed = differs if count_first else differs & ~F.col("_first")
    return seen.filter(changed).groupBy(pipeline).agg(F.count(F.lit(1)).alias("direction_changes"))
