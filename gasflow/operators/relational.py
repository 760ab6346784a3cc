"""Filters, projection, samples, top-k and plain aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasflow.functions.columns import numeric_columns, require
from gasflow.functions.quantiles import column_quantiles


def _equals(column: Column, value: Any) -> Column:
    return column == F.lit(value)


def _one_of(column: Column, values: Sequence[Any]) -> Column:
    return column.isin(list(values))


def _above(column: Column, bound: Any) -> Column:
    return column > F.lit(bound)


def _below(column: Column, bound: Any) -> Column:
    return column < F.lit(bound)


def _between(column: Column, bounds: Sequence[Any]) -> Column:
    low, high = bounds
    return column.between(F.lit(low), F.lit(high))


# In order of precedence: a condition that names several uses the first.
PREDICATES = {
    "equals": _equals,
    "in": _one_of,
    "greater_than": _above,
    "less_than": _below,
    "between": _between,
}


def apply_filters(df: DataFrame, filters: Mapping[str, Any] | None) -> DataFrame:
    """Keep the rows that meet all conditions; conditions on unknown columns are skipped."""
    for name, condition in (filters or {}).items():
        if name not in df.columns:
            continue
        if not isinstance(condition, Mapping):
            df = df.filter(_equals(df[name], condition))
            continue
        chosen = next((p for p in PREDICATES if p in condition), None)
        if chosen:
            df = df.filter(PREDICATES[chosen](df[name], condition[chosen]))
    return df


def select_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The listed columns; none listed means all."""
    if not columns:
        return df
    require(df, *columns)
    return df.select(*columns)


def sample_rows(df: DataFrame, by: str | Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in the order of ``by``."""
    return df.orderBy(*([by] if isinstance(by, str) else by)).limit(n)


def unique_values(df: DataFrame, column: str, limit: int = 50) -> DataFrame:
    """The first ``limit`` distinct non-null values, as text in text order."""
    require(df, column)
    first = df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(limit)
    return first.select(F.col(column).cast("string").alias("value")).orderBy("value")


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop a row when any of the columns is null."""
    require(df, *columns)
    return df.na.drop("any", subset=list(columns))


def top_k(df: DataFrame, by: str, ties: str | Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` rows with the largest ``by``; equal values are ordered by ``ties``."""
    names = [ties] if isinstance(ties, str) else list(ties)
    return df.orderBy(F.col(by).desc_nulls_last(), *names).limit(k)


AGGREGATIONS = ("count", "sum", "mean", "median", "max", "min")


def aggregate(df: DataFrame, how: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row of aggregates.

    ``count`` gives ``total_count`` and a non-null count per listed column, or per column when none is; the others give one
    ``<column>_<how>`` per numeric column that is listed, or per numeric column when none is. An
    unknown aggregation gives an empty result, an unknown column an error.
    """
    wanted = list(columns or [])
    require(df, *wanted)
    if how == "count":
        return df.agg(
            F.count(F.lit(1)).alias("total_count"), *[F.count(F.col(c)).alias(f"{c}_count") for c in wanted or df.columns]
        )
    numeric = [c for c in numeric_columns(df) if not wanted or c in wanted]
    if how not in AGGREGATIONS or not numeric:
        return df.sparkSession.createDataFrame([], "nothing string")
    if how == "median":
        rows = column_quantiles(df, numeric, [0.5])
        return rows.agg(*[F.max(F.when(F.col("column") == c, F.col("q")[0])).alias(f"{c}_median") for c in numeric])
    plain = {"mean": F.avg, "max": F.max, "min": F.min}
    if how == "sum":
        return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum") for c in numeric])
    return df.agg(*[plain[how](c).alias(f"{c}_{how}") for c in numeric])
