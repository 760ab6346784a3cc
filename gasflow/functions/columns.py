"""Column names, column kinds and small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The expected schema of a pipeline nominations table.
EXPECTED_COLUMNS = [
    "pipeline_name",
    "loc_name",
    "connecting_pipeline",
    "connecting_entity",
    "rec_del_sign",
    "category_short",
    "country_name",
    "state_abb",
    "county_name",
    "latitude",
    "longitude",
    "eff_gas_day",
    "scheduled_quantity",
]
COORDINATES = ("latitude", "longitude")


def numeric_columns(df: DataFrame, without: Iterable[str] = ()) -> list[str]:
    """Integer, float and decimal columns in schema order; booleans are not numeric."""
    skip = set(without)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def boolean_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)]


def require(df: DataFrame, *names: str) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")


def holds(condition: Column) -> Column:
    """A comparison as a mask: an unknown outcome counts as false."""
    return F.coalesce(condition, F.lit(False))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN stands for a missing number in float columns; make it null."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def melt(df: DataFrame, columns: Sequence[str], as_type: str, keys: Sequence[str] = ()) -> DataFrame:
    """Long form ``keys, column, value`` without null values."""
    values = [F.col(c).cast(as_type).alias(c) for c in columns]
    return (
        df.select(*keys, *values)
        .unpivot(list(keys), list(columns), "column", "value")
        .filter(F.col("value").isNotNull())
    )
