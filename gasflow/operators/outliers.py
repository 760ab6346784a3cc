"""Outliers by deviation and by quartile range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gasflow.functions.columns import COORDINATES, holds, numeric_columns, require
from gasflow.functions.quantiles import column_quantiles
from gasflow.functions.sizing import materialize
from gasflow.operators.profiling import per_column

Z_LIMIT = 3.0
PATTERN_Z_LIMIT = 2.0
QUARTILE_RANGE = 1.5


def default_features(df: DataFrame) -> list[str]:
    """Numeric columns other than the coordinates."""
    return numeric_columns(df, without=COORDINATES)


def _share(count: str, of: str) -> Column:
    return (F.coalesce(F.try_divide(F.col(count), F.col(of)), F.lit(0.0)) * 100).alias("percentage")


def _spread(df: DataFrame, columns: Sequence[str]) -> Column:
    """Mean and population deviation of each column as one scalar subquery."""
    parts = []
    for c in columns:
        number = F.col(c).cast("double")
        parts.append(F.struct(F.avg(number).alias("mean"), F.stddev_pop(number).alias("std")).alias(c))
    return df.agg(F.struct(*parts).alias("spread")).scalar()


def _far(spread: Column, column: str, limit: float) -> Column:
    """More than ``limit`` population deviations from the mean; a constant column has no such value."""
    found = spread.getField(column)
    return holds((found["std"] > 0) & (F.abs(F.col(column) - found["mean"]) > found["std"] * F.lit(limit)))


def _fences(df: DataFrame, columns: Sequence[str], k: float) -> dict[str, tuple[Column, Column]]:
    """Lower and upper bound of each column; all of them come from one scalar subquery."""
    found = materialize(column_quantiles(df, columns, [0.25, 0.75]))
    quartiles = found.agg(F.map_from_entries(F.collect_list(F.struct("column", "q")))).scalar()
    bounds = {}
    for c in columns:
        q1, q3 = quartiles[c][0], quartiles[c][1]
        bounds[c] = (q1 - F.lit(k) * (q3 - q1), q3 + F.lit(k) * (q3 - q1))
    return bounds


def zscore_outliers(df: DataFrame, columns: Sequence[str] | None = None, limit: float = Z_LIMIT) -> DataFrame:
    """``column, non_null, count, percentage`` of the values far from the mean."""
    names = list(columns or default_features(df))
    require(df, *names)
    spread = _spread(df, names)
    counted = {"non_null": F.count, "count": lambda c: F.count_if(_far(spread, c, limit))}
    return per_column(df, names, counted).select("*", _share("count", "non_null"))


def zscore_outlier_rows(df: DataFrame, column: str, id: str, limit: float = Z_LIMIT, n: int | None = 10) -> DataFrame:
    """The first ``n`` such rows in the order of ``id`` (all when None)."""
    rows = df.filter(_far(_spread(df, [column]), column, limit))
    return rows if n is None else rows.orderBy(id).limit(n)


def iqr_outliers(df: DataFrame, columns: Sequence[str] | None = None, k: float = QUARTILE_RANGE) -> DataFrame:
    """``column, non_null, lower_bound, upper_bound, count, percentage`` of the values outside the fences."""
    names = list(columns or default_features(df))
    require(df, *names)
    bounds = _fences(df, names, k)
    measures = {
        "non_null": F.count,
        "lower_bound": lambda c: F.max(bounds[c][0]),
        "upper_bound": lambda c: F.max(bounds[c][1]),
        "count": lambda c: F.count_if((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1])),
    }
    return per_column(df, names, measures).select("*", _share("count", "non_null"))


def iqr_outlier_rows(df: DataFrame, column: str, id: str, k: float = QUARTILE_RANGE, n: int | None = 10) -> DataFrame:
    low, high = _fences(df, [column], k)[column]
    rows = df.filter(holds((F.col(column) < low) | (F.col(column) > high)))
    return rows if n is None else rows.orderBy(id).limit(n)


def first_zscore_rows(df: DataFrame, id: str, columns: Sequence[str], limit: float = Z_LIMIT, n: int = 10) -> DataFrame:
    """``column, <id>, value``: the first ``n`` values far from the mean of each column, in the order of ``id``."""
    spread = _spread(df, columns)
    return _first(df, id, {c: _far(spread, c, limit) for c in columns}, n)


def first_iqr_rows(df: DataFrame, id: str, columns: Sequence[str], k: float = QUARTILE_RANGE, n: int = 10) -> DataFrame:
    """``column, <id>, value``: the first ``n`` values outside the fences of each column, in the order of ``id``."""
    outside = {c: holds((F.col(c) < low) | (F.col(c) > high)) for c, (low, high) in _fences(df, columns, k).items()}
    return _first(df, id, outside, n)


def _first(df: DataFrame, id: str, flags: dict[str, Column], n: int) -> DataFrame:
    each = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), flag.alias("flagged")) for c, flag in flags.items()]
    found = df.select(id, F.inline(F.array(*each))).filter("flagged")
    place = F.row_number().over(Window.partitionBy("column").orderBy(id))
    return found.withColumn("place", place).filter(F.col("place") <= n).select("column", id, "value")


def numeric_patterns(df: DataFrame, columns: Sequence[str] | None = None, first: int = 5) -> DataFrame:
    """Mean, median, sample deviation, skewness, kurtosis and share of values beyond two deviations."""
    names = list(columns or numeric_columns(df)[:first])
    spread = _spread(df, names)
    basic = {
        "non_null": F.count,
        "mean": lambda c: F.avg(F.col(c).cast("double")),
        "std": lambda c: F.stddev_samp(F.col(c).cast("double")),
        "skewness": lambda c: F.skewness(F.col(c).cast("double")),
        "kurtosis": lambda c: F.kurtosis(F.col(c).cast("double")),
        "far": lambda c: F.count_if(_far(spread, c, PATTERN_Z_LIMIT)),
    }
    middle = column_quantiles(df, names, [0.5]).select("column", F.col("q")[0].alias("median"))
    return (
        per_column(df, names, basic)
        .join(F.broadcast(middle), "column", "left")
        .select(
            "column",
            "mean",
            "median",
            "std",
            "skewness",
            "kurtosis",
            (F.try_divide(F.col("far"), F.col("non_null")) * 100).alias("outlier_percentage"),
        )
    )
