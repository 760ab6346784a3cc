"""Descriptions of columns and groups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gasflow.functions.columns import boolean_columns, datetime_columns, melt, numeric_columns, require, text_columns
from gasflow.functions.quantiles import column_quantiles, quantiles
from gasflow.functions.sizing import materialize

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
# How a date written as text begins.
DATE_PATTERNS = (r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}", r"\d{2}-\d{2}-\d{4}", r"\d{4}/\d{2}/\d{2}")
COORDINATE_HINTS = ("lat", "lon", "coord")


def per_column(df: DataFrame, columns: Sequence[str], measures: dict[str, callable]) -> DataFrame:
    """One row per column with the given aggregates of it, all computed in one pass."""
    aggregates = [
        F.struct(F.lit(c).alias("column"), *[f(c).alias(m) for m, f in measures.items()]).alias(f"s{i}")
        for i, c in enumerate(columns)
    ]
    return df.agg(*aggregates).select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(columns))])))


def _number(f: callable) -> callable:
    return lambda c: f(F.col(c).cast("double"))


def describe_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, exact quartiles and maximum per numeric column."""
    names = list(columns or numeric_columns(df))
    basic = {
        "count": F.count,
        "mean": _number(F.avg),
        "std": _number(F.stddev_samp),
        "min": _number(F.min),
        "max": _number(F.max),
    }
    order = ["column", "count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    found = column_quantiles(df, names, [0.25, 0.5, 0.75]).select("column", "q")
    rows = per_column(df, names, basic).join(F.broadcast(found), "column", "left")
    return rows.select(
        "*", F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75")
    ).select(*order)


def moments(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Biased skewness and biased excess kurtosis per numeric column."""
    names = list(columns or numeric_columns(df))
    return per_column(df, names, {"skewness": _number(F.skewness), "kurtosis": _number(F.kurtosis)})


def value_counts(df: DataFrame, column: str, k: int | None = 10) -> DataFrame:
    """``value, count``: the ``k`` most frequent non-null values (all when ``k`` is None)."""
    require(df, column)
    counts = df.groupBy(F.col(column).alias("value")).count().filter(F.col("value").isNotNull())
    in_order = counts.orderBy(F.col("count").desc(), "value")
    return in_order if k is None else in_order.limit(k)


def category_summary(df: DataFrame, columns: Sequence[str] | None = None, k: int = 10) -> DataFrame:
    """Per text column its distinct values, missing values, diversity and ``k`` most frequent values.

    One row per column and listed value; a column without values has one row with a null value.
    """
    names = list(columns or text_columns(df))
    counts = melt(df, names, "string").groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    best = Window.partitionBy("column").orderBy(F.col("count").desc(), "value")
    top = counts.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    missing = per_column(df, names, {"missing_count": lambda c: F.count_if(F.col(c).isNull()), "rows": lambda c: F.count(F.lit(1))})
    unique = F.coalesce("unique_count", F.lit(0))
    return (
        missing.join(F.broadcast(distinct), "column", "left")
        .join(top, "column", "left")
        .select(
            "column",
            unique.alias("unique_count"),
            "missing_count",
            F.coalesce(F.try_divide(unique, F.col("rows")), F.lit(0.0)).alias("diversity_index"),
            "position",
            "value",
            "count",
        )
    )


def group_stats(
    df: DataFrame, key: str, value: str = "scheduled_quantity", top: int | None = None, with_std: bool = True
) -> DataFrame:
    """Mean, median, sample deviation and count of a value per group; ``top`` keeps the largest means."""
    require(df, key, value)
    number = F.col(value).cast("double")
    known = df.filter(F.col(key).isNotNull())
    parts = {"mean": F.avg(number), "std": F.stddev_samp(number), "count": F.count(value)}
    order = [key, "mean", "median", "std", "count"] if with_std else [key, "mean", "median", "count"]
    basic = known.groupBy(key).agg(*[c.alias(n) for n, c in parts.items()])
    middle = quantiles(known, value, [0.5], [key]).select(key, F.col("q")[0].alias("median"))
    stats = basic.join(middle, key, "left")
    stats = stats.select(*order)
    return stats.orderBy(F.col("mean").desc_nulls_last(), key).limit(top) if top else stats


def count_by_period(df: DataFrame, part: str) -> DataFrame:
    """Rows per year, month, weekday or quarter, in its order."""
    require(df, part)
    return df.filter(F.col(part).isNotNull()).groupBy(part).count().orderBy(part)


def weekly_pattern(df: DataFrame, weekday: str = "day_of_week") -> DataFrame:
    """Rows per weekday name, all seven of them."""
    require(df, weekday)
    week = df.sparkSession.createDataFrame(list(enumerate(WEEKDAYS)), "day_number int, weekday string")
    counts = df.groupBy(F.col(weekday).cast("int").alias("day_number")).count()
    return (
        week.join(F.broadcast(counts.filter("day_number between 0 and 6")), "day_number", "left")
        .select("day_number", "weekday", F.coalesce("count", F.lit(0)).alias("count"))
        .orderBy("day_number")
    )


def date_span(df: DataFrame, day: str = "eff_gas_day") -> DataFrame:
    """First and last day as text and the whole days between."""
    require(df, day)
    first, last = F.min(day), F.max(day)
    seconds = F.unix_timestamp("last") - F.unix_timestamp("first")
    return df.agg(first.alias("first"), last.alias("last")).select(
        F.date_format("first", "yyyy-MM-dd").alias("start"),
        F.date_format("last", "yyyy-MM-dd").alias("end"),
        F.floor(seconds / 86400).alias("span_days"),
    )


def geographic_counts(df: DataFrame, k: int = 10) -> DataFrame:
    """``level, value, count``: top states, top countries and all quadrants, whichever columns exist."""
    levels = [("state", "state_abb", k), ("country", "country_name", k), ("quadrant", "geographic_quadrant", None)]
    parts = [
        value_counts(df, column, limit).select(F.lit(level).alias("level"), "value", "count")
        for level, column, limit in levels
        if column in df.columns
    ]
    if not parts:
        raise ValueError("no state_abb, country_name or geographic_quadrant column")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def diversity_index(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per row of the table; ``approximate`` counts them with a sketch."""
    require(df, column)
    distinct = F.approx_count_distinct(column) if approximate else F.count_distinct(F.col(column))
    return df.agg(distinct.alias("unique_count"), F.count(F.lit(1)).alias("total_rows")).select(
        F.lit(column).alias("column"),
        "unique_count",
        "total_rows",
        F.coalesce(F.try_divide(F.col("unique_count"), F.col("total_rows")), F.lit(0.0)).alias("diversity_index"),
    )


def crosstab(df: DataFrame, rows: str, columns: str, values: Sequence | None = None) -> DataFrame:
    """Contingency table with zeros; null keys are left out.

    Without ``values`` the column values are looked up first. Their number is limited by
    ``spark.sql.pivotMaxValues``; use ``crosstab_long`` beyond that.
    """
    known = df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull())
    table = known.groupBy(rows).pivot(columns, list(values) if values else None).count()
    return table.na.fill(0)


def crosstab_long(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """The occupied cells of the contingency table, one per row."""
    return df.filter(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows, columns).count()


def distinct_counts(df: DataFrame) -> DataFrame:
    """One row with the distinct non-null values of each column, ``u0`` and on in column order.

    Each column is counted by itself, so a row that is shuffled is one value; ``df`` is read once per column.
    """
    parts = [
        df.select(F.col(c).alias("value")).distinct().agg(F.lit(i).alias("i"), F.count("value").alias("n"))
        for i, c in enumerate(df.columns)
    ]
    counted = reduce(DataFrame.unionByName, parts)
    return counted.agg(*[F.max(F.when(F.col("i") == i, F.col("n"))).alias(f"u{i}") for i in range(len(parts))])


def _counted(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The table, written once as it is read once per column, and its distinct counts."""
    held = materialize(df)
    return held, distinct_counts(held)


def column_profile(df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """Per column type, null and distinct counts, kind flags and, for numbers, range, mean, median, deviation.

    A boolean column without nulls counts as a number here. ``distinct`` are the ``distinct_counts`` if known.
    """
    df, distinct = (df, distinct) if distinct else _counted(df)
    numeric, flags = set(numeric_columns(df)), set(boolean_columns(df))
    text, dates = set(text_columns(df)), set(datetime_columns(df))
    kinds = dict(df.dtypes)
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        measures.append(F.count(F.col(c)).alias(f"n{i}"))
        if c in numeric | flags:
            number = F.col(c).cast("double")
            figures = {"min": F.min(number), "max": F.max(number), "mean": F.avg(number), "std": F.stddev_samp(number)}
            measures.append(F.struct(*[f.alias(n) for n, f in figures.items()]).alias(f"m{i}"))
    nothing = F.lit(None).cast("struct<min:double,max:double,mean:double,std:double>")
    rows = []
    for i, c in enumerate(df.columns):
        whole = F.col(f"n{i}") == F.col("rows")
        counts = whole if c in flags else F.lit(c in numeric)
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kinds[c]).alias("dtype"),
                F.col(f"n{i}").alias("non_null_count"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.col(f"u{i}").alias("unique_count"),
                counts.alias("is_numeric"),
                F.lit(c in text).alias("is_categorical"),
                F.lit(c in dates).alias("is_datetime"),
                (F.when(counts, F.col(f"m{i}")) if c in numeric | flags else nothing).alias("m"),
            )
        )
    base = df.agg(*measures).crossJoin(distinct).select(F.inline(F.array(*rows))).select("*", "m.*").drop("m")
    if not numeric | flags:
        return base.withColumn("median", F.lit(None).cast("double"))
    middle = column_quantiles(df, sorted(numeric | flags), [0.5]).select("column", F.col("q")[0].alias("median"))
    joined = base.join(F.broadcast(middle), "column", "left")
    return joined.withColumn("median", F.when(F.col("is_numeric"), F.col("median")))


def profile_values(df: DataFrame, most: int = 20, k: int = 10) -> DataFrame:
    """Top values of the text columns that have at most ``most`` distinct ones."""
    return category_summary(df, k=k).filter((F.col("unique_count") <= most) & F.col("value").isNotNull()).select(
        "column", "position", "value", "count"
    )


def infer_column_kind(df: DataFrame, distinct: DataFrame | None = None) -> DataFrame:
    """``column, kind`` with its counts; the first rule that applies decides.

    empty, identifier (numbers, all distinct), numeric (booleans without nulls too), datetime, date_string (more than half of the
    values begin like a date), categorical (fewer distinct values than half of the values),
    coordinate (by name, some value is a number; ``unknown`` when none is), text. The date share is taken over all
    values: rows of a distributed table have no first hundred. ``distinct`` are the ``distinct_counts`` if known.
    """
    df, distinct = (df, distinct) if distinct else _counted(df)
    numeric, flags, dates = set(numeric_columns(df)), set(boolean_columns(df)), set(datetime_columns(df))
    like_date = "^(" + "|".join(DATE_PATTERNS) + ")"
    measures = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        text = F.col(c).cast("string")
        measures.append(F.count(F.col(c)).alias(f"n{i}"))
        if c not in numeric | dates:
            measures.append(F.avg(text.rlike(like_date).cast("double")).alias(f"d{i}"))
            measures.append(F.count(text.try_cast("double")).alias(f"c{i}"))

    def kind(i: int, c: str) -> Column:
        found, distinct = F.col(f"n{i}"), F.col(f"u{i}")
        rule = F.when(found == 0, "empty")
        if c in numeric:
            return rule.when(distinct == found, "identifier").otherwise("numeric")
        if c in dates:
            return rule.otherwise("datetime")
        if c in flags:
            whole = found == F.col("rows")
            rule = rule.when(whole & (distinct == found), "identifier").when(whole, "numeric")
        rule = rule.when(F.col(f"d{i}") > 0.5, "date_string").when(distinct < found * 0.5, "categorical")
        if any(hint in c.lower() for hint in COORDINATE_HINTS):
            return rule.when(F.col(f"c{i}") > 0, "coordinate").otherwise("unknown")
        return rule.otherwise("text")

    rows = [
        F.struct(
            F.lit(c).alias("column"),
            kind(i, c).alias("kind"),
            (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
            (F.coalesce(F.try_divide(F.col("rows") - F.col(f"n{i}"), F.col("rows")), F.lit(0.0)) * 100).alias("null_percentage"),
            F.col(f"u{i}").alias("unique_count"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(*measures).crossJoin(distinct).select(F.inline(F.array(*rows)))
