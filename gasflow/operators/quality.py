"""Data quality: duplicates, completeness, issues and suggested fixes, insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasflow.functions.columns import datetime_columns, melt, numeric_columns, text_columns
from gasflow.operators.cleaning import has_geo, missing_report, missing_summary
from gasflow.operators.outliers import iqr_outliers
from gasflow.operators.profiling import per_column

# Columns whose case should be uniform.
STANDARD_CASE_COLUMNS = ("state_abb", "country_code", "category_short")
FAR_OUTLIER_RANGE = 3.0
FAR_OUTLIER_MIN_VALUES = 10


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of equal rows, and their percentage; nulls are equal to nulls."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    total = groups.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_rows"))
    extra = F.col("total_rows") - F.col("distinct_rows")
    return total.select(
        "total_rows",
        extra.alias("duplicate_rows"),
        (F.coalesce(F.try_divide(extra, F.col("total_rows")), F.lit(0.0)) * 100).alias("duplicate_percentage"),
    )


def completeness(df: DataFrame) -> DataFrame:
    """Missing cells, columns that have any, and the share of cells that are present."""
    return missing_summary(df).select(
        "total_missing_values",
        "columns_with_missing",
        (F.lit(1.0) - F.try_divide(F.col("total_missing_values"), F.col("total_cells"))).alias("completeness_score"),
    )


def quality_issues(df: DataFrame) -> DataFrame:
    """``issue, column, count, percentage``, one row per issue found.

    Issues: ``missing`` values, ``duplicate_rows``, ``mixed_case`` in columns with standard values,
    ``outer_spaces`` in text, ``far_outliers`` beyond three quartile ranges.
    """
    missing = missing_report(df).filter("missing_count > 0").select(
        F.lit("missing").alias("issue"), "column", F.col("missing_count").alias("count"), (F.col("missing_rate") * 100).alias("percentage")
    )
    copies = duplicate_rows(df).filter("duplicate_rows > 0").select(
        F.lit("duplicate_rows").alias("issue"),
        F.lit(None).cast("string").alias("column"),
        F.col("duplicate_rows").alias("count"),
        F.col("duplicate_percentage").alias("percentage"),
    )
    issues = missing.unionByName(copies)
    if text := text_columns(df):
        padded = {"count": lambda c: F.count_if(F.regexp_replace(c, r"^\s+|\s+$", "") != F.col(c)), "n": F.count}
        spaces = per_column(df, text, padded).filter("count > 0").select(
            F.lit("outer_spaces").alias("issue"), "column", "count", (F.col("count") / F.col("n") * 100).alias("percentage")
        )
        issues = issues.unionByName(spaces)
    if cased := [c for c in text if c.lower() in STANDARD_CASE_COLUMNS]:
        spellings = melt(df, cased, "string").distinct().groupBy("column", F.upper("value").alias("folded")).count()
        mixed = (
            spellings.filter(F.col("count") > 1)
            .groupBy("column")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(F.lit("mixed_case").alias("issue"), "column", "count", F.lit(None).cast("double").alias("percentage"))
        )
        issues = issues.unionByName(mixed)
    if numbers := numeric_columns(df):
        far = iqr_outliers(df, numbers, FAR_OUTLIER_RANGE)
        far = far.filter((F.col("non_null") > FAR_OUTLIER_MIN_VALUES) & (F.col("count") > 0))
        issues = issues.unionByName(far.select(F.lit("far_outliers").alias("issue"), "column", "count", "percentage"))
    return issues


def suggest_fixes(issues: DataFrame) -> DataFrame:
    """Adds ``suggestion`` to the issues that call for one."""
    kind, share = F.col("issue"), F.col("percentage")
    suggestion = (
        F.when((kind == "missing") & (share > 50), "remove the column")
        .when((kind == "missing") & (share > 10), "impute the column")
        .when(kind == "duplicate_rows", "remove the duplicate rows")
        .when(kind.isin("mixed_case", "outer_spaces"), "standardize the format")
        .when(kind == "far_outliers", "investigate the outliers")
    )
    return issues.withColumn("suggestion", suggestion).filter(F.col("suggestion").isNotNull())


def dataset_summary(df: DataFrame, day: str = "eff_gas_day") -> DataFrame:
    """One row: rows, columns, names, types, missing cells, date range, coordinates available."""
    dated = day in datetime_columns(df)
    span = [F.min(day).alias("first"), F.max(day).alias("last")] if dated else []
    present = [F.count(F.col(c)).alias(f"p{i}") for i, c in enumerate(df.columns)]
    held = sum((F.col(f"p{i}") for i in range(len(df.columns))), F.lit(0))
    text = F.concat_ws(" to ", F.date_format("first", "yyyy-MM-dd"), F.date_format("last", "yyyy-MM-dd"))
    dates = F.when(F.col("first").isNotNull(), text) if dated else F.lit(None).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), *present, *span).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.lit(",".join(df.columns)).alias("names"),
        F.lit(",".join(kind for _, kind in df.dtypes)).alias("types"),
        (F.col("rows") * len(df.columns) - held).alias("missing_values"),
        dates.alias("date_range"),
        F.lit(has_geo(df)).alias("geo_features_available"),
    )


def insights(df: DataFrame) -> DataFrame:
    """``position, rule, value``: size, missing cells, states, days and variability as text; rules that do not hold are left out."""
    names = df.columns
    measures = [F.count(F.lit(1)).alias("rows"), *[F.count(F.col(c)).alias(f"p{i}") for i, c in enumerate(names)]]
    rules: list[tuple[str, Column]] = [("rows", F.col("rows")), ("columns", F.lit(len(names)))]
    cells = F.col("rows") * len(names)
    held = sum((F.col(f"p{i}") for i in range(len(names))), F.lit(0))
    missing = F.try_divide(cells - held, cells) * 100
    rules.append(("missing_percent", F.when((missing > 10) | (missing < 1), F.format_string("%.1f", missing))))
    if "state_abb" in names:
        measures.append(F.count_distinct("state_abb").alias("states"))
        first = df.groupBy("state_abb").count().filter("state_abb is not null").agg(F.min(F.struct(-F.col("count"), "state_abb")).alias("top"))
        rules += [("states", F.col("states")), ("largest_state", first.select("top.state_abb").scalar())]
    if "eff_gas_day" in names:
        measures.append(F.floor((F.unix_timestamp(F.max("eff_gas_day")) - F.unix_timestamp(F.min("eff_gas_day"))) / 86400).alias("days"))
        rules.append(("days", F.col("days")))
    if "scheduled_quantity" in names:
        number = F.col("scheduled_quantity").cast("double")
        measures.append((F.try_divide(F.stddev_samp(number), F.avg(number))).alias("variation"))
        rules.append(("quantity_varies", F.when(F.col("variation") > 1, "true")))
    lines = F.array(*[F.struct(F.lit(i + 1).alias("position"), F.lit(r).alias("rule"), v.cast("string").alias("value")) for i, (r, v) in enumerate(rules)])
    return df.agg(*measures).select(F.inline(lines)).filter(F.col("value").isNotNull())
