"""Correlation, analysis of variance and feature scaling."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.functions.columns import require, text_columns
from gasflow.functions.ranks import with_average_ranks
from gasflow.operators.outliers import default_features
from gasflow.operators.relational import drop_incomplete

STRONG = 0.7
SIGNIFICANT = 0.05
MOST_PAIRWISE = 20
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


def _pairs(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``first, second, variable1, variable2, <name>`` for the upper triangle, in column order."""
    spark = df.sparkSession
    if len(columns) <= MOST_PAIRWISE:
        entries = []
        for (i, a), (j, b) in combinations(enumerate(columns), 2):
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            # corr() raises on a constant column in ANSI mode
            entries.append((i, j, a, b, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))))
        wide = df.agg(*[e[4].alias(f"r{n}") for n, e in enumerate(entries)])
        rows = [
            F.struct(
                F.lit(i).alias("first"),
                F.lit(j).alias("second"),
                F.lit(a).alias("variable1"),
                F.lit(b).alias("variable2"),
                F.col(f"r{n}").alias(name),
            )
            for n, (i, j, a, b, _) in enumerate(entries)
        ]
        return wide.select(F.inline(F.array(*rows)))
    features = VectorAssembler(inputCols=list(columns), outputCol="features").transform(df)
    matrix = Correlation.corr(features, "features").first()[0].toArray()
    found = [(i, j, columns[i], columns[j], float(matrix[i, j])) for i, j in combinations(range(len(columns)), 2)]
    kept = [(*row[:4], None if math.isnan(row[4]) else row[4]) for row in found]
    return spark.createDataFrame(kept, f"first int, second int, variable1 string, variable2 string, {name} double")


def _complete(df: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    names = list(columns or default_features(df))
    require(df, *names)
    if len(names) < 2:
        raise ValueError("correlation needs at least two numeric columns")
    return drop_incomplete(df.select(*names), names), names


def pearson_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``variable1, variable2, pearson`` over the rows that are complete in all columns.

    By default all numeric columns but the coordinates. A constant column has no correlation (null).
    """
    rows, names = _complete(df, columns)
    return _pairs(rows, names, "pearson").drop("first", "second")


def spearman_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``variable1, variable2, spearman``: the same on average ranks."""
    rows, names = _complete(df, columns)
    return _pairs(with_average_ranks(rows, names), names, "spearman").drop("first", "second")


def strong_correlations(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.5, k: int = 10
) -> DataFrame:
    """The ``k`` strongest pairs whose Pearson or Spearman correlation reaches ``threshold``."""
    rows, names = _complete(df, columns)
    linear = _pairs(rows, names, "pearson")
    ranked = _pairs(with_average_ranks(rows, names), names, "spearman").select("first", "second", "spearman")
    both = linear.join(ranked, ["first", "second"])
    strongest = F.greatest(F.abs("pearson"), F.abs("spearman"))
    shown = F.greatest(F.abs("pearson_correlation"), F.abs("spearman_correlation"))
    return (
        both.filter(strongest >= threshold)
        .select(
            "first",
            "second",
            "variable1",
            "variable2",
            F.round("pearson", 3).alias("pearson_correlation"),
            F.round("spearman", 3).alias("spearman_correlation"),
            F.when(strongest >= STRONG, "strong").otherwise("moderate").alias("strength"),
        )
        .orderBy(shown.desc(), "first", "second")
        .limit(k)
        .drop("first", "second")
    )


def anova_f(df: DataFrame, categories: Sequence[str] | None = None, numbers: Sequence[str] | None = None) -> DataFrame:
    """One-way analysis of variance: ``category, variable, groups, rows, f_statistic``.

    By default the first three text columns against the first three numeric columns that are no
    coordinates. Pairs with a single non-empty group are left out.
    """
    cats = list(categories or text_columns(df)[:3])
    nums = list(numbers or default_features(df)[:3])
    require(df, *cats, *nums)
    centre = df.agg(F.struct(*[F.avg(F.col(n).cast("double")).alias(n) for n in nums]).alias("centre")).scalar()
    centred = df.select(
        *[F.col(c).cast("string").alias(f"c_{c}") for c in cats],
        *[(F.col(n).cast("double") - centre.getField(n)).alias(f"n_{n}") for n in nums],
    )
    levels = centred.unpivot([f"n_{n}" for n in nums], [f"c_{c}" for c in cats], "category", "level").filter("level is not null")
    groups = levels.groupBy("category", "level").agg(
        *[
            F.struct(F.count(f"n_{n}").alias("n"), F.avg(f"n_{n}").alias("mean"), F.var_pop(f"n_{n}").alias("var")).alias(n)
            for n in nums
        ]
    )
    long = groups.select(
        F.expr("substring(category, 3)").alias("category"),
        F.inline(F.array(*[F.struct(F.lit(n).alias("variable"), F.col(f"{n}.n"), F.col(f"{n}.mean"), F.col(f"{n}.var")) for n in nums])),
    ).filter("n > 0")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - F.pow(F.sum(F.col("n") * F.col("mean")), 2) / F.sum("n")
    sums = long.groupBy("category", "variable").agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("rows"),
        between.alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
    )
    explained = F.col("between") / (F.col("groups") - 1)
    ratio = F.when((F.col("within") == 0) & (explained > 0), F.lit(float("inf"))).otherwise(
        F.try_divide(explained, F.try_divide(F.col("within"), F.col("rows") - F.col("groups")))
    )
    return sums.filter("groups > 1").select("category", "variable", "groups", "rows", ratio.alias("f_statistic"))


def anova(df: DataFrame, categories: Sequence[str] | None = None, numbers: Sequence[str] | None = None) -> DataFrame:
    """``anova_f`` with the p-value of each pair; figures rounded to three places."""
    found = anova_f(df, categories, numbers)
    p = _f_tail(F.col("f_statistic"), (F.col("groups") - 1).cast("double"), (F.col("rows") - F.col("groups")).cast("double"))
    return found.withColumn("p", p).select(
        "category",
        "variable",
        F.round("f_statistic", 3).alias("f_statistic"),
        F.round("p", 3).alias("p_value"),
        (F.col("p") < SIGNIFICANT).alias("significant"),
    )


@F.pandas_udf(T.DoubleType())
def _f_tail(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
    """Upper tail of the F distribution; the frame has one row per pair of columns."""
    values = [None if pd.isna(x) else f_tail(x, b, w) for x, b, w in zip(f, between, within)]
    return pd.Series(values, dtype="float64")


def f_tail(f: float, between: float, within: float) -> float:
    """Probability of a larger F, to about nine digits for any degrees of freedom.

    It is a share of the beta distribution. The smaller tail is integrated; the density where it begins is written by
    deviances, so that no two large numbers are subtracted.
    """
    a, b = within / 2, between / 2
    if f <= 0.0 or math.isinf(f):
        return 1.0 if f <= 0.0 else 0.0
    ratio = between * f / within
    x, y = 1.0 / (1.0 + ratio), ratio / (1.0 + ratio)
    return _beta_tail(x, y, a, b) if x * b <= y * a else 1.0 - _beta_tail(y, x, b, a)


def _beta_tail(x: float, y: float, a: float, b: float) -> float:
    """Share of the beta distribution below ``x``, which lies below its mean; ``y`` is 1 - x."""
    n = a + b
    deviance = _deviance(a, n * x) + _deviance(b, n * y)
    density = math.sqrt(a * b / (2 * math.pi * n)) * math.exp(_remainder(n) - _remainder(a) - _remainder(b) - deviance)
    # over s = log(x / t) the integrand falls from 1; panels widen with their distance from the start
    first = min(0.5 * y, y / (a + b))
    edges = np.concatenate([[0.0], first * 1.3 ** np.arange(400)])
    width = np.diff(edges)[:, None] / 2
    s = edges[:-1, None] + width * (1.0 + _NODES)
    fall = -a * s + (b - 1.0) * np.log1p(x / y * -np.expm1(-s))
    return density / y * float((width * _WEIGHTS * np.exp(fall)).sum())


def _deviance(value: float, expected: float) -> float:
    """value * log(value / expected) + expected - value."""
    e = (expected - value) / value
    if abs(e) < 1e-3:
        return value * e * e * (1 / 2 - e * (1 / 3 - e * (1 / 4 - e * (1 / 5 - e / 6))))
    return value * (e - math.log(expected / value)) if expected > 0.0 else math.inf


def _remainder(z: float) -> float:
    """What Stirling's formula leaves of the logarithm of the gamma function."""
    if z < 16:
        return math.lgamma(z) - (z - 0.5) * math.log(z) + z - 0.5 * math.log(2 * math.pi)
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * z * z)) / (z * z)) / (z * z)) / z


def scale_features(df: DataFrame, columns: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Complete rows with each feature as (value - mean) / population deviation; a constant feature is 0.

    ``keep`` names columns to carry along unscaled, such as a row id.
    """
    names = list(columns or [c for c in default_features(df) if c not in keep])
    rows = drop_incomplete(df, names)
    stats = rows.agg(
        F.struct(
            *[
                F.struct(F.avg(F.col(c).cast("double")).alias("mean"), F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(c)
                for c in names
            ]
        ).alias("stats")
    ).scalar()

    def scaled(c: str) -> Column:
        found = stats.getField(c)
        return ((F.col(c).cast("double") - found["mean"]) / F.when(found["std"] > 0, found["std"]).otherwise(1.0)).alias(c)

    return rows.select(*keep, *[scaled(c) for c in names])
