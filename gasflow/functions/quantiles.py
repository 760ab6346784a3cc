"""Exact quantiles with linear interpolation, also for groups that fit no single task.

The built-in ``percentile`` keeps all distinct values of a group in one task. Here rows are cut into even ranges of key and
value, at rows drawn from all of them. Counts per range show which ranges hold a wanted rank; only their values are counted and
ordered, each range by itself. There is one plan for every size, and no rank can be missed, as the counts are exact. Keys and values
are written to the checkpoint folder once and read three times.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gasflow.functions.chunks import in_ranges
from gasflow.functions.columns import melt
from gasflow.functions.sizing import materialize, spread_out


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    keys: Sequence[str] = (),
    few_keys: bool = False,
) -> DataFrame:
    """``keys, n, q``: non-null count and one interpolated quantile per probability, as an array.

    ``few_keys`` says that the number of key values does not grow with the data (column names, say): the wanted ranges are
    then handed to all tasks, else they are joined. Groups without any value have no row; a null is a key value like
    others; without keys there is always one row.
    """
    return _quantiles(spread_out(df.select(*dict.fromkeys([*keys, value]))), value, probabilities, keys, few_keys)


def _quantiles(df: DataFrame, value: str, probabilities: Sequence[float], keys: Sequence[str], few_keys: bool) -> DataFrame:
    probs = [float(p) for p in probabilities]
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    long = df.select(key.alias("key"), F.col(value).cast("double").alias("value")).filter(F.col("value").isNotNull())
    long = materialize(long)
    ranged = in_ranges(long, F.struct("key", "value")).drop("_cuts")
    totals = ranged.groupBy("key", "_range").agg(F.count(F.lit(1)).alias("held"))
    of_key = Window.partitionBy("key")
    in_order = of_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    totals = totals.withColumns({"before": F.sum("held").over(in_order) - F.col("held"), "n": F.sum("held").over(of_key)})
    ranks = []
    for i, p in enumerate(probs):  # the two values that a quantile lies between
        low = F.floor((F.col("n") - 1) * F.lit(p))
        ranks += [F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.alias("rank")) for side, rank in ((0, low), (1, F.least(low + 1, F.col("n") - 1)))]
    held = lambda r: (r["rank"] >= F.col("before")) & (r["rank"] < F.col("before") + F.col("held"))
    wanted = totals.select("key", "_range", "before", "n", F.filter(F.array(*ranks), held).alias("wanted")).filter(F.size("wanted") > 0)
    if few_keys or not keys:
        some = ranged.join(F.broadcast(wanted), ["key", "_range"])  # at most two ranges per key and probability
        counts = some.groupBy("key", "_range", "before", "n", "wanted", "value").agg(F.count(F.lit(1)).alias("count"))
    else:
        counts = ranged.groupBy("key", "_range", "value").agg(F.count(F.lit(1)).alias("count")).join(wanted, ["key", "_range"])
    by_value = Window.partitionBy("key", "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = counts.withColumn("upto", F.col("before") + F.sum("count").over(by_value))
    inside = lambda r: (r["rank"] < F.col("upto")) & (r["rank"] >= F.col("upto") - F.col("count"))
    met = upto.select("key", "n", "value", F.explode(F.filter("wanted", inside)).alias("w"))
    value_at = lambda i, side: F.max(F.when((F.col("w.i") == i) & (F.col("w.side") == side), F.col("value")))
    pairs = [F.struct(value_at(i, 0).alias("low"), value_at(i, 1).alias("high")).alias(f"q{i}") for i in range(len(probs))]
    found = (met.groupBy("key") if keys else met).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *pairs)

    def between(i: int, p: float) -> Column:
        at = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"q{i}.low"), F.col(f"q{i}.high")
        return F.when(low == high, low).otherwise((F.floor(at) + 1 - at) * low + (at - F.floor(at)) * high)

    q = F.array(*[between(i, p) for i, p in enumerate(probs)])
    return found.select(*[F.col("key")[k].alias(k) for k in keys], "n", F.when(F.col("n") > 0, q).alias("q"))


def column_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """``column, n, q`` for several columns of one table in one pass; rows are spread out before they become one row per value."""
    return _quantiles(melt(spread_out(df.select(*columns)), columns, "double"), "value", probabilities, ["column"], few_keys=True)


def scalar_quantiles(df: DataFrame, column: str, probabilities: Sequence[float]) -> list[Column]:
    """Quantiles of a whole column as scalar subqueries, usable in any expression of another frame.

    They are computed here, once, however often the expressions occur.
    """
    found = materialize(quantiles(df, column, probabilities)).select("q").scalar()
    return [found[i] for i in range(len(probabilities))]
