"""Average ranks of whole columns without ordering any of them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gasflow.functions.chunks import in_ranges
from gasflow.functions.columns import melt
from gasflow.functions.sizing import dealt_out, materialize

#: A value that more than one in so many rows has is frequent, so a column has fewer frequent values than this.
FREQUENT = 1000


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, value, rank, held`` for each distinct non-null value; equal values share their mean rank. ``held`` are the rows that have the value.

    Distinct values are counted first, so a hot value is one row. They are cut into even ranges of column and value; a rank
    is a value's place in its range and what all ranges before it hold.
    """
    counts = melt(df, columns, "double").groupBy("column", "value").agg(F.count(F.lit(1)).alias("held"))
    counts = materialize(counts)
    ranged = in_ranges(counts, F.struct("column", "value")).drop("_cuts")
    in_order = Window.partitionBy("column").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        ranged.groupBy("column", "_range")
        .agg(F.sum("held").alias("in_range"))
        .withColumn("before", F.sum("in_range").over(in_order) - F.col("in_range"))
        .select("column", "_range", "before")
    )  # a row per column and range
    within = Window.partitionBy("column", "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("before") + F.sum("held").over(within)
    placed = dealt_out(ranged, counts.count(), "column", "_range").join(F.broadcast(starts), ["column", "_range"])
    return placed.select("column", "value", (upto - (F.col("held") - 1) / 2).alias("rank"), "held")


def with_average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each column by its average rank over the table; rows must be complete.

    The rows are written once with a number. Ranks of frequent values, of which there are few, go to the rows where they are.
    Whatever the number of columns, there is one join of the other values in long form to their ranks, and one regrouping
    by row, both dealt out so that a task has its share of rows only, however many there are.
    """
    numbered = df.select(F.monotonically_increasing_id().alias("row"), *[F.col(c).cast("double").alias(c) for c in columns])
    numbered = materialize(numbered)
    rows = numbered.count()
    ranks = materialize(average_ranks(numbered, columns))
    frequent = F.col("held") * FREQUENT > rows
    known = numbered
    for i, c in enumerate(columns):
        of_column = ranks.filter(frequent & (F.col("column") == c)).select(F.col("value").alias(c), F.col("rank").alias(f"r{i}"))
        known = known.join(F.broadcast(of_column), c, "left")
    values = [F.struct(F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(c).alias("value"), F.col(f"r{i}").alias("known")) for i, c in enumerate(columns)]
    others = known.select("row", F.inline(F.array(*values))).filter("known is null")
    # A key of doubles would be shuffled a second time by the join, so rows meet by a hash of them; equality is tested beside it.
    hashed = F.xxhash64("column", F.col("value") + 0.0).alias("hash")
    left = dealt_out(others.select("row", "i", "value", hashed), rows * len(columns), "hash")
    place = F.array_position(F.array(*[F.lit(c) for c in columns]), F.col("column")).cast("int") - 1
    right = ranks.filter(~frequent).select(hashed, place.alias("of"), F.col("value").alias("like"), "rank")
    same = F.col("i").between(F.col("of"), F.col("of")) & F.col("value").between(F.col("like"), F.col("like"))
    met = left.join(right, "hash").filter(same)
    found = met.select("row", *[F.when(F.col("i") == i, F.col("rank")).alias(f"r{i}") for i in range(len(columns))])
    whole = known.select("row", *[f"r{i}" for i in range(len(columns))]).unionByName(found)
    ranked = dealt_out(whole, rows * len(columns), "row").groupBy("row")
    return ranked.agg(*[F.max(f"r{i}").alias(c) for i, c in enumerate(columns)]).select(*columns)
