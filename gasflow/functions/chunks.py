"""Row windows over long histories.

A window function keeps one key in one task. Here the rows are cut into ranges of (key, time, id), whatever their types, at
rows drawn from all of them; a chunk is what a range holds of one key. Each chunk is ordered on its own. Where a key goes on
into the next range, its last rows there are carried over as a short array. The results are those of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows drawn for each range; more of them make the ranges more even.
DRAWN = 20
CHUNK = ["_range"]


def in_ranges(df: DataFrame, row: Column, ranges: int | None = None) -> DataFrame:
    """Add ``_range``, which of some even ranges of ``row`` a row is in, and ``_cuts``, the least rows of all ranges but the first.

    There are as many ranges as shuffle partitions unless told otherwise. The cuts are rows themselves, drawn by a hash from
    all of them, so they depend on nothing but the rows. Equal rows are in one range.
    """
    n = ranges or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    drawn = df.select(row.alias("row")).orderBy(F.xxhash64("row"), "row").limit(DRAWN * n)
    held = drawn.agg(F.sort_array(F.collect_list("row")).alias("rows"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("rows", F.floor(i * F.size("rows") / n).cast("int")))
    cuts = held.select(F.array_distinct(F.filter(at, lambda r: r.isNotNull())).alias("cuts")).scalar()
    ranged = df.withColumns({"_cuts": cuts, "_row": row, "_range": F.lit(0)})
    for step in (1 << i for i in reversed(range(n.bit_length()))):  # how many cuts are not above the row, bit by bit
        passed = F.get("_cuts", F.col("_range") + F.lit(step - 1)) <= F.col("_row")
        ranged = ranged.withColumn("_range", F.col("_range") + F.when(passed, step).otherwise(0))
    return ranged.drop("_row")


def into_chunks(df: DataFrame, key: str, day: str, id: str, ranges: int | None = None) -> DataFrame:
    """Add ``_range``, and the flags ``_opens`` and ``_goes_on``: the key has rows in the range before, in the range after.

    Rows must have a key; rows without a day come last.
    """
    row = F.struct(F.col(key).alias("key"), F.col(day).isNull().alias("open"), F.col(day).alias("day"), F.col(id).alias("id"))
    same = lambda place: F.coalesce(F.get("_cuts", place)["key"] == F.col(key), F.lit(False))
    placed = in_ranges(df, row, ranges)
    return placed.withColumns({"_opens": same(F.col("_range") - 1), "_goes_on": same(F.col("_range"))}).drop("_cuts")


def with_trailing(chunked: DataFrame, key: str, day: str, id: str, payload: Column, n: int, name: str) -> DataFrame:
    """Add ``name``: the payloads of the up to ``n`` rows before the row's chunk, oldest first."""
    group = [key, *CHUNK]
    latest_first = Window.partitionBy(*group).orderBy(F.col(day).desc_nulls_first(), F.col(id).desc())
    tails = (
        chunked.filter("_goes_on")
        .select(*group, day, id, payload.alias("payload"))
        .withColumn("back", F.row_number().over(latest_first))
        .filter(F.col("back") <= n)
        .groupBy(*group)
        .agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), "payload"))).alias("tail"))
    )  # at most one row per range
    upto = Window.partitionBy(key).orderBy(*CHUNK).rowsBetween(1 - n, 0)
    gathered = F.flatten(F.collect_list(F.col("tail.payload")).over(upto))
    carried = tails.select(key, (F.col("_range") + 1).alias("_range"), last_of(gathered, F.lit(n)).alias(name), F.lit(True).alias("_opens"))
    joined = chunked.join(carried, [*group, "_opens"], "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(carried.schema[name].dataType))).drop("_opens", "_goes_on")


def last_of(array: Column, n: Column) -> Column:
    """The last ``n`` elements of an array, or all when there are fewer."""
    return F.slice(array, F.greatest(F.size(array) - n, F.lit(0)) + 1, F.greatest(n, F.lit(0)))
