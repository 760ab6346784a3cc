"""Links between texts or vectors that are compared in tiles: pairs stay inside a task, which returns sums and stars.

A group is cut into tiles of bounded rows and each pair of tiles is one task's work. Of the links a task finds it
returns, for each row, how many there are and the smallest row reachable by them, so what leaves a task grows with its
rows and not with its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasflow.functions.components import connected_components
from gasflow.functions.sizing import materialize

FOUND = "key long, links long, root long"


def wide_hash(*columns: str | Column) -> Column:
    """128 bits of hash as binary; names a class of equal values."""
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0") for seed in (1, 2)]
    return F.unhex(F.concat(*halves))


def numbered(classes: DataFrame) -> DataFrame:
    """Write the classes out with a ``number`` each; links and components run on numbers instead of wide keys."""
    return materialize(classes.withColumn("number", F.monotonically_increasing_id()))


def in_tile_pairs(rows: DataFrame, size: str, member: str, tile_rows: int) -> DataFrame:
    """Each row of a group of ``size`` rows once for each pair of tiles that its own tile is in: adds ``tile``, ``left``, ``right``."""
    tiles = F.greatest(F.ceil(F.col(size) / tile_rows), F.lit(1)).cast("int")
    cut = rows.withColumn("tile", F.pmod(F.xxhash64(member), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    return cut.withColumns({"left": F.least("tile", "other"), "right": F.greatest("tile", "other")}).drop("other")


def stars(adjacent: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Smallest reachable place for rows and columns of a link matrix; columns are numbered after the rows, or are
    the rows themselves if ``same``."""
    n, m = adjacent.shape
    left, right = np.arange(n), np.arange(m) if same else np.arange(n, n + m)
    far = n + m
    while True:
        new_left = np.minimum(left, np.where(adjacent, right, far).min(1, initial=far))
        if same:
            new_left = np.minimum(new_left, np.where(adjacent, left[:, None], far).min(0, initial=far))
            new_left = np.minimum(new_left, new_left[new_left])
            new_right = new_left
        else:
            new_right = np.minimum(right, np.where(adjacent, new_left[:, None], far).min(0, initial=far))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def found_rows(keys: list[int], copies: np.ndarray, tile: np.ndarray, left: int, right: int, adjacent: np.ndarray) -> pa.Table:
    """Links and roots of the rows of two tiles. ``adjacent`` has the rows of tile ``left`` by those of tile ``right``; where
    both are one tile its diagonal is ignored."""
    a, b = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    if left == right:
        np.fill_diagonal(adjacent, False)
    root_a, root_b = stars(adjacent, left == right)
    order = a if left == right else np.concatenate((a, b))
    rows = list(zip(a, (adjacent @ copies[b]).tolist(), order[root_a], strict=True))
    if left != right:
        rows += zip(b, (copies[a] @ adjacent).tolist(), order[root_b], strict=True)
    rows = [(keys[i], int(n), keys[r]) for i, n, r in rows if n]
    types = (pa.int64(), pa.int64(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "links", "root"])


def joined_up(classes: DataFrame, found: DataFrame) -> DataFrame:
    """``key, n_links, class_id`` for numbered classes ``key, first_id, copies``: direct links of each member, own copies
    included, and the smallest id that links reach. Other columns of the classes are kept."""
    found = materialize(found)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("key <> root").select(F.col("key").alias("a"), F.col("root").alias("b")))
    named = classes.join(links, "key", "left").join(parts.select(F.col("node").alias("key"), "component"), "key", "left")
    named = named.withColumn("component", F.coalesce("component", "key"))
    least = named.filter("links > 0").groupBy("component").agg(F.min("first_id").alias("least_id"))
    kept = [c for c in classes.columns if c not in ("first_id", "copies")]
    return named.join(least, "component", "left").select(
        *kept, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least_id", "first_id").alias("class_id")
    )
