"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are turned into the basis of the principal components, where the leading dimensions carry most of a product. Rows of a
label are cut into tiles along the first component; tiles too far apart there are never compared. For a pair of tiles the
leading dimensions are multiplied first; the product of what is left is bounded by the norms of the suffixes, and rows and
columns that cannot reach the threshold are dropped before the next dimensions are added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasflow.functions.sizing import materialize
from gasflow.llm.links import FOUND, found_rows, joined_up, numbered, wide_hash

THRESHOLD = 0.93
TILE_ROWS = 1024
LEADING = 4
SLACK = 1e-9


def bounded_cosines(x: np.ndarray, y: np.ndarray, threshold: float, leading: int = LEADING) -> np.ndarray:
    """Which rows of ``x`` and ``y`` (unit vectors, leading dimensions first) have a cosine of ``threshold`` or more."""
    out = np.zeros((len(x), len(y)), bool)
    rows, columns = np.arange(len(x)), np.arange(len(y))
    products, at, d = np.zeros((len(x), len(y))), 0, x.shape[1]
    while at < d and products.size:
        upto = min(d, max(leading, 2 * at))
        products += x[rows, at:upto] @ y[columns, at:upto].T
        at = upto
        rest = np.sqrt((x[rows, at:] ** 2).sum(1))[:, None] * np.sqrt((y[columns, at:] ** 2).sum(1))[None, :]
        able = products + rest >= threshold - SLACK
        keep_rows, keep_columns = able.any(1), able.any(0)
        rows, columns, products = rows[keep_rows], columns[keep_columns], products[keep_rows][:, keep_columns]
    out[np.ix_(rows, columns)] = products >= threshold
    return out


def _basis(units: DataFrame, d: int) -> np.ndarray:
    """Principal axes of the vectors of ``d`` dimensions, as columns."""
    own = units.filter(F.col("dims") == d).select(array_to_vector("unit").alias("unit"))
    if d == 1 or len(own.head(2)) < 2:
        return np.eye(d)
    axes = PCA(k=d, inputCol="unit", outputCol="turned").fit(own).pc.toArray()
    return axes if np.allclose(axes.T @ axes, np.eye(d), atol=1e-9) else np.eye(d)


def link_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, id: str = "vec_id", vector: str = "embedding", label: str = "label", tile_rows: int = TILE_ROWS
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Rows with equal labels and vectors of equal length are compared; null labels, and vectors that are null, empty, zero
    or hold nulls, NaN or infinities, link with nothing and are components of their own. Equal vectors of a label are one
    class that is compared once, so a group of copies costs what one vector does. Repeated rows count as links of each
    other. A null id is never the name of a component that has others. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    # -0.0 and 0.0 are one number
    rows = rows.withColumn("key", F.when(usable, wide_hash("label", F.transform("v", lambda x: x + 0.0))))
    classes = numbered(
        rows.filter("key is not null").groupBy("key", "label").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v"))
    )
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = classes.withColumn("v", F.transform("v", lambda x: x / top))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    units = scaled.select(F.col("number").alias("key"), "label", "copies", F.transform("v", lambda x: x / norm).alias("unit"), F.size("v").alias("dims"))
    bases = {r.dims: _basis(units, r.dims) for r in units.select("dims").distinct().collect()}
    tiles = materialize(_cut(units, bases, tile_rows))
    found = _compare(tiles, threshold)
    results = joined_up(classes.select(F.col("number").alias("key"), F.col("key").alias("wide"), "first_id", "copies"), found)
    return rows.select("id", F.col("key").alias("wide")).join(results, "wide", "left").select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("class_id", "id").alias("component_id"),
        F.col("id").eqNullSafe(F.coalesce("class_id", "id")).alias("kept"),
    )


def _cut(units: DataFrame, bases: dict[int, np.ndarray], tile_rows: int) -> DataFrame:
    """Turned vectors with the tile they are in: runs of at most ``tile_rows`` rows along the first component."""
    spark = units.sparkSession
    shipped = spark.sparkContext.broadcast(bases)
    label = units.schema["label"].dataType.simpleString()

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned = [(np.asarray(u) @ shipped.value[len(u)]) for u in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], batch.column(4), pa.array([float(t[0]) for t in turned], pa.float64()), pa.array([t.tobytes() for t in turned], pa.binary())],
                names=["key", "label", "copies", "dims", "first", "unit"],
            )

    turned = units.mapInArrow(turn, f"key long, label {label}, copies long, dims int, first double, unit binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_order = turned.repartitionByRange(parts, "label", "dims", "first", "key").sortWithinPartitions("label", "dims", "first", "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, group = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            numbers = []
            for now in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if now != group or held == tile_rows:
                    tile, held, group = tile + 1, 0, now
                held += 1
                numbers.append(tile)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=[*batch.schema.names, "tile"])

    return in_order.mapInArrow(cut, f"key long, label {label}, copies long, dims int, first double, unit binary, tile long")


def _compare(tiles: DataFrame, threshold: float) -> DataFrame:
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK
    spans = tiles.groupBy("label", "dims", "tile").agg(F.min("first").alias("low"), F.max("first").alias("high"))
    a, b = spans.alias("a"), spans.alias("b")
    near = (F.col("a.tile") <= F.col("b.tile")) & (F.col("b.low") <= F.col("a.high") + reach) & (F.col("a.low") <= F.col("b.high") + reach)
    pairs = a.join(b, (F.col("a.label") == F.col("b.label")) & (F.col("a.dims") == F.col("b.dims")) & near)
    pairs = pairs.select(F.col("a.tile").alias("left"), F.col("b.tile").alias("right"))
    sides = pairs.select("*", F.explode(F.array_distinct(F.array("left", "right"))).alias("tile"))

    def compare(table: pa.Table) -> pa.Table:
        tile = table["tile"].to_numpy()
        left, right = table["left"][0].as_py(), table["right"][0].as_py()
        units = np.stack([np.frombuffer(u, np.float64) for u in table["unit"].to_pylist()])
        adjacent = bounded_cosines(units[tile == left], units[tile == right], threshold)
        return found_rows(table["key"].to_pylist(), table["copies"].to_numpy(), tile, left, right, adjacent)

    return tiles.select("tile", "key", "copies", "unit").join(sides, "tile").groupBy("left", "right").applyInArrow(compare, FOUND)
