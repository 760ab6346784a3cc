"""K-means over a range of k, chosen by silhouette.

Every restart of every k is fitted on all rows, and one pass over the table advances all of them at once.
Equal points are counted once and lie along a Z-shaped curve, so neighbours are read together: a short piece
of the curve whose bounding box lies on one side of all borders between clusters adds its totals, and only
points of other pieces are compared with the centres. Pieces are written once as rows with their boxes and totals, so
a pass is work on pieces, and on the points along the borders. Starts come from a few rounds that draw rows of all
the table by their distance from those drawn before, for all restarts in one pass each; the boxes tell which
points may be drawn.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gasflow.functions.columns import text_columns
from gasflow.functions.sizing import materialize

MAX_K = 10
RESTARTS = 10
TOLERANCE = 1e-4
DRAWING_ROUNDS = 5
PIECE = 128
#: Pieces that a task draws from before it takes twice as many at a time.
FIRST_PIECES = 16
#: Numbers in the arrays of one comparison.
AT_ONCE = 1 << 21
_KEY_BITS = 60


def kmeans_best(
    features: DataFrame,
    id: str,
    columns: Sequence[str] | None = None,
    ks: Sequence[int] | None = None,
    restarts: int = RESTARTS,
    seed: int = 42,
) -> DataFrame:
    """``k, inertia, silhouette, is_best, centers``; the first k with the highest silhouette is best.

    ``features`` comes from ``scale_features`` with the row id kept. By default k runs from 2 to 10,
    or to half the number of rows if that is less.
    """
    used = [c for c in (columns or features.columns) if c != id]
    names = [f"x{i}" for i in range(len(used))]
    points = _points(features.select(*[F.col(c).cast("double").alias(n) for c, n in zip(used, names)]), names)
    size = points.agg(F.sum(F.col("total")[0]).alias("rows")).first()["rows"] or 0
    tried = list(ks or range(2, min(MAX_K, int(size) // 2) + 1))
    if not tried or not size:
        raise ValueError(f"{int(size)} rows are too few to cluster")
    centers = _starts(points, names, tried, restarts, seed)
    moving = set(centers)
    while moving:  # each round that moves centres by more than the tolerance lowers the cost by a fixed share of it
        sums = _pass(points, names, {model: centers[model] for model in sorted(moving)})
        for model in list(moving):
            moved = _means(sums[model], centers[model])
            shift = float(((moved - centers[model]) ** 2).sum())
            centers[model] = moved
            if shift <= TOLERANCE:
                moving.discard(model)
    final = _pass(points, names, centers)
    inertia = {model: _cost(final[model], centers[model]) for model in centers}
    won = {k: min((m for m in centers if m[0] == k), key=lambda m: (inertia[m], m)) for k in tried}
    silhouettes = _silhouettes(points, names, {k: centers[m] for k, m in won.items()}, {k: final[m] for k, m in won.items()})
    best = max(tried, key=lambda k: (silhouettes[k], -k))
    found = [(k, inertia[won[k]], silhouettes[k], k == best, centers[won[k]].tolist()) for k in tried]
    return features.sparkSession.createDataFrame(
        found, "k int, inertia double, silhouette double, is_best boolean, centers array<array<double>>"
    )


def kmeans_labels(features: DataFrame, id: str, models: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``id, cluster`` under the best model."""
    names = [c for c in (columns or features.columns) if c != id]
    centers = np.array(models.filter("is_best").first()["centers"])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            distance = _distances(batch[names].to_numpy(dtype=float), centers)
            yield pd.DataFrame({id: batch[id], "cluster": distance.argmin(axis=1).astype("int32")})

    kind = features.schema[id].dataType.simpleString()
    return features.select(id, *names).mapInPandas(label, f"{id} {kind}, cluster int")


def silhouette(rows: DataFrame, columns: Sequence[str], label: str = "cluster") -> float | None:
    """Mean silhouette with squared distances, from cluster sums; None with fewer than two clusters."""
    if rows.select(label).distinct().limit(2).count() < 2:
        return None
    vectors = VectorAssembler(inputCols=list(columns), outputCol="features").transform(rows)
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol=label, distanceMeasure="squaredEuclidean")
    return evaluator.evaluate(vectors)


def cluster_profile(
    df: DataFrame, labels: DataFrame, id: str, columns: Sequence[str] | None = None, k: int = 5
) -> DataFrame:
    """Per cluster its size, its percentage of all rows and the top values of the first text columns.

    ``cluster, size, percentage, column, position, value, count``; rows meet labels by row id.
    """
    names = list(columns or text_columns(df)[:3])
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    sizes = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    labelled = df.select(id, *names).join(labels, id)
    counts = (
        labelled.unpivot(["cluster"], names, "column", "value")
        .filter("value is not null")
        .groupBy("cluster", "column", "value")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    best = Window.partitionBy("cluster", "column").orderBy(F.col("count").desc(), "value")
    top = counts.withColumn("position", F.row_number().over(best)).filter(F.col("position") <= k)
    return sizes.join(top, "cluster", "left").select(
        "cluster", "size", (F.col("size") / total * 100).alias("percentage"), "column", "position", "value", "count"
    )


def _points(features: DataFrame, names: list[str]) -> DataFrame:
    """The distinct points along the curve, a row per piece.

    Of its points a piece holds the features, ``weight`` (rows) and ``draw`` (a hash of the point), of itself ``low`` and ``high`` (its
    bounding box) and ``total`` (rows, sum of squared norms, sums of the features).
    """
    spark = features.sparkSession
    counted = materialize(
        features.groupBy(*names)
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
        .withColumn("draw", F.xxhash64(*names))
    )
    ends = counted.agg(F.struct(*[F.struct(F.min(c).alias("low"), F.max(c).alias("high")).alias(c) for c in names])).scalar()
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    along = counted.withColumn("curve", _curve(names, ends)).repartitionByRange(spread, "curve", *names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            held = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in [*names, "weight", "draw"]}
            at = np.column_stack([held[c] for c in names])
            starts = np.arange(0, len(at), PIECE)
            ends = np.append(starts, len(at))
            whole = {
                "low": np.minimum.reduceat(at, starts),
                "high": np.maximum.reduceat(at, starts),
                "total": np.add.reduceat(_measures(at, held["weight"]), starts),
            }
            lists = {c: _lists(values, ends) for c, values in held.items()}
            lists |= {c: _lists(rows.ravel(), np.arange(len(rows) + 1) * rows.shape[1]) for c, rows in whole.items()}
            yield pa.RecordBatch.from_pydict(lists)

    schema = ", ".join([*[f"{n} array<double>" for n in names], "weight array<double>", "draw array<bigint>"])
    schema += ", low array<double>, high array<double>, total array<double>"
    return materialize(along.sortWithinPartitions("curve", *names).drop("curve").mapInArrow(cut, schema))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _measures(at: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """What clusters add up of their points: rows, squared norms, features."""
    out = np.empty((len(at), at.shape[1] + 2))
    out[:, 0], out[:, 1] = weight, weight * np.einsum("ij,ij->i", at, at)
    np.multiply(weight[:, None], at, out=out[:, 2:])
    return out


class _Pieces:
    """A batch of the pieces as arrays: figures of each piece, and of all their points one after the other."""

    def __init__(self, batch: pa.RecordBatch, names: list[str]) -> None:
        self.low, self.high, self.total = (self._flat(batch, c).reshape(batch.num_rows, -1) for c in ("low", "high", "total"))
        self.at = np.column_stack([self._flat(batch, c) for c in names])
        self.weight = self._flat(batch, "weight")
        self.draw = self._flat(batch, "draw") if "draw" in batch.schema.names else None
        self.length = pc.list_value_length(batch.column("weight")).to_numpy()
        self.ends = np.append(0, np.cumsum(self.length))
        self.middle, self.half = (self.low + self.high) / 2, (self.high - self.low) / 2

    def points_of(self, chosen: np.ndarray) -> np.ndarray:
        """The places of the points of the chosen pieces; no other piece is looked at."""
        length = self.length[chosen]
        return np.repeat(self.ends[chosen] - np.append(0, np.cumsum(length)[:-1]), length) + np.arange(length.sum())

    @staticmethod
    def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[_Pieces]:
    for batch in batches:
        if batch.num_rows:
            yield _Pieces(batch, names)


def _curve(names: list[str], ends: Column) -> Column:
    """The bits of the cell numbers of a point in all features, interleaved; features beyond the sixtieth have no bit."""
    used = names[:_KEY_BITS]
    bits = _KEY_BITS // len(used)
    key = F.lit(0).cast("long")
    for place, name in enumerate(used):
        end = ends.getField(name)
        part = F.coalesce(F.try_divide(F.col(name) - end["low"], end["high"] - end["low"]), F.lit(0.0))
        cell = F.floor(part * float(2**bits - 1)).cast("long")
        for bit in range(bits):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(used) + place))
    return key


def _starts(
    points: DataFrame, names: list[str], ks: Sequence[int], restarts: int, seed: int
) -> dict[tuple[int, int], np.ndarray]:
    """Centres to begin with for each ``(k, restart)``.

    A round draws twice the largest k of points per restart, each with a chance that grows with its rows and its squared
    distance from those drawn before. All drawn points, weighted by the rows nearest to each, are then clustered here
    for every k and restart; their number depends on the parameters only.
    """
    drawn = {r: np.empty((0, len(names))) for r in range(restarts)}
    for turn in range(DRAWING_ROUNDS + 1):
        more = _draw(points, names, drawn, 2 * max(ks) if turn else 1, seed, turn)
        drawn = {r: np.concatenate([drawn[r], more[r]]) if r in more else drawn[r] for r in drawn}
    found = np.unique(np.concatenate(list(drawn.values())), axis=0)
    weight = _pass(points, names, {(0, 0): found})[0, 0]["n"].to_numpy()
    return {(k, r): _thin(found, weight, k, np.random.default_rng([seed, k, r])) for k in ks for r in range(restarts)}


def _draw(
    points: DataFrame, names: list[str], drawn: dict[int, np.ndarray], size: int, seed: int, turn: int
) -> dict[int, np.ndarray]:
    """For each restart the ``size`` points whose exponential clocks, as fast as weight times squared distance, ring first."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (np.empty((0, len(names))), np.empty(0))
        best = dict.fromkeys(drawn, nothing)
        for pieces in _batches(batches, names):
            heaviest = np.maximum.reduceat(pieces.weight, pieces.ends[:-1])
            for r, found in drawn.items():
                salt = np.random.SeedSequence([seed, turn, r]).generate_state(1, np.uint64)[0]
                fastest = heaviest * _farthest(pieces, found) if len(found) else heaviest
                begin, end = 0, FIRST_PIECES
                while begin < len(heaviest):  # the first pieces tell how early a point of the others must ring
                    best[r] = _earliest(pieces, slice(begin, end), found, salt, fastest[begin:end], size, *best[r])
                    begin, end = end, 2 * end
        for r, (at, rings) in best.items():
            columns = [*at.T, np.full(len(at), r, "int32"), rings]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*names, "restart", "rings"])

    schema = ", ".join([*[f"{n} double" for n in names], "restart int", "rings double"])
    order = Window.partitionBy("restart").orderBy("rings", *names)
    used = points.select(*names, "weight", "draw", "low", "high", "total")
    rung = used.mapInArrow(first, schema).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    found = rung.toPandas().sort_values(["restart", "place"])
    return {int(r): part[names].to_numpy(dtype=float) for r, part in found.groupby("restart")}


def _farthest(pieces: _Pieces, found: np.ndarray) -> np.ndarray:
    """For each piece a bound on the squared distance of its points from the nearest of those found."""
    out = np.empty(len(pieces.middle))
    step = max(1, AT_ONCE // found.size)
    for i in range(0, len(out), step):
        gap = np.abs(pieces.middle[i : i + step, None, :] - found[None, :, :]) + pieces.half[i : i + step, None, :]
        out[i : i + step] = (gap**2).sum(axis=2).min(axis=1)
    scale = (np.maximum(np.abs(pieces.low), np.abs(pieces.high)) ** 2).sum(axis=1) + (found**2).sum(axis=1).max()
    return out + 1e-12 * scale  # as much as rounding may add to a distance


def _earliest(
    pieces: _Pieces,
    part: slice,
    found: np.ndarray,
    salt: np.uint64,
    fastest: np.ndarray,
    size: int,
    at: np.ndarray,
    rings: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """``at`` and ``rings``, the points that ring first so far, with those of a part of the pieces.

    ``fastest`` bounds the speeds of a piece, so most points are too late by their draw alone and no distance is asked for.
    """
    least = np.zeros(len(fastest))
    if len(rings) == size:
        least = np.exp(-rings[-1] * fastest) * (1.0 - 1e-9)
    points = slice(pieces.ends[part.start], pieces.ends[min(part.stop, len(pieces.length))])
    even = _even(pieces.draw[points], salt)
    early = np.flatnonzero(~(even < np.repeat(least, pieces.length[part])))
    chosen, weight = pieces.at[points][early], pieces.weight[points][early]
    speed = weight * _nearest(chosen, found) if len(found) else weight
    with np.errstate(divide="ignore"):
        rung = -np.log(even[early]) / speed
    at, rings = np.concatenate([at, chosen]), np.concatenate([rings, rung])
    first = np.argsort(rings, kind="stable")[:size]
    first = first[np.isfinite(rings[first])]
    return at[first], rings[first]


def _nearest(points: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Squared distance of each point from the nearest of those found."""
    step = max(1, AT_ONCE // len(found))
    return np.concatenate([np.empty(0), *[_distances(points[i : i + step], found).min(axis=1) for i in range(0, len(points), step)]])


def _even(draw: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Numbers spread evenly over (0, 1) that depend on the point and the salt only."""
    mixed = draw.astype(np.int64).view(np.uint64) ^ salt
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # fixed values: a well-known 64-bit mixer
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    mixed ^= mixed >> np.uint64(31)
    return ((mixed >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def _thin(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k centres of the drawn points: taken by weight and squared distance from those taken before, then moved until they rest."""
    taken: list[np.ndarray] = []
    chance = weight
    for _ in range(k):
        total = chance.sum()
        pick = rng.choice(len(points), p=chance / total) if total > 0 else rng.integers(len(points))
        taken.append(points[pick])
        chance = weight * _distances(points, np.array(taken)).min(axis=1)
    centers, shift = np.array(taken), np.inf
    measures = np.column_stack([weight, weight[:, None] * points])
    while shift > TOLERANCE:
        sums = np.zeros((k, measures.shape[1]))
        _add(sums, _distances(points, centers).argmin(axis=1), measures)
        moved = np.where(sums[:, :1] > 0, sums[:, 1:] / np.maximum(sums[:, :1], 1.0), centers)
        shift = float(((moved - centers) ** 2).sum())
        centers = moved
    return centers


def _distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = (points**2).sum(axis=1)[:, None] - 2.0 * points @ centers.T + (centers**2).sum(axis=1)[None, :]
    return np.maximum(squares, 0.0)


def _pass(
    points: DataFrame, names: list[str], centers: dict[tuple[int, int], np.ndarray]
) -> dict[tuple[int, int], pd.DataFrame]:
    """Rows, squared norms and sums of every cluster of every model, in one pass over the points."""
    models = list(centers)
    fields = ["n", "norm", *[f"s{i}" for i in range(len(names))]]
    model_of = np.repeat(np.arange(len(models), dtype="int32"), [len(centers[m]) for m in models])
    cluster_of = np.concatenate([np.arange(len(centers[m]), dtype="int32") for m in models])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((len(centers[m]), len(fields))) for m in models]
        for pieces in _batches(batches, names):
            measures = _measures(pieces.at, pieces.weight)
            for sums, m in zip(held, models):
                _settle(sums, pieces, measures, centers[m])
        columns = [model_of, cluster_of, *np.concatenate(held).T]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["model", "cluster", *fields])

    schema = "model int, cluster int, " + ", ".join(f"{f} double" for f in fields)
    parts = points.select(*names, "weight", "low", "high", "total").mapInArrow(partial, schema)
    found = parts.groupBy("model", "cluster").agg(*[F.sum(f).alias(f) for f in fields]).toPandas()
    found = found.sort_values(["model", "cluster"])
    return {models[n]: part for n, part in found.groupby("model")}


def _settle(sums: np.ndarray, pieces: _Pieces, measures: np.ndarray, centers: np.ndarray) -> None:
    """Add pieces with one nearest centre by their totals, points of the others by themselves.

    Pieces are taken a stretch of the curve at a time, as many as keep the comparisons in memory; the points of a stretch are
    compared with the centres that are nearest to some point of its boxes.
    """
    step = max(1, AT_ONCE // (len(centers) * max(PIECE, centers.shape[1])))
    between = np.abs(centers[:, None, :] - centers[None, :, :])
    for i in range(0, len(pieces.total), step):
        part = slice(i, i + step)
        own, rivals = _rivals(pieces.middle[part], pieces.half[part], centers, between)
        whole = ~rivals.any(axis=1)
        _add(sums, own[whole], pieces.total[part][whole])
        if whole.all():
            continue
        able = rivals.any(axis=0)
        able[own[~whole]] = True
        near = np.flatnonzero(able)
        apart = pieces.points_of(np.flatnonzero(~whole) + i)
        label = near[_distances(pieces.at[apart], centers[near]).argmin(axis=1)]
        _add(sums, label, measures[apart])


def _owners(middle: np.ndarray, half: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre nearest to the middle of each box, and whether it is the nearest to every point of the box."""
    own, rivals = _rivals(middle, half, centers, np.abs(centers[:, None, :] - centers[None, :, :]))
    return own, ~rivals.any(axis=1)


def _rivals(middle: np.ndarray, half: np.ndarray, centers: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The centre nearest to the middle of each box, and which others may be the nearest to some point of the box.

    The lead of a centre over another is linear in the point, so it is least in a corner of the box. ``between`` are the
    distances of the centres in each feature.
    """
    square = _distances(middle, centers)
    row = np.arange(len(middle))
    own = square.argmin(axis=1)
    lead = square - square[row, own][:, None] - 2.0 * np.einsum("bd,bkd->bk", half, between[own])
    lead[row, own] = np.inf
    scale = (middle**2).sum(axis=1) + (half**2).sum(axis=1) + (centers**2).sum(axis=1).max()
    return own, ~(lead > 1e-12 * scale[:, None])  # ties and near ties are left to the points


def _add(sums: np.ndarray, label: np.ndarray, measures: np.ndarray) -> None:
    for j in range(sums.shape[1]):
        sums[:, j] += np.bincount(label, measures[:, j], minlength=len(sums))


def _cost(sums: pd.DataFrame, centers: np.ndarray) -> float:
    """Sum of squared distances from the centres, out of the sums of the clusters."""
    n, norm, total = _stats(sums, centers.shape[1])
    return max(float((norm - 2.0 * (total * centers).sum(axis=1) + n * (centers**2).sum(axis=1)).sum()), 0.0)


def _stats(sums: pd.DataFrame, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return sums["n"].to_numpy(), sums["norm"].to_numpy(), sums[[f"s{i}" for i in range(d)]].to_numpy()


def _means(sums: pd.DataFrame, centers: np.ndarray) -> np.ndarray:
    """New centres; an empty cluster keeps its own."""
    n, _, total = _stats(sums, centers.shape[1])
    return np.where(n[:, None] > 0, total / np.maximum(n, 1.0)[:, None], centers)


def _silhouettes(
    points: DataFrame, names: list[str], centers: dict[int, np.ndarray], sums: dict[int, pd.DataFrame]
) -> dict[int, float]:
    """Mean silhouette of each model with squared distances, from its cluster sums."""
    stats = {k: _stats(s, len(names)) for k, s in sums.items()}
    step = max(1, AT_ONCE // (16 * max(centers)))  # several arrays of a number per point and cluster

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = dict.fromkeys(centers, 0.0)
        seen = 0.0
        for pieces in _batches(batches, names):
            seen += float(pieces.weight.sum())
            for i in range(0, len(pieces.at), step):
                at, weight = pieces.at[i : i + step], pieces.weight[i : i + step]
                norms = (at**2).sum(axis=1)
                row = np.arange(len(at))
                for k, c in centers.items():
                    n, norm, total = stats[k]
                    label = _distances(at, c).argmin(axis=1)
                    filled = np.maximum(n, 1.0)
                    mean = norms[:, None] + (norm / filled)[None, :] - 2.0 * at @ (total / filled[:, None]).T
                    mean[:, n == 0] = np.inf
                    own = np.maximum(mean[row, label], 0.0) * n[label] / np.maximum(n[label] - 1, 1.0)
                    mean[row, label] = np.inf
                    other = mean.min(axis=1)
                    larger = np.maximum(own, other)
                    valid = (n[label] > 1) & np.isfinite(other) & (larger > 0)
                    held[k] += float((weight[valid] * (other - own)[valid] / larger[valid]).sum())
        columns = [np.array(list(held), "int32"), np.array(list(held.values())), np.full(len(held), seen)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["k", "total", "n"])

    parts = points.select(*names, "weight", "low", "high", "total").mapInArrow(partial, "k int, total double, n double")
    found = parts.groupBy("k").agg((F.sum("total") / F.sum("n")).alias("silhouette")).collect()
    return {row["k"]: row["silhouette"] for row in found}
