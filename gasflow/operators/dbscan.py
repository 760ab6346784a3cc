"""Density clustering (DBSCAN) on a grid.

Equal points are counted once. Points fall into cells whose diagonal is the radius, so all points of a
cell are neighbours of each other. Most questions are settled between cells, from their counts and
bounding boxes. What a pair of cells leaves open is put to the pairs of their halved cells, level by level:
a cell asks no further once its answer is certain, so only cells along the border between two answers are
halved. Points are compared when that is no more work than halving again. Clusters are connected components
of cells.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasflow.functions.components import connected_components
from gasflow.functions.sizing import materialize, spread_out

EPS = 0.5
MIN_SHARE = 0.01
MIN_SAMPLES = 5
GRID_DIMENSIONS = 3
NOISE = -1
#: So many pairs of points are compared without halving cells first.
FEW = 1_000_000
DEEPEST = 40


def dbscan(
    features: DataFrame,
    id: str,
    columns: Sequence[str] | None = None,
    eps: float = EPS,
    min_samples: int | None = None,
) -> DataFrame:
    """``id, cluster``: a cluster is named by the smallest row id among its core points; noise is -1.

    ``features`` comes from ``scale_features`` with an integer row id kept. A row is its own neighbour.
    ``min_samples`` is by default one percent of the rows, at least 5. A border row joins the cluster
    with the smallest name among those that reach it.
    """
    names = [c for c in (columns or features.columns) if c != id]
    d, side = len(names), eps / math.sqrt(len(names))
    grid = _Grid(d, eps, side)
    rows = features.select(F.col(id).alias("id"), *[F.col(c).cast("double").alias(x) for c, x in zip(names, grid.axes)])
    points = grid.located(materialize(rows.groupBy(*grid.axes).agg(F.count(F.lit(1)).alias("w"), F.min("id").alias("first"))))
    cells = materialize(_boxes(points, ["cell"], d))
    size = cells.agg(F.sum("n").alias("rows")).first()
    least = min_samples if min_samples is not None else max(MIN_SAMPLES, int((size["rows"] or 0) * MIN_SHARE))
    marked = grid.stored(grid.mark_core(points, cells, least))
    core = marked.filter("core")
    core_cells = materialize(_boxes(core, ["cell"], d))
    clusters = materialize(grid.connect(core, core_cells))
    by_cell = materialize(core_cells.join(clusters, "first"))
    border = grid.border(marked.filter("not core"), core, by_cell)

    own = by_cell.select("cell", "cluster")
    mixed = marked.groupBy("cell").agg(F.bool_and("core").alias("whole"))
    whole = materialize(mixed.filter("whole").join(own, "cell").select("cell", F.col("cluster").alias("cell_cluster")))
    placed = rows.withColumn("cell", grid.cell()).join(whole, "cell", "left")
    settled = placed.filter("cell_cluster is not null").select("id", F.col("cell_cluster").alias("cluster"))
    split = mixed.filter("not whole").select("cell")
    in_split = core.join(split, "cell", "left_semi").join(own, "cell").select("cell", "x", "cluster")
    labels = grid.apart(in_split.unionByName(border.select("cell", "x", "cluster")))
    rest = placed.filter("cell_cluster is null").join(labels, grid.axes, "left")
    found = settled.unionByName(rest.select("id", F.coalesce("cluster", F.lit(NOISE)).alias("cluster")))
    return found.withColumnRenamed("id", id)


def dbscan_summary(labels: DataFrame) -> DataFrame:
    """Number of clusters and of noise rows."""
    return labels.agg(
        F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("n_clusters"),
        F.count_if(F.col("cluster") == NOISE).alias("n_noise_points"),
    )


def _cell(x: Column, side: float, d: int) -> Column:
    return F.array(*[F.floor(x[i] / F.lit(side)) for i in range(d)])


def _boxes(points: DataFrame, keys: list[str], d: int) -> DataFrame:
    """Per cell its rows, distinct points, smallest row id and bounding box."""
    low = [F.min(F.col("x")[i]) for i in range(d)]
    high = [F.max(F.col("x")[i]) for i in range(d)]
    return points.groupBy(*keys).agg(
        F.sum("w").alias("n"),
        F.count(F.lit(1)).alias("distinct"),
        F.min("first").alias("first"),
        F.array(*low).alias("low"),
        F.array(*high).alias("high"),
    )


class _Grid:
    """The distance tests for a number of dimensions and a radius."""

    def __init__(self, d: int, eps: float, side: float) -> None:
        self.d = d
        self.side = side
        self.reach = math.ceil(math.sqrt(d))
        self.far = F.lit(eps * eps)
        self.axes = [f"x{i}" for i in range(d)]

    def cell(self) -> Column:
        """The cell of a point that has a column per feature."""
        return _cell(F.array(*self.axes), self.side, self.d)

    def apart(self, points: DataFrame) -> DataFrame:
        """The points written with a column per feature: a narrow row of numbers is read, hashed and sorted faster than arrays."""
        rest = [c for c in points.columns if c not in ("cell", "x")]
        return materialize(points.select(*[F.col("x")[i].alias(x) for i, x in enumerate(self.axes)], *rest))

    def located(self, points: DataFrame) -> DataFrame:
        """Points with a column per feature as points with ``cell`` and ``x``; the arrays are made where they are used."""
        rest = [c for c in points.columns if c not in self.axes]
        return points.select(self.cell().alias("cell"), F.array(*self.axes).alias("x"), *rest)

    def stored(self, points: DataFrame) -> DataFrame:
        """The points, written."""
        return self.located(self.apart(points))

    def _squares(self, term) -> Column:
        terms = [term(i) * term(i) for i in range(self.d)]
        return sum(terms[1:], terms[0])

    def gap(self, low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
        """Squared distance between two boxes; a point is a box of its own."""
        return self._squares(lambda i: F.greatest(low_a[i] - high_b[i], low_b[i] - high_a[i], F.lit(0.0)))

    def span(self, low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
        """Squared distance of the farthest points of two boxes."""
        return self._squares(lambda i: F.greatest(high_a[i] - low_b[i], high_b[i] - low_a[i]))

    def node(self, level: int) -> Column:
        """The cell of a point when all cells are halved ``level`` times; each lies in one cell of the level before."""
        return _cell(F.col("x"), self.side / 2**level, self.d)

    def near_cells(self, left: DataFrame, right: DataFrame, *carry: str) -> DataFrame:
        """``a, b`` cells with points that may be within the radius, and whether all of them are (``sure``).

        ``nb`` are the rows of ``b``, ``work`` the pairs of points. Cells meet through blocks at least as wide as the
        radius on the first few dimensions.
        """
        dims = range(min(self.d, GRID_DIMENSIONS))

        def block(shift: tuple[int, ...]) -> Column:
            return F.struct(*[(F.floor(F.col("cell")[i] / self.reach) + shift[i]).alias(f"b{i}") for i in dims])

        around = F.explode(F.array(*[block(s) for s in product((-1, 0, 1), repeat=len(dims))]))
        a = self._side(left.withColumn("block", around), "cell", "a", "block")
        b = self._side(right.withColumn("block", block((0,) * len(dims))), "cell", "b", "block", *carry)
        return self._met(a.join(b, "block"), ["fa", "fb", *carry])

    def _side(self, boxes: DataFrame, key: str, name: str, *carry: str) -> DataFrame:
        """The boxes as one side of pairs: ``name``, and their figures with its letter behind them."""
        figures = {"l": "low", "h": "high", "f": "first", "n": "n", "d": "distinct"}
        return boxes.select(F.col(key).alias(name), *[F.col(c).alias(f"{short}{name}") for short, c in figures.items()], *carry)

    def _met(self, pairs: DataFrame, carry: Sequence[str]) -> DataFrame:
        boxes = [F.col(c) for c in ("la", "ha", "lb", "hb")]
        sure = (self.span(*boxes) <= self.far).alias("sure")
        return pairs.filter(self.gap(*boxes) <= self.far).select("a", "b", "nb", (F.col("da") * F.col("db")).alias("work"), *carry, sure)

    def halve(self, pairs: DataFrame, asking: DataFrame, others: DataFrame, level: int, carry: Sequence[str]) -> DataFrame:
        """The pairs as pairs of the next level, without those beyond the radius."""

        def halves(points: DataFrame, names: str) -> DataFrame:
            met = reduce(DataFrame.union, [pairs.select(F.col(name).alias("up")) for name in names]).distinct()
            within = points.withColumn("up", self.node(level)).join(met, "up", "left_semi")
            return _boxes(within.withColumn("cell", self.node(level + 1)), ["up", "cell"], self.d)

        # points that ask each other are halved by one plan, so that Spark reads and shuffles them once for both sides
        left = halves(asking, "ab" if asking is others else "a")
        right = left if asking is others else halves(others, "b")
        a = self._side(left.withColumnRenamed("up", "up_a"), "cell", "a", "up_a")
        b = self._side(right.withColumnRenamed("up", "up_b"), "cell", "b", "up_b")
        above = spread_out(pairs).select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), *carry)
        return self._met(above.join(a, "up_a").join(b, "up_b"), carry)

    def by_points(self, pairs: DataFrame, asking: DataFrame, others: DataFrame, level: int, carry: Sequence[str]) -> DataFrame:
        """``x, <carry>, w`` for the points within the radius, of pairs of cells of the level."""
        left = asking.select(self.node(level).alias("a"), "x")
        right = others.select(self.node(level).alias("b"), F.col("x").alias("y"), "w")
        compared = spread_out(pairs).select("a", "b", *carry).join(left, "a").join(right, "b")
        near = self._squares(lambda i: F.col("x")[i] - F.col("y")[i]) <= self.far
        return compared.filter(near).select("x", *carry, "w")

    def _points_next(self, pairs: DataFrame, level: int) -> bool | None:
        """Whether to compare points now; None when no pair is left."""
        size = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.sum("work").alias("work")).first()
        if not size["pairs"]:
            return None
        return size["work"] <= max(FEW, 4**self.d * size["pairs"]) or level == DEEPEST

    def mark_core(self, points: DataFrame, cells: DataFrame, least: int) -> DataFrame:
        """The points with ``core``: as many rows within the radius as needed.

        ``known`` are the rows that are surely within the radius of all points of a cell. A cell that meets no others is
        as it was known: without enough.
        """
        kept = ["cell", "x", "w", "first"]
        pairs = materialize(self.near_cells(cells, cells).withColumn("known", F.lit(0).cast("bigint")))
        asking, marked, level = points, [], 0
        while True:
            surely = F.max("known") + F.sum(F.when(F.col("sure"), F.col("nb")).otherwise(0))
            bounds = pairs.groupBy("a").agg(surely.alias("surely"), (F.max("known") + F.sum("nb")).alias("at_most"))
            enough = F.col("surely") >= least
            verdict = materialize(bounds.select("a", "surely", (~enough & (F.col("at_most") >= least)).alias("open")))
            judged = asking.withColumn("a", self.node(level)).join(verdict, "a", "left")
            marked.append(judged.filter("open is null or not open").select(*kept, F.coalesce(enough, F.lit(False)).alias("core")))
            left_open = verdict.filter("open").select("a", F.col("surely").alias("known"))
            pairs = materialize(pairs.filter("not sure").drop("known").join(left_open, "a"))
            compare = self._points_next(pairs, level)
            if compare is None:
                break
            asking = self.stored(judged.filter("open").select(*kept))
            if compare:
                met = self.by_points(pairs, asking, points, level, ["known"]).groupBy("x").agg((F.max("known") + F.sum("w")).alias("surely"))
                marked.append(asking.join(met, "x", "left").select(*kept, F.coalesce(enough, F.lit(False)).alias("core")))
                break
            pairs = materialize(self.halve(pairs, asking, points, level, ["known"]))
            level += 1
        return reduce(DataFrame.unionByName, marked)

    def connect(self, core: DataFrame, cells: DataFrame) -> DataFrame:
        """``first, cluster`` per core cell: cells are linked when core points in them are neighbours.

        Only cells that are still in different groups are halved or compared point by point.
        """
        groups = cells.select("first", F.col("first").alias("cluster"))
        pairs = self.near_cells(cells, cells).filter("fa > fb").withColumnsRenamed({"fa": "ga", "fb": "gb"})
        pairs, level = materialize(pairs), 0
        while True:
            bridges = pairs.filter("sure").select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
            merged = materialize(connected_components(bridges))
            groups = materialize(self._renamed(groups, "cluster", merged))
            apart = self._renamed(self._renamed(pairs.filter("not sure"), "ga", merged), "gb", merged)
            pairs = materialize(apart.filter("ga <> gb"))
            compare = self._points_next(pairs, level)
            if compare is None:
                return groups
            if compare:
                touching = self.by_points(pairs, core, core, level, ["ga", "gb"])
                bridges = touching.select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct()
                return self._renamed(groups, "cluster", connected_components(bridges))
            pairs = materialize(self.halve(pairs, core, core, level, ["ga", "gb"]))
            level += 1

    def _renamed(self, df: DataFrame, group: str, merged: DataFrame) -> DataFrame:
        """The groups under the names of the components that they are in, if any."""
        told = merged.select(F.col("node").alias(group), "component")
        return df.join(told, group, "left").withColumn(group, F.coalesce("component", group)).drop("component")

    def border(self, others: DataFrame, core: DataFrame, cells: DataFrame) -> DataFrame:
        """``cell, x, cluster`` of the points that are no core but within the radius of one.

        ``best`` is the smallest cluster that surely reaches all points of a cell; only smaller ones are looked for.
        """
        nothing = F.lit(None).cast(cells.schema["cluster"].dataType)
        near = self.near_cells(_boxes(others, ["cell"], self.d), cells, "cluster")
        pairs, level = materialize(near.withColumn("best", nothing)), 0
        asking, found = others.select("cell", "x", "w", "first", nothing.alias("best")), []
        while True:
            reached = F.least(F.max("best"), F.min(F.when(F.col("sure"), F.col("cluster"))))
            told = materialize(pairs.groupBy("a").agg(reached.alias("reached")))
            rest = pairs.filter("not sure").join(told, "a").filter("reached is null or cluster < reached")
            pairs = materialize(rest.withColumn("best", F.col("reached")).drop("reached"))
            judged = asking.withColumn("a", self.node(level)).join(told, "a", "left").withColumn("best", F.least("best", "reached"))
            waiting = pairs.select("a").distinct()
            found.append(judged.join(waiting, "a", "left_anti").select("cell", "x", F.col("best").alias("cluster")))
            compare = self._points_next(pairs, level)
            if compare is None:
                break
            asking = self.stored(judged.join(waiting, "a", "left_semi").select("cell", "x", "w", "first", "best"))
            if compare:
                met = self.by_points(pairs, asking, core, level, ["cluster"]).groupBy("x").agg(F.min("cluster").alias("reached"))
                found.append(asking.join(met, "x", "left").select("cell", "x", F.least("best", "reached").alias("cluster")))
                break
            pairs = materialize(self.halve(pairs, asking, core, level, ["cluster", "best"]))
            level += 1
        return reduce(DataFrame.unionByName, found).filter("cluster is not null")
