"""Isolation forest (Liu, Ting and Zhou 2008)."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.functions.quantiles import scalar_quantiles
from gasflow.functions.sizing import materialize, spread_out
from gasflow.operators.outliers import default_features
from gasflow.operators.relational import drop_incomplete

TREES = 100
SAMPLE = 256
CONTAMINATION = 0.1
_NODES = "tree int, node int, feature int, threshold double, left int, right int, depth double"
_HASH_RANGE = 2**31


def isolation_forest(
    df: DataFrame,
    id: str,
    columns: Sequence[str] | None = None,
    contamination: float = CONTAMINATION,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
) -> DataFrame:
    """``id, <columns>, score, is_anomaly`` for the rows that are complete in the columns.

    Lower scores are stranger; the rows below the ``contamination`` quantile of the scores are flagged.
    Samples are drawn by a hash of the row id, so partitioning does not change the result. Each tree is
    grown by one task from ``sample`` rows, or all when there are fewer; the forest is small whatever the table, and each batch of
    rows is scored against it where it lies. Scaling the features would not change the splits.
    """
    names = list(columns or [c for c in default_features(df) if c != id])
    rows = drop_incomplete(df.select(id, *[F.col(c).cast("double").alias(c) for c in names]), names)
    total = rows.count()
    sample = max(1, min(sample, total))
    forest = _grow(rows, total, id, names, trees, sample, seed)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(_scores(batch.to_numpy(dtype=float), forest, sample))

    scored = materialize(spread_out(rows).withColumn("score", score(F.struct(*names))))
    cut = scalar_quantiles(scored, "score", [contamination])[0]
    return scored.withColumn("is_anomaly", F.col("score") < cut)


def isolation_summary(scored: DataFrame) -> DataFrame:
    """Flagged rows and their percentage."""
    found = F.count_if("is_anomaly")
    return scored.agg(
        F.count(F.lit(1)).alias("total_rows"),
        found.alias("total_anomalies"),
        (F.try_divide(found, F.count(F.lit(1))) * 100).alias("percentage"),
    )


def _grow(rows: DataFrame, total: int, id: str, names: list[str], trees: int, sample: int, seed: int) -> list[pd.DataFrame]:
    """The node tables of the trees: at most ``trees * 2 * sample`` nodes."""
    # each tree draws from all rows: about twice its sample by a hash of row and tree, of which the first are kept
    share = min(1.0, 2 * sample / max(total, 1) + 64 / max(total, 1))
    draw = lambda tree: F.xxhash64(F.col(id), tree, F.lit(seed))
    drawing = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.pmod(draw(t), F.lit(_HASH_RANGE)) < int(share * _HASH_RANGE))
    shuffled = rows.select(F.explode(drawing).alias("tree"), id, *names).withColumn("draw", draw(F.col("tree")))
    chosen = Window.partitionBy("tree").orderBy("draw", id)
    samples = shuffled.withColumn("nth", F.row_number().over(chosen)).filter(F.col("nth") <= sample)

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("nth")
        tree = int(part["tree"].iloc[0])
        nodes = _tree(part[names].to_numpy(dtype=float), sample, np.random.default_rng([seed, tree]))
        return nodes.assign(tree=tree)[["tree", "node", "feature", "threshold", "left", "right", "depth"]]

    grown = samples.groupBy("tree").applyInPandas(grow, _NODES).toPandas()
    return [nodes.sort_values("node").reset_index(drop=True) for _, nodes in grown.groupby("tree")]


def _average_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n points."""
    if n < 2:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def _tree(points: np.ndarray, sample: int, rng: np.random.Generator) -> pd.DataFrame:
    """Split at random until points are alone, equal or deep; a leaf points to itself."""
    limit = math.ceil(math.log2(max(sample, 2)))
    nodes: list[list[float]] = []
    waiting = [(points, 0, -1, False)]
    while waiting:
        held, depth, parent, is_right = waiting.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][4 if is_right else 3] = at
        low, high = held.min(axis=0), held.max(axis=0)
        varied = np.flatnonzero(high > low)
        if depth >= limit or len(held) < 2 or len(varied) == 0:
            nodes.append([at, 0, 0.0, at, at, depth + _average_depth(len(held))])
            continue
        feature = int(rng.choice(varied))
        threshold = float(rng.uniform(low[feature], high[feature]))
        if threshold <= low[feature]:
            threshold = float(np.nextafter(low[feature], high[feature]))
        nodes.append([at, feature, threshold, at, at, 0.0])
        below = held[:, feature] < threshold
        waiting.append((held[~below], depth + 1, at, True))
        waiting.append((held[below], depth + 1, at, False))
    return pd.DataFrame(nodes, columns=["node", "feature", "threshold", "left", "right", "depth"])


def _scores(features: np.ndarray, forest: list[pd.DataFrame], sample: int) -> np.ndarray:
    """Minus two to the power of the mean path length over its expectation; all rows walk a tree together."""
    depth = np.zeros(len(features))
    row = np.arange(len(features))
    for nodes in forest:
        feature, threshold = nodes["feature"].to_numpy(dtype=int), nodes["threshold"].to_numpy()
        left, right = nodes["left"].to_numpy(dtype=int), nodes["right"].to_numpy(dtype=int)
        at = np.zeros(len(features), dtype=int)
        while True:
            below = features[row, feature[at]] < threshold[at]
            following = np.where(below, left[at], right[at])
            if np.array_equal(following, at):
                break
            at = following
        depth += nodes["depth"].to_numpy()[at]
    expected = max(_average_depth(sample), 1.0)
    return -np.power(2.0, -depth / max(len(forest), 1) / expected)
