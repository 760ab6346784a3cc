"""Clustering, forest and matching against brute force."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pytest

from gasflow.operators import association, dbscan, forest, kmeans, matching
from gasflow.plans import analyses


def neighbourhood_labels(points, eps, least):
    """DBSCAN from the full distance matrix."""
    near = ((points[:, None, :] - points[None, :, :]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= least
    label = np.full(len(points), -1)
    for i in range(len(points)):
        if core[i] and label[i] < 0:
            label[i], waiting = i, [i]
            while waiting:
                for j in np.flatnonzero(near[waiting.pop()] & core):
                    if label[j] < 0:
                        label[j] = i
                        waiting.append(j)
    for i in np.flatnonzero(~core):
        reached = label[near[i] & core]
        label[i] = reached.min() if len(reached) else -1
    return label


def blobs(d, n, seed):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, 0.3, (n, d)) for c in (0.0, 1.6, 5.0)] + [rng.uniform(-3, 8, (n // 2, d))]
    points = np.concatenate([*parts, parts[0][:60]])
    return rng.permutation(points)


@pytest.mark.parametrize("d, eps, least", [(1, 0.05, 4), (2, 0.5, 12), (3, 0.4, 4)])
def test_dbscan(spark, d, eps, least):
    points = blobs(d, 130, d)
    names = [f"x{i}" for i in range(d)]
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["id", *names])
    got = dict(dbscan.dbscan(table, "id", eps=eps, min_samples=least).collect())
    wanted = neighbourhood_labels(points, eps, least)
    assert got == {i: int(wanted[i]) for i in range(len(points))}
    assert len(set(wanted)) > 2


def test_dbscan_halves_cells(spark, monkeypatch, d=2, eps=0.5, least=12):
    """What cells leave open goes down to halved cells: the answers are the same, and far fewer points meet than by whole cells."""
    points = np.concatenate([blobs(d, 130, d), np.random.default_rng(2).normal(0.0, 0.3, (900, d))])
    names = [f"x{i}" for i in range(d)]
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["id", *names])
    compared = []
    by_points = dbscan._Grid.by_points
    monkeypatch.setattr(dbscan, "FEW", 0, raising=False)

    def counting(grid, pairs, *rest):
        compared.append(pairs.agg({"work": "sum"}).first()[0])
        return by_points(grid, pairs, *rest)

    monkeypatch.setattr(dbscan._Grid, "by_points", counting)
    got = dict(dbscan.dbscan(table, "id", eps=eps, min_samples=least).collect())
    wanted = neighbourhood_labels(points, eps, least)
    assert got == {i: int(wanted[i]) for i in range(len(points))}
    assert sum(compared) < 20 * len(points)


def test_kmeans(spark):
    rng = np.random.default_rng(4)
    truth = np.repeat([0, 1, 2], 80)
    points = np.array([[0, 0], [6, 0], [0, 6]])[truth] + rng.normal(0, 0.4, (240, 2))
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], ["id", "x", "y"])
    features = association.scale_features(table, ["x", "y"], keep=["id"])
    models = kmeans.kmeans_best(features, "id", restarts=3)
    best = models.filter("is_best").first()
    assert best["k"] == 3 and models.count() == 9
    labels = kmeans.kmeans_labels(features, "id", models)
    got = dict(labels.collect())
    assert len({(truth[i], c) for i, c in got.items()}) == 3
    assert abs(kmeans.silhouette(features.join(labels, "id"), ["x", "y"]) - best["silhouette"]) < 1e-9
    again = kmeans.kmeans_best(features.repartition(5, "x"), "id", restarts=3)
    assert again.filter("is_best").first()["k"] == 3


def test_kmeans_meets_every_row(spark):
    """Three rows far from thousands of others, many of them equal, are clusters of their own; figures equal those of all rows."""
    rng = np.random.default_rng(9)
    points = np.concatenate([rng.normal(0, 1, (3000, 3)).round(1), np.zeros((3000, 3)), [[900, 0, 0], [0, 900, 0], [0, 0, 900.0]]])
    table = spark.createDataFrame(
        [(i, *map(float, p)) for i, p in enumerate(rng.permutation(points))], ["id", "weight", "draw", "z"]
    )
    models = {m["k"]: m for m in kmeans.kmeans_best(table, "id", ks=[3, 4], restarts=2).collect()}
    best = models[4]
    assert best["is_best"] and not models[3]["is_best"]
    centers = np.array(best["centers"])
    near = ((points[:, None, :] - centers[None]) ** 2).sum(-1)
    label = near.argmin(1)
    assert sorted(np.bincount(label)) == [1, 1, 1, 6000]
    assert abs(best["inertia"] - near.min(1).sum()) < 1e-6 * best["inertia"]
    means = np.array([points[label == c].mean(axis=0) for c in range(4)])
    assert np.abs(means - centers).max() < 0.01


@pytest.mark.parametrize("d", [1, 2, 5])
def test_kmeans_boxes(d):
    """A box is settled only if all its points have the same nearest centre."""
    rng = np.random.default_rng(d)
    centers = rng.normal(0, 1, (6, d))
    middle, half = rng.normal(0, 1.5, (400, d)), rng.uniform(0, 0.3, (400, d))
    own, whole = kmeans._owners(middle, half, centers)
    assert 20 < whole.sum() < 400
    for _ in range(50):
        inside = middle + half * rng.choice([-1.0, -0.5, 0.0, 1.0], (400, d))
        nearest = ((inside[:, None, :] - centers[None]) ** 2).sum(-1).argmin(1)
        assert (nearest == own)[whole].all()


def test_cluster_passes_read_pieces(spark, monkeypatch):
    """In ``cluster``, too, K-means passes read a row per piece, and its figures are those of all rows."""
    rng = np.random.default_rng(8)
    points = np.repeat([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]], 900, axis=0) + rng.normal(0, 0.4, (2700, 2))
    table = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "id long, x double, y double")
    read, passed = [], kmeans._pass

    def counting(points, *rest):
        read.append(points.count())
        return passed(points, *rest)

    monkeypatch.setattr(kmeans, "MAX_K", 4)
    monkeypatch.setattr(kmeans, "_pass", counting)
    sections = analyses.cluster(table, "id", columns=["x", "y"])
    assert max(read) < 100
    best = sections["kmeans_models"].filter("is_best").first()
    labels = np.array([r["cluster"] for r in sections["kmeans_labels"].orderBy("id").collect()])
    scaled = (points - points.mean(axis=0)) / points.std(axis=0)
    near = ((scaled[:, None, :] - np.array(best["centers"])[None]) ** 2).sum(-1)
    assert best["k"] == 3 and sorted(np.bincount(labels)) == [900, 900, 900]
    assert abs(best["inertia"] - near.min(1).sum()) < 1e-6 * best["inertia"]


def test_cluster_keeps_rows_narrow(spark, monkeypatch):
    """In ``cluster`` DBSCAN writes its points as plain numbers, and the profile reads labels that are written."""
    points = blobs(2, 130, 5)
    table = spark.createDataFrame([(i, *map(float, p), "ab"[i % 2]) for i, p in enumerate(points)], "id long, x double, y double, kind string")
    written, materialize = [], dbscan.materialize

    def noting(df):
        written.append(df.dtypes)
        return materialize(df)

    monkeypatch.setattr(dbscan, "materialize", noting)
    monkeypatch.setattr(kmeans, "MAX_K", 3)
    sections = analyses.cluster(table, "id", columns=["x", "y"])
    by_point = [dict(columns) for columns in written if {"w", "x0"} <= set(dict(columns)) or {"w", "x"} <= set(dict(columns))]
    assert by_point and not any("array" in kind for columns in by_point for kind in columns.values())
    profile = sections["kmeans_profile"]._jdf.queryExecution().toString()
    assert "MapInPandas" not in profile and "PythonMapInPandas" not in profile
    shares = {r["cluster"]: r["size"] for r in sections["kmeans_profile"].collect()}
    assert sum(shares.values()) == len(points) == sections["kmeans_labels"].count()
    scaled = (points - points.mean(axis=0)) / points.std(axis=0)
    wanted = neighbourhood_labels(scaled, dbscan.EPS, max(dbscan.MIN_SAMPLES, len(points) // 100))
    assert dict(sections["dbscan_labels"].collect()) == {i: int(wanted[i]) for i in range(len(points))}


def pieces_of(points, weight):
    """One batch of pieces of the points as they come."""
    rng = np.random.default_rng(7)
    cuts = np.arange(0, len(points), kmeans.PIECE)
    lists = lambda rows: pa.array(list(rows))
    parts = {f"x{i}": lists(np.split(points[:, i], cuts[1:])) for i in range(points.shape[1])}
    parts["weight"] = lists(np.split(weight, cuts[1:]))
    parts["draw"] = lists(np.split(rng.integers(-(2**63), 2**63 - 1, len(points)), cuts[1:]))
    parts["low"], parts["high"] = lists(np.minimum.reduceat(points, cuts)), lists(np.maximum.reduceat(points, cuts))
    parts["total"] = lists(np.add.reduceat(kmeans._measures(points, weight), cuts))
    return kmeans._Pieces(pa.RecordBatch.from_pydict(parts), [f"x{i}" for i in range(points.shape[1])])


def along_lines(n, seed):
    """Points that lie together in order, some heavier than others."""
    rng = np.random.default_rng(seed)
    points = np.column_stack([np.sort(rng.normal(0, 1, n)), rng.normal(0, 0.01, n)])
    return points, rng.integers(1, 4, n).astype(float)


def counting_distances(monkeypatch):
    met = []
    distances = kmeans._distances

    def counted(points, centers):
        met.append(len(points) * len(centers))
        return distances(points, centers)

    monkeypatch.setattr(kmeans, "_distances", counted)
    return met


def test_kmeans_points_lie_in_pieces(spark):
    """A pass reads a row per piece, not per point, and nothing of the points is lost."""
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b)) for a, b in rng.normal(0, 1, (5000, 2)).round(2)] * 2
    pieces = kmeans._points(spark.createDataFrame(rows, ["x0", "x1"]).repartition(3), ["x0", "x1"]).collect()
    assert len(pieces) < 100
    held = {(a, b): w for p in pieces for a, b, w in zip(p["x0"], p["x1"], p["weight"])}
    assert held == {row: float(rows.count(row)) for row in set(rows)}
    assert sum(p["total"][0] for p in pieces) == len(rows)
    assert all(p["low"] == [min(p["x0"]), min(p["x1"])] and p["high"] == [max(p["x0"]), max(p["x1"])] for p in pieces)


@pytest.mark.parametrize("k", [1, 5, 300])
def test_kmeans_settles_pieces(monkeypatch, k):
    """Sums of clusters are those of all points, though few points meet few centres."""
    points, weight = along_lines(30000, k)
    centers = points[np.random.default_rng(k).choice(len(points), k, replace=False)]
    label = kmeans._distances(points, centers).argmin(axis=1)
    wanted = np.zeros((k, 4))
    kmeans._add(wanted, label, kmeans._measures(points, weight))
    pieces, got = pieces_of(points, weight), np.zeros((k, 4))
    met = counting_distances(monkeypatch)
    kmeans._settle(got, pieces, kmeans._measures(points, weight), centers)
    assert np.abs(got - wanted).max() < 1e-6
    assert sum(met) < len(points) * k / 4


@pytest.mark.parametrize("n, size, f", [(30000, 20, 60), (30000, 1, 0), (50, 20, 3), (15, 20, 4)])
def test_kmeans_draws_few(monkeypatch, n, size, f):
    """The points drawn are those of a draw that asks all points for their distance."""
    points, weight = along_lines(n, f)
    found = points[np.random.default_rng(f).choice(n, f, replace=False)]
    pieces = pieces_of(points, weight)
    salt = np.uint64(12345)
    square = ((points[:, None, :] - found[None]) ** 2).sum(-1).min(1) if f else np.ones(n)
    with np.errstate(divide="ignore"):
        rings = -np.log(kmeans._even(pieces.draw, salt)) / (weight * square)
    order = np.argsort(rings)[: min(size, n - f)]
    met = counting_distances(monkeypatch)
    heaviest = np.maximum.reduceat(pieces.weight, pieces.ends[:-1])
    fastest = heaviest * kmeans._farthest(pieces, found) if f else heaviest
    at, got = np.empty((0, 2)), np.empty(0)
    begin, end = 0, kmeans.FIRST_PIECES
    while begin < len(heaviest):
        at, got = kmeans._earliest(pieces, slice(begin, end), found, salt, fastest[begin:end], size, at, got)
        begin, end = end, 2 * end
    assert np.array_equal(at[: len(order)], points[order])
    assert np.abs(got[: len(order)] / rings[order] - 1).max() < 1e-6
    if n > 1000:
        assert sum(met) <= n * f / 5


def test_forest(spark):
    rng = np.random.default_rng(42)
    values = rng.normal(1000, 200, 1000)
    values[0], values[1] = 5000, -2000
    table = spark.createDataFrame([(i, float(v), float(w)) for i, (v, w) in enumerate(zip(values, rng.normal(size=1000)))], "id long, q double, w double")
    scored = forest.isolation_forest(table, "id", ["q", "w"])
    flagged = {r["id"] for r in scored.filter("is_anomaly").collect()}
    assert {0, 1} <= flagged and 90 <= len(flagged) <= 100
    lowest = [r["id"] for r in scored.orderBy("score").limit(3).collect()]
    assert {0, 1} <= set(lowest)  # row 949 is far out in both features
    moved = forest.isolation_forest(table.repartition(7, "w"), "id", ["q", "w"])
    assert {r["id"] for r in moved.filter("is_anomaly").collect()} == flagged
    summary = forest.isolation_summary(scored).first()
    assert summary["total_rows"] == 1000 and summary["total_anomalies"] == len(flagged)


def best_match(name, others, threshold=0.6):
    def score(a, b):
        a, b = a.lower(), b.lower()
        if a == b:
            return 1.0
        if a in b or b in a:
            return 0.8
        wa, wb = set(re.split(r"[_\s]+", a)), set(re.split(r"[_\s]+", b))
        return len(wa & wb) / len(wa | wb)

    ranked = sorted((-score(name, o), o) for o in others)
    return (name, ranked[0][1], -ranked[0][0]) if ranked and -ranked[0][0] >= threshold else None


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.85])
def test_matching(spark, threshold):
    rng = np.random.default_rng(6)
    words = ["gas", "day", "eff", "loc", "name", "id", "a", "qty", "scheduled", "pipe"]

    def names(n):
        made = ["_".join(rng.choice(words, rng.integers(1, 5))) for _ in range(n)]
        return made + ["A", "id", "Gas Day", "gasday", "xyz", "LOC name"]

    left, right = names(60), names(50)
    got = matching.fuzzy_match_top1(
        spark.createDataFrame([(n,) for n in left] + [(None,)], "name string"),
        spark.createDataFrame([(n,) for n in right], "name string"),
        threshold=threshold,
    )
    wanted = {m for n in set(left) if (m := best_match(n, set(right), threshold))}
    assert {(r[0], r[1], round(r[2], 9)) for r in got.collect()} == {(a, b, round(s, 9)) for a, b, s in wanted}
