"""Quantiles, ranks, chunked windows and components against plain computations."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gasflow.functions.chunks import into_chunks
from gasflow.functions.components import connected_components
from gasflow.functions.quantiles import column_quantiles, quantiles, scalar_quantiles
from gasflow.functions.ranks import with_average_ranks
from gasflow.operators import operations, profiling

PROBS = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]


@pytest.mark.parametrize("shape", ["spread", "ties", "skewed", "one value"])
def test_quantiles_of_many_values(spark, shape):
    values = {
        "spread": "randn(3) * 1000",
        "ties": "floor(rand(3) * 7)",
        "skewed": "exp(randn(3) * 6)",
        "one value": "7.5",
    }[shape]
    table = spark.range(120_000).select("id", F.expr(values).cast("double").alias("v"), (F.col("id") % 9 > 5).alias("hot"))
    frame = table.toPandas()
    got = quantiles(table, "v", PROBS).first()
    assert got["n"] == len(frame)
    assert np.allclose(got["q"], frame["v"].quantile(PROBS), rtol=1e-12)
    keyed = {r["hot"]: r["q"] for r in quantiles(table, "v", PROBS, ["hot"]).collect()}
    for hot, part in frame.groupby("hot"):
        assert np.allclose(keyed[hot], part["v"].quantile(PROBS), rtol=1e-12)


def test_quantiles_of_few_or_no_values(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), ("c", 5.0)], "k string, v double")
    got = {r["k"]: (r["n"], r["q"]) for r in quantiles(table, "v", [0.5], ["k"]).collect()}
    assert got.pop("a") == (2, [1.5]) and got.pop("c") == (1, [5.0])
    assert all(n == 0 for n, _ in got.values())
    empty = quantiles(table.filter("v > 99"), "v", [0.5]).first()
    assert (empty["n"], empty["q"]) == (0, None)
    assert table.select(scalar_quantiles(table, "v", [0.5])[0]).first()[0] == 2.0
    assert [tuple(r) for r in column_quantiles(table, ["v"], [0.5]).collect()] == [("v", 3, [2.0])]


def test_average_ranks(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"a": rng.integers(0, 40, 3000).astype(float), "b": rng.normal(size=3000)})
    frame.loc[:1000, "a"] = 17.0
    ranked = with_average_ranks(spark.createDataFrame(frame), ["a", "b"]).toPandas()
    wanted = frame.rank()
    assert sorted(map(tuple, ranked.to_numpy())) == sorted(map(tuple, wanted.to_numpy()))


def test_average_ranks_in_shares(spark, monkeypatch):
    """Rows are dealt out by their number, whatever the number of shuffle partitions; frequent, rare and signed zero values get their ranks."""
    rng = np.random.default_rng(6)
    frame = pd.DataFrame({"a": rng.integers(0, 3, 4000).astype(float), "b": rng.normal(size=4000).round(2), "c": rng.normal(size=4000)})
    frame.loc[::7, "b"] = -0.0
    frame.loc[3::7, "b"] = 0.0
    monkeypatch.setattr("gasflow.functions.sizing.A_SHARE", 500, raising=False)
    dealt = []
    repartition = type(spark.range(0)).repartition
    monkeypatch.setattr(type(spark.range(0)), "repartition", lambda df, n, *keys: dealt.append(n) or repartition(df, n, *keys))
    ranked = with_average_ranks(spark.createDataFrame(frame), ["a", "b", "c"]).toPandas()
    assert sorted(map(tuple, ranked.to_numpy())) == sorted(map(tuple, frame.rank().to_numpy()))
    assert dealt.count(24) == 2


def history(spark, rows=400, days=12, intraday=False):
    rng = np.random.default_rng(8)
    days = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, days, rows), unit="D")
    if intraday:
        days = days + pd.to_timedelta(rng.choice([0, 5, 5, 5, *range(100)], rows), unit="m")
    frame = pd.DataFrame(
        {
            "obs_id": rng.permutation(rows),
            "pipeline_name": rng.choice(["hot", "hot", "hot", "cold"], rows),
            "loc_name": rng.choice(["x", "y"], rows),
            "eff_gas_day": days,
            "rec_del_sign": rng.choice(["R", "D", None], rows),
            "utilization": rng.choice([0.2, 0.85, 0.9, None], rows),
        }
    )
    frame.loc[frame.index % 37 == 0, "eff_gas_day"] = pd.NaT
    frame.loc[frame.index % 41 == 0, "pipeline_name"] = None
    schema = "obs_id long, pipeline_name string, loc_name string, eff_gas_day timestamp, rec_del_sign string, utilization double"
    rows = [tuple(None if pd.isna(v) else (v.to_pydatetime() if isinstance(v, pd.Timestamp) else v) for v in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame([(int(r[0]), *r[1:]) for r in rows], schema), rows


@pytest.mark.parametrize("intraday", [False, True])
@pytest.mark.parametrize("ranges", [2, 11, 120])
@pytest.mark.parametrize("text_ids", [False, True])
def test_chunked_windows_equal_plain_ones(spark, monkeypatch, ranges, intraday, text_ids):
    table, rows = history(spark, days=2 if intraday else 12, intraday=intraday)
    monkeypatch.setattr(operations, "into_chunks", lambda *a: into_chunks(*a, ranges=ranges))
    if text_ids:
        table = table.withColumn("obs_id", F.concat(F.lit("n"), F.lpad("obs_id", 6, "0")))
        rows = [(f"n{r[0]:06d}", *r[1:]) for r in rows]
    wanted, changes = {}, {}
    for pipeline in ("hot", "cold"):
        own = sorted((r for r in rows if r[1] == pipeline), key=lambda r: (r[3] is None, r[3] or 0, r[0]))
        flags = [r[5] is not None and r[5] > 0.85 for r in own]
        before = object()
        for i, r in enumerate(own):
            wanted[r[0]] = sum(flags[max(0, i - 29) : i + 1])
            sign = r[4]
            if sign is None or before is None or sign != before:
                changes[pipeline] = changes.get(pipeline, 0) + 1
            before = sign
    rolled = operations.rolling_high_util(table)
    got = {r["obs_id"]: r["rolling_high_count"] for r in rolled.collect()}
    assert {i for i, n in got.items() if n is None} == {r[0] for r in rows if r[1] is None}
    assert {i: n for i, n in got.items() if n is not None} == wanted
    assert dict(operations.flow_direction_changes(table).collect()) == changes
    without_first = {p: n - 1 for p, n in changes.items()}
    assert dict(operations.flow_direction_changes(table, count_first=False).collect()) == without_first


def test_one_hot_key_is_cut_into_even_ranges(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("k"), F.lit("2024-01-01").cast("timestamp").alias("day"), F.md5(F.col("id").cast("string")).alias("id"))
    sizes = [r["count"] for r in into_chunks(rows, "k", "day", "id", ranges=16).groupBy("_range").count().collect()]
    assert len(sizes) == 16 and sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / 16
    assert into_chunks(rows.limit(0), "k", "day", "id").count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(400, 460)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {n: root(n) for e in edges if e[0] != e[1] for n in e}


def test_distinct_counts_without_expanded_rows(spark):
    """Each column is counted by itself: no row is repeated once per column."""
    rows = [(1, "a", 0.0), (2, "a", -0.0), (None, None, float("nan")), (2, "b", None)]
    table = spark.createDataFrame(rows, "i int, s string, x double")
    counts = profiling.distinct_counts(table)
    assert tuple(counts.first()) == (2, 2, 2)
    for found in (profiling.column_profile(table), profiling.infer_column_kind(table)):
        assert {r["column"]: r["unique_count"] for r in found.collect()} == {"i": 2, "s": 2, "x": 2}
        assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
