from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gasflow.llm import quality
from gasflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain_score(trees, row):
    total = trees.start
    for node in trees.roots:
        while trees.below[node] != node:
            node = trees.above[node] if row[trees.feature[node]] > trees.cut[node] else trees.below[node]
        total += trees.value[node]
    return 1 / (1 + np.exp(-total))


def test_flat_trees_equal_a_walk_and_learn():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(600, 5)).round(2)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.2)).astype(float)
    trees = quality.grow(x[:400], y[:400], trees=40, depth=3)
    scores = trees.score(x)
    assert np.allclose(scores, [plain_score(trees, row) for row in x])
    assert ((scores >= 0.5) == y)[400:].mean() > 0.93


def test_first_cut_is_the_best_one():
    draw = np.random.default_rng(2)
    x = draw.integers(0, 12, size=(200, 3)).astype(float)
    y = (x[:, 1] > 6).astype(float)
    y[:30] = 1 - y[:30]
    trees = quality.grow(x, y, trees=1, depth=1)
    g, h = 1 / (1 + np.exp(-trees.start)) - y, np.full(200, 1 / (1 + np.exp(-trees.start))) * (1 - 1 / (1 + np.exp(-trees.start)))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(x[:, f] <= c), f, c) for f in range(3) for c in np.arange(0.5, 11) if min(h[x[:, f] <= c].sum(), h[x[:, f] > c].sum()) >= 1)
    assert (trees.feature[0], trees.cut[0]) == best[1:]


@pytest.mark.parametrize("y", [[], [1.0, 1.0], [0.0]])
def test_no_rows_or_one_class(y):
    scores = quality.grow(np.zeros((len(y), 3)), np.array(y)).score(np.zeros((2, 3)))
    assert ((scores > 0) & (scores < 1)).all() and (scores >= 0.5).all() == (sum(y) * 2 >= len(y))


def test_statistics_by_hand():
    texts = [b"", b"Ab cd cd\nAb cd cd\n!! 12", "é".encode() * 3]
    got = [dict(zip(quality.STATISTICS, row, strict=True)) for row in quality.statistics(texts)]
    assert set(got[0].values()) == {0.0}
    assert got[1]["log_words"] == np.log1p(8) and got[1]["distinct_words"] == 4 / 8 and got[1]["most_frequent_word"] == 4 / 8
    assert got[1]["distinct_lines"] == 2 / 3 and got[1]["distinct_pairs"] == 5 / 7 and got[1]["words_opened_by_mark"] == 1 / 8
    assert got[1]["upper"] == 2 / 23 and got[2]["beyond_ascii"] == 1.0
    joined = quality.statistics([texts[1]])
    assert np.array_equal(joined[0], quality.statistics(texts)[1])


def test_edge_rows(spark):
    rows = [(1, None, 9), (None, "", 9), (2, "word " * 200_000, 9), (2, "word " * 200_000, 9), (3, "!!", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (4, 7)], "doc_id long, quality int")
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert got[0].score == got[1].score and got[2].score == got[3].score
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


def test_held_out_labels(spark):
    got = QUERIES["op12_quality"](spark, FOLDER)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    rows = got.filter("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    high, low = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    above = sum((a > b) + (a == b) / 2 for a in high for b in low) / (len(high) * len(low))
    assert above > 0.9
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    crc = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    assert got.filter(F.col("held_out") != crc).count() == 0
