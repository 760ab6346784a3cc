from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gasflow.llm import links, neardup_texts as t, neardup_vectors as v
from gasflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def closed(n, adjacent):
    """Direct links and smallest reachable place of each of n rows."""
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(adjacent), strict=True):
        a, b = top(i), top(j)
        root[max(a, b)] = min(a, b)
    return [(int(adjacent[i].sum()), top(i)) for i in range(n)]


def plain_vectors(rows, threshold=0.93):
    n = len(rows)
    adjacent = np.zeros((n, n), bool)
    ok = [r[2] is not None and len(r[1] or ()) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
                adjacent[i, j] = adjacent[j, i] = x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold
    return closed(n, adjacent)


@pytest.mark.parametrize("tile_rows", [7, 1024])
def test_vectors_against_all_pairs(spark, tile_rows):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + rng.normal(size=8) * rng.choice([0.05, 0.2, 0.4])).tolist(), i % 2) for i in range(150)]
    rows += [(200 + i, rows[4][1], 0) for i in range(20)]
    rows += [(300, None, 1), (301, [0.0] * 8, 1), (302, [1.0, None] + [0.0] * 6, 1), (303, [float("nan")] * 8, 1), (304, rows[0][1], None)]
    rows += [(305, [], 1), (306, [1.0], 1), (307, [2.0], 1), (308, [-3.0], 1), (309, [1e300] * 8, 0), (310, [2e300] * 8, 0), (311, [float("inf")] + [0.0] * 7, 1)]
    rows.sort()
    with np.errstate(over="ignore", invalid="ignore"):
        want = plain_vectors([(i, [x * 1e-300 for x in w] if i in (309, 310) else w, l) for i, w, l in rows])
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int, n_links int")
    got = {r.vec_id: r for r in v.link_vectors(df, tile_rows=tile_rows).collect()}
    for (i, _, _), (n, root) in zip(rows, want, strict=True):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n, rows[root][0], root == [r[0] for r in rows].index(i)), i


def test_vectors_empty_null_id_and_repeated(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert v.link_vectors(spark.createDataFrame([], schema)).count() == 0
    got = v.link_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], schema)).collect()
    assert sorted((r.n_links, r.component_id) for r in got) == [(2, 2)] * 3


def test_vector_query_against_all_pairs(spark):
    rows = sorted((r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect())
    want = plain_vectors(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in QUERIES["op3_neardup"](spark, FOLDER).collect()}
    assert got == {rows[i][0]: (n, rows[root][0]) for i, (n, root) in enumerate(want)}


def test_bounded_cosines_equal_full_products():
    rng = np.random.default_rng(2)
    x, y = (rng.normal(size=(n, 16)) for n in (40, 60))
    y[:40] = x + 0.2 * rng.normal(size=x.shape)
    x, y = (a / np.linalg.norm(a, axis=1)[:, None] for a in (x, y))
    assert (v.bounded_cosines(x, y, 0.9) == (x @ y.T >= 0.9)).all()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_texts(texts, threshold=0.8):
    sets = []
    for text in texts:
        w = words(text)
        k = min(5, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    n = len(sets)
    adjacent = np.zeros((n, n), bool)
    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            adjacent[i, j] = adjacent[j, i] = both > 0 and both >= threshold * len(sets[i] | sets[j]) - 1e-9
    return closed(n, adjacent)


def linked(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    df = spark.createDataFrame([(i, x, "b") for i, x in zip(ids, texts, strict=True)], "doc_id long, text string, key string")
    return df, t.link_texts(df)


def test_texts_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(t, "SKETCH_TILE", 5)
    monkeypatch.setattr(t, "SET_TILE", 5)
    rng = random.Random(8)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 999)}" for _ in range(rng.choice([5, 20, 60, 300]))]
        for _ in range(rng.randint(1, 8)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = "x"
            texts.append(" ".join(copy))
    texts += [None, "", "...", "one two", "One, TWO", "one two three", "only", "é " * 50_000, texts[0], texts[0].upper()]
    want = plain_texts(texts)
    got = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in linked(spark, texts)[1].collect()}
    assert got == {i: (n, root, root == i) for i, (n, root) in enumerate(want)}


def test_text_query_against_all_pairs(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    want = plain_texts([x for _, x in docs])
    got = {r.doc_id: (r.n_links, r.class_id) for r in QUERIES["op10_jaccard"](spark, FOLDER).collect()}
    assert got == {docs[i][0]: (n, docs[root][0]) for i, (n, root) in enumerate(want)}


def test_one_of_each_and_null_ids(spark):
    text = "a b c d e f g h"
    df, result = linked(spark, [text, text, "other words stay here", None, text, "x y"], [None, 4, 4, None, 4, None])
    kept = t.one_of_each(df, result).collect()
    assert Counter(r.text for r in kept) == Counter([text, "other words stay here", None, "x y"]) and len(kept[0]) == 3
    assert t.one_of_each(df.limit(0), t.link_texts(df.limit(0))).count() == 0


def test_recall_of_the_forest():
    depth = t.prefix_depth(0.8)
    assert 1 - (1 - 0.8**depth) ** t.TREES >= t.RECALL > 1 - (1 - 0.8 ** (depth + 1)) ** t.TREES
    rng = np.random.default_rng(3)
    seeds = t._seeds(t.TREES * depth)
    for _ in range(50):
        shared, own = rng.integers(0, 1 << 63, 800, dtype=np.uint64), [rng.integers(0, 1 << 63, 100, dtype=np.uint64) for _ in "ab"]
        a, b = (t.signature(np.concatenate((shared, o)), seeds).reshape(t.TREES, depth) for o in own)
        assert (a == b).all(1).any() and 0.6 < (a == b).mean()


def test_stars():
    rng = np.random.default_rng(1)
    for n, m, same in ((8, 8, True), (5, 9, False)):
        a = rng.random((n, m)) < 0.15
        if same:
            a |= a.T
        left, right = links.stars(a.copy(), same)
        size = n if same else n + m
        whole = np.zeros((size, size), bool)
        whole[:n, (0 if same else n) :] = a
        want = [r for _, r in closed(size, whole | whole.T)]
        assert [*left, *([] if same else right)] == want


def trie_rows(labels, sketches, sizes):
    return pa.record_batch(
        {
            "number": pa.array(range(len(labels)), pa.int64()),
            "tree": pa.array([x[0] for x in labels], pa.int32()),
            "prefix": pa.array([x[1] for x in labels], pa.int64()),
            "longer": pa.array([list(x[2:]) for x in labels], pa.list_(pa.int32())),
            "shingles": pa.array(sizes, pa.int32()),
            "sketch": pa.array([s.tobytes() for s in sketches], pa.binary()),
        }
    )


@pytest.mark.parametrize("batch_rows", [1, 3, 1000])
def test_walk_links_to_the_deepest_branch_that_is_alike(batch_rows):
    rng = np.random.default_rng(4)
    labels = sorted((int(a), int(b), int(c), int(d)) for a, b, c, d in rng.integers(0, 3, (120, 4)))
    kinds = rng.integers(0, 256, (3, 96)).astype(np.uint8)
    kind = rng.integers(0, 3, 120)
    rows = trie_rows(labels, kinds[kind], [10] * 120)
    want = {}
    for i, label in enumerate(labels):
        for depth in (4, 3, 2):
            first = min(j for j in range(120) if labels[j][:depth] == label[:depth])
            if first != i and kind[first] == kind[i]:
                want[i] = first
                break
    parts = [rows.slice(at, batch_rows) for at in range(0, 120, batch_rows)]
    got = [(r["a"], r["b"]) for part in t.walk_tries(iter([rows.slice(0, 0), *parts]), 0.8) for r in part.to_pylist()]
    assert len(got) == len(set(got)) and dict(got) == want
    assert list(t.walk_tries(iter([]), 0.8)) == []


def test_walk_minds_the_sizes_of_sets():
    same = np.zeros((2, 96), np.uint8)
    assert [p.num_rows for p in t.walk_tries(iter([trie_rows([(0, 1)] * 2, same, [10, 20])]), 0.8)] == [0]
    assert [p.num_rows for p in t.walk_tries(iter([trie_rows([(0, 1)] * 2, same, [10, 11])]), 0.8)] == [1]
