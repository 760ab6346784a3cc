from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gasflow.llm import decontaminate as d
from gasflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def check(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, items int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = d.contamination(d.find_items(docs.drop("items"), bench, **options)).collect()
    assert len(found) == len(texts)
    for r in found:
        n, hit, listed = d.brute_hits(texts[r.doc_id], items)
        listed -= {None}
        assert (r.n_words, set(r.hit_words), set(r.items)) == (n, hit, listed), texts[r.doc_id]
        assert (r.n_hit, r.n_items, r.items_sha256) == (len(hit), len(listed), d.items_digest(listed))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


@pytest.mark.parametrize("set_bytes", [1 << 20, 40])
def test_random_texts_against_plain_search(spark, set_bytes):
    rng = random.Random(3)
    vocabulary = ["a", "B", "çé", "d1", "ee"]
    text = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i % 7, text(rng.choice([1, 3, 5, 12, 13, 14, 20]))) for i in range(12)] + [(None, text(3)), (50, None), (51, "."), (52, "")]
    texts = [text(rng.randint(0, 700)) for _ in range(30)] + [None, "", "...", items[3][1].upper(), "x " + items[4][1] + " y"]
    check(spark, texts, [(i, t) for i, t in items if t is None or len(t.split()) != 1 or i == 51], set_bytes=set_bytes)
    check(spark, ["a b a", "a b", "b"], [(1, "A b"), (1, "A b"), (2, "a")], set_bytes=set_bytes)


def test_no_window_crosses_documents_and_long_text(spark):
    item = " ".join(f"w{i}" for i in range(13))
    half = " ".join(f"w{i}" for i in range(6)), " ".join(f"w{i}" for i in range(6, 13))
    check(spark, [half[0], half[1], "z " * 300_000 + item + " z" * 999, item * 1], [(9, item)])


def test_empty_tables(spark):
    check(spark, ["a b"], [(None, None)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.find_items(empty, bench).count() == 0
    assert d.find_items(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), bench).first().n_words == 2


def test_query_against_plain_search(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = QUERIES["op4_decontaminate"](spark, FOLDER).collect()
    assert len(rows) == len(docs) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, listed = d.brute_hits(docs[r.doc_id], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, len(hit), len(listed), d.items_digest(listed))


def test_other_columns_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x")], "doc_id long, text string, n_words int, extra string")
    row = d.find_items(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")).select("extra", "n_words", F.size("hit_words")).first()
    assert tuple(row) == ("x", 3, 2)


def test_items_named_by_strings(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, None, "y")], "doc_id long, text string, items string")
    items = spark.createDataFrame([("q/2", "b c"), ("q/10", "d"), (None, "a")], "item_id string, text string")
    got = d.find_items(docs, items).orderBy("doc_id").collect()
    assert (got[0]["items"], got[0].hit_words, got[1]["items"]) == (["q/10", "q/2"], [0, 1, 2, 3], [])
