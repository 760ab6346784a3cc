from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gasflow.llm import language, scoring
from gasflow.llm.blocks import TOKEN_BYTES, WORD_BYTES, Words
from gasflow.llm.ppm import ContextTree, Table, adaptive_bits, bits_by_tree, counted, grams_of, text_bits
from gasflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TEXTS = [b"banana bandana", b"", b"abracadabra", b"\xc3\xa9t\xc3\xa9", b"a\0b"]


def plain_bits(training: list[bytes], text: bytes, order: int, least: int = 1) -> float:
    """Dictionary version of the frozen model."""
    seen: list[dict] = [defaultdict(lambda: defaultdict(int)) for _ in range(order + 1)]
    for t in training:
        padded = b"\0" * order + t + b"\0"
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[k][padded[i - k : i]][padded[i]] += 1
    total, padded = 0.0, b"\0" * order + text + b"\0"
    for i in range(order, len(padded)):
        out: set[int] = set()
        for k in range(order, -1, -1):
            every = seen[k].get(padded[i - k : i], {})
            kept = {b: n for b, n in every.items() if n >= least}
            if not kept:
                out = set()
                continue
            escape = sum(every.values()) - sum(kept.values()) + len(kept)
            weight = sum(n for b, n in kept.items() if b not in out) + escape
            if padded[i] in kept:
                total += math.log2(weight / kept[padded[i]])
                break
            total += math.log2(weight / escape)
            out = set(kept)
        else:
            total += math.log2(256 - len([b for b, n in seen[0].get(b"", {}).items() if n >= least]))
    return total


@pytest.mark.parametrize("order", [0, 1, 3, 4])
def test_frozen_tree_against_dictionaries(order):
    tree = ContextTree.of(*counted(grams_of(TEXTS, order)[0]), order)
    unseen = [b"banal cab", b"zzz", b"", "ü".encode(), b"abra\0", b"an"]
    assert np.allclose(text_bits(tree, unseen), [plain_bits(TEXTS, t, order) for t in unseen])


def test_probabilities_of_the_next_byte_add_up():
    tree = ContextTree.of(*counted(grams_of(TEXTS, 2)[0]), 2)
    for context in (b"an", b"zz", b"na", b"\0\0"):
        keys = np.array([context[0] << 16 | context[1] << 8 | b for b in range(256)], np.uint64)
        assert abs(np.exp2(-tree.bits(keys)).sum() - 1) < 1e-9


def test_adaptive_code_of_a_repetition_is_short():
    assert adaptive_bits(b"abcd" * 50, 3) < adaptive_bits(bytes(random.Random(1).randbytes(200)), 3) / 5
    assert adaptive_bits(b"", 2) == 8.0


def test_table():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000, dtype=np.uint64))
    table = Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all() and (Table(keys[:0]).find(keys) == -1).all()
    assert (table.find(keys + np.uint64(1 << 41)) == -1).all()


def test_words_across_segments():
    import re

    text = ("lorem ipsum, " * 200_000).encode() + b"x" * 3_000_000 + b" end"
    words = Words([b"a B", text, b"", b"b"], WORD_BYTES)
    got = [words.buffer[s:e] for s, e in zip(words.starts, words.ends, strict=True)]
    assert got == re.findall(rb"[0-9a-z\x80-\xff]+", b" ".join([b"a b", text, b"", b"b"]))
    assert len(set(words.numbers.tolist())) == len(set(got)) and np.diff(words.bounds).tolist() == [2, 400002, 0, 1]


def plain_base(spark_rows):
    import re
    import zlib

    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in spark_rows}
    count = defaultdict(int)
    for r in spark_rows:
        for t in tokens(r.text) if not held[r.doc_id] else ():
            count[t] += 1
    n = sum(count.values())
    share = n + 0.1 * (len(count) + 1)
    return {
        r.doc_id: (held[r.doc_id], len(w := tokens(r.text)), sum(count[t] > 0 for t in w), n, sum(math.log10((count.get(t, 0) + 0.1) / share) for t in w))
        for r in spark_rows
    }


def test_score_query_against_plain_counts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    want = plain_base(rows)
    got = QUERIES["op9_score"](spark, FOLDER).collect()
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
    training = [(r.text or "").encode() for r in rows if not want[r.doc_id][0]][:]
    some = got[0]
    text = next((r.text or "").encode() for r in rows if r.doc_id == some.doc_id)
    assert abs(some.score + plain_bits(training, text, scoring.ORDER) * math.log10(2)) < 1e-6 * abs(some.score)


def test_score_with_pruning_and_nothing_shipped(spark):
    texts = ["the cat the hat", "the the dog", None, "", "the cat the hat"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n int")
    raw = [(t or "").encode() for t in texts]
    model, tokens = scoring.train(docs, order=2, share=20, shipped=0)
    least = -(-sum(len(t) + 1 for t in raw) // 20)
    for r in scoring.score(docs, model, tokens).collect():
        assert abs(r.score + plain_bits(raw, raw[r.doc_id], 2, least) * math.log10(2)) < 1e-9
        assert r.n_known == r.n_tokens
    more, all_tokens = scoring.train(docs, order=2)
    a, b = (sorted((r.doc_id, round(r.base_score, 9)) for r in scoring.score(docs, *x).collect()) for x in ((model, tokens), (more, all_tokens)))
    assert a == b


@pytest.mark.parametrize("order", [0, 4])
def test_score_with_all_grams_of_which_few_are_shipped(spark, order):
    texts = ["the cat the hat", "the the dog", None, "é été", "zzz"]
    raw = [(t or "").encode() for t in texts]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = [-plain_bits(raw[:4], t, order) * math.log10(2) for t in raw]
    for shipped_grams in (0, 4):
        model, tokens = scoring.train(docs.filter("doc_id < 4"), order, shipped_grams=shipped_grams)
        got = {r.doc_id: r.score for r in scoring.score(docs, model, tokens).collect()}
        assert np.allclose([got[i] for i in range(5)], want, atol=1e-9)


def test_score_keeps_rare_grams_of_a_large_corpus(spark):
    # a word seen once beside more than 2^20 bytes of other text
    docs = spark.createDataFrame([(0, "ab " * 200_000), (1, "ab " * 200_000), (2, "xylophon")], "doc_id long, text string")
    model, tokens = scoring.train(docs)
    raw = [b"ab " * 200_000] * 2 + [b"xylophon"]
    seen = {r.doc_id: r.score for r in scoring.score(docs, model, tokens).collect()}
    assert abs(seen[2] + plain_bits(raw, raw[2], scoring.ORDER) * math.log10(2)) < 1e-9


def test_score_of_empty_corpus_and_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model, tokens = scoring.train(empty)
    assert scoring.score(empty, model, tokens).count() == 0
    row = scoring.score(spark.createDataFrame([(None, "ab")], "doc_id long, text string"), model, tokens).first()
    assert row.n_known == 0 and row.doc_id is None and abs(row.score + 24 * math.log10(2)) < 1e-9
    assert scoring.score_adaptively(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().score < 0


def test_language_of_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op6_language"](spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and len(held) > 20 and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_language_edges(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 !?", "de"), (4, "hello there world", "en"), (5, "guten tag welt", "de"), (6, "hallo", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, score double")
    trees = language.fit(docs, order=2)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(docs, trees).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en" and got[5][0] == "de"
    assert {r.lang_pred for r in language.identify(docs, {}).collect()} == {"und"}
    assert language.identify(docs.limit(0), trees).count() == 0
    assert {r.doc_id for r in language.recognised(language.identify(docs, trees)).collect()} == {4, 5, 6}
    assert language.fit(docs.limit(0)) == {}


def test_clean_documents_of_many_bits_are_recognised(spark):
    trees = language.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    texts = ["the", "yes", "Hello", "THE OFFICE WILL BE CLOSED ON FRIDAY", "Total 12.99, 4 x 3.25, 13.00, 7.45, 118.60", None, "12 !?"]
    found = language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), trees)
    assert all(r.bits_per_byte > 6 for r in found.filter("doc_id in (0, 3, 4)").collect())
    assert {r.doc_id for r in language.recognised(found).collect()} == {0, 1, 2, 3, 4}


def test_labelled_sample_keeps_to_its_limit(spark):
    docs = spark.range(2000).selectExpr("concat('text ', id) as text", "if(id % 2 = 0, 'a', 'b') as lang")
    sample = language.labelled_sample(docs, 1000).collect()
    for lang in "ab":
        assert 100 < sum(len(r.text) for r in sample if r.lang == lang) <= 1000


def test_labelled_sample_counts_copies_once_and_takes_part_of_a_level(spark):
    rows = spark.range(1000).selectExpr("concat('text ', id) as text", "'a' as lang", "if(id % 100 = 0, 5000, 1) as times")
    docs = rows.selectExpr("text", "lang", "explode(sequence(1, times)) as copy")
    assert language.labelled_sample(docs, 20_000).count() == 1000
    assert 5000 < sum(len(r.text) for r in language.labelled_sample(docs, 6000).collect()) <= 6000


def test_bits_by_tree_are_those_of_each_tree():
    trees = [ContextTree.of(*counted(grams_of(part, 3)[0]), 3) for part in ([b"abab", b"ba"], [b"xyz" * 9])]
    texts = [b"ab", b"", b"xyzab" * 20, b"\xc3\xa9"]
    assert (bits_by_tree(trees, texts) == np.stack([text_bits(t, texts) for t in trees], 1)).all()
    assert bits_by_tree(trees, []).shape == (0, 2)


def test_columns_of_clashing_names(spark):
    rows = [(1, "the cat sat", 7, "p"), (2, None, 8, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, has_letter int, bits string")
    trees = language.fit(docs.withColumn("lang", F.lit("en")))
    got = language.identify(docs, trees).orderBy("doc_id").collect()
    assert [(r.has_letter, r.bits, r.lang_pred) for r in got] == [(7, "p", "en"), (8, "q", "und")]
    model, tokens = scoring.train(docs)
    kept = ("doc_id", "has_letter", "bits", "base", "score")
    frame = docs.withColumns({"base": F.lit(1), "score": F.lit("mine")})
    scored = scoring.score(frame, model, tokens, keep=kept).orderBy("doc_id").collect()
    assert [(r.doc_id, r.has_letter, r.bits, r.base) for r in scored] == [(1, 7, "p", 1), (2, 8, "q", 1)] and scored[0].score < 0
