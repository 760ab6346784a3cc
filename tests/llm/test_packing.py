from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gasflow.llm import packing
from gasflow.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
IDS = packing.WordIds(PATH)
TEXTS = [
    "The cat's hat, isn't it? AND!! 12,345.67 x=1;",
    "",
    None,
    "café café İstanbul ΣΑΣ ß, é. à,",
    "<|endoftext|> in a text <|STARTOFTEXT|>",
    " leading  and\ttabs\x1c\x85 \n\n.\n, .,",
    "word " * 5000,
    "a" * 20000,
    "one, two.\nthree.,",
]


def frame(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, length string, tokens int")


def test_pieces_hold_every_token_once(spark):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack(frame(spark, TEXTS), PATH).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate(TEXTS):
        want = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        got = [int(x) for r in mine for x in np.frombuffer(r.tokens, "<u4")]
        assert got == want, t
        assert [r.start for r in mine] == list(np.cumsum([0] + [r.length for r in mine])[:-1])
        assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 for r in mine)
        assert all(r.doc_tokens == len(want) for r in mine)


def test_digest_and_repeated_rows(spark):
    df = frame(spark, ["a b c"]).union(frame(spark, ["a b c"]))
    pieces = packing.pack(df, PATH)
    rows = packing.piece_digest(pieces).collect()
    assert len(rows) == 2 and len({r.sequence_id for r in rows}) == 2
    tokens = pieces.first().tokens
    assert {r.ids_crc32 for r in rows} == {zlib.crc32(tokens)}


def test_empty_table_null_id_and_buckets(spark, tmp_path):
    assert packing.pack(frame(spark, []), PATH).count() == 0
    df = spark.createDataFrame([(None, "x y z")], "doc_id long, text string")
    pieces = packing.pack(df, PATH)
    assert {r.doc_id for r in pieces.collect()} == {None}
    packing.write_buckets(pieces, str(tmp_path / "b"))
    assert sorted(r.length for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [4]
    with pytest.raises(ValueError):
        packing.pack(df, PATH, longest=3000)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="aBé,. \n'1\tİ!$-<|>é", max_size=40), max_size=5))
def test_ids_equal_the_tokenizer(texts):
    IDS.kept, IDS.earlier = packing._Generation(), IDS.kept
    got = IDS.of_texts([t.encode() for t in texts])
    assert [g.tolist() for g in got] == [IDS.plain(t).tolist() for t in texts]


@given(st.integers(1, 100_000))
def test_piece_lengths(n):
    lengths = packing.piece_lengths(n)
    assert sum(lengths) == n and lengths == sorted(lengths, reverse=True)


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 4)
    ids = packing.WordIds(PATH)
    for text in ("one two three four five six!!", "one seven", "two! eight nine, ten eleven", "one two eight", "", "seven six!! twelve"):
        assert ids.of_texts([text.encode()])[0].tolist() == ids.plain(text).tolist()


def test_sequences_are_numbered_by_bucket(spark):
    pieces = packing.pack(frame(spark, TEXTS * 20).repartition(5), PATH).cache()
    rows = pieces.withColumn("bucket", packing.bucket_of()).collect()
    assert all(r.bucket == r.length for r in rows) and all(r.sequence_id >= 0 for r in rows)
    in_order = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert in_order == sorted(in_order)
    sizes = {r.length: (r.sequences, r.tokens) for r in packing.bucket_sizes(pieces).collect()}
    assert sizes == {n: (in_order.count(n), n * in_order.count(n)) for n in set(in_order)}


def test_query_against_the_tokenizer(spark):
    folder = "/root/testdata/sf0.001"
    tokenizer = Tokenizer.from_file(PATH)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op5_pack"](spark, folder).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.doc_id for r in rows} == set(docs)
    mine = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        mine.setdefault(r.doc_id, []).append(r)
    for doc, pieces in mine.items():
        ids = np.array([*tokenizer.encode(docs[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        start = 0
        for r in pieces:
            assert (r.start, r.ids_crc32, r.doc_tokens, r.offset) == (start, zlib.crc32(ids[start : start + r.length].tobytes()), len(ids), 0)
            start += r.length
        assert start == len(ids) and [r.length for r in pieces] == packing.piece_lengths(len(ids))
