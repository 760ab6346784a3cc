from __future__ import annotations

import re
import zlib

import numpy as np
from test_neardup import plain_texts
from tokenizers import Tokenizer

import corpus_pipeline
from gasflow.llm import decontaminate, packing
from gasflow.llm.queries import tokenizer_path

FOLDER = "/root/testdata/sf0.001"
SECRET = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}""", re.A
)


def test_pipeline_against_plain_version(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    docs = [d for d in docs if d[1] and any(c.isalpha() for c in d[1])]
    docs = [docs[i] for i, (_, root) in enumerate(plain_texts([t for _, t in docs])) if root == i]

    def clean(text):
        n, hit, _ = decontaminate.brute_hits(text, items)
        return not hit or 20 * len(hit) < n

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = []
    for i, text in docs:
        if clean(text):
            ids = np.array([*tokenizer.encode(SECRET.sub("[secret]", text), add_special_tokens=False).ids, 2], "<u4")
            start = 0
            for n in packing.piece_lengths(len(ids)):
                want.append((i, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids)))
                start += n
    got = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert got == sorted(want)


def test_stages_keep_the_columns_and_take_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "hello there, a b c d e f", "en", "s", 5), (2, "hello there, a b c d e f", "en", "s", 5), (3, "1 2 3", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, FOLDER)
            assert out.count() <= 40
            if name != "packing":
                assert out.columns == corpus_pipeline.COLUMNS and out.schema == docs.schema
    assert corpus_pipeline.STAGES[1][1](spark, docs, FOLDER).count() == 4
