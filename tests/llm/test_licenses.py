from __future__ import annotations

import pytest

from gasflow.llm import licenses
from gasflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.read.parquet(f"{FOLDER}/documents.parquet"))


def found(spark, model, texts):
    rows = [(i, t, "x", 1.5, "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, features string, probability double, prediction string")
    return sorted((r.doc_id, r.paragraph_no, r.family, r.features) for r in licenses.scan(df, model).collect() if r.confirmed)


def test_notices_in_other_words(spark, model):
    texts = [
        "plain line\n\nThis program is licensed under the GNU General Public License, version 3 or later.\nend",
        "# Licensed under the Apache License, Version 2.0 (see file)",
        "The of and that.\nAll rights reserved.",
        "We have a license to drive and rights to know.",
        "Permission was asked for the software.",
        "released under the mit license",
    ]
    assert found(spark, model, texts) == [(0, 2, "gpl", "x"), (1, 0, "apache-2.0", "x"), (2, 1, "all-rights-reserved", "x"), (5, 0, "mit", "x")]


def test_edges(spark, model):
    assert found(spark, model, [None, "", "\n\n", "word " * 100_000]) == []
    line = "Licensed under CC BY-NC 4.0."
    assert found(spark, model, [line, line, f"{line}\n{line}"]) == [(0, 0, "cc-by-nc", "x"), (1, 0, "cc-by-nc", "x"), (2, 0, "cc-by-nc", "x"), (2, 1, "cc-by-nc", "x")]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(empty, model).count() == 0
    alone = licenses.train(empty)
    assert found(spark, alone, ["Released under the MIT License.", "nothing here"]) == [(0, 0, "mit", "x")]


def test_every_template_is_its_own_family(spark, model):
    texts = [(f, t) for f, ts in licenses.TEMPLATES.items() for t in ts]
    got = found(spark, model, [t for _, t in texts])
    assert [(f,) for f, _ in texts] == [(g[2],) for g in got]


def test_words_without_which_no_family_wins(spark, model, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()] + ["of the license", "mit"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    gated = licenses.scan(df, model).collect()
    assert model.anchors(0.5) and len(model.anchors(0.5)) < 150
    monkeypatch.setattr(licenses.LicenseModel, "anchors", lambda *_: None)
    assert sorted(map(str, licenses.scan(df, model).collect())) == sorted(map(str, gated))


def test_query_finds_the_planted_lines(spark):
    wanted = {
        "Released under the MIT License.": "mit", "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl", "All rights reserved.": "all-rights-reserved",
    }
    want = sorted(
        (r.doc_id, i, wanted[line]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect() for i, line in enumerate((r.text or "").split("\n")) if line in wanted
    )
    got = sorted((r.doc_id, r.paragraph_no, r.family) for r in QUERIES["op1_licenses"](spark, FOLDER).collect() if r.confirmed)
    assert len(want) > 5 and got == want
