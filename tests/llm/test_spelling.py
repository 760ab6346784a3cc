from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from gasflow.llm import spelling
from gasflow.llm.queries import QUERIES, shortened


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, least=5, ratio=5):
    words = {w: n for w, n in counts.items() if n >= least}
    blanks = defaultdict(set)  # words that are equal but for one place, or one shorter, share a key
    for w in words:
        blanks[w].add(w)
        for i in range(len(w)):
            blanks[w[:i] + w[i + 1 :]].add(w)
    near = defaultdict(set)
    for group in blanks.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n, len(near[w]), words[form[w]] if form[w] is not None else None)
    return out


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_single_edits_in_tiles():
    draw = random.Random(3)
    words = sorted({"".join(draw.choice("abé") for _ in range(draw.randrange(1, 7))) for _ in range(300)})
    for longest in range(1, 8):
        left = [w for w in words if len(w) == longest]
        right = [w for w in words if longest - 1 <= len(w) <= longest]
        if left and right:
            both = [spelling.single_edits(left, right, longest, s) for s in (False, True)]
            assert not (both[0] & both[1]).any()
            assert (np.array([[one_edit(a, b) for b in right] for a in left]) == (both[0] | both[1])).all()


@pytest.mark.parametrize("tile", [512, 3])
def test_against_plain_version(spark, monkeypatch, tile):
    monkeypatch.setattr(spelling, "TILE", tile)
    draw = random.Random(tile)
    counts = Counter()
    for _ in range(400):
        w = "".join(draw.choice("abc") for _ in range(draw.randrange(0, 9)))
        counts[w] += draw.choice([1, 4, 5, 7, 30, 200, 2000])
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()] + [(None, 50, 1)], "word string, n long, root int")
    assert got(spelling.variants(df)) == plain_variants(counts)


def test_chains_ties_and_repeated_rows(spark):
    rows = [("aaaaaa", 5), ("aaaaab", 25), ("aaaabb", 125), ("aaabbb", 300), ("aaabbb", 400), ("aacaaa", 25), ("lonely", 9), ("a" * 5000, 5), ("a" * 4999, 50)]
    found = got(spelling.variants(spark.createDataFrame(rows, "word string, n long")))
    assert found["aaaaaa"] == ("aaaaab", "aaabbb", 5, 2, 25)
    assert found["aaaabb"] == ("aaabbb", "aaabbb", 125, 2, 700)
    assert found["lonely"] == (None, "lonely", 9, 0, None)
    assert found["a" * 5000][0] == "a" * 4999
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_count_words(spark):
    rows = [(1, "Überall ÜBERALL überall×x abc1defghi", 3), (1, None, 3), (None, "", 3), (None, "überall", 3), (2, "überall", 3), (2, "überall", 3)]
    counts = {r.word: r.n for r in spelling.count_words(spark.createDataFrame(rows, "doc_id long, text string, word int")).collect()}
    assert counts == {"Überall": 1, "ÜberALL".replace("ALL", "all"): 1, "überall": 3, "überall×x": 1, "defghi": 1} | {"Überall": 2}
    assert spelling.count_words(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_plain_version(spark, folder):
    counts = Counter()
    for d in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", d.text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            counts[shortened(d.doc_id, word.encode()).decode()] += 1
    want = plain_variants(Counter({w: n for w, n in counts.items() if len(w) >= 6}))
    assert any(f for f, *_ in want.values())
    assert got(QUERIES["op11_spelling"](spark, folder)) == want
