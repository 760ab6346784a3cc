from __future__ import annotations

import hashlib
import random
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gasflow.llm import periodic
from gasflow.llm.queries import QUERIES, repeated_words

FOLDER = "/root/testdata/sf0.001"


def plain_runs(words, least=24):
    """All runs, lag by lag; a stretch that has a smaller period too is a run of that."""
    found, n = [], len(words)
    for lag in range(1, n // 3 + 1):
        i = 0
        while i < n - lag:
            if words[i] != words[i + lag]:
                i += 1
                continue
            first = i
            while i < n - lag and words[i] == words[i + lag]:
                i += 1
            length = i - first + lag
            part = words[first : first + length]
            if length >= max(least, 3 * lag) and not any(part[t:] == part[:-t] for t in range(1, lag)):
                found.append((first, length, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 4), st.integers(1, 70), st.integers(3, 6))
def test_planted_repeats(seed, letters, period, times):
    draw = random.Random(seed)
    text = lambda n: [b"abcdefgh"[j : j + 1] for j in (draw.randrange(letters) for _ in range(n))]
    unit = text(period)
    words = text(draw.randrange(40)) + unit * times + unit[: draw.randrange(period)] + text(draw.randrange(40))
    other = text(draw.randrange(90))
    assert periodic.runs_of([words, [], other]) == [plain_runs(words), [], plain_runs(other)]


def test_structured_words():
    thue_morse = [b"ab"[bin(i).count("1") % 2 : bin(i).count("1") % 2 + 1] for i in range(700)]
    fibonacci = [b"a"]
    before = [b"b"]
    while len(fibonacci) < 700:
        fibonacci, before = fibonacci + before, fibonacci
    cases = [thue_morse, thue_morse * 3, fibonacci, [b"x"] * 900, [b"x", b"y"] * 23, [b"x"] * 23, [b"x"] * 24, fibonacci[:233] * 4]
    assert periodic.runs_of(cases) == [plain_runs(c) for c in cases]


def test_long_period_of_a_long_text():
    draw = random.Random(5)
    unit = [b"%d" % draw.randrange(300) for _ in range(20_011)]
    words = [b"head"] * 5 + unit * 3 + unit[:17]
    assert periodic.runs_of([words]) == [[(5, 3 * 20_011 + 17, 20_011)]]


def test_collapsed_keeps_first_periods():
    words = [b"h", *[b"a", b"b"] * 15, b"t"]
    (runs,) = periodic.runs_of([words])
    assert runs == [(1, 30, 2)] and periodic.collapsed(words, runs) == b"h a b t"


def test_edge_rows(spark):
    rows = [(1, None, 7), (1, "", 7), (None, "x " * 30, 8), (2, "x\x0b \x1cx " * 30, 9), (2, "x\x0b \x1cx " * 30, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int").withColumn("a b", F.lit(1))
    got = periodic.run_digest(periodic.find_runs(docs)).collect()
    assert [r.n_runs for r in got] == [0, 0, 1, 1, 1] and got[0]["a b"] == 1
    assert [r.start for r in got[:3]] == [None, None, 0]
    assert [(r.n_words, r.length, r.period, r.exponent_milli) for r in got[2:]] == [(30, 30, 1, 30000), (60, 60, 2, 30000), (60, 60, 2, 30000)]
    assert got[0].collapsed_sha256 == got[0].runs_sha256 == hashlib.sha256(b"").hexdigest()
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_strongest_is_exact(spark):
    runs = [(0, 30, 9), (5, 40, 12), (9, 50, 15), (50, 33, 10)]
    df = spark.createDataFrame([(runs,)], "runs array<struct<start:long,length:long,period:long>>")
    assert tuple(df.select(periodic.strongest(F.col("runs")).alias("b")).first().b) == (0, 30, 9)


@pytest.mark.parametrize("folder", [FOLDER])
def test_query_against_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = {r.doc_id: r for r in QUERIES["op13_runs"](spark, folder).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = repeated_words(d.doc_id, (d.text or "").encode().split())
        r = got[d.doc_id]
        runs = plain_runs(words) if len(words) < 1200 else periodic.runs_of([words])[0]
        some += bool(runs)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None,) * 3)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        dropped = {i for a, b, c in runs for i in range(a + c, a + b)}
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest()
    assert some > 10
