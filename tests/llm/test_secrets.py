from __future__ import annotations

import hashlib
import re

from gasflow.llm import secrets
from gasflow.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
KEY = "aZ3kQ9xT7vB1nM5cR8wE2yU6pL0s"


def plain(text):
    text = text or ""
    letters = "".join
    found = []
    assign = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text, re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    counts = [sum(k == kind for _, kind, _ in found) for k in range(3)]
    written = letters(f"{('assign', 'access', 'hex')[k]}:{s}:{e}," for s, k, e in sorted(found)).rstrip(",")
    return *counts, hashlib.sha256(written.encode()).hexdigest()


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, secrets int")
    return {r.doc_id: r for r in secrets.secret_digest(secrets.find_secrets(df)).collect()}


def test_plain_patterns(spark):
    texts = [
        None, "", "é token = 'abcdefghijkl' x", "TOKEN:short", f"api_key={KEY}", "AKIA" + "A" * 14 + " AKIA123", "0123456789abcdef0 f" * 3,
        "secret=password=abcdefghijklmno", "passwordpassword: abcdefabcdefabcdef", "z" * 200_000 + " Secret : " + "a1" * 20,
    ]
    got = scan(spark, texts)
    for i, t in enumerate(texts):
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex, got[i].base_sha256) == plain(t), t


def test_novel_strings_and_known_ones(spark):
    hidden = f"Authorization: Bearer {KEY} end"
    texts = [hidden, f"private_key => {KEY}", "auth: get_token_value.get_api_config", f"{KEY} is known; bearer {KEY}", "the author wrote of authenticity"]
    got = scan(spark, texts)
    start = hidden.index(KEY)
    assert got[0].spans == f"novel:{start}:{start + len(KEY)}"
    assert [got[i].n_novel for i in range(5)] == [1, 1, 0, 0, 0]


def test_masking(spark):
    df = spark.createDataFrame([(1, f"é a token={KEY} b AKIA{'Z' * 16} c"), (2, "clean"), (3, None), (4, f"token={'ab' * 10}")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secrets.masked(secrets.find_secrets(df)).collect()}
    assert got == {1: "é a [secret] b [secret] c", 2: "clean", 3: None, 4: "[secret]"}
    assert secrets.find_secrets(df.limit(0)).count() == 0


def test_query_against_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op8_secrets"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == plain(docs[r.doc_id])


def test_names_in_camel_case_and_long_names():
    novelty = secrets.Novelty()
    for text in ("clientCredential = Qz8xV3kLm9Tr2WpY7b", "secret_of_the_billing_service_in_the_old_region: Qz8xV3kLm9Tr2WpY7b"):
        assert [(text[a:b]) for a, _, b in secrets.novel_spans(text, text.lower(), novelty)] == ["Qz8xV3kLm9Tr2WpY7b"]
    assert secrets.novel_spans("subtoken Qz8xV3kLm9Tr2WpY7b", "subtoken qz8xv3klm9tr2wpy7b", novelty) == []


def test_values_of_letters_only():
    novelty = secrets.Novelty()
    values = lambda text: [text[a:b] for a, _, b in secrets.novel_spans(text, text.lower(), novelty)]
    about = "The service reads its configuration at the start and sends the requests of all users to the nearest region. "
    for value in ("QwErTyUiOpAsDfGhJkLzXcVb", "qzxvkjwpbymfhgtrcndl"):
        for sign in ("Authorization: Bearer ", "private_key=", "clientCredential = '", "auth => "):
            assert values(f"{about}{sign}{value} {about}") == [value]
            assert values(f"{sign}{value}") == [value]
        assert values(f"{about} the secret {value} {about}") == []
        assert values(f"{about}{value} private_key={value}") == []
    for known in ("auth = get_user_token_value", "pwd: default_password_path", "the bearer internationalization of", "private_key = xxxxxxxxxxxxxxxxxxxxxxxx"):
        assert values(about + known) == []


def test_novel_spans_of_the_query_against_plain_version(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    novelty = secrets.Novelty()
    for r in QUERIES["op8_secrets"](spark, FOLDER).collect():
        text = docs[r.doc_id]
        base = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s and not s.startswith("novel")]
        want = set()
        for m in secrets.CANDIDATE.finditer(text):
            start, end = m.span("value")
            around = [x.encode() for x in (text[max(0, start - 256) : start], m["value"], text[end : end + 256])]
            words = not re.search(r"\d", m["value"]) and (m["value"].isalpha() or m["value"] in (m["value"].lower(), m["value"].upper()))
            judged = novelty.bits(*around) >= 3 and (not words or (m["sign"] and novelty.bits_inside(*around) >= 6.5))
            if judged and not any(a <= start and end <= b for a, b in base):
                want.add(f"novel:{start}:{end}")
        assert {s for s in r.spans.split(",") if s.startswith("novel")} == want
