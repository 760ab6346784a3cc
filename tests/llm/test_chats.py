from __future__ import annotations

import hashlib

from hypothesis import given
from hypothesis import strategies as st

from gasflow.llm import chats
from gasflow.llm.queries import ESCAPED, QUERIES

FOLDER = "/root/testdata/sf0.001"
EVENT = "conv_id long, seq long, kind string, msg long, role string, text string"


def folded(spark, rows):
    messages = chats.fold_events(spark.createDataFrame(rows, EVENT))
    return [(r.conv_id, r.msg, r.role, r.text) for r in messages.orderBy("conv_id", "at").collect()]


def test_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 1, "message", 1, "user", "hi"),
        (1, 2, "message", 2, "assistant", None),
        (1, 4, "delta", 2, None, "wor"),
        (1, 3, "delta", 2, None, "hello "),
        (1, 5, "delta", 2, None, "ld"),
        (1, 6, "message", 3, "user", "more"),
        (1, 7, "message", 4, "assistant", "gone"),
        (1, 8, "regenerate", 2, None, "ignored"),
        (1, 9, "delta", 2, None, "again"),
        (1, 10, "message", 5, "user", "new"),
        (1, 11, "edit", 1, None, "hi there"),
        (1, 12, "delta", 1, None, "!"),
        (1, 13, "typing", 5, None, "no"),
        (2, 1, "message", 1, None, "x"),
        (2, 2, "edit", 1, None, None),
        (None, 1, "message", 1, "user", "n"),
        (3, 1, "delta", 9, "user", "never began"),
    ]
    assert folded(spark, rows) == [
        (None, 1, "user", "n"),
        (1, 1, "user", "hi there!"),
        (1, 2, "assistant", "again"),
        (1, 5, "user", "new"),
        (2, 1, None, ""),
        (3, 9, None, "never began"),
    ]
    assert folded(spark, []) == []


def plain(turns):
    """Reference digest of one conversation's turns ``(role, text)``."""
    told = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(told), len(loss), sha(loss)


def test_query_against_plain_version(spark):
    convs: dict = {-1: [(0, "user", ESCAPED), (1, "assistant", ESCAPED)]}
    for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect():
        convs.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op7_chats"](spark, FOLDER).collect()}
    assert got == {c: plain([t[1:] for t in sorted(turns)]) for c, turns in convs.items()}


def test_repeated_turns_odd_roles_and_long_conversation(spark):
    turns = [(1, 1, "user", "same"), (1, 1, "user", "same"), (1, None, None, None), (1, 2, "a\n</s>\\n\\", "<\\s> [\\\\/INST]"), (1, 3, "assistant", "<</s>[/INST")]
    turns += [(5, i, "assistant" if i % 2 else "user", f"t{i}" * 50) for i in range(3000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chats.conversation_digests(chats.render(chats.fold_events(chats.log_of_turns(df))), ["at"]).collect()}
    first = [turns[2], turns[0], turns[1], turns[3], turns[4]]
    assert got[1] == plain([t[2:] for t in first])
    assert got[5] == plain([t[2:] for t in turns[5:]])


def test_loss_mask_marks_the_assistant_text(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "a</s>b"), (1, 1, "user", "q")], "conv_id long, at long, role string, text string")
    a, u = chats.render(df).orderBy("at").collect()
    assert chats.unescape(a.formatted[a.loss_start : a.loss_end]) == "a</s>b" and u.loss_start is None
    assert a.formatted.count("</s>") == 1 and chats.parse_turn(u.formatted) == ("user", "q")


@given(st.text(alphabet="<>[]/\\sINST", max_size=30))
def test_escapes_are_reversible(text):
    import re

    escaped = re.sub(r"\[(\\*)(/?INST\])", r"[\\\1\2", re.sub(r"<(\\*)(/?s>)", r"<\\\1\2", text))
    assert chats.unescape(escaped) == text and not re.search(r"</?s>|\[/?INST\]", escaped)
