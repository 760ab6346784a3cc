"""Chat formatting from event logs: fold each conversation's events into final messages, then render them.

Events are ``conv_id, seq, kind, msg, role, text``:

* ``message`` begins the message ``msg`` with a role and a first text (or none),
* ``delta`` appends to it,
* ``edit`` replaces its text so far,
* ``regenerate`` empties it and takes back all messages that had begun after it by then.

Each message is folded for itself, so a long conversation is many groups; its turns meet only in a sorted stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "[INST]", "[/INST]"
BEGIN, END = "<s>", "</s>"
LEARNED = "assistant"


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, at, msg, role, text``; ``at`` is the ``seq`` of a message's first event.

    ``seq`` is any type with an order. Events of one message with equal ``seq`` go by kind and text. A message that never
    began has a null role. Null texts are empty; events of other kinds are left out. Null ids are ids of their own.
    """
    rank = F.create_map(*(F.lit(x) for kv in (("message", 0), ("edit", 1), ("regenerate", 2), ("delta", 3)) for x in kv))
    known = events.filter(F.col("kind").isin("message", "delta", "edit", "regenerate")).select(
        "conv_id", "msg", "seq", "kind", "role", F.struct("seq", rank[F.col("kind")].alias("rank"), F.coalesce("text", F.lit("")).alias("text")).alias("event")
    )
    own = Window.partitionBy("conv_id", "msg")
    begun = known.withColumns(
        {"at": F.min("seq").over(own), "reset": F.max(F.when(F.col("kind") != "delta", F.col("event"))).over(own)}
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reset").isNull() | (F.col("event") >= F.col("reset")), F.col("event")))), lambda e: e["text"]), "")
    empty = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("event.text"))
    begun = begun.withColumn("event", F.col("event").withField("text", empty))
    messages = begun.groupBy("conv_id", "msg").agg(
        F.first("at").alias("at"), F.max(F.when(F.col("kind") == "message", F.col("role"))).alias("role"), text.alias("text")
    )
    # a message is taken back by a later regeneration of one that began before it
    again = events.filter("kind = 'regenerate'").select("conv_id", "msg", F.col("seq").alias("when"))
    if again.isEmpty():
        return messages.select("conv_id", "at", "msg", "role", "text")
    again = again.join(messages.select("conv_id", "msg", F.col("at").alias("from")), [_same(again, messages, "conv_id"), _same(again, messages, "msg")]).select(
        again["conv_id"], F.col("when").alias("at"), "from"
    )
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc(), F.col("is_message")).rowsBetween(Window.unboundedPreceding, 0)
    line = messages.withColumns({"from": F.lit(None).cast(again.schema["from"].dataType), "is_message": F.lit(True)}).unionByName(
        again.withColumn("is_message", F.lit(False)), allowMissingColumns=True
    )
    kept = line.withColumn("from", F.min("from").over(later)).filter(F.col("is_message") & (F.col("from").isNull() | (F.col("from") >= F.col("at"))))
    return kept.select("conv_id", "at", "msg", "role", "text")


def _same(a: DataFrame, b: DataFrame, name: str) -> Column:
    return a[name].eqNullSafe(b[name])


def escape(text: Column) -> Column:
    """Put a backslash into each control string, and one more into each that already has some."""
    return F.regexp_replace(F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: str) -> str:
    return re.sub(r"\[\\(\\*)(/?INST\])", r"[\1\2", re.sub(r"<\\(\\*)(/?s>)", r"<\1\2", text))


def render(messages: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_start``, ``loss_end``: the part of it that is learned (null where nothing is).

    A turn of the assistant is ``<s>role newline text</s>``, any other ``[INST]role newline text[/INST]``; control strings in
    texts are escaped, and line ends and backslashes in roles. A null role is rendered as an empty one.
    """
    learned = F.coalesce(F.col("role") == LEARNED, F.lit(False))
    role = escape(F.replace(F.replace(F.coalesce("role", F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    head = F.concat(F.when(learned, BEGIN).otherwise(OPEN), role, F.lit("\n"))
    body = escape(F.coalesce("text", F.lit("")))
    start = F.length(head).cast("long")
    return messages.withColumns(
        {
            "formatted": F.concat(head, body, F.when(learned, END).otherwise(CLOSE)),
            "loss_start": F.when(learned, start),
            "loss_end": F.when(learned, start + F.length(body)),
        }
    )


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    begin, end = (BEGIN, END) if formatted.startswith(BEGIN) else (OPEN, CLOSE)
    stop = formatted.find(end, len(begin))
    if not formatted.startswith(begin) or stop + len(end) != len(formatted):
        raise ValueError("not one whole turn")
    role, _, text = formatted[len(begin) : stop].partition("\n")
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.n, self.chars, self.learned = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int | None, end: int | None) -> None:
        role, text = parse_turn(formatted)
        self.n, self.chars = self.n + 1, self.chars + len(formatted)
        self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if start is not None:
            part = unescape(formatted[start:end])
            self.learned += len(part)
            self.loss.update(part.encode("utf-8", "surrogatepass"))

    def row(self) -> tuple:
        return self.conv, self.n, self.turns.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def conversation_digests(rendered: DataFrame, order: list[str]) -> DataFrame:
    """One row per conversation, read back from its formatted turns.

    Turns go to tasks by conversation, are sorted there and pass by one at a time, so a conversation of any length takes
    the memory of one batch; a hash over all its turns in order cannot be cut further.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: _Digest | None = None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            types = [pa.string() if c.endswith("string") else pa.int64() for c in DIGEST.split(", ")]
            columns = zip(*done, strict=True) if done else [[] for _ in types]
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

        for batch in batches:
            for conv, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        done.append(held.row())
                    held = _Digest(conv)
                held.add(formatted, start, end)
            if len(done) > 1000:
                yield out()
                done.clear()
        if held is not None:
            done.append(held.row())
        yield out()

    lines = rendered.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    return lines.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(digest, DIGEST)


def log_of_turns(turns: DataFrame) -> DataFrame:
    """The event log of finished turns (``conv_id, turn, role, text``): each begins as a message and streams its text in deltas.

    Equal turns are numbered by role and text, so that repeated rows stay messages of their own.
    """
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    at = turns.select("conv_id", F.struct("turn", copy.alias("copy")).alias("msg"), "role", F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.explode(
        F.array(
            F.struct(F.lit("message").alias("kind"), F.lit(0).alias("step"), F.lit("").alias("part")),
            F.struct(F.lit("delta").alias("kind"), F.lit(1).alias("step"), F.substring("text", F.lit(1), half).alias("part")),
            F.struct(F.lit("delta").alias("kind"), F.lit(2).alias("step"), F.col("text").substr(half + 1, F.length("text")).alias("part")),
        )
    )
    return at.withColumn("e", parts).select(
        "conv_id", F.struct("msg.turn", "msg.copy", "e.step").alias("seq"), F.col("e.kind").alias("kind"), "msg", "role", F.col("e.part").alias("text")
    )
