"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

A pattern is a window: 13 consecutive words of a benchmark item, or all words of a shorter one. Patterns of equal
length m are searched together. A shift table over blocks of two words says how far the cursor may jump: m - 1 when
no pattern holds the block, less when one does, 0 when one ends with it. At 0 the hash of the window selects a bucket
of patterns and the words themselves are compared. Many cursors advance in lockstep, each over its own stretch of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.llm.blocks import WORD_BYTES, Words, row_blocks, runs

WINDOW = 13
#: Bytes of item text in one pattern set that is shipped to the executors; more items make more sets.
SET_BYTES = 8 << 20
STRETCH = 256
TABLE_BITS = 20


class Patterns:
    """Shift table and suffix buckets of the windows of one length."""

    def __init__(self, m: int, windows: dict[bytes, tuple[np.ndarray, int]]):
        self.m, self.block = m, min(2, m)
        self.texts = list(windows)
        numbers = np.array([w[0] for w in windows.values()], np.uint64).reshape(len(windows), m)
        self.window_of = np.array([w[1] for w in windows.values()], np.int64)
        self.shift = np.full(1 << TABLE_BITS, m - self.block + 1, np.uint16)
        for end in range(self.block, m + 1):  # later blocks leave less room to jump
            np.minimum.at(self.shift, self._slot(runs(numbers[:, end - self.block : end].ravel(), self.block)[:: self.block]), m - end)
        hashes = runs(numbers.ravel(), m)[::m]
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.order = hashes[order], order

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def occurrences(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First words of confirmed occurrences, and which window occurs there. None crosses two texts."""
        stops = words.bounds[1:]
        counts = np.maximum(np.diff(words.bounds) - self.m + 1, 0)  # windows that start in each text
        stretches = -(-counts // STRETCH)
        text = np.repeat(np.arange(len(counts)), stretches)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        cursor = words.bounds[:-1][text] + nth * STRETCH + self.m  # end of the window the cursor looks at
        last = np.minimum(cursor + STRETCH - 1, stops[text])
        blocks = runs(words.numbers, self.block)
        ends: list[np.ndarray] = []
        while len(cursor):
            jump = self.shift[self._slot(blocks[cursor - self.block])].astype(np.int64)
            ends.append(cursor[jump == 0])
            cursor = cursor + np.maximum(jump, 1)
            inside = cursor <= last
            cursor, last = cursor[inside], last[inside]
        at = np.sort(np.concatenate(ends)) - self.m if ends else np.zeros(0, np.int64)
        h = np.zeros(len(at), np.uint64) if not len(at) else words.numbers[at].copy()
        for i in range(1, self.m):
            h = runs(np.stack([h, words.numbers[at + i]], 1).ravel(), 2)[::2] if len(at) else h
        left, right = np.searchsorted(self.hashes, h), np.searchsorted(self.hashes, h, "right")
        starts, found = [], []
        for i in np.flatnonzero(right > left):
            a = int(at[i])
            text_here = b" ".join(words.buffer[s:e] for s, e in zip(words.starts[a : a + self.m].tolist(), words.ends[a : a + self.m].tolist(), strict=True))
            for j in self.order[left[i] : right[i]]:
                if self.texts[j] == text_here:
                    starts.append(a)
                    found.append(self.window_of[j])
        return np.array(starts, np.int64), np.array(found, np.int64)


class PatternSet:
    """The windows of some items, by length."""

    def __init__(self, items: list[tuple[int | None, bytes]], width: int):
        by_length: dict[int, dict[bytes, tuple[np.ndarray, int]]] = {}
        self.items: list[set[int | None]] = []
        words = Words([t for _, t in items], WORD_BYTES)
        for i, (item, _) in enumerate(items):
            own = words.of_text(i)
            n = own.stop - own.start
            m = min(width, n)
            for a in range(own.start, own.stop - m + 1 if m else own.start):
                text = b" ".join(words.buffer[s:e] for s, e in zip(words.starts[a : a + m].tolist(), words.ends[a : a + m].tolist(), strict=True))
                known = by_length.setdefault(m, {})
                if text not in known:
                    known[text] = (words.numbers[a : a + m], len(self.items))
                    self.items.append(set())
                self.items[known[text][1]].add(item)
        self.patterns = [Patterns(m, w) for m, w in sorted(by_length.items())]


def _item_sets(benchmark: DataFrame, id: str, text: str, limit: int) -> Iterator[list[tuple[int | None, bytes]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(id).alias("i"), F.col(text).alias("t")).filter("t is not null").toLocalIterator():
        held.append((row.i, row.t.encode("utf-8", "replace")))
        size += len(held[-1][1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_items(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, set_bytes: int = SET_BYTES,
) -> DataFrame:
    """The documents with ``n_words``, ``hit_words`` (sorted places of words inside an occurrence of a window) and
    ``items`` (sorted ids of the items that occur).

    The benchmark is read to the driver in sets of about ``set_bytes`` bytes of text and one set is shipped at a time; each
    set is one more narrow pass over the same rows, which needs no shuffle. Null texts have no words. Repeated items count
    once, an item without id marks words but is not listed, an item without words never occurs. Each row of
    ``docs`` gives one row, so repeated rows stay; its other columns are kept. Columns that bear the new names are replaced.
    Ids may be of any type with an order. Texts of any length are searched whole, and an empty table gives no rows.
    """
    new = ("n_words", "hit_words", "items")
    ids = T.ArrayType(benchmark.schema[item_id].dataType)
    out = docs.drop(*new).withColumns(
        {"n_words": F.lit(0).cast("long"), "hit_words": F.array().cast("array<long>"), "items": F.array().cast(ids)}
    )
    context = docs.sparkSession.sparkContext
    sets = 0
    for items in _item_sets(benchmark, item_id, item_text, set_bytes):
        shipped = context.broadcast(PatternSet(items, window))
        out, sets = out.mapInArrow(_search(shipped, text), out.schema), sets + 1
    return out if sets else out.mapInArrow(_search(context.broadcast(PatternSet([], window)), text), out.schema)


def _search(shipped, text: str):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns: PatternSet = shipped.value
        for batch in batches:
            for rows, texts in row_blocks(batch, text):
                words = Words(texts, WORD_BYTES)
                hit = np.zeros(len(words.numbers) + 1, np.int32)
                items: dict[int, set[int | None]] = {}
                for p in patterns.patterns:
                    starts, found = p.occurrences(words)
                    np.add.at(hit, starts, 1)
                    np.add.at(hit, starts + p.m, -1)
                    for doc, w in zip((np.searchsorted(words.bounds, starts, "right") - 1).tolist(), found.tolist(), strict=True):
                        items.setdefault(doc, set()).update(patterns.items[w])
                places = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
                yield _with_hits(rows, words, places, items)

    return search


def _with_hits(rows: pa.RecordBatch, words: Words, places: np.ndarray, items: dict[int, set[int | None]]) -> pa.RecordBatch:
    names = rows.schema.names
    old_hits, old_items = rows.column(names.index("hit_words")).to_pylist(), rows.column(names.index("items")).to_pylist()
    cuts = np.searchsorted(places, words.bounds)
    hits, listed = [], []
    for i in range(rows.num_rows):
        mine = places[cuts[i] : cuts[i + 1]] - words.bounds[i]
        hits.append(np.union1d(old_hits[i], mine).astype(np.int64) if old_hits[i] else mine)
        listed.append(sorted({*old_items[i], *(x for x in items.get(i, ()) if x is not None)}))
    columns = {"n_words": pa.array(np.diff(words.bounds)), "hit_words": pa.array(hits, pa.list_(pa.int64())), "items": pa.array(listed, rows.schema.field("items").type)}
    return pa.RecordBatch.from_arrays([columns.get(n, rows.column(i)) for i, n in enumerate(names)], names=names)


def contamination(found: DataFrame) -> DataFrame:
    """Add ``n_hit``, ``n_items``, ``items_sha256`` and ``contaminated`` (a twentieth of the words or more are hit)."""
    n_hit = F.size("hit_words").cast("long")
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.withColumns(
        {
            "n_hit": n_hit,
            "n_items": F.size("items").cast("long"),
            "items_sha256": F.sha2(F.array_join(ids, ","), 256),
            "contaminated": (n_hit > 0) & (n_hit * 20 >= F.col("n_words")),
        }
    )


def brute_hits(text: str | None, items: list[tuple[int, str | None]], window: int = WINDOW) -> tuple[int, set[int], set[int]]:
    """Plain search, for tests: number of words, places hit, items that occur."""
    import re

    def words(t: str | None) -> list[str]:
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        m = min(window, len(w))
        wanted = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(own) - m + 1 if m else 0):
            if tuple(own[i : i + m]) in wanted:
                hit |= set(range(i, i + m))
                found.add(item)
    return len(own), hit, found


def items_digest(items: set[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
