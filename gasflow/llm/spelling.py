"""Groups of spelling variants: words one insertion, deletion or replacement apart, each led to its most frequent neighbour.

Two words whose longer one has T code points differ by a single edit exactly if the lengths of their common prefix and their
common suffix add up to T - 1 or more. One of the two is then at least T // 2 long, so only words that share their first or
last T // 2 code points are compared: in tiles of padded code-point matrices, column by column from both ends. A tile pair
returns, for each of its words, how many are near and the best of them, never the pairs.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasflow.functions.sizing import materialize
from gasflow.llm.blocks import LOWER, row_blocks

#: Runs of A-Z, a-z and U+00C0 to U+00FF, in UTF-8.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
SHORTEST, LEAST_COUNT, RATIO = 6, 5, 5
#: Rows of a tile, and the most code points that one holds.
TILE, TILE_POINTS = 512, 1 << 20
KEPT_WORDS = 200_000

Change = Callable[[object, bytes], bytes]


def count_words(docs: DataFrame, shortest: int = SHORTEST, text: str = "text", id: str = "doc_id", change: Change | None = None) -> DataFrame:
    """``word, n``: how often each word of at least ``shortest`` code points occurs in all texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which only A-Z are lower-cased. ``change`` may alter the
    distinct words of a document, by its id. Whole texts are read; a task adds up its words before they are shuffled.
    Null and empty texts have no words, repeated rows count again, other columns are not read, and an empty table
    gives no rows.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        for batch in batches:
            for rows, texts in row_blocks(batch):
                for doc, raw in zip(rows.column(0).to_pylist(), texts, strict=True):
                    found = LETTERS.findall(raw.translate(LOWER))
                    if change:
                        for word, n in Counter(found).items():
                            held[change(doc, word)] += n
                    else:
                        held.update(found)
                if len(held) > KEPT_WORDS:
                    yield from _counted(held, shortest)
                    held.clear()
        yield from _counted(held, shortest)

    frame = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return frame.mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter[bytes], shortest: int) -> Iterator[pa.RecordBatch]:
    words = [(w.decode(), n) for w, n in held.items()]
    words = [(w, n) for w, n in words if len(w) >= shortest]
    for at in range(0, len(words), 20_000):
        some = words[at : at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in some], pa.string()), pa.array([n for _, n in some], pa.int64())], names=["word", "n"])


def common(left: np.ndarray, right: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of ``left`` with each of ``right``, padded code points; at most ``sizes``."""
    alive = np.ones((len(left), len(right)), bool)
    length = np.zeros(alive.shape, np.int32)
    for column in range(min(left.shape[1], right.shape[1])):
        alive &= left[:, column, None] == right[None, :, column]
        if not alive.any():
            break
        length += alive
    return np.minimum(length, sizes)


def _matrix(words: list[str], width: int) -> np.ndarray:
    return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)


def single_edits(left: list[str], right: list[str], longest: int, suffixes: bool) -> np.ndarray:
    """Which words of ``left``, of ``longest`` code points, and of ``right``, of as many or one less, are one edit apart.

    With ``suffixes`` only pairs that do not share their first ``longest // 2`` code points, so that each is found once.
    """
    sizes = np.array([len(w) for w in right], np.int32)[None, :]
    width = max(longest, 1)
    prefix = common(_matrix(left, width), _matrix(right, width), sizes)
    suffix = common(_matrix([w[::-1] for w in left], width), _matrix([w[::-1] for w in right], width), sizes)
    same = prefix == longest
    wanted = prefix < longest // 2 if suffixes else prefix >= longest // 2
    return (prefix + suffix >= longest - 1) & ~same & wanted


def _in_tiles(vocabulary: DataFrame) -> DataFrame:
    """Each word once per pair of tiles that it is compared in: ``word, n, longest, side, part, left, right, tile``.

    A group holds the words of ``longest`` code points, and those with one less, that share a half. Tiles of the former are
    numbered first; each is compared with itself, with those after it and with the tiles of the latter.
    """
    of_length = vocabulary.select("word", "n", F.char_length("word").alias("points"))
    long = of_length.select("*", F.explode(F.array(F.col("points"), F.col("points") + 1)).alias("longest"))
    half = F.expr("longest div 2").cast("int")
    halves = F.array(
        F.struct(F.lit(0).alias("side"), F.xxhash64(F.substring("word", F.lit(1), half)).alias("part")),
        F.struct(F.lit(1).alias("side"), F.xxhash64(F.substring("word", F.col("points") - half + 1, half)).alias("part")),
    )
    group = ["longest", "side", "part"]
    full = F.col("points") == F.col("longest")
    keyed = long.select("word", "n", "longest", full.alias("full"), F.inline(halves))
    sizes = keyed.groupBy(*group).agg(F.count_if("full").alias("_full"), F.count(F.lit(1)).alias("_all")).filter("_full > 0 and _all > 1")
    rows = F.greatest(F.least(F.lit(TILE), F.floor(F.lit(TILE_POINTS) / F.greatest("longest", F.lit(1)))), F.lit(1))
    tiles = {"_first": F.ceil(F.col("_full") / rows), "_second": F.ceil((F.col("_all") - F.col("_full")) / rows)}
    spread = lambda n: F.pmod(F.xxhash64("word"), F.greatest(n, F.lit(1)))
    cut = keyed.join(sizes, group).withColumns(tiles).withColumn("tile", F.when(F.col("full"), spread(F.col("_first"))).otherwise(F.col("_first") + spread(F.col("_second"))))
    others = F.when(F.col("full"), F.sequence(F.lit(0).cast("long"), F.col("_first") + F.col("_second") - 1)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("_first") - 1))
    paired = cut.withColumn("other", F.explode(others))
    return paired.select("word", "n", *group, F.least("tile", "other").alias("left"), F.greatest("tile", "other").alias("right"), "tile")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of the tile pairs in a stream that is sorted by them; a pair may go on in the next batch."""
    held: list[tuple] = []
    key = None
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2:7] != key:
                out += _near_in(held, key)
                held, key = [], row[2:7]
            held.append(row)
        yield _near_batch(out)
    yield _near_batch(_near_in(held, key))


def _near_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["word", "near", "best_n", "best"])


def _near_in(rows: list[tuple], key: tuple | None) -> list[tuple]:
    """``word, near, best_n, best`` for the words of two tiles that have near words in the other."""
    if len(rows) < 2:
        return []
    longest, side, _, left, right = key
    rows = sorted(rows, key=lambda r: (-r[1], r[0]))  # the first near word is the best
    a, b = [r for r in rows if r[7] == left], [r for r in rows if r[7] == right]
    if not a or not b:
        return []
    near = single_edits([r[0] for r in a], [r[0] for r in b], longest, bool(side))
    out = _best(near, a, b)
    return out if left == right else out + _best(near.T, b, a)


def _best(near: np.ndarray, rows: list[tuple], others: list[tuple]) -> list[tuple]:
    counts, first = near.sum(1), near.argmax(1)
    return [(rows[i][0], int(counts[i]), others[first[i]][1], others[first[i]][0]) for i in np.flatnonzero(counts).tolist()]


def variants(counted: DataFrame, least: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for the words of ``counted`` (``word, n``) that occur ``least`` times.

    Near words are one inserted, deleted or replaced code point apart. ``n_near`` counts them; ``form`` is the near word
    of largest n, the smallest in code-point order of several, if its n is ``ratio`` times the word's or more,
    else null; ``root`` is the last form reached from form to form, or the word itself.

    Rows of one word are added up, null words dropped; words of any length, the empty one included, are
    compared. Other columns are not read. Groups of many words that share a half are cut into tiles, so no task holds one.
    An empty table gives no rows. Some jobs run when this is called: tables are written to the checkpoint folder.
    """
    words = counted.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    words = materialize(words)
    pair = ["longest", "side", "part", "left", "right"]
    streams = _in_tiles(words).repartition(*pair).sortWithinPartitions(*pair)
    near = streams.mapInArrow(_compared, "word string, near long, best_n long, best string")
    best = near.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    joined = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("b.best").alias("form"), (-F.col("b.less")).alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    joined = materialize(joined.withColumns({"form": F.when(enough, F.col("form")), "form_n": F.when(enough, F.col("form_n"))}))
    roots = _last_forms(joined.filter("form is not null").select("word", F.col("form").alias("root")))
    return joined.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _last_forms(links: DataFrame) -> DataFrame:
    """Follow ``word, root`` to the end, twice as far each round. Each step multiplies n, so there are few rounds and no rings."""
    current = links
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = materialize(current.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return current
