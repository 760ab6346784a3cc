"""Quality classification: histogram gradient-boosted trees over statistics of the text.

The statistics of all texts come from numpy over blocks of bytes. Trees are grown on a bounded sample of labelled rows:
each statistic is cut into bins at its quantiles, gradients are summed per node and bin, and the best cut of a node is
read off the running sums. The finished trees are flattened into arrays, which score a block of texts at once, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.llm.blocks import TOKEN_BYTES, Words, row_blocks, runs

#: The trees learn from at most this many labelled documents, chosen by a hash of their ids.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE = 64, 120, 4, 0.1
#: Added to the sum of second derivatives of a leaf; least sum of a leaf.
RIDGE, LEAST_WEIGHT = 1.0, 1.0

_LOWER, _UPPER, _DIGIT, _SPACE, _LINE, _STOP, _MARK, _HIGH, _CONTROL = range(9)


def _kind(b: int) -> int:
    c = chr(b)
    if b >= 128:
        return _HIGH
    if c.isalpha():
        return _LOWER if c.islower() else _UPPER
    if c.isdigit():
        return _DIGIT
    return _LINE if c == "\n" else _SPACE if c in " \t" else _STOP if c in ".,;:?'\"-" else _MARK if 32 < b < 127 else _CONTROL


KINDS = np.array([_kind(b) for b in range(256)], np.int64)
#: Texts are joined by spaces; with spaces and line ends turned around, lines are runs of all other bytes.
_TURNED, _IN_LINE = bytes({10: 32, 32: 10}.get(b, b) for b in range(256)), np.arange(256) != 32
STATISTICS = (
    "log_bytes", "lower", "upper", "digits", "spaces", "line_ends", "stops", "marks", "beyond_ascii", "controls", "kind_changes",
    "log_words", "word_bytes", "word_bytes_spread", "log_longest_word", "distinct_words", "most_frequent_word", "distinct_pairs", "distinct_fives",
    "words_opened_upper", "words_closed_upper", "words_closed_by_mark", "words_closed_by_stop", "words_opened_by_mark",
    "log_lines", "words_a_line", "distinct_lines",
)


def _distinct(numbers: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How many different numbers each of ``n`` texts has, and how often its most frequent one occurs (by 40 bits of them)."""
    if not len(numbers):
        return np.zeros(n), np.zeros(n)
    keys = np.sort((owner.astype(np.uint64) << np.uint64(40)) | (numbers >> np.uint64(24)))
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    of = (keys[starts] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.concatenate((starts, [len(keys)]))))
    return np.bincount(of, minlength=n).astype(float), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """The ``STATISTICS`` of each text; all are finite, those of an empty text are zeros."""
    n = len(texts)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    data = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), sizes)
    kinds = KINDS[data]
    by_kind = np.bincount(owner * 9 + kinds, minlength=n * 9).reshape(n, 9)
    changed = (kinds[1:] != kinds[:-1]) & (owner[1:] == owner[:-1])
    changes = np.bincount(owner[1:][changed], minlength=n)

    words = Words(texts, TOKEN_BYTES, lower=False)
    buffer = np.frombuffer(words.buffer, np.uint8)
    counts = np.diff(words.bounds)
    of = np.repeat(np.arange(n), counts)
    widths = (words.ends - words.starts).astype(float)
    total = lambda values: np.bincount(of, values, minlength=n)
    mean = total(widths) / np.maximum(counts, 1)
    spread = np.sqrt(np.maximum(total(widths**2) / np.maximum(counts, 1) - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, of, widths)
    different, most = _distinct(words.numbers, of, n)
    opening, closing = KINDS[buffer[words.starts]], KINDS[buffer[words.ends - 1]]

    def repeated(width: int) -> np.ndarray:
        several, inside = runs(words.numbers, width), of[: max(len(of) - width + 1, 0)]
        whole = inside == of[width - 1 :] if len(inside) else np.zeros(0, bool)
        return _distinct(several[whole], inside[whole], n)[0] / np.maximum(counts - width + 1, 1)

    lines = Words([t.translate(_TURNED) for t in texts], _IN_LINE, lower=False)
    line_counts = np.diff(lines.bounds)
    different_lines, _ = _distinct(lines.numbers, np.repeat(np.arange(n), line_counts), n)
    a_byte, a_word, a_line = np.maximum(sizes, 1), np.maximum(counts, 1), np.maximum(line_counts, 1)
    return np.column_stack(
        [
            np.log1p(sizes), *(by_kind / a_byte[:, None]).T, changes / a_byte,
            np.log1p(counts), mean, spread, np.log1p(longest), different / a_word, most / a_word, repeated(2), repeated(5),
            *(total(mask) / a_word for mask in (opening == _UPPER, closing == _UPPER, closing == _MARK, closing == _STOP, opening == _MARK)),
            np.log1p(line_counts), counts / a_line, different_lines / a_line,
        ]
    )


@dataclass
class Trees:
    """Boosted trees as flat arrays. A leaf leads to itself; ``roots`` are the nodes where the trees begin."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row: all trees go down one level at a time."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] > self.cut[at], self.above[at], self.below[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(1))))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between bins, at most ``bins - 1``: quantiles, or midpoints when there are few values."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> Trees:
    """Boosted trees for labels 0 and 1 by Newton steps on the logistic loss. No rows give 0.5, one class a constant."""
    n, width = x.shape
    ones = float(y.sum())
    start = np.log((ones + 1) / (n - ones + 1))
    nodes: list[list] = []  # feature, cut, below, above, value
    roots = []
    if 0 < ones < n:
        edges = [_edges(x[:, f], bins) for f in range(width)]
        binned = np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
        place = binned + np.arange(width) * bins
        margin = np.full(n, start)
        for _ in range(trees):
            chance = 1 / (1 + np.exp(-margin))
            roots.append(len(nodes))
            leaf = _grow_one(nodes, place, binned, edges, chance - y, chance * (1 - chance), depth, rate, bins)
            margin += np.array([node[4] for node in nodes])[leaf]
    columns = list(zip(*nodes, strict=True)) if nodes else [()] * 5
    feature, cut, below, above, value = (np.array(c, t) for c, t in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True))
    return Trees(float(start), np.array(roots, np.int64), feature, cut, below, above, value, depth)


def _grow_one(nodes: list[list], place: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int, rate: float, bins: int) -> np.ndarray:
    """Add one tree to ``nodes``; returns the leaf of each row."""
    n, width = place.shape
    at = np.full(n, len(nodes))
    level = [len(nodes)]
    nodes.append([0, np.inf, len(nodes), len(nodes), 0.0])
    for deep in range(depth + 1):
        number = {node: i for i, node in enumerate(level)}
        active = np.flatnonzero(np.isin(at, level))
        slot = np.array([number[a] for a in at[active].tolist()], np.int64)
        g, h = np.bincount(slot, gradient[active], len(level)), np.bincount(slot, weight[active], len(level))
        for node, i in number.items():
            nodes[node][4] = float(-rate * g[i] / (h[i] + RIDGE))
        if deep == depth:
            break
        cell = (slot[:, None] * (width * bins) + place[active]).ravel()
        shape = (len(level), width, bins)
        sums = [np.bincount(cell, np.repeat(v[active], width), len(level) * width * bins).reshape(shape).cumsum(2)[:, :, :-1] for v in (gradient, weight)]
        g_all, h_all = g[:, None, None], h[:, None, None]
        gain = sums[0] ** 2 / (sums[1] + RIDGE) + (g_all - sums[0]) ** 2 / (h_all - sums[1] + RIDGE) - g_all**2 / (h_all + RIDGE)
        gain[(sums[1] < LEAST_WEIGHT) | (h_all - sums[1] < LEAST_WEIGHT)] = -np.inf
        for f, e in enumerate(edges):
            gain[:, f, len(e) :] = -np.inf
        best = gain.reshape(len(level), -1).argmax(1)
        following = []
        for node, i in number.items():
            f, b = divmod(int(best[i]), bins - 1)
            if gain[i, f, b] > 1e-6:
                nodes[node][:4] = [f, float(edges[f][b]), len(nodes), len(nodes) + 1]
                following += [len(nodes), len(nodes) + 1]
                nodes += [[0, np.inf, k, k, 0.0] for k in following[-2:]]
                inside = active[slot == i]
                at[inside] = np.where(binned[inside, f] > b, following[-1], following[-2])
        level = following
        if not level:
            break
    return at


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``statistics``, an array in the order of ``STATISTICS``, in place of their text."""
    frame = docs.drop("statistics")
    kept = [f for f in frame.schema.fields if f.name != text]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in row_blocks(batch, text):
                columns = [rows.column(rows.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(statistics(texts)), pa.list_(pa.float64()))], names=[*(f.name for f in kept), "statistics"])

    return frame.mapInArrow(measure, T.StructType([*kept, T.StructField("statistics", T.ArrayType(T.DoubleType()))]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, text: str = "text", id: str = "doc_id") -> Trees:
    """Trees that tell label 1 from label 0, grown on at most ``sample`` labelled documents.

    The labelled ids are chosen by a hash of them, so the choice does not depend on how the table is stored. Null ids
    and labels other than 0 and 1 are not learned from; an id of two labels counts with both, a repeated document once.
    """
    known = labels.filter(F.col(id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    chosen = known.orderBy(F.xxhash64(F.lit(12), "id"), "id", "label").limit(sample)
    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = with_statistics(texts).groupBy("id", "label").agg(F.min("statistics").alias("statistics"))
    table = rows.orderBy("id", "label").toArrow()
    x = np.array(table["statistics"].to_pylist(), float).reshape(-1, len(STATISTICS))
    return grow(x, table["label"].to_numpy().astype(float))


def score(docs: DataFrame, trees: Trees, text: str = "text") -> DataFrame:
    """The documents with ``score``, the probability of label 1, and ``predicted``, 1 from a score of 0.5 on.

    Every whole text is scored by itself, by nothing but the text; a null or empty one has zeros for
    statistics. Repeated rows stay, other columns are kept, those that bear the new names are replaced. An empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    frame = docs.drop("score", "predicted")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in row_blocks(batch, text):
                found = shipped.value.score(statistics(texts))
                columns = [pa.array(found, pa.float64()), pa.array((found >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, "score", "predicted"])

    return frame.mapInArrow(judge, T.StructType([*frame.schema.fields, *new]))
