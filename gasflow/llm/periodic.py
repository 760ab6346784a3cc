"""Periodic runs of words: multi-scale minimizers seed them, direct comparison extends them.

A run is a stretch of words that repeats with a smallest period q at least ``TIMES`` times over. Short periods are
scanned lag by lag. Longer ones are searched in scales of periods P+1 to K = 3P/2. At a scale each place is named by the K
words from there, and of each window of places the smallest name is kept. Inside a run the windows come again a period
later, so a kept place p has its equal at p + q; as K words are no shorter than the period, no equal place lies between
(two shifts below q would give the run a smaller period). Hence neighbours of equal name, at a distance of the scale,
hit every run of it. What they hit is extended word by word, so nothing is reported that the words do not show.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.llm.blocks import mixed, row_blocks

LEAST_WORDS, TIMES = 24, 3
#: Periods up to this one are scanned lag by lag.
SHORT = 16
RUN = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
_ARROW_RUN = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

Run = tuple[int, int, int]
Rewrite = Callable[[object, list[bytes]], list[bytes]]


def stretch(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The largest ``first, end`` around ``at`` with ``x[i] == x[i + lag]`` for all i from first to before end."""
    end, step = at, 64
    while end < len(x) - lag:
        stop = min(end + step, len(x) - lag)
        same = x[end:stop] == x[end + lag : stop + lag]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = stop, step * 2
    first, step = at, 64
    while first > 0:
        stop = max(first - step, 0)
        same = x[stop:first] == x[stop + lag : first + lag]
        if not same.all():
            first -= int(same[::-1].argmin())
            break
        first, step = stop, step * 2
    return first, end


def _primes(n: int) -> list[int]:
    found, p = [], 2
    while p * p <= n:
        if n % p == 0:
            found.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*found, n] if n > 1 else found


def _runs_at(x: np.ndarray, lag: int, places: np.ndarray, least: int) -> Iterator[Run]:
    """The runs of smallest period ``lag`` that hold one of the sorted ``places``."""
    end = 0
    for at in places.tolist():
        if at < end:
            continue
        first, end = stretch(x, at, lag)
        length = end - first + lag
        if length >= max(least, TIMES * lag):
            shorter = (lag // p for p in _primes(lag))
            if not any((x[first : first + length - t] == x[first + t : first + length]).all() for t in shorter):
                yield first, length, lag


def _short_periods(x: np.ndarray, least: int) -> Iterator[Run]:
    for lag in range(1, SHORT + 1):
        step = max(1, (max(least, TIMES * lag) - lag) // 2)  # every stretch that counts holds two places of the scan
        same = x[: len(x) - lag : step] == x[lag::step]
        yield from _runs_at(x, lag, np.flatnonzero(same[1:] & same[:-1]) * step, least)


def _smallest(h: np.ndarray, window: int, pick: np.ufunc = np.minimum) -> np.ndarray:
    """Smallest (or largest) of each ``window`` neighbours, from the first of them on."""
    done, out = 1, h
    while done < window:
        step = min(done, window - done)
        out = pick(out[: len(out) - step], out[step:])
        done += step
    return out


def _minimizers(names: np.ndarray, window: int) -> np.ndarray:
    """Places that hold the smallest name of a window of places."""
    if len(names) < window:
        return np.zeros(0, np.int64)
    least = _smallest(names, window)
    pad = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_smallest(np.concatenate((pad, least, pad)), window, np.maximum) == names)


def _long_periods(x: np.ndarray, bounds: np.ndarray, least: int) -> Iterator[Run]:
    """Runs of periods above ``SHORT``; ``bounds`` are the starts of the texts, each closed by a separator."""
    sizes, place = np.diff(bounds), np.arange(len(x))
    names, width, below = mixed(x.astype(np.uint64) + np.uint64(1)), 1, SHORT
    while True:
        enough = sizes > TIMES * (below + 1)  # a separator is no word
        if not enough.any():
            return
        if not enough.all():
            kept = np.repeat(enough, sizes)
            names, place, sizes = names[kept], place[kept], sizes[enough]
        longest = below * 3 // 2
        while 2 * width <= longest:
            names, width = _joined(names, width, width), 2 * width
        of_scale = _joined(names, longest - width, width) if longest > width else names
        chosen = _minimizers(of_scale, 2 * below + 3 - longest)
        order = chosen[np.argsort(of_scale[chosen], kind="stable")]
        lags = place[order[1:]] - place[order[:-1]]
        hits = np.flatnonzero((of_scale[order[1:]] == of_scale[order[:-1]]) & (lags > below) & (lags <= longest))
        lags, firsts = lags[hits], place[order[hits]]
        for lag in np.unique(lags).tolist():
            yield from _runs_at(x, lag, np.sort(firsts[lags == lag]), least)
        below = longest


def _joined(names: np.ndarray, step: int, width: int) -> np.ndarray:
    """Names of ``step + width`` words from those of ``width``; places too near the end get names of their own."""
    own = mixed(np.arange(len(names), dtype=np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    n = max(0, len(names) - step)
    own[:n] = mixed(names[:n] * np.uint64(31) + np.uint64(step + width) + mixed(names[len(names) - n :]))
    return own


def runs_of(texts: list[list[bytes]], least: int = LEAST_WORDS) -> list[list[Run]]:
    """``start, length, period`` of the runs of each list of words, by start, then period."""
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    words = pa.array([w for t in texts for w in t], pa.binary()).dictionary_encode()
    x = np.empty(bounds[-1], np.int64)
    separators = bounds[1:] - 1
    is_word = np.ones(len(x), bool)
    is_word[separators] = False
    x[is_word] = words.indices.to_numpy()
    x[separators] = len(words.dictionary) + np.arange(len(texts))  # each its own, so that no run leaves its text
    found: list[list[Run]] = [[] for _ in texts]
    for search in (_short_periods(x, least), _long_periods(x, bounds, least)):
        for start, length, period in search:
            text = int(np.searchsorted(bounds, start, "right")) - 1
            found[text].append((start - int(bounds[text]), length, period))
    return [sorted(f, key=lambda r: (r[0], r[2])) for f in found]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those that repeat what a run said in its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept).tolist()])


def find_runs(docs: DataFrame, least: int = LEAST_WORDS, text: str = "text", id: str = "doc_id", rewrite: Rewrite | None = None) -> DataFrame:
    """The documents with ``n_words``, ``runs`` and ``collapsed``.

    Words are runs of characters other than the space and the controls from tab to carriage return, counted from 0. A run is
    a stretch of words of smallest period q and at least ``least`` and 3 q words that no word beside it extends;
    ``runs`` lists start, length and period by start, then period. ``collapsed`` is the text without the
    words that any run holds behind its first q words. ``rewrite`` may change the words of a document, by its id, beforehand.

    Whole texts are searched, each for itself: nothing is shuffled, memory follows the longest text, repeated rows stay.
    Null and empty texts have no words, no runs and an empty ``collapsed``. Runs of one start are told apart by
    period. Other columns are kept, those that bear the new names are replaced. An empty table gives no rows. A run of a
    period above ``SHORT`` would be missed if two different stretches of words shared a 64-bit name inside its text.
    """
    new = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())]
    frame = docs.drop(*(f.name for f in new))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in row_blocks(batch, text):
                words = [t.split() for t in texts]  # bytes are split at exactly these six characters
                if rewrite:
                    ids = rows.column(rows.schema.get_field_index(id)).to_pylist()
                    words = [rewrite(i, w) for i, w in zip(ids, words, strict=True)]
                found = runs_of(words, least)
                left = [collapsed(w, r) for w, r in zip(words, found, strict=True)]
                told = [[dict(zip(RUN.names, r, strict=True)) for r in runs] for runs in found]
                columns = [pa.array([len(w) for w in words], pa.int64()), pa.array(told, _ARROW_RUN), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, *(f.name for f in new)])

    return frame.mapInArrow(search, T.StructType([*frame.schema.fields, *new]))


def strongest(runs: Column) -> Column:
    """The run of greatest length per period, exactly; of equal ones the first by start, then period."""
    ahead = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, run: F.when(ahead(best, run), run).otherwise(best))


def run_digest(found: DataFrame) -> DataFrame:
    """Add ``n_runs``, the strongest run and its exponent in thousandths, and digests of all runs and of the collapsed text."""
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    best = strongest(F.col("runs"))
    return found.withColumns({"n_runs": F.size("runs").cast("long"), "_best": F.when(F.size("runs") > 0, best)}).withColumns(
        {
            **{c: F.col("_best")[c] for c in RUN.names},
            "exponent_milli": F.expr("1000 * _best.length div _best.period"),
            "runs_sha256": F.sha2(lines, 256),
            "collapsed_sha256": F.sha2("collapsed", 256),
        }
    ).drop("_best")
