"""Whole texts in Arrow batches, cut into blocks of bounded bytes, and their words as 64-bit numbers.

A block holds whole documents; one document larger than a block is a block of its own. Words are maximal
runs of word bytes. Equal words have equal numbers; two different words share one with a probability of
about 2^-64, so operators that must be exact compare the bytes afterwards.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
SEGMENT_BYTES = 1 << 18
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Word bytes: digits, lower-case letters and every byte of a character beyond ASCII.
WORD_BYTES = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: Token bytes: everything but the space and the control characters from tab to carriage return.
TOKEN_BYTES = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])

_VALUES = np.random.Generator(np.random.PCG64(20240817)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def row_blocks(batch: pa.RecordBatch, name: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts add up to about ``limit`` bytes, each with its texts."""
    texts = texts_of(batch.column(batch.schema.get_field_index(name)))
    first, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield batch.slice(first, i - first), texts[first:i]
            first, held = i, 0
        held += len(t) + 1
    if first < len(texts):
        yield batch.slice(first), texts[first:]


Batches = Iterator[pa.RecordBatch]


def handing_back(work: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``work`` on the batches of a task; afterwards its process, which waits for other tasks, hands free memory back."""

    def whole(batches: Batches) -> Batches:
        try:
            yield from work(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
            if trim:
                trim(0)

    return whole


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column bears it."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


class Kept(dict):
    """A cache of one process that is shipped empty."""

    def __reduce__(self):
        return Kept, ()


_POWERS = Kept()


def _powers(base: np.uint64, n: int) -> np.ndarray:
    size = max(SEGMENT_BYTES * 2, 1 << int(n).bit_length())
    if (int(base), size) not in _POWERS:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _POWERS[int(base), size] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[int(base), size]


class Words:
    """The words of some texts in order: where each starts and ends, its number, and its text's position."""

    def __init__(self, texts: list[bytes], word_bytes: np.ndarray, lower: bool = True):
        joined = b" ".join(texts)
        self.buffer = joined.translate(LOWER) if lower else joined
        data = np.frombuffer(self.buffer, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_starts = np.concatenate(([0], np.cumsum(lengths + 1)))[: len(texts)]
        starts, ends, numbers = [], [], []
        at = 0
        while at < len(data):
            stop = min(at + SEGMENT_BYTES, len(data))
            inside = word_bytes[data[at:stop]]
            if stop < len(data):  # a word is never cut: stop behind the last byte between words
                while inside.all() and stop < len(data):
                    stop = min(stop + SEGMENT_BYTES, len(data))
                    inside = word_bytes[data[at:stop]]
                if stop < len(data):
                    stop = at + len(inside) - int(np.argmin(inside[::-1]))
                    inside = inside[: stop - at]
            edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
            first, last = edges[0::2], edges[1::2]
            sums = np.concatenate(([np.uint64(0)], np.cumsum(_VALUES[data[at:stop]] * _powers(_BASE, stop - at)[: stop - at], dtype=np.uint64)))
            number = (sums[last] - sums[first]) * _powers(_BASE_INVERSE, stop - at)[first]
            starts.append(first + at)
            ends.append(last + at)
            numbers.append(mixed(number ^ (last - first).astype(np.uint64)))
            at = stop
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.ends = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        self.numbers = np.concatenate(numbers) if numbers else np.zeros(0, np.uint64)
        bounds = np.searchsorted(self.starts, self.text_starts)
        self.bounds = np.concatenate((bounds, [len(self.starts)]))

    def of_text(self, i: int) -> slice:
        return slice(self.bounds[i], self.bounds[i + 1])


def runs(numbers: np.ndarray, n: int) -> np.ndarray:
    """A number for each ``n`` consecutive words."""
    if len(numbers) < n:
        return numbers[:0]
    out = numbers[: len(numbers) - n + 1].copy()
    for i in range(1, n):
        out = mixed(out * np.uint64(31) + numbers[i : len(numbers) - n + 1 + i])
    return out


def sums_by_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each text's stretch of ``values``; 0 for an empty one."""
    out = np.zeros(len(bounds) - 1)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, bounds[:-1][full])
    return out
