"""Packing documents into training sequences by power-of-two decomposition.

A document of n tokens is cut into as many pieces of the longest length as it holds, then into pieces of the
binary digits of the rest, longest first. Each piece is a sequence of its own length: a sequence never crosses
documents, no token is padding, and a batch takes its sequences from one bucket of equal lengths. A sequence's number
names its bucket, the task that filled it, and its place there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasflow.llm.blocks import LOWER, Words, handing_back, row_blocks

LONGEST = 4096
END_ID = 2
#: Stretches that a worker keeps in each of two generations.
KEPT_WORDS = 200_000
#: Where the bucket and the task begin in a sequence's number: 2^22 tasks of 2^36 sequences a bucket.
BUCKET_BITS, PLACE_BITS = 58, 36
PIECE = "doc_id long, start long, length long, tokens binary, doc_tokens long, sequence_id long, offset long"
_SPLIT = np.array([b not in (10, 32) for b in range(256)])
#: ASCII marks but for the apostrophe, which may open an ending such as 's.
_MARKS = np.array([33 <= b <= 126 and not chr(b).isalnum() and b != 39 for b in range(256)])


def piece_lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths that add up to ``n``: ``longest`` as often as it fits, then the powers of two of the rest."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class _Generation:
    """Stretches and their ids, one behind the other in one array."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.ids, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self.sizes = np.zeros(1 << 14, np.int64)

    def add(self, chunks: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        have = len(self.place)
        begin = int(self.ends[have - 1]) if have else 0
        self.ids = _room(self.ids, begin + len(ids))
        self.ends, self.sizes = _room(self.ends, have + len(chunks)), _room(self.sizes, have + len(chunks))
        self.ids[begin : begin + len(ids)] = ids
        self.sizes[have : have + len(chunks)] = sizes
        self.ends[have : have + len(chunks)] = begin + np.cumsum(sizes)
        self.place.update(zip(chunks, range(have, have + len(chunks)), strict=True))

    def get(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the stretches at ``places``, and how many each has."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        source = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.ends[places] - ends, sizes)
        return self.ids[source], sizes


def _room(array: np.ndarray, size: int) -> np.ndarray:
    if size <= len(array):
        return array
    larger = np.zeros(1 << size.bit_length(), array.dtype)
    larger[: len(array)] = array
    return larger


class WordIds:
    """Token ids of whole texts for a tokenizer that lower-cases and never joins across white space.

    Stretches between spaces are tokenized and kept. All of a block that are new go to the tokenizer in two
    calls; those of letters only are told apart in its answer by the tokens that end a word. What was not met since the
    last generation began is forgotten when the next one does.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ends = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends[list(ends)] = True
        self.kept, self.earlier = _Generation(), _Generation()

    def plain(self, text: str) -> np.ndarray:
        # the fast call leaves out the places of tokens in the text
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def learn(self, new: list[bytes]) -> None:
        """Tokenize stretches and keep their ids."""
        texts = [chunk.decode("utf-8", "replace") for chunk in new]
        letters = [i for i, t in enumerate(texts) if t.isalpha()]
        if letters:
            ids = self.plain(" ".join([texts[i] for i in letters]))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(letters):
                self.kept.add([new[i] for i in letters], ids, np.diff(ends, prepend=0))
            else:  # a letter that composes or lower-cases to something that is none
                letters = []
        told = set(letters)
        others = [i for i in range(len(new)) if i not in told]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in others], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.kept.add([new[i] for i in others], np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())), sizes)

    def of_texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, as the tokenizer gives them for the whole text."""
        odd = {i for i, t in enumerate(texts) if b"<|" in t}  # may hold a special token, which is told by case
        usual = [b"" if i in odd else t for i, t in enumerate(texts)]
        words = _split_words(usual)
        place, different = pd.factorize(words.numbers)
        first = np.empty(len(different), np.int64)
        first[place[::-1]] = np.arange(len(place) - 1, -1, -1)
        chunks = [words.buffer[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist(), strict=True)]
        if len(self.kept.place) > KEPT_WORDS:
            self.earlier, self.kept = self.kept, _Generation()
        new = [c for c in chunks if c not in self.kept.place]
        again = [c for c in new if c in self.earlier.place]
        if again:
            self.kept.add(again, *self.earlier.get(np.array([self.earlier.place[c] for c in again], np.int64)))
            new = [c for c in new if c not in self.earlier.place]
        if new:
            self.learn(new)
        kept = np.fromiter(map(self.kept.place.__getitem__, chunks), np.int64, len(chunks))
        tokens, sizes = self.kept.get(kept[place])
        bounds = np.concatenate(([0], np.cumsum(sizes)))[words.bounds]
        return [self.plain(texts[i].decode("utf-8", "replace")) if i in odd else tokens[bounds[i] : bounds[i + 1]] for i in range(len(texts))]


def _split_words(texts: list[bytes]) -> Words:
    """Stretches between spaces and line ends; marks between a letter and a space stand alone, as for the tokenizer."""
    data = np.frombuffer(b" ".join(texts).translate(LOWER), np.uint8)
    edges = np.flatnonzero(np.diff(_MARKS[data], prepend=False, append=False))
    first, end = edges[0::2], edges[1::2]
    inner = (first > 0) & (end < len(data))
    first, end = first[inner], end[inner]
    alone = first[(data[first - 1] >= 97) & (data[first - 1] <= 122) & ~_SPLIT[data[end]]]
    words = Words([np.insert(data, alone, 32).tobytes()], _SPLIT, lower=False)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    bounds = np.searchsorted(words.starts, starts + np.searchsorted(alone, starts))
    words.bounds = np.concatenate((bounds, [len(words.starts)]))
    return words


def pack(docs: DataFrame, tokenizer: str, longest: int = LONGEST, end_id: int = END_ID, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per piece: its document, where it starts there, its tokens (little-endian unsigned 32-bit ids,
    binary), the document's number of tokens, and its sequence.

    ``longest`` must be a power of two. ``sequence_id`` starts with the bucket, the binary logarithm of the length, and counts
    within a task's share of it: it is unique in one run of a plan and needs no shuffle, and a range of numbers is a
    run of equal lengths. ``offset`` is 0, since each piece is a sequence. A null or empty text is the end token
    alone; a null id stays null; repeated rows are packed each for itself. Other columns are not read. An empty table
    gives no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task = WordIds(tokenizer), TaskContext.get().partitionId()
        following = {1 << k: (k << BUCKET_BITS) + (task << PLACE_BITS) for k in range(longest.bit_length())}
        for batch in batches:
            for rows, texts in row_blocks(batch, "_text"):
                out: list[tuple] = []
                for doc, tokens in zip(rows.column(0).to_pylist(), ids.of_texts(texts), strict=True):
                    data = np.append(tokens, np.uint32(end_id)).astype("<u4").tobytes()
                    n, start = len(data) // 4, 0
                    for length in piece_lengths(n, longest):
                        out.append((doc, start, length, data[4 * start : 4 * (start + length)], n, following[length], 0))
                        start, following[length] = start + length, following[length] + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    return docs.select(F.col(id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInArrow(handing_back(pieces), PIECE)


_NAMES = [c.split()[0] for c in PIECE.split(", ")]
_TYPES = [pa.binary() if c.endswith("binary") else pa.int64() for c in PIECE.split(", ")]


def bucket_of(sequence_id: str = "sequence_id") -> Column:
    """The length of the sequences in a sequence's bucket, from its number alone."""
    return F.expr(f"shiftleft(1L, cast(shiftright({sequence_id}, {BUCKET_BITS}) as int))")


def bucket_sizes(pieces: DataFrame) -> DataFrame:
    """``length, sequences, tokens`` of each bucket, for a loader that draws batches by its budget of tokens."""
    return pieces.groupBy(bucket_of().alias("length")).agg(F.count(F.lit(1)).alias("sequences"), F.sum("length").alias("tokens"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write the pieces in one folder per length; a loader draws each batch from one folder."""
    pieces.write.partitionBy("length").parquet(path)


def piece_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
