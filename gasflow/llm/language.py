"""Language identification by prediction by partial matching: one frozen context tree per language.

A text's code length under each language's tree is its evidence: the shortest wins, and the score is the winner's
share when code lengths are taken as probabilities of equally likely languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.llm.blocks import fresh, handing_back, row_blocks
from gasflow.llm.ppm import ContextTree, bits_by_tree, counted, grams_of

ORDER = 4
#: The labelled sample holds at most about this many bytes of text per language.
SAMPLE_BYTES = 1 << 20
LEVELS = 62
#: A level is taken in this many parts.
PARTS = 16


def labelled_sample(labelled: DataFrame, limit: int = SAMPLE_BYTES, text: str = "text", lang: str = "lang") -> DataFrame:
    """A bounded sample of whole distinct texts per language: ``lang, text``.

    Each distinct text, however often it occurs, has a level n with probability 2^-(n+1) and one of ``PARTS`` parts of
    it, both from a hash. Parts are taken from the highest level down as long as the chosen texts fit the limit; a
    part that does not fit is left out, unless it is a language's first.
    """
    bits = F.lpad(F.bin(F.xxhash64(text).bitwiseAND((1 << LEVELS) - 1)), LEVELS, "0")
    rows = labelled.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.length(F.regexp_extract(bits, "^(0*)", 1)).alias("level"),
        F.pmod(F.xxhash64(F.lit(1), F.col(text)), F.lit(PARTS)).cast("int").alias("part"),
    )
    # a text stands for its copies; 128 bits of hashes and the length tell texts apart
    mark = [F.xxhash64("text").alias("h"), F.xxhash64(F.lit(2), F.col("text")).alias("g"), F.octet_length("text").alias("size")]
    distinct = rows.select("lang", "level", "part", *mark).distinct()
    sizes = distinct.groupBy("lang", "level", "part").agg(F.sum("size").alias("bytes")).collect()
    held: dict[str, int] = {}
    chosen = []
    for r in sorted(sizes, key=lambda r: (-r.level, r.part)):
        if r.lang not in held or held[r.lang] + r.bytes <= limit:
            held[r.lang] = held.get(r.lang, 0) + r.bytes
            chosen.append((r.lang, r.level, r.part))
    if not chosen:
        return rows.select("lang", "text").limit(0)
    parts = labelled.sparkSession.createDataFrame(chosen, "lang string, level int, part int")
    return rows.join(F.broadcast(parts), ["lang", "level", "part"]).select("lang", "text").distinct()


def fit(labelled: DataFrame, order: int = ORDER, limit: int = SAMPLE_BYTES, text: str = "text", lang: str = "lang") -> dict[str, ContextTree]:
    """A context tree per language, from the bounded sample of labelled rows."""
    texts: dict[str, list[bytes]] = {}
    for r in labelled_sample(labelled, limit, text, lang).toLocalIterator():
        texts.setdefault(r.lang, []).append(r.text.encode("utf-8", "replace"))
    return {name: ContextTree.of(*counted(grams_of(own, order)[0]), order) for name, own in sorted(texts.items())}


def identify(docs: DataFrame, trees: dict[str, ContextTree], text: str = "text") -> DataFrame:
    """The documents with ``lang_pred``, ``score`` and ``bits_per_byte`` (under the predicted language).

    Whole texts are scored. ``lang_pred`` is ``und`` and the score 0 when a text is null or has no letter, or
    when no language was learned. Equal code lengths go to the first language by name. Each row gives one row; other
    columns are kept, those that bear the new names are replaced. A text of any length is scored whole, in memory that
    grows with the longest one. An empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    flag = fresh("has_letter", docs.columns)
    frame = docs.drop("lang_pred", "score", "bits_per_byte").withColumn(flag, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    schema = T.StructType([*(f for f in frame.schema if f.name != flag), *new])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(shipped.value)
        for batch in batches:
            for rows, texts in row_blocks(batch, text, 1 << 20):
                lettered = np.array(rows.column(rows.schema.get_field_index(flag)).to_pylist(), bool)
                n = len(texts)
                lengths = np.fromiter(map(len, texts), np.int64, n) + 1
                best, share, bits = np.zeros(n, int), np.zeros(n), np.zeros(n)
                if names:
                    all_bits = bits_by_tree(list(shipped.value.values()), texts)
                    best = all_bits.argmin(1)
                    bits = all_bits[np.arange(n), best]
                    share = 1 / np.exp2(np.maximum(bits[:, None] - all_bits, -1000)).sum(1)
                known = lettered & bool(names)
                predicted = [names[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
                kept = [(rows.column(i), f) for i, f in enumerate(rows.schema.names) if f != flag]
                yield pa.RecordBatch.from_arrays(
                    [*(c for c, _ in kept), pa.array(predicted, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(np.where(known, bits / lengths, 0.0))],
                    names=[*(f for _, f in kept), "lang_pred", "score", "bits_per_byte"],
                )

    return frame.mapInArrow(handing_back(score), schema)


def recognised(identified: DataFrame) -> DataFrame:
    """Only the documents that have a language: not ``und``.

    The code length is no reason to drop one, since short, upper-case or numeric clean texts cost as much as noise.
    """
    return identified.filter(F.col("lang_pred") != "und")
