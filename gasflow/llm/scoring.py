"""Language-model scores: a byte context tree pretrained on the whole corpus, beside a smoothed unigram model.

Both models are counted over all training documents in one pass. Each task counts distinct keys of its rows before
anything is shuffled. Every token and every gram counts, however rare; the counts are written tables that grow with the
corpus. The most frequent tokens and longest grams (a bounded number) are shipped. All others meet their documents in a
join; the grams are coded there once for each distinct one, with the escapes looked up in the tables of all orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gasflow.functions.sizing import materialize
from gasflow.llm.blocks import TOKEN_BYTES, Words, row_blocks, sums_by_text
from gasflow.llm.ppm import Table, adaptive_bits, counted, grams_of

ORDER = 4
SHIPPED_TOKENS = 1 << 18
SHIPPED_GRAMS = 1 << 19
#: Tables keyed by at most this many bytes have a bounded number of rows and are broadcast.
SHORT_KEY = 2
HELD_KEYS = 1 << 21
END_TOKEN = np.uint64(0)
ALPHA = 0.1
LOG2 = float(np.log10(2))


def _counts(docs: DataFrame, order: int) -> DataFrame:
    """``kind, key, n``: training counts of tokens (kind 0) and of byte grams (kind 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]

        def merged(kind: int) -> tuple[np.ndarray, np.ndarray]:
            return counted(np.concatenate([k for k, _ in held[kind]]), np.concatenate([n for _, n in held[kind]]))

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            if held[kind]:
                keys, n = merged(kind)
                held[kind] = []
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])

        for batch in batches:
            for _, texts in row_blocks(batch, "text"):
                words = Words(texts, TOKEN_BYTES)
                tokens, n = counted(words.numbers)
                held[0].append((np.append(tokens, END_TOKEN), np.append(n, len(texts))))
                held[1].append(counted(grams_of(texts, order)[0]))
                for kind in (0, 1):
                    if sum(len(k) for k, _ in held[kind]) > HELD_KEYS:
                        held[kind] = [merged(kind)]
                        if len(held[kind][0][0]) > HELD_KEYS // 2:
                            yield from out(kind)
        yield from out(0)
        yield from out(1)

    return docs.mapInArrow(count, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


class Shipped:
    """What scoring ships to the executors; its size is bounded."""

    def __init__(self, tokens: pa.Table, grams: pa.Table, order: int):
        self.order = order
        self.known, self.counts = self._table(tokens, "n")
        self.grams, self.bits = self._table(grams, "bits")

    @staticmethod
    def _table(found: pa.Table, value: str) -> tuple[Table, np.ndarray]:
        keys = found["key"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(keys)
        return Table(keys[order]), found[value].to_numpy()[order]


class Model:
    """The shipped part, and the written tables of all grams and contexts.

    ``grams`` has ``k, key, n``: grams of k + 1 bytes. ``contexts`` has ``k, key, weight, escape, excluded``: contexts of k
    bytes, the weight of all that followed them, that of an escape, and the shorter context's count of what they rule out.
    """

    def __init__(self, shipped: Shipped, grams: DataFrame, contexts: DataFrame, total: int, distinct: int, first: int):
        self.shipped, self.grams, self.contexts = shipped, grams, contexts
        self.total, self.distinct = total, distinct
        #: how many different bytes the empty context has seen
        self.first = first

    def coded(self, keys: DataFrame) -> DataFrame:
        """``key, bits``: the code length of each distinct gram's last byte, given the bytes before it."""
        order = self.shipped.order
        start = keys.select("key", F.lit(0.0).alias("cost"), F.lit(0.0).alias("ruled_out"))
        # most grams are found in the longest context; only the others go on to the shorter ones
        longest = materialize(self._step(start, order))
        parts, rest = [longest.filter("bits IS NOT NULL").select("key", "bits")], longest.filter("bits IS NULL").drop("bits")
        for k in range(order - 1, -1, -1):
            rest = self._step(rest, k, F.col("bits") if k < order - 1 else F.lit(None).cast("double"))
        left = float(np.log2(max(256 - self.first, 1)))
        last = F.coalesce("bits", F.col("cost") + left) if order else F.col("cost") + left
        return materialize(parts[0].unionByName(rest.select("key", last.alias("bits"))))

    def _step(self, rows: DataFrame, k: int, done: Column | None = None) -> DataFrame:
        """Code what is still open in the contexts of k bytes: ``key, cost, ruled_out, bits``."""

        def level(table: DataFrame, size: int, *columns: str) -> DataFrame:
            here = table.filter(F.col("k") == k).select(F.col("key").alias(f"_of_{size}"), *columns)
            return F.broadcast(here) if size <= SHORT_KEY else here

        open_rows = rows.withColumn("_done", F.lit(None).cast("double") if done is None else done).drop("bits")
        gram, context = f"_of_{k + 1}", f"_of_{k}"
        both = (
            open_rows.withColumn(gram, F.col("key").bitwiseAND((1 << 8 * (k + 1)) - 1))
            .join(level(self.grams, k + 1, "n"), gram, "left").drop(gram)
            .withColumn(context, F.shiftright("key", 8).bitwiseAND((1 << 8 * k) - 1))
            .join(level(self.contexts, k, "weight", "escape", "excluded"), context, "left").drop(context)
        )
        known = F.col("weight").isNotNull()
        return both.select(
            "key",
            F.when(known, F.col("cost") + F.log2((F.col("weight") - F.col("ruled_out")) / F.col("escape"))).otherwise(F.col("cost")).alias("cost"),
            F.when(known, F.col("excluded")).otherwise(0.0).alias("ruled_out"),
            F.coalesce("_done", F.when(F.col("n").isNotNull(), F.col("cost") + F.log2(F.col("weight") - F.col("ruled_out")) - F.log2("n"))).alias("bits"),
        )


def _tree(counts: DataFrame, order: int, share: int | None) -> tuple[DataFrame, DataFrame]:
    """The grams and contexts of each order; with ``share``, only what occurs at least in one of so many places."""
    orders = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit((1 << 8 * (k + 1)) - 1).alias("mask")) for k in range(order + 1))))
    grams = materialize(
        counts.filter("kind = 1").select(orders.alias("o"), "key", "n")
        .groupBy(F.col("o.k").alias("k"), F.col("key").bitwiseAND(F.col("o.mask")).alias("key")).agg(F.sum("n").alias("n"))
    )
    least = 1 if share is None else -(-(grams.filter("k = 0").agg(F.sum("n")).first()[0] or 0) // share)
    kept = F.col("n") >= least
    shorter = grams.select((F.col("k") + 1).alias("k"), F.col("key").alias("suffix"), F.col("n").alias("less"))
    # a gram has at most 256 longer ones that end with it, so this join has no hot key
    suffix = F.col("key").bitwiseAND(F.expr("shiftleft(1L, 8 * k) - 1"))
    with_shorter = grams.withColumn("suffix", F.when(F.col("k") > 0, suffix)).join(shorter, ["k", "suffix"], "left")
    contexts = (
        with_shorter.groupBy("k", F.shiftright("key", 8).alias("key"))
        .agg(
            F.sum("n").alias("total"), F.count(F.when(kept, 1)).alias("distinct"), F.coalesce(F.sum(F.when(kept, F.col("n"))), F.lit(0)).alias("kept"),
            F.coalesce(F.sum(F.when(kept, F.col("less"))), F.lit(0)).cast("double").alias("excluded"),
        )
        .filter("distinct > 0")
        .select(
            "k", "key", (F.col("total") + F.col("distinct")).cast("double").alias("weight"),
            (F.col("total") - F.col("kept") + F.col("distinct")).cast("double").alias("escape"), "excluded",
        )
    )
    return grams.filter(kept), materialize(contexts)


def _sizes(counts: DataFrame, shipped: int) -> tuple[int, int, int]:
    """How many keys there are, their summed counts, and the least count of which at most ``shipped`` keys have as much."""
    # one row per power of two: how many keys have counts of that size
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n")).collect()
    least, held = 1 << 62, 0
    for r in sorted(sizes, key=lambda r: -r.level):
        held += r["keys"]
        if held > shipped:
            break
        least = 1 << r.level
    return sum(r["keys"] for r in sizes), sum(r.n for r in sizes), least


def train(
    docs: DataFrame,
    order: int = ORDER,
    share: int | None = None,
    shipped: int = SHIPPED_TOKENS,
    text: str = "text",
    shipped_grams: int = SHIPPED_GRAMS,
) -> tuple[Model, DataFrame]:
    """Count a corpus: the model, and the written table of all token counts.

    All grams are kept unless a ``share`` is given: then those in less than one of so many places are pruned. Null texts
    count as empty ones; repeated rows count each time. An empty corpus gives a model that knows nothing.
    """
    if not 0 <= order <= 6:
        raise ValueError("the order is 0 to 6")
    counts = materialize(_counts(docs.select(F.col(text).cast("string").alias("text")), order))
    tokens = counts.filter("kind = 0").select("key", "n")
    distinct, total, least = _sizes(tokens, shipped)
    grams, contexts = _tree(counts, order, share)
    longest = grams.filter(F.col("k") == order).select("key", "n")
    often = longest.filter(F.col("n") >= _sizes(longest, shipped_grams)[2]).withColumn("context", F.shiftright("key", 8))
    weights = contexts.filter(F.col("k") == order).select(F.col("key").alias("context"), "weight")
    coded = often.join(weights, "context").select("key", (F.log2("weight") - F.log2("n")).alias("bits"))
    part = Shipped(tokens.filter(F.col("n") >= least).toArrow(), coded.toArrow(), order)
    return Model(part, grams, contexts, total, distinct, grams.filter("k = 0").count()), tokens


RESULTS = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score(docs: DataFrame, model: Model, tokens: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document with the columns ``keep`` and

    ``n_tokens``, ``n_known`` (tokens that occur in training), ``train_tokens``, ``base_score`` (log10 probability under
    the smoothed unigram model) and ``score`` (log10 probability of the text and its end under the context tree).

    Names in ``keep`` that results bear are left out. Texts are read whole; a null text is empty. Repeated rows are scored each for itself, a null id stays null. Tokens
    and grams too rare to be shipped, and those not in training, are looked up by a join on the distinct ones of each text.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model.shipped)
    kept = [c for c in keep if c not in RESULTS] or [F.lit(None).alias("_nothing")]
    frame = docs.select(F.struct(*kept).alias("_kept"), F.col(text).cast("string").alias("_text"))
    extra = ["_row", "n_tokens", "n_known", "base", "bits", "rare", "times", "grams", "gram_times"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Shipped = shipped.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for rows, texts in row_blocks(batch, "_text", 1 << 20):
                words = Words(texts, TOKEN_BYTES)
                at = m.known.find(words.numbers)
                n = m.counts[at] if len(m.counts) else np.zeros(len(at), np.int64)
                known = at >= 0
                base = sums_by_text(np.where(known, np.log10(n + ALPHA), 0.0), words.bounds)
                n_known = sums_by_text(known.astype(float), words.bounds).astype(np.int64)
                doc = np.repeat(np.arange(len(texts)), np.diff(words.bounds))[~known]
                rare, times = _by_text(words.numbers[~known], doc, len(texts))
                grams, bounds = grams_of(texts, m.order)
                at = m.grams.find(grams)
                bits = sums_by_text(np.where(at >= 0, m.bits[at], 0.0) if len(m.bits) else np.zeros(len(at)), bounds)
                far = np.flatnonzero(at < 0)
                far_grams, far_times = _by_text(grams[far], np.searchsorted(bounds, far, "right") - 1, len(texts))
                columns = [
                    pa.array(row + np.arange(len(texts))), pa.array(np.diff(words.bounds) + 1), pa.array(n_known), pa.array(base),
                    pa.array(bits), rare, times, far_grams, far_times,
                ]
                row += len(texts)
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *columns], names=[*rows.schema.names[:-1], *extra])

    types = "_row long, n_tokens long, n_known long, base double, bits double, rare array<long>, times array<long>, grams array<long>, gram_times array<long>"
    table = materialize(frame.mapInArrow(scored, T.StructType([frame.schema["_kept"], *T.StructType.fromDDL(types).fields])))

    def apart(keys: str, times: str) -> DataFrame:
        each = table.select("_row", F.explode(F.arrays_zip(F.col(keys).alias("key"), F.col(times).alias("times"))).alias("t"))
        return each.select("_row", "t.key", "t.times")

    n = F.coalesce("n", F.lit(0))
    rare = apart("rare", "times").join(tokens, "key", "left").select(
        "_row", F.when(n > 0, F.col("times")).otherwise(0).alias("known"), (F.col("times") * F.log10(n + ALPHA)).alias("base"), F.lit(0.0).alias("bits")
    )
    grams = apart("grams", "gram_times")
    coded = model.coded(grams.select("key").distinct())
    far = grams.join(coded, "key").select("_row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("bits")).alias("bits"))
    rest = rare.unionByName(far).groupBy("_row").agg(F.sum("known").alias("more_known"), F.sum("base").alias("more_base"), F.sum("bits").alias("more_bits"))
    end_count = tokens.filter(F.col("key") == int(END_TOKEN)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    share = float(np.log10(model.total + ALPHA * (model.distinct + 1)))
    return table.drop("rare", "times", "grams", "gram_times").join(rest, "_row", "left").select(
        *(F.col("_kept")[c].alias(c) for c in kept if isinstance(c, str)),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + (1 if end_count else 0)).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + float(np.log10(end_count + ALPHA)) - F.col("n_tokens") * share).alias("base_score"),
        (-(F.col("bits") + F.coalesce("more_bits", F.lit(0.0))) * LOG2).alias("score"),
    )


def _by_text(numbers: np.ndarray, doc: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Distinct numbers of each text and how often they occur there."""
    order = np.lexsort((numbers, doc))
    numbers, doc = numbers[order], doc[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(doc), 1), bool), (numbers[1:] != numbers[:-1]) | (doc[1:] != doc[:-1]))))
    times = np.diff(np.append(first, len(doc)))
    offsets = np.searchsorted(doc[first], np.arange(n + 1)).astype(np.int32)
    return (
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(numbers[first].view(np.int64))),
        pa.ListArray.from_arrays(pa.array(offsets), pa.array(times.astype(np.int64))),
    )


def score_adaptively(docs: DataFrame, order: int = ORDER, text: str = "text") -> DataFrame:
    """Add ``score``: log10 probability of each text under counts learned from its own earlier bytes alone.

    Python goes byte by byte here; meant for reports on chosen documents.
    """
    frame = docs.drop("score")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in row_blocks(batch, text):
                bits = [-adaptive_bits(t, order) * LOG2 for t in texts]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(bits, pa.float64())], names=[*rows.schema.names, "score"])

    return frame.mapInArrow(scored, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema), "score double"]))
