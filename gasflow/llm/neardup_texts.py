"""Similarity join of texts on five-word shingles: MinHash LSH forest, then exact verification.

A signature is laid out in trees. Each tree is a trie kept as sorted rows: texts of one prefix are neighbours. A text is
compared with the first one that shares its longest prefix, and while the two differ too much its prefix is shortened,
down to the depth at which a pair at the threshold meets in some tree with the target recall. Texts that agree by their
sketches are gathered into clusters, so a dense branch of copies is settled at long prefixes in one walk over its rows; only
branches that hold several clusters at the last depth are compared row by row, and only between clusters. Inside a cluster
every pair is verified by the Jaccard similarity of the whole shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gasflow.functions.components import connected_components
from gasflow.functions.sizing import materialize
from gasflow.llm.blocks import WORD_BYTES, Words, handing_back, mixed, row_blocks, runs
from gasflow.llm.links import FOUND, found_rows, in_tile_pairs, joined_up, numbered, stars

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
FULL_DEPTH = 6
RECALL = 0.99999
#: A pair at the threshold agrees in this share of its sketch, or more, but for one in ninety million.
SCREEN = 0.55
SKETCH_TILE, SET_TILE = 1024, 256
NO_ID = -(1 << 63)


def prefix_depth(threshold: float, trees: int = TREES, full: int = FULL_DEPTH, recall: float = RECALL) -> int:
    """The last depth: shorten prefixes from ``full`` until a pair at the threshold meets in one of the trees with probability ``recall``."""
    depth = full
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingle_sets(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingles of each text as 64-bit numbers; a text of fewer words, but not none, is one shingle."""
    words = Words(texts, WORD_BYTES)
    out = []
    for i in range(len(texts)):
        own = words.numbers[words.of_text(i)]
        out.append(np.unique(runs(own, min(width, len(own)))) if len(own) else own)
    return out


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Smallest value of the set under each of the hash functions."""
    least = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048]
        h = part[None, :] * seeds[:, None]
        least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(1))
    return least


def _seeds(n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(99)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def link_texts(
    docs: DataFrame, threshold: float = THRESHOLD, width: int = SHINGLE, id: str = "doc_id", text: str = "text", trees: int = TREES, recall: float = RECALL
) -> DataFrame:
    """``doc_id, class_id, n_links, kept`` for each row.

    Two documents are linked when the Jaccard similarity of their sets of ``width``-word shingles is ``threshold`` or more
    (words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased). ``n_links`` counts the other rows
    linked directly, ``class_id`` is the smallest id that links reach, and ``kept`` marks the row that has it. Texts
    without words (null, empty, punctuation) link with nothing. Documents with equal sets are one class that is compared once.
    Of repeated rows with one id all are marked alike. A null id names a class only if all its ids are null. Empty tables give
    no rows. A pair of classes at the threshold is missed by the forest or by the screen of its sketch with a probability of
    at most about ``1 - recall``, 3.3e-6 with the parameters given; pairs that share a cluster are all verified.
    """
    rows, classes = _classes(docs, threshold, width, id, text, trees, recall)
    found = _verify(docs, classes, _clusters(classes, threshold, trees), threshold, width, id, text)
    results = joined_up(classes.select(F.col("number").alias("key"), F.col("key").alias("wide"), F.col("rep.id").alias("first_id"), "copies"), found)
    named = F.when(F.col("class_id") != NO_ID, F.col("class_id"))
    return rows.select("id", F.col("key").alias("wide"), "hash").join(results, "wide", "left").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id),
        F.when(F.col("wide").isNull(), F.when(F.col("id") != NO_ID, F.col("id"))).otherwise(named).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (F.col("wide").isNull() | (F.col("id") == F.col("class_id"))).alias("kept"),
        F.col("hash").alias("text_hash"),
    )


def _ids(docs: DataFrame, id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(body).alias("hash"), body.alias("text"))


def _classes(docs: DataFrame, threshold: float, width: int, id: str, text: str, trees: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows with the key of their shingle set, and one row per set with its label in each tree and its sketch.

    A label is the prefix of the last depth as one number, and what each greater depth adds (``longer``, tree by tree).
    """
    depth = prefix_depth(threshold, trees, recall=recall)
    seeds = _seeds(trees * FULL_DEPTH)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in row_blocks(batch):
                sets = shingle_sets(texts, width)
                keys, sizes, prefixes, longer, sketches = [], [], [], [], []
                for s in sets:
                    keys.append(set_key(s) if len(s) else None)
                    sizes.append(len(s))
                    sig = signature(s, seeds).reshape(trees, FULL_DEPTH)
                    prefixes.append(runs(sig[:, :depth].ravel(), depth)[::depth].view(np.int64) if len(s) else None)
                    longer.append((mixed(sig[:, depth:]) >> np.uint64(32)).astype(np.uint32).view(np.int32).ravel() if len(s) else None)
                    sketches.append((mixed(sig[:, :depth]) >> np.uint64(56)).astype(np.uint8).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32())]
                    + [pa.array(prefixes, pa.list_(pa.int64())), pa.array(longer, pa.list_(pa.int32())), pa.array(sketches, pa.binary())],
                    names=["id", "hash", "key", "shingles", "prefixes", "longer", "sketch"],
                )

    rows = materialize(_ids(docs, id, text).mapInArrow(handing_back(sign), "id long, hash long, key binary, shingles int, prefixes array<long>, longer array<int>, sketch binary"))
    classes = rows.filter("key is not null").groupBy("key").agg(
        F.min(F.struct("id", "hash")).alias("rep"), F.count(F.lit(1)).alias("copies"),
        *(F.any_value(c).alias(c) for c in ("shingles", "prefixes", "longer", "sketch")),
    )
    return rows, numbered(classes)


def alike(left: np.ndarray, right: np.ndarray, left_sizes: np.ndarray, right_sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Whether sketches, and sizes of the sets, agree as those of a pair at the threshold do; arrays are matched by broadcasting."""
    close = np.minimum(left_sizes, right_sizes) >= threshold * np.maximum(left_sizes, right_sizes) - 1e-9
    return close & ((left == right).sum(-1, dtype=np.int32) >= SCREEN * left.shape[-1])


def walk_tries(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Walk rows sorted by ``tree, prefix, longer``; link each to the first row of the deepest branch that is alike.

    From batch to batch the first rows of the open branches are carried, one for each depth.
    """
    carried: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if carried is None else [carried, batch]).combine_chunks()
        n = table.num_rows
        longer = np.array(table["longer"].to_pylist(), np.int64).reshape(n, -1)
        label = np.column_stack([table["tree"].to_numpy(), table["prefix"].to_numpy(), longer]).astype(np.int64)
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(n, -1)
        sizes, numbers = table["shingles"].to_numpy(), table["number"].to_numpy()
        differs = np.ones((n, label.shape[1]), bool)
        differs[1:] = np.logical_or.accumulate(label[1:] != label[:-1], axis=1)
        # the first row of each row's branch, by depth; column 0 tells trees apart
        firsts = np.maximum.accumulate(np.where(differs, np.arange(n)[:, None], 0), axis=0)[:, 1:]
        met = np.arange(n)
        for depth in range(firsts.shape[1] - 1, -1, -1):
            open_rows = np.flatnonzero((met == np.arange(n)) & (firsts[:, depth] != np.arange(n)))
            to = firsts[open_rows, depth]
            agree = alike(sketches[open_rows], sketches[to], sizes[open_rows], sizes[to], threshold)
            met[open_rows[agree]] = to[agree]
        linked = np.flatnonzero(met != np.arange(n))
        linked = linked[linked >= n - batch.num_rows]
        yield pa.RecordBatch.from_arrays([pa.array(numbers[linked], pa.int64()), pa.array(numbers[met[linked]], pa.int64())], names=["a", "b"])
        carried = table.take(np.unique(firsts[-1])).combine_chunks().to_batches()[0]


def _clusters(classes: DataFrame, threshold: float, trees: int) -> DataFrame:
    """``number, cluster, size`` of the classes that meet others in a tree and pass the screen."""
    nodes = classes.select("number", "longer", F.posexplode("prefixes").alias("tree", "prefix"))
    added = (F.size("longer") / trees).cast("int")
    nodes = nodes.select("number", "tree", "prefix", F.slice("longer", F.col("tree") * added + 1, added).alias("longer"))
    buckets = nodes.groupBy("tree", "prefix").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("number")).alias("mark"), F.sum(F.hash("number").cast("long")).alias("sum")
    )
    # texts that meet in several trees in the same company are compared in one of them
    distinct = buckets.filter("size > 1").groupBy("size", "mark", "sum").agg(F.min(F.struct("tree", "prefix")).alias("b"))
    wanted = materialize(distinct.select(F.col("b.tree").alias("tree"), F.col("b.prefix").alias("prefix")))
    members = materialize(nodes.join(wanted, ["tree", "prefix"]).join(classes.select("number", "shingles", "sketch"), "number"))

    order = ["tree", "prefix", "longer", "number"]
    walked = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda batches: walk_tries(batches, threshold), "a long, b long")
    settled = _components(walked).withColumnRenamed("cluster", "walked")
    told = materialize(members.drop("longer").join(settled, "number", "left").withColumn("walked", F.coalesce("walked", "number")))
    several = told.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size"), F.min("walked").alias("low"), F.max("walked").alias("high"))
    unsettled = told.join(several.filter("low <> high").select("tree", "prefix", "size"), ["tree", "prefix"])

    def screen(table: pa.Table) -> pa.Table:
        tile = table["tile"].to_numpy()
        left, right = table["left"][0].as_py(), table["right"][0].as_py()
        sketches = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(tile), -1)
        sizes, walked = table["shingles"].to_numpy(), table["walked"].to_numpy()
        a, b = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
        adjacent = np.zeros((len(a), len(b)), bool)
        step = max(1, (1 << 23) // max(1, sketches.shape[1] * len(b)))
        for at in range(0, len(a), step):
            some = a[at : at + step]
            others = np.flatnonzero((walked[b][None, :] != walked[some][:, None]).any(0))  # rows of one cluster are verified anyway
            met = alike(sketches[some][:, None, :], sketches[b[others]][None, :, :], sizes[some][:, None], sizes[b[others]][None, :], threshold)
            adjacent[at : at + step, others] = met
        adjacent &= walked[a][:, None] != walked[b][None, :]
        root_a, root_b = stars(adjacent, left == right)
        order = a if left == right else np.concatenate((a, b))
        moved = [(i, order[r]) for i, r in zip(a, root_a, strict=True) if i != order[r]]
        if left != right:
            moved += [(i, order[r]) for i, r in zip(b, root_b, strict=True) if i != order[r]]
        return pa.table({"a": pa.array([walked[i] for i, _ in moved], pa.int64()), "b": pa.array([walked[r] for _, r in moved], pa.int64())})

    cut = in_tile_pairs(unsettled, "size", "number", SKETCH_TILE)
    joined = _components(cut.groupBy("tree", "prefix", "left", "right").applyInArrow(screen, "a long, b long")).withColumnRenamed("number", "walked")
    # a cluster of the walk that the screen joins to others, be it of one class, takes the name of their whole
    alone = joined.select(F.col("walked").alias("number"), "walked").join(settled, "number", "left_anti")
    clusters = materialize(
        settled.unionByName(alone).join(joined, "walked", "left").select("number", F.coalesce("cluster", "walked").alias("cluster"))
    )
    return clusters.join(clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")), "cluster")


def _components(edges: DataFrame) -> DataFrame:
    return materialize(connected_components(edges).select(F.col("node").alias("number"), F.col("component").alias("cluster")))


def similar_sets(sets: list[np.ndarray], others: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of ``threshold`` or more; sets are sorted and distinct."""
    sizes = [np.array([len(s) for s in side]) for side in (sets, others)]
    owners = [np.repeat(np.arange(len(side)), n) for side, n in zip((sets, others), sizes, strict=True)]
    values, places = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    left, right = places[: len(owners[0])], places[len(owners[0]) :]
    shared = np.intersect1d(left, right)  # shingles on one side only cannot add to an intersection
    common = np.zeros((len(sets), len(others)), np.float64)
    number = np.full(len(values), -1)
    number[shared] = np.arange(len(shared))
    left, right = number[left], number[right]
    for at in range(0, len(shared), 4096):
        width = min(4096, len(shared) - at)
        a, b = np.zeros((len(sets), width), np.float32), np.zeros((len(others), width), np.float32)
        for matrix, owner, column in ((a, owners[0], left), (b, owners[1], right)):
            inside = (column >= at) & (column < at + width)
            matrix[owner[inside], column[inside] - at] = 1
        common += a @ b.T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return common >= threshold * union - 1e-9


def _verify(docs: DataFrame, classes: DataFrame, clusters: DataFrame, threshold: float, width: int, id: str, text: str) -> DataFrame:
    """Links between the classes of each cluster."""
    wanted = clusters.join(classes.select("number", "key", "copies", "rep"), "number").select("number", "key", "cluster", "size", "copies", "rep.id", "rep.hash")
    texts = _ids(docs, id, text).join(wanted, ["id", "hash"])

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in row_blocks(batch):
                kept = ["number", "cluster", "size", "copies"]
                columns = [part.column(part.schema.get_field_index(n)) for n in kept]
                sets = shingle_sets(raw, width)
                whole = pa.RecordBatch.from_arrays([*columns, pa.array([s.tobytes() for s in sets], pa.binary())], names=[*kept, "shingles"])
                # another row may have the id and hash of this class, but not its set
                yield whole.filter(pa.array([k == set_key(s) for k, s in zip(part.column(part.schema.get_field_index("key")).to_pylist(), sets, strict=True)], pa.bool_()))

    sets = texts.select("number", "key", "cluster", "size", "copies", "text").mapInArrow(handing_back(sets_of), "number long, cluster long, size long, copies long, shingles binary")

    def compare(table: pa.Table) -> pa.Table:
        first = np.sort(np.unique(table["number"].to_numpy(), return_index=True)[1])  # repeated rows of a representative
        table = table.take(first)
        keys, tile = table["number"].to_pylist(), table["tile"].to_numpy()
        left, right = table["left"][0].as_py(), table["right"][0].as_py()
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        adjacent = similar_sets([s for s, t in zip(sets, tile, strict=True) if t == left], [s for s, t in zip(sets, tile, strict=True) if t == right], threshold)
        return found_rows(keys, table["copies"].to_numpy(), tile, left, right, adjacent)

    cut = in_tile_pairs(sets, "size", "number", SET_TILE)
    return cut.groupBy("cluster", "left", "right").applyInArrow(compare, FOUND)


def one_of_each(docs: DataFrame, linked: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that ``link_texts`` keeps: one of each class, and all that link with nothing."""
    kept = linked.filter("kept").select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    # the columns of the documents travel in one struct, so none can clash with the names used here
    rows = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_hash"), F.struct("*").alias("_row"))
    return rows.join(kept, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select("_row.*")
