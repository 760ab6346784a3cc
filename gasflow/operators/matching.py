"""Best match between two lists of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.6
CONTAINED = 0.8
GRAM = 3


def fuzzy_match_top1(
    left: DataFrame, right: DataFrame, left_name: str = "name", right_name: str = "name", threshold: float = THRESHOLD
) -> DataFrame:
    """``left_name, right_name, score``: the most similar right name for each left name that has one.

    Case aside, equal names score 1.0, a name contained in the other 0.8, others the share of common
    words (split at underscores and white space). Equal scores take the first right name.

    Pairs meet only where they can qualify: on the rarest three-letter piece of the shorter name, or on
    one of the rare words that any sufficiently similar pair must share.
    """
    lefts = left.select(F.col(left_name).alias("left_name")).filter("left_name is not null").distinct()
    lefts = lefts.withColumn("l", F.lower("left_name"))
    ours = lefts.select(F.col("l").alias("s")).distinct()
    theirs = (
        right.select(F.col(right_name).alias("right_name"))
        .filter("right_name is not null")
        .groupBy(F.lower("right_name").alias("s"))
        .agg(F.min("right_name").alias("right_name"))
    )
    pairs = _shared_words(ours, theirs.select("s"), threshold)
    if threshold <= CONTAINED:
        inner_ours = _contained(ours, theirs.select("s")).select(F.col("inner").alias("l"), F.col("outer").alias("r"))
        inner_theirs = _contained(theirs.select("s"), ours).select(F.col("outer").alias("l"), F.col("inner").alias("r"))
        pairs = pairs.unionByName(inner_ours).unionByName(inner_theirs)
    else:
        pairs = pairs.unionByName(ours.join(theirs.select("s"), "s").select(F.col("s").alias("l"), F.col("s").alias("r")))
    scored = pairs.withColumn("score", _score(F.col("l"), F.col("r"))).filter(F.col("score") >= threshold)
    named = scored.join(theirs.withColumnRenamed("s", "r"), "r")
    best = named.groupBy("l").agg(F.min(F.struct((-F.col("score")).alias("rank"), "right_name")).alias("best"))
    short = _short_inside(ours, theirs) if threshold <= CONTAINED else None
    if short is not None:
        best = best.unionByName(short).groupBy("l").agg(F.min("best").alias("best"))
    return lefts.join(best, "l").select("left_name", F.col("best.right_name"), (-F.col("best.rank")).alias("score"))


def _words(name: Column) -> Column:
    return F.array_distinct(F.split(name, r"[_\s]+"))


def _score(l: Column, r: Column) -> Column:
    common = F.size(F.array_intersect(_words(l), _words(r)))
    either = F.size(F.array_union(_words(l), _words(r)))
    return F.when(l == r, 1.0).when(F.contains(l, r) | F.contains(r, l), CONTAINED).otherwise(common / either)


def _pieces(name: Column, width: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - width + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(width))))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """``inner, outer`` pairs of names of at least three letters that lie within the other.

    Each inner name is looked up by the one of its pieces that the fewest outer names have.
    """
    held = outer.filter(F.length("s") >= GRAM).select(
        F.col("s").alias("outer"), F.explode(_pieces(F.col("s"), GRAM)).alias("piece")
    )
    rarity = held.groupBy("piece").agg(F.count(F.lit(1)).alias("names"))
    probes = (
        inner.filter(F.length("s") >= GRAM)
        .select(F.col("s").alias("inner"), F.explode(_pieces(F.col("s"), GRAM)).alias("piece"))
        .join(rarity, "piece")
        .groupBy("inner")
        .agg(F.min(F.struct("names", "piece")).alias("rarest"))
        .select("inner", F.col("rarest.piece"))
    )
    return probes.join(held, "piece").filter(F.contains("outer", "inner")).select("inner", "outer")


def _short_inside(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Best containment for names of one or two letters, on either side.

    A short left name can lie within very many right names; only the first of them is needed, so
    pieces are reduced to it before the names meet.
    """
    hit = F.lit(-CONTAINED)

    def short_pieces(names: DataFrame, *keep: str) -> DataFrame:
        both = F.array_union(_pieces(F.col("s"), 1), _pieces(F.col("s"), 2))
        return names.select(*keep, F.explode(both).alias("piece"))

    first = short_pieces(theirs, "right_name").groupBy("piece").agg(F.min("right_name").alias("right_name"))
    ours_short = ours.filter(F.length("s") < GRAM).join(first, ours["s"] == first["piece"])
    theirs_short = short_pieces(ours, "s").join(
        theirs.filter(F.length("s") < GRAM).select(F.col("s").alias("piece"), "right_name"), "piece"
    )
    found = ours_short.select("s", "right_name").unionByName(theirs_short.select("s", "right_name"))
    return found.groupBy(F.col("s").alias("l")).agg(F.min(F.struct(hit.alias("rank"), "right_name")).alias("best"))


def _shared_words(ours: DataFrame, theirs: DataFrame, threshold: float) -> DataFrame:
    """``l, r`` pairs that share one of the rare words a pair at the threshold must have in common.

    A pair with word share t has at least t * n words of an n-word name in common. With words ordered
    from rare to frequent it therefore shares one among the first n - ceil(t * n) + 1 of each name.
    """
    words = ours.union(theirs).select(F.explode(_words(F.col("s"))).alias("word"))
    rarity = words.groupBy("word").agg(F.count(F.lit(1)).alias("names"))

    def prefixes(names: DataFrame, as_name: str) -> DataFrame:
        each = names.select(F.col("s").alias(as_name), F.explode(_words(F.col("s"))).alias("word")).join(rarity, "word")
        ranked = each.groupBy(as_name).agg(F.sort_array(F.collect_list(F.struct("names", "word"))).alias("ranked"))
        n = F.size("ranked")
        first = n - F.ceil(n * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1
        return ranked.select(as_name, F.explode(F.slice(F.col("ranked.word"), F.lit(1), first)).alias("word"))

    return prefixes(ours, "l").join(prefixes(theirs, "r"), "word").select("l", "r").distinct()
