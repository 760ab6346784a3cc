"""Licence scans: a trained paragraph classifier over word n-grams, confirmed by comparison with templates.

Training paragraphs are the templates below, whole and in pieces, and for the class ``unknown`` a bounded sample of the
corpus. A sparse multinomial logistic regression over one- and two-word grams predicts a family; a second, one-dimensional
regression calibrates the probability that a paragraph is a licence at all; a prediction counts as confirmed when enough of its
word triples are those of a template of the family. All work is done by DataFrame functions and Spark's own learners.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gasflow.functions.sizing import materialize

UNKNOWN = "unknown"
#: At most about this many paragraphs of the corpus teach the class ``unknown``.
UNKNOWN_SAMPLE = 4000
VOCABULARY = 1 << 14
LEAST_PROBABILITY = 0.5
CONFIRMED = 0.6

# fixed values: wording of public licence notices
TEMPLATES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See the LICENSE file in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "all-rights-reserved": [
        "Copyright. All rights reserved.",
        "All rights reserved. No part of this publication may be reproduced, distributed or transmitted without the prior written permission of the publisher.",
    ],
}
FAMILIES = [UNKNOWN, *TEMPLATES]
WORD = r"[a-z0-9]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def grams(words: Column, n: int) -> Column:
    """Each run of ``n`` words as one string, in time linear in the words."""
    out = words
    for k in range(2, n + 1):
        # beyond the last run one side is null, and so is what it makes
        out = F.zip_with(out, F.slice(words, k, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(out)


def features(words: Column) -> Column:
    return F.array_distinct(F.concat(words, grams(words, 2)))


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per paragraph (line with other than white space): adds ``paragraph_no`` from 0 and ``paragraph``."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("paragraph_no"), x.alias("paragraph")))
    kept = [c for c in docs.columns if c not in (text, "paragraph_no", "paragraph")]
    return docs.select(*kept, F.explode(lines).alias("_p")).select(*kept, "_p.*").filter(F.trim("paragraph") != "")


def _labelled(spark: SparkSession) -> DataFrame:
    """Templates whole, without either end, and halved: ``label, words``."""
    rows = [(float(FAMILIES.index(f)), t) for f, ts in TEMPLATES.items() for t in ts]
    whole = spark.createDataFrame(rows, "label double, text string").select("label", words_of(F.col("text")).alias("words"))
    half = F.ceil(F.size("words") / 2).cast("int")
    cut = [F.col("words"), F.slice("words", 1, half + 1), F.slice("words", 2, F.size("words")), F.slice("words", 1, F.size("words") - 1)]
    return whole.select("label", F.explode(F.array(*cut)).alias("words")).filter(F.size("words") >= 3)


class LicenseModel:
    """The fitted vocabulary, both regressions, and what each gram can add to a family."""

    def __init__(self, vocabulary: CountVectorizerModel, family: LogisticRegressionModel, known: LogisticRegressionModel):
        self.vocabulary, self.family = vocabulary, family
        self.grams = list(vocabulary.vocabulary)  # each look at the property fetches all of it from the JVM
        self.slope, self.offset = float(known.coefficients[0]), float(known.intercept)
        matrix, start = family.coefficientMatrix.toArray(), family.interceptVector.toArray()
        self.gains = np.maximum(matrix[1:] - matrix[0], 0).T  # what a gram can add to each family over unknown
        self.start = start[1:] - start[0]

    def anchors(self, least: float) -> list[str] | None:
        """Words of which a paragraph must have one to reach the probability ``least``; None if it needs none.

        Grams of little gain are left out as long as all of them together, each counted once as in the features,
        leave every family short. Of each other gram the rarer word stands for it.
        """
        need = (np.log(least / (1 - least)) - self.offset) / self.slope
        if self.slope <= 0 or (self.start >= need).any():
            return None
        order = np.argsort(self.gains.max(axis=1))
        weak = (np.cumsum(self.gains[order], axis=0) + self.start < need).all(axis=1)
        grams = [self.grams[i] for i in order[~weak]]
        place = {g: i for i, g in enumerate(self.grams)}  # the most frequent come first
        return sorted({max(g.split(" "), key=lambda w: place.get(w, len(place))) for g in grams})


def train(docs: DataFrame, text: str = "text", sample: int = UNKNOWN_SAMPLE) -> LicenseModel:
    """Fit on the templates and a bounded sample of distinct paragraphs of the corpus that name no licence.

    The sample is chosen by a hash of the paragraph, about ``sample`` of them whatever the size of the corpus.
    """
    spark = docs.sparkSession
    markers = r"(?i)licen[sc]e|copyright|creative commons|public domain|rights reserved|redistribut|permission"
    plain = paragraphs(docs.select(text), text).select("paragraph", F.xxhash64("paragraph").alias("h"))
    total = plain.count()
    share = min(1.0, sample / total) if total else 0.0
    chosen = plain.filter(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))).filter(~F.col("paragraph").rlike(markers)).select("paragraph").distinct()
    negative = chosen.select(F.lit(0.0).alias("label"), words_of(F.col("paragraph")).alias("words")).filter(F.size("words") > 0)
    # a class with no example at all would have no weight
    fallback = spark.createDataFrame([(0.0, ["the", "of", "and"])], "label double, words array<string>")
    # a few thousand rows at most: two tasks keep the rounds of the learners short
    rows = materialize(_labelled(spark).unionByName(negative).unionByName(fallback).withColumn("grams", features(F.col("words"))).coalesce(2))
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True).fit(rows)
    sizes = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    weight = F.create_map(*(F.lit(x) for label, n in sizes.items() for x in (label, 1.0 / n)))[F.col("label")]
    ready = vocabulary.transform(rows).withColumn("weight", weight * F.lit(float(sum(sizes.values()) / len(sizes))))
    learner = LogisticRegression(family="multinomial", elasticNetParam=0.5, regParam=0.002, maxIter=60, weightCol="weight", standardization=False)
    family = learner.fit(ready)
    evidence = family.transform(ready).select(
        (F.col("label") > 0).cast("double").alias("label"), "weight", F.array(_evidence(vector_to_array("rawPrediction"))).alias("x")
    )
    known = LogisticRegression(regParam=0.01, weightCol="weight").fit(evidence.select("label", "weight", array_to_vector("x").alias("features")))
    return LicenseModel(vocabulary, family, known)


def _evidence(raw: Column) -> Column:
    """Log odds of the best family against ``unknown``."""
    return F.array_max(F.slice(raw, 2, len(FAMILIES) - 1)) - raw[0]


def scan(docs: DataFrame, model: LicenseModel, text: str = "text", least: float = LEAST_PROBABILITY, confirmed: float = CONFIRMED) -> DataFrame:
    """One row per paragraph that is predicted to be a licence notice.

    Adds ``paragraph_no``, ``paragraph``, ``family``, ``probability`` (calibrated, that it is a licence), ``similarity`` (of word
    triples with the best template of the family: shared ones by those of the shorter side) and ``confirmed``. Paragraphs
    without a word that speaks for a family are not scored: they cannot win. Null and empty texts give no rows; repeated rows
    give theirs each; other columns are kept, those that bear the new names are replaced.
    """
    new = ("paragraph_no", "paragraph", "family", "probability", "similarity", "confirmed")
    kept = [c for c in docs.columns if c not in (text, *new)]
    # the learners add columns of their own, so those of the documents travel in one struct
    lines = paragraphs(docs.select(F.struct(F.lit(0).alias("_"), *kept).alias("_row"), text), text).withColumn("_words", words_of(F.col("paragraph")))
    anchors = model.anchors(least)
    if anchors is not None:
        lines = lines.filter(F.arrays_overlap("_words", F.array(*map(F.lit, anchors))) if anchors else F.lit(False))
    lines = lines.withColumn("grams", features(F.col("_words")))
    scored = model.family.transform(model.vocabulary.transform(lines)).withColumn("_raw", vector_to_array("rawPrediction"))
    best = F.slice("_raw", 2, len(FAMILIES) - 1)
    family = F.element_at(F.array(*map(F.lit, FAMILIES[1:])), F.array_position(best, F.array_max(best)).cast("int"))
    probability = 1 / (1 + F.exp(-(F.lit(model.slope) * _evidence(F.col("_raw")) + F.lit(model.offset))))
    found = scored.withColumns({"family": family, "probability": probability}).filter(F.col("probability") >= least)
    triples = F.array_distinct(grams(F.col("_words"), 3))
    similarity = F.lit(0.0)
    for name, templates in TEMPLATES.items():
        similarity = F.when(F.col("family") == name, F.greatest(*(_containment(F.col("_triples"), t) for t in [*templates, templates[0]]))).otherwise(similarity)
    found = found.withColumn("_triples", triples).withColumn("similarity", similarity)
    return found.withColumn("confirmed", F.col("similarity") >= confirmed).select(*(F.col("_row")[c].alias(c) for c in kept), *new)


def _containment(triples: Column, template: str) -> Column:
    words = re.findall(WORD, template.lower())
    own = sorted({" ".join(words[i : i + 3]) for i in range(len(words) - 2)})
    wanted = F.array(*map(F.lit, own))
    return F.coalesce(F.size(F.array_intersect(triples, wanted)) / F.nullif(F.least(F.size(triples), F.lit(len(own))), F.lit(0)), F.lit(0.0))
