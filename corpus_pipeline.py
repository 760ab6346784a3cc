"""A corpus pipeline over ``documents``: each stage reads what the one before it wrote.

Language identification drops documents without a letter; the similarity join keeps one document of each
near-duplicate group; decontamination drops documents that repeat benchmark windows; secrets are masked in the text; packing
turns the rest into training sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gasflow.functions.sizing import scratch_folder
from gasflow.llm import decontaminate, language, neardup_texts, packing, secrets
from gasflow.llm.queries import remainder, table, tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that get a language, learned from the labelled ones; texts without letters go."""
    trees = language.fit(docs.filter(remainder(4) != 2))
    return language.recognised(language.identify(docs, trees)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group linked by a shingle similarity of 0.8 or more."""
    return neardup_texts.one_of_each(docs, neardup_texts.link_texts(docs)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more is benchmark text."""
    found = decontaminate.contamination(decontaminate.find_items(docs, table(spark, sf_dir, "benchmark")))
    return found.filter("not contaminated").select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets in the texts; ``n_chars`` stays that of the original."""
    return secrets.masked(secrets.find_secrets(docs)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the documents into sequences of power-of-two length."""
    return packing.piece_digest(packing.pack(docs, tokenizer_path("word_bpe_49k.json")))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]
#: The stages are not all expressible in SQL; tests compare the pipeline with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
