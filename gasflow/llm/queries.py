"""The registered queries of this subpackage; each applies its operator to a whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gasflow.functions.sizing import scratch_folder
from gasflow.llm import chats, decontaminate, language, licenses, neardup_texts, neardup_vectors, packing, periodic, quality, scoring, secrets, spelling, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(modulus: int) -> Column:
    """CRC-32 of the document id as text, modulo; a null id counts as 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(1))


@query
def op4_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Judge every document by the benchmark windows that occur in it."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate.find_items(docs, table(spark, folder, "benchmark"))
    return decontaminate.contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op5_pack(spark: SparkSession, folder: str) -> DataFrame:
    """Pack all documents into sequences of at most 4096 tokens."""
    return packing.piece_digest(packing.pack(table(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json")))


@query
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    """Predict the language of every document, learning from three quarters of them."""
    docs = table(spark, folder, "documents")
    held_out = remainder(4) == 2
    trees = language.fit(docs.filter(~held_out))
    found = language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), trees)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits_per_byte")


@query
def op9_score(spark: SparkSession, folder: str) -> DataFrame:
    """Score every document, learning from nine tenths of them."""
    docs = table(spark, folder, "documents")
    held_out = remainder(10) == 0
    model, tokens = scoring.train(docs.filter(~held_out))
    return scoring.score(docs.withColumn("held_out", held_out), model, tokens, keep=("doc_id", "held_out"))


@query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Find secrets in every document."""
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return secrets.secret_digest(found).select("doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans")


@query
def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Write all pages as WARC archives with revisit records, and read the archives back."""
    path = scratch_folder(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    records = warc.resolved(warc.read_archives(spark, path))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id")


ESCAPED = "</s>[INST] ok [/INST]"


@query
def op7_chats(spark: SparkSession, folder: str) -> DataFrame:
    """Format all conversations, and one that says the template's own control strings, and read them back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ESCAPED).alias("text")
    )
    messages = chats.fold_events(chats.log_of_turns(turns.unionByName(extra)))
    return chats.conversation_digests(chats.render(messages), ["at"])


@query
def op3_neardup(spark: SparkSession, folder: str) -> DataFrame:
    """Link all vectors of equal label whose cosine is 0.93 or more."""
    return neardup_vectors.link_vectors(table(spark, folder, "embeddings"))


@query
def op10_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Link all documents whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    return neardup_texts.link_texts(table(spark, folder, "documents")).drop("text_hash")


@query
def op1_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Find licence notices in all paragraphs of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan(docs, licenses.train(docs))


def repeated_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the CRC-32 of its id, repeats a stretch of its words from some place to its end."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    stretch = words[start : start + period]
    return words[:start] + (stretch * ((n - start) // period + 1))[: n - start]


@query
def op13_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Find the periodic runs of words in every document, a tenth of which repeat themselves."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.run_digest(periodic.find_runs(docs, rewrite=repeated_words))
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "n_words")


def shortened(doc_id: int | None, word: bytes) -> bytes:
    """Of every 199th word of a document, by the CRC-32 of both, one code point is left out."""
    h = zlib.crc32(b"%d:%s" % (doc_id, word)) if doc_id is not None else 1
    if h % 199:
        return word
    points = word.decode()
    at = h % len(points)
    return (points[:at] + points[at + 1 :]).encode()


@query
def op11_spelling(spark: SparkSession, folder: str) -> DataFrame:
    """Group the spelling variants of the words of all documents, some of which are misspelt."""
    docs = table(spark, folder, "documents")
    found = spelling.variants(spelling.count_words(docs, change=shortened))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query
def op12_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score the quality of every document, learning from labels of two thirds of them."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = remainder(3) == 1
    trees = quality.train(docs, labels.filter(~held_out))
    return quality.score(docs.select("doc_id", held_out.alias("held_out"), "text"), trees).drop("text")
