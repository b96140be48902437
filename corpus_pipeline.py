"""From documents to token ids: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoy.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from convoy.llm.queries import BATCH_ROWS, tokenizer_path
from convoy.llm.shared import materialize, settled, shuffles_dropped

#: The language model must prefer a language by so much; four equal ones would have a quarter each.
LEAST_SCORE = 0.3
NEAR = ngram_join.Likeness(words=5, least=80, per=100)
MIX = mixing.Mix(block_words=256)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the languages that the labels teach, go. Without labels none can be judged, and all stay."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    model = language_id.fit(docs)
    if not model.languages:
        return docs
    told = language_id.identify(docs, model, keep=tuple(docs.columns), names=("__convoy_lang", "__convoy_score"))
    return told.where((F.col("__convoy_lang") != "und") & (F.col("__convoy_score") >= LEAST_SCORE)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the smallest doc_id stays; rows without an id stay.

    The join's tables, some 1.5 times the documents, go before the next stage shuffles texts.
    """
    copies = lambda: ngram_join.jaccard_components(docs, NEAR).where("doc_id <> component_id").select("doc_id").distinct()
    with shuffles_dropped(spark):
        gone = settled(spark, "near_copies", copies)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents in the target proportions; one drawn twice comes twice."""
    return mixing.mixed_documents(docs, MIX)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, decoded_sha256 (of the ids decoded again)."""
    path = tokenizer_path("word_bpe_49k.json")
    both = bpe.round_trip(docs, path)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", keep_known_languages),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
