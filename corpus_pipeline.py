"""Corpus cleaning in five stages, each over all that the one before kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns rows with the columns of ``documents``; the last returns the packed
sequences, one row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitebag.llm import secret_scan, toxicity
from sitebag.llm.jaccard import jaccard_components
from sitebag.llm.packing import pack_documents
from sitebag.llm.passages import repeated_passages, without_passages
from sitebag.llm.spark_help import arrow_rows, read, staged
from sitebag.llm.tokenizer_files import tokenizer_file


TEXT_ROWS = 1000  # of an Arrow batch: every stage maps over whole texts


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go. The chain learns from the labels of documents still here."""
    arrow_rows(spark, TEXT_ROWS)
    return toxicity.without_toxic(docs, toxicity.train_toxicity(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; rows that repeat it go too.

    A row without doc_id is nobody's copy and stays.
    """
    arrow_rows(spark, TEXT_ROWS)
    found = jaccard_components(docs)
    kept = staged(found.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct(), "kept")
    one = docs.where("doc_id is not null").join(kept, F.col("doc_id").cast("long") == F.col("_kept"), "left_semi")
    return one.dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has too are cut out; a document of which nothing is left goes."""
    arrow_rows(spark, TEXT_ROWS)
    return without_passages(docs, repeated_passages(docs))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; no document goes."""
    arrow_rows(spark, TEXT_ROWS)
    return secret_scan.masked(docs, secret_scan.thresholds(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, tokenized and packed into sequences of at most 2048 tokens."""
    arrow_rows(spark, TEXT_ROWS)
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"), 2048)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("secret_scans", mask_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # trained models, alignments and tokenizers are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; what a stage returns is written and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
