"""A training corpus from raw documents: filtering, dedup, mixing and tokenising, a stage at a time.

Each stage takes all rows that the one before it kept and is written as Parquet before the next one reads
it. All but the last return the columns of ``documents``; the last returns tokens. Null texts are rejected
by the first stage; an empty table stays empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, compact_windows, exchange, jaccard_forest, mixing, quality
from textloom.llm.common import checkpoint_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.filter_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest id."""
    return jaccard_forest.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; ``n_chars`` follows the text."""
    cleaned = compact_windows.clean_documents(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else cleaned


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated so that sources reach their targets."""
    return mixing.repeat_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, piece_offsets, decoded_sha256) of every document that the mix takes."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True)
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", "piece_offsets", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_different),
    ("substring dedup", cut_passages),
    ("mixing sources", mix_sources),
    ("byte-level BPE", tokenize),
]
#: Classifiers and hashes are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline_{uuid.uuid4().hex}"
    before = exchange.made()
    for i, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        exchange.release(spark, before)  # what the stage stored, and what the one before it wrote, is not read again
        if i:
            exchange.remove_folder(spark, f"{folder}/{i - 1}")
    return docs
