"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import ann, bpe, compact_windows, jaccard_forest, langid, mixing, quality, suffix_dedup, url_rules, vector_dedup
from textloom.llm.common import cut, table
from textloom.llm.oracles import ORACLES

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_forest.join(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = cut(compact_windows.remove_passages(table(spark, sf_dir, "documents")))
    named = compact_windows.classes(cleaned)
    removed = F.aggregate(F.arrays_zip("span_begins", "span_ends"), F.lit(0).cast("long"), lambda a, x: a + x["span_ends"] - x["span_begins"])
    return cleaned.join(named, F.col("doc_id") == F.col("node"), "left").select(
        "doc_id", F.coalesce("component", "doc_id").alias("class_id"), "n_words", removed.alias("n_removed"), F.size("span_begins").cast("long").alias("n_spans"), "sources", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate(F.arrays_zip("span_begins", "span_ends"), F.lit(0).cast("long"), lambda a, x: a + x["span_ends"] - x["span_begins"])
    return cleaned.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("span_begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_byte_bpe, op2_jaccard_join, op3_source_mix, op4_language_id, op5_url_rules, op6_passage_dedup, op7_vector_dedup, op8_quality, op9_nearest_neighbours, op10_suffix_dedup)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
