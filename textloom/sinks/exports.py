"""Exports: reports, vectors, topics, registries, resumable outputs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators.semantics import vector_faults
from textloom.sinks.collections import exists, move, remove, write_records, write_text


def report(tables: dict[str, DataFrame], folder: str, metadata: dict) -> None:
    """Each table as CSV with a header, and the metadata beside them."""
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}.csv"
        remove(df.sparkSession, f"{path}.new")
        df.write.option("header", "true").csv(f"{path}.new")
        move(df.sparkSession, f"{path}.new", path)
    write_text(df.sparkSession, f"{folder.rstrip('/')}/metadata.json", json.dumps(metadata, indent=2, default=str, ensure_ascii=False))


def vectors(points: DataFrame, path: str, expected: int, vector: str = "v") -> dict:
    """Points as Parquet if there are as many as expected, of one dimension, all finite and none zero; else nothing stays."""
    spark = points.sparkSession
    remove(spark, f"{path}.new")
    points.write.parquet(f"{path}.new")
    found = vector_faults(spark.read.parquet(f"{path}.new"), vector).first().asDict()
    wrong = [k for k in ("empty", "not_finite", "zero") if found[k]]
    if found["vectors"] != expected or (expected and found["dimensions"] != 1) or wrong:
        remove(spark, f"{path}.new")
        raise ValueError(f"expected {expected} vectors of one dimension: {found}")
    move(spark, f"{path}.new", path)
    return found


def upsert(points: DataFrame, path: str, key: str = "point_id") -> None:
    """The stored points with these in place of those that share a key; equal keys among the new ones: one of them."""
    spark = points.sparkSession
    new = points.dropDuplicates([key])
    if exists(spark, path):
        old = spark.read.parquet(path)
        new = old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)
    remove(spark, f"{path}.new")
    new.write.parquet(f"{path}.new")
    move(spark, f"{path}.new", path)


def evolution(tables: dict[str, DataFrame], folder: str, metadata: dict) -> None:
    """Nodes, edges, membership and coverage as JSON lines, term shares and centroids as Parquet, and the metadata."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        if any(t.startswith("array") for _, t in df.dtypes) or "term" in df.columns:
            df.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}.parquet")
        else:
            write_records(df, f"{folder.rstrip('/')}/{name}.jsonl")
    write_text(spark, f"{folder.rstrip('/')}/metadata.json", json.dumps(metadata, indent=2, default=str, ensure_ascii=False))


def registry(rows: DataFrame, path: str) -> None:
    """{tier: [domain, ...]}, sorted. A registry is a hand-kept list; it is written from one place."""
    tiers = rows.groupBy("tier").agg(F.array_sort(F.collect_set("domain")).alias("domains")).orderBy("tier").collect()
    write_text(rows.sparkSession, path, json.dumps({r["tier"]: r["domains"] for r in tiers}, indent=2, ensure_ascii=False))


def append_unprocessed(docs: DataFrame, path: str, key: str, work) -> int:
    """Works on the documents that the output does not have yet and adds their rows to it; the number of documents."""
    spark = docs.sparkSession
    todo = docs if not exists(spark, path) else docs.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    work(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def inventory(rows: DataFrame, columns: list[str], lists: list[str] = ()) -> DataFrame:
    """(measure, field, value, n): number of records, entries of list columns, and the commonest values of others."""
    from textloom.operators.corpus import category_counts

    sums = rows.agg(F.count("*").alias("n"), *[F.sum(F.coalesce(F.greatest(F.size(c), F.lit(0)), F.lit(0))).alias(f"l_{c}") for c in lists])
    flat = F.array(F.struct(F.lit("records").alias("measure"), F.lit(None).cast("string").alias("field"), F.col("n").alias("n")), *[F.struct(F.lit("entries").alias("measure"), F.lit(c).alias("field"), F.coalesce(f"l_{c}", F.lit(0)).cast("long").alias("n")) for c in lists])
    out = sums.select(F.explode(flat).alias("x")).select("x.measure", "x.field", F.lit(None).cast("string").alias("value"), "x.n")
    if not columns:
        return out
    return out.unionByName(category_counts(rows, columns).select(F.lit("value").alias("measure"), "field", "value", "n"))
