"""Publication of collections: written beside, checked, then put in place; what was there before is backed up."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import dedupe as DD
from textloom.operators.corpus import collection_order, collection_summary
from textloom.sources.files import DOCUMENTS, collection_files, legacy_files, list_files


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """``source`` in the place of ``target``: what is there goes only when the new one is complete beside it."""
    fs, a = _fs(spark, source)
    b = _fs(spark, target)[1]
    fs.mkdirs(b.getParent())
    old = _fs(spark, f"{target}.old")[1]
    fs.delete(old, True)
    if fs.exists(b):
        fs.rename(b, old)
    if not fs.rename(a, b):
        fs.rename(old, b)
        raise RuntimeError(f"{target} was not put in place")
    fs.delete(old, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, f"{path}.new")
    out = fs.create(p, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    move(spark, f"{path}.new", path)


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.option("wholetext", "true").text(path).collect())  # one small file


def write_records(rows: DataFrame, path: str) -> None:
    """JSON lines, complete or not at all; the rows keep their order over the part files."""
    remove(rows.sparkSession, f"{path}.new")
    rows.write.option("ignoreNullFields", "false").json(f"{path}.new")
    move(rows.sparkSession, f"{path}.new", path)


def backup(spark: SparkSession, folder: str, now: datetime | None = None) -> str | None:
    """A copy of a folder that is not empty, beside its parent, under the time; None if there is nothing to copy."""
    if not list_files(spark, folder):
        return None
    parent, _, name = folder.rstrip("/").rpartition("/")
    grand, _, kind = parent.rpartition("/")
    target = f"{grand}/collection_backups/{kind}/{name}/{(now or datetime.now(UTC)).strftime('%Y%m%dT%H%M%S%fZ')}"
    fs, a = _fs(spark, folder)
    b = _fs(spark, target)[1]
    fs.mkdirs(b.getParent())
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, fs, b, False, spark.sparkContext._jsc.hadoopConfiguration())
    return target


def retire_legacy(spark: SparkSession, folder: str) -> None:
    for p in legacy_files(spark, folder):
        for path in (p, f"{p}.progress", f"{p}.progress.json"):
            remove(spark, path)
    remove(spark, f"{folder.rstrip('/')}/phase_summary.json")


def publish(rows: DataFrame, folder: str, phases: list[str]) -> dict:
    """One collection's documents, sorted by date, with a summary beside them; several collections are refused.

    ``rows`` has event_time, capture_time, assigned_phase and date_source beside the columns of a document.
    """
    spark = rows.sparkSession
    if rows.select("collection_id").distinct().limit(2).count() > 1:
        raise ValueError("one collection at a time")
    counts = {(r["measure"], r["name"]): r["n"] for r in collection_summary(rows, phases).collect()}  # a row a phase
    summary = {"documents": counts["corpus", "documents"], "moved": counts["corpus", "moved"], "event_time_policy": "valid publish_date, otherwise capture_timestamp; UTC",
               "date_sources": {n: k for (m, n), k in counts.items() if m == "date_source"}, "counts": {p: counts["phase", p] for p in phases}}
    if kept := backup(spark, folder):
        summary["backup"] = kept
    write_records(collection_order(rows), f"{folder.rstrip('/')}/{DOCUMENTS}")
    write_text(spark, f"{folder.rstrip('/')}/collection_summary.json", json.dumps(summary, indent=2))
    retire_legacy(spark, folder)
    return summary


def publish_deduplicated(docs: DataFrame, folder: str, threshold: float = 0.9) -> dict:
    """The documents that dedup keeps, the audit of all, and a summary; inputs are not touched."""
    spark = docs.sparkSession
    records = DD.cut(DD.audit(docs, "origin", threshold))
    summary = DD.stats(records, threshold).first().asDict()
    staged = f"{folder.rstrip('/')}.staged"
    remove(spark, staged)
    DD.deduplicated(docs, records).drop("origin").write.json(f"{staged}/{DOCUMENTS}")
    records.write.json(f"{staged}/audit/duplicates.jsonl")
    if kept := backup(spark, folder):
        summary["backup"] = kept
    write_text(spark, f"{staged}/dedupe_summary.json", json.dumps(summary, indent=2))
    move(spark, staged, folder)
    return summary


def fingerprint(spark: SparkSession, paths: list[str]) -> dict:
    """Number of records and a digest of them in their order, whatever their white space and the order of their keys.

    Lines are digested where they lie; digests are folded in runs of a file's lines, so no task holds a file.
    """
    if not paths:
        return {"records": 0, "sha256": None}
    lines = spark.read.text(paths).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).filter(F.trim("value") != "")
    canonical = F.to_json(F.transform(F.array_sort(F.map_entries(F.from_json("value", "map<string,string>"))), lambda e: F.struct(e["key"], e["value"])))
    bad = lines.filter(F.get_json_object("value", "$").isNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))).limit(1).count()
    if bad:
        raise ValueError("a line is no JSON object")
    digest = lines.select("file", "at", F.sha2(canonical, 256).alias("h"))
    run = digest.withColumn("run", F.floor(F.row_number().over(Window.partitionBy("file", F.shiftright("at", 33)).orderBy("at")) / 4096))
    folded = run.groupBy("file", F.shiftright("at", 33).alias("part"), "run").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256).alias("h"))  # 4096 lines
    rows = folded.orderBy("file", "part", "run").select("n", "h").collect()
    return {"records": sum(r["n"] for r in rows), "sha256": hashlib.sha256("".join(r["h"] for r in rows).encode()).hexdigest()}


def same_records(spark: SparkSession, a: list[str], b: list[str]) -> bool:
    """Whether both have the same records, each as often; order and white space do not count."""
    rows = lambda paths: spark.read.text(paths).filter(F.trim("value") != "").select(F.to_json(F.array_sort(F.map_entries(F.from_json("value", "map<string,string>")))).alias("r"))
    n = rows(a).groupBy("r").agg(F.count("*").alias("n")).join(rows(b).groupBy(F.col("r").alias("q")).agg(F.count("*").alias("m")), F.col("r") == F.col("q"), "full")
    return n.filter(~F.col("n").eqNullSafe(F.col("m"))).isEmpty()


def migrate(spark: SparkSession, folder: str, name: str = DOCUMENTS) -> dict:
    """Files of phases become one collection, verified before they go; refused if a collection says otherwise."""
    sources, target = legacy_files(spark, folder), f"{folder.rstrip('/')}/{name}"
    if not sources:
        return {"status": "unchanged", "records": collection_files(spark, folder, name) and spark.read.text(target).filter(F.trim("value") != "").count() or 0}
    if exists(spark, target) and not same_records(spark, sources, [target]):
        raise ValueError(f"{folder} has a collection and files of phases that differ; neither is discarded")
    kept = backup(spark, folder)
    if not exists(spark, target):
        remove(spark, f"{target}.new")
        spark.read.text(sources).filter(F.trim("value") != "").write.text(f"{target}.new")
        move(spark, f"{target}.new", target)
    if not same_records(spark, sources, [target]):
        raise ValueError(f"{target} could not be verified; the files of phases stay")
    n = spark.read.text(target).count()
    write_text(spark, f"{folder.rstrip('/')}/collection_migration.json", json.dumps({"status": "migrated", "sources": [p.rpartition("/")[2] for p in sources], "backup": kept, "records": n}, indent=2))
    retire_legacy(spark, folder)
    return {"status": "migrated", "records": n, "backup": kept}
