"""Stages from the command line: ``spark-submit -m textloom <stage> ...`` (or ``python -m textloom``)."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.functions.times import PHASES, assigned, event_time, parse_timestamp
from textloom.operators import semantics as S
from textloom.plans import stages
from textloom.plans.config import settings
from textloom.sinks import collections as K
from textloom.sinks import exports
from textloom.sources import files


def _documents(spark: SparkSession, folder: str):
    d = files.documents(spark, folder)
    p, c = parse_timestamp(F.col("publish_date")), parse_timestamp(F.col("capture_timestamp"), capture=True)
    return d.withColumns({"publish_date": p.cast("date"), "capture_date": c.cast("date"), "event_time": event_time(p, c), "capture_time": c, "origin": F.monotonically_increasing_id()}), p, c


def rephase(spark: SparkSession, a: argparse.Namespace) -> dict:
    d, p, c = _documents(spark, a.input)
    new = assigned(F.col("publish_date").cast("timestamp"), F.col("capture_time"), F.col("capture_phase"), F.col("phase"))
    d = d.withColumns({"assigned_phase": new["phase"], "date_source": new["event_date_source"]})
    return K.publish(d, a.output, [*[n for n, _, _ in PHASES], "outside_study", "undated"])


def dedupe(spark: SparkSession, a: argparse.Namespace) -> dict:
    s = settings("dedupe", **({"threshold": a.threshold} if a.threshold else {}), **({"max_docs": a.max_docs} if a.max_docs else {}))
    kept, audit, stats = stages.dedupe(_documents(spark, a.input)[0], s["threshold"], s["max_docs"])
    kept.write.mode("overwrite").parquet(f"{a.output}/documents")
    audit.write.mode("overwrite").json(f"{a.output}/audit")
    return stats.first().asDict()


def embed(spark: SparkSession, a: argparse.Namespace) -> dict:
    chunks = stages.embed(spark.read.parquet(a.input), **settings("embed"))
    exports.upsert(chunks, a.output)
    return {"chunks": spark.read.parquet(a.output).count()}


def georef(spark: SparkSession, a: argparse.Namespace) -> dict:
    places, states = files.gazetteer(spark, f"{a.gazetteer}/cities1000.txt"), files.countries(spark, f"{a.gazetteer}/countryInfo.txt")
    n = exports.append_unprocessed(spark.read.parquet(a.input), a.output, "origin", lambda todo: stages.georef(todo, places, states))
    return {"articles": n}


def analyze(spark: SparkSession, a: argparse.Namespace) -> dict:
    c = spark.read.parquet(a.input)
    month, phase = c.select("month").distinct(), c.select("phase").distinct()
    s = settings("semantic")
    exports.report(S.semantic_report(c, "month", "phase", month, phase, s["min_chunks"], s["min_reference"]), a.output, s)
    return s


def migrate(spark: SparkSession, a: argparse.Namespace) -> dict:
    return K.migrate(spark, a.input)


def status(spark: SparkSession, a: argparse.Namespace) -> dict:
    return K.fingerprint(spark, files.collection_files(spark, a.input))


STAGES = {f.__name__: f for f in (rephase, dedupe, embed, georef, analyze, migrate, status)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="textloom", description=__doc__)
    p.add_argument("stage", choices=sorted(STAGES))
    p.add_argument("input")
    p.add_argument("output", nargs="?")
    p.add_argument("--threshold", type=float)
    p.add_argument("--max-docs", type=int)
    p.add_argument("--gazetteer")
    a = p.parse_args(argv)
    if a.stage not in ("migrate", "status") and not a.output:
        p.error("this stage needs an output")
    told = STAGES[a.stage](spark or SparkSession.builder.appName(f"textloom {a.stage}").getOrCreate(), a)
    print(json.dumps(told, default=str))
    return told


if __name__ == "__main__":
    main()
