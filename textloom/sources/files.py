"""Tables from files: JSON lines of collections, gazetteers, registries, caches, vectors.

Folders are listed through Spark's file systems, so any store that Spark reads will do.
"""

from __future__ import annotations

import gzip
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.times import event_phase, event_time, parse_timestamp

DOCUMENTS, CAPTURES = "documents.jsonl", "captures.jsonl"
#: Names of files of one phase each, from before collections were one file: a fixed pattern.
LEGACY = re.compile(r"P\d+_.+|outside_study|undated")
CAPTURE = "collection_id long, seed_id string, seed_url string, url string, timestamp string, mimetype string, status string, digest string, length long, offset long, filename string, phase string"
DOCUMENT = (
    "collection_id long, seed_id string, seed_url string, capture_url string, capture_timestamp string, digest string, phase string, capture_phase string, title string, text string, language string, "
    "publish_date string, event_date string, event_date_source string, extraction_mode string, fetch_status string, word_count long, char_count long"
)


def list_files(spark: SparkSession, folder: str, pattern: str = "*") -> list[str]:
    """Paths of a folder's files that match, sorted; none if the folder is not there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    found = path.getFileSystem(conf).globStatus(path) or []
    return sorted(s.getPath().toString() for s in found)


def legacy_files(spark: SparkSession, folder: str) -> list[str]:
    return [p for p in list_files(spark, folder, "*.jsonl") if LEGACY.fullmatch(p.rpartition("/")[2].removesuffix(".jsonl"))]


def collection_files(spark: SparkSession, folder: str, name: str = DOCUMENTS) -> list[str]:
    """The collection's one file (or folder of part files), else those of its phases; never both."""
    return list_files(spark, folder, name) or legacy_files(spark, folder)


def _lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Records of JSON lines; a line that is not one ends the read. Blank lines do not count."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.json(paths) if paths else spark.createDataFrame([], schema)


def collection(spark: SparkSession, folder: str, schema: str, name: str = DOCUMENTS) -> DataFrame:
    return _lines(spark, collection_files(spark, folder, name), schema)


def captures(spark: SparkSession, folder: str) -> DataFrame:
    return collection(spark, folder, CAPTURE, CAPTURES)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return collection(spark, folder, DOCUMENT, DOCUMENTS)


def whole_corpus(spark: SparkSession, root: str) -> DataFrame:
    """Documents of all collections below ``root``, with their event time and phase anew."""
    d = _lines(spark, list_files(spark, root, f"*/{DOCUMENTS}"), DOCUMENT)
    p, c = parse_timestamp(F.col("publish_date")), parse_timestamp(F.col("capture_timestamp"), capture=True)
    return d.withColumns({"event_time": event_time(p, c), "phase": event_phase(p, c)})


def cdx(lines: DataFrame, line: str = "value") -> DataFrame:
    """Captures of the space-separated lines of a capture index; ``-`` is null, and numbers that are none are null."""
    p = F.split(F.trim(line), r"\s+")
    names = ("urlkey", "timestamp", "url", "mimetype", "status", "digest", "redirect", "meta", "length", "offset", "filename")
    field = lambda i: F.nullif(F.get(p, i), F.lit("-"))
    out = lines.filter(F.size(p) >= 7).select(*[field(i).alias(n) for i, n in enumerate(names)])
    return out.withColumns({"length": F.col("length").try_cast("long"), "offset": F.col("offset").try_cast("long")})


def in_dates(found: DataFrame, first: str | None, last: str | None, limit: int | None = None) -> DataFrame:
    """Captures between two timestamps (both included); the limit holds for what is left."""
    if first:
        found = found.filter(F.col("timestamp") >= first)
    if last:
        found = found.filter(F.col("timestamp") <= last)
    return found if limit is None else found.orderBy("timestamp", "url").limit(limit)


def html_cache(spark: SparkSession, root: str) -> DataFrame:
    """(collection_id, digest, html) of a cache of gzipped pages: <root>/<collection>/<digest>.html.gz."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.html.gz").option("recursiveFileLookup", "true").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "html": [gzip.decompress(x).decode("utf-8", "replace") for x in b["content"]]})

    at = F.regexp_extract("path", r"([^/]+)/([^/]+)\.html\.gz$", 1), F.regexp_extract("path", r"([^/]+)/([^/]+)\.html\.gz$", 2)
    return files.mapInPandas(run, "path string, html string").select(at[0].try_cast("long").alias("collection_id"), at[1].alias("digest"), "html")


def with_html(found: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captures with their cached page, captures to fetch)."""
    return found.join(cache, ["collection_id", "digest"]), found.join(cache, ["collection_id", "digest"], "left_anti")


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(place_id, name, alternates, country_code, population, lat, lon) of a gazetteer's tab-separated file.

    Lines of fewer than 19 fields, and those whose numbers are none, are left out.
    """
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(p) >= 19)
    alternates = F.filter(F.transform(F.split(F.get(p, 3), ","), F.trim), lambda x: F.length(x) >= 2)
    alternates = F.array_distinct(F.when(F.get(p, 2) != F.get(p, 1), F.concat(F.array(F.get(p, 2)), alternates)).otherwise(alternates))
    out = rows.select(
        F.get(p, 0).try_cast("long").alias("place_id"), F.get(p, 1).alias("name"), F.filter(alternates, lambda x: x != "").alias("alternates"), F.get(p, 8).alias("country_code"),
        F.coalesce(F.nullif(F.get(p, 14), F.lit("")), F.lit("0")).try_cast("long").alias("population"), F.get(p, 4).try_cast("double").alias("lat"), F.get(p, 5).try_cast("double").alias("lon"),
    )
    return out.dropna(subset=["place_id", "population", "lat", "lon"])


def countries(spark: SparkSession, path: str) -> DataFrame:
    """(country_code, country_name, capital) of a tab-separated file with comment lines; both names have to be there."""
    p = F.split("value", "\t")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit("#")) & (F.size(p) >= 6))
    return rows.select(F.get(p, 0).alias("country_code"), F.get(p, 4).alias("country_name"), F.get(p, 5).alias("capital")).filter("country_code <> '' and country_name <> ''")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(domain, tier) of a JSON object of lists: {tier: [domain, ...]}."""
    tiers = spark.read.schema("authoritative array<string>, low array<string>, mixed array<string>").option("multiLine", "true").json(path)
    flat = tiers.select(F.explode(F.create_map(*[x for t in tiers.columns for x in (F.lit(t), F.coalesce(t, F.array().cast("array<string>")))])).alias("tier", "domains"))
    return flat.select(F.explode("domains").alias("domain"), "tier")


def export(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of an export of topics: nodes, edges, membership, coverage or provenance."""
    return spark.read.json(f"{folder.rstrip('/')}/{name}.jsonl")


def vectors(spark: SparkSession, metadata: str, array: str, rows_each: int = 4096) -> DataFrame:
    """Rows of ``metadata`` (JSON lines, in order, with a column row) with vector ``v`` of a NumPy file of as many rows.

    The file is read as bytes by Spark's reader in tasks of ``rows_each`` rows, for files up to 2 GB.
    """
    head = spark.read.format("binaryFile").load(array).select("content", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io

        for b in batches:
            for content in b["content"]:
                m = np.load(io.BytesIO(content), allow_pickle=False)
                for i in range(0, len(m), rows_each):
                    yield pd.DataFrame({"row": np.arange(i, min(len(m), i + rows_each)), "v": list(m[i : i + rows_each].astype(np.float64))})

    return spark.read.json(metadata).join(head.mapInPandas(run, "row long, v array<double>"), "row")


def compose(parts: list[DataFrame]) -> DataFrame:
    """All collections' rows as one table, columns by name; what a part lacks is null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
