"""The stages of a corpus from end to end: harvest, normalize, dedupe, embed, georef, as functions of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import html as H
from textloom.functions import text as X
from textloom.functions import times as D
from textloom.functions import urls as U
from textloom.operators import corpus as C
from textloom.operators import dedupe as DD
from textloom.operators import places as P
from textloom.sources.files import with_html

OUTCOMES = ["kept", "skipped_status", "skipped_mimetype", "skipped_dup_digest", "skipped_dup_url"]


def harvest(found: DataFrame, max_captures_per_page: int = 1, phases: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(captures that stay, counters a phase) of the capture index of a collection: all phases in one pass.

    ``found`` has collection_id, seed_id, seed_url and the columns of files.cdx(), and ``ordinal``, the order of arrival.
    """
    t = D.captured_at(F.col("timestamp"))
    page = F.coalesce(F.nullif(U.canonical_url(F.col("url")), F.lit("")), F.col("url"))
    c = found.withColumns({"phase": D.phase_of(t.cast("date")), "page": page}).filter("phase is not null")
    if phases is not None:
        c = c.filter(F.col("phase").isin(phases))
    told = C.retain_captures(c, max_captures_per_page)
    return told.filter("outcome = 'kept'").drop("outcome"), C.outcome_counts(told, ["phase"], "outcome", OUTCOMES)


def normalize(captures: DataFrame, cache: DataFrame, captures_per_url: int = 1, phases: list[str] | None = None, old: DataFrame | None = None) -> DataFrame:
    """Documents of the earliest captures of each page and phase: extracted, dated, counted, with their outcome.

    With ``phases`` only captures of those are worked on, and the ``old`` documents of other phases stay.
    """
    t = D.captured_at(F.col("timestamp"))
    label = F.col("phase")
    c = captures.withColumns({"capture_phase": D.selected_phase(t, F.lit(None).cast("string"), label), "page": U.canonical_url(F.col("url"))})
    if phases is not None:
        c = c.filter(F.col("capture_phase").isin(phases))
    c = c.withColumn("seed_name", F.col("seed_id").cast("string"))
    c = C.earliest_per(c, ["page", "capture_phase"], ["timestamp", "url", "seed_name"], captures_per_url).drop("seed_name")
    hit, miss = with_html(c, cache)
    e = hit.withColumn("e", H.extract(F.col("html")))
    docs = e.select(*c.columns, F.col("e.title").alias("title"), F.col("e.text").alias("text"), F.col("e.mode").alias("extraction_mode"), F.when(F.col("e.text").isNull(), "extract_failed").otherwise("ok").alias("fetch_status"))
    lost = miss.select(*c.columns, *[F.lit(None).cast("string").alias(n) for n in ("title", "text", "extraction_mode")], F.lit("fetch_failed").alias("fetch_status"))
    docs = docs.unionByName(lost)
    t = D.captured_at(F.col("timestamp"))
    none = F.lit(None).cast("timestamp")
    docs = docs.withColumns(D.assigned(none, t, F.col("capture_phase"), F.col("phase"))).withColumns({
        "capture_url": F.col("url"), "capture_timestamp": F.col("timestamp"), "capture_date": t.cast("date"), "publish_date": F.lit(None).cast("date"),
        "language": X.detect_language(F.col("text")), "word_count": F.coalesce(X.word_count(F.col("text")), F.lit(0)), "char_count": F.coalesce(F.char_length("text"), F.lit(0)),
    })
    return docs if old is None else C.overwrite_windows(old, docs, "capture_phase", phases or [])


def dedupe(docs: DataFrame, threshold: float = 0.9, max_docs: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents that stay, audit of all, counters); ``docs`` has a column origin."""
    docs = C.first_rows(docs, "collection_id", "origin", max_docs)
    records = DD.cut(DD.audit(docs, "origin", threshold))
    return DD.deduplicated(docs, records), records, DD.stats(records, threshold)


def embed(docs: DataFrame, words_each: int = 128, dims: int = 64, batch: int = 256, namespace: str = "corpus") -> DataFrame:
    """Chunks of fetched documents with stable ids and vectors, each id once; texts that a store does not take are left out."""
    own = C.comparable(docs).withColumn("c", F.explode(X.sentence_chunks(F.col("text"), words_each)))
    own = C.small_enough(own.withColumn("chunk_text", F.col("c.text")), "chunk_text")
    t = D.event_time(F.col("publish_date"), F.col("capture_date"))
    month = D.observation_month(t, F.lit(None).cast("string"))
    made = U.chunk_id(F.lit(namespace), F.col("collection_id"), F.col("capture_url"), month, F.col("language"), X.content_hash(F.col("chunk_text")), DD.VERSION)
    chunks = own.select(
        made.alias("point_id"), "collection_id", "capture_url", "seed_url", "language", F.date_format(t, "yyyy-MM-dd").alias("event_date"), F.col("c.begin").alias("begin"), F.col("c.end").alias("end"),
        F.col("c.token_count").alias("token_count"), F.col("chunk_text").alias("text"), F.lit(DD.VERSION).alias("dedupe_version"),
    )
    return chunks.dropDuplicates(["point_id"]).withColumn("v", X.encode(F.col("text"), dims))


def georef(docs: DataFrame, places: DataFrame, countries: DataFrame, article: str = "origin", language: str = "en") -> DataFrame:
    """Articles of the language with the places they name, their centroid, its dispersion and the entropy of countries."""
    own = C.comparable(docs).filter(F.lower("language") == language)
    known = P.with_capitals(places, countries)
    names = known.select("name").unionByName(known.select(F.explode("alternates").alias("name"))).distinct()
    found = P.mentions(own.select(article, "text"), names, article)
    resolved = P.resolve(found.withColumn("order", F.col("start_char")), known, P.country_names(countries))
    per = DD.cut(P.collapse(resolved, article, "order"))
    out = own.select(article, "event_date", "phase").join(P.nested(per, article), article, "left")
    for part in (P.centroids(per, article), P.country_entropy(per, article)):
        out = out.join(part, article, "left")
    return out
