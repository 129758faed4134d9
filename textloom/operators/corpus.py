"""Captures, tiers, counts and exact dedup: relational operators of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import content_hash, is_html
from textloom.functions.urls import domain_chain

#: Of the tiers that any parent domain is in, the first of these holds, whatever the domain's length.
PRIORITY = ("authoritative", "low", "mixed")


def with_tier(rows: DataFrame, host: str, registry: DataFrame, fallback: Column | None = None) -> DataFrame:
    """``tier`` of each row by its host's parent domains; ``unknown`` (or the fallback) if none is registered.

    Hosts are looked up once each; the registry's size decides how Spark joins it.
    """
    hosts = rows.select(F.col(host).alias("tier_host")).distinct()
    rank = F.element_at(F.map_from_arrays(F.array(*map(F.lit, PRIORITY)), F.array(*[F.lit(i) for i in range(len(PRIORITY))])), F.col("tier"))
    found = hosts.select("tier_host", F.explode(domain_chain(F.col("tier_host"))).alias("domain")).join(registry, "domain").groupBy("tier_host").agg(F.min(rank).alias("rank"))
    out = rows.join(found, F.col(host) == F.col("tier_host"), "left").drop("tier_host")
    tier = F.get(F.array(*map(F.lit, PRIORITY)), F.col("rank"))
    return out.withColumn("tier", F.coalesce(tier, *([fallback] if fallback is not None else []), F.lit("unknown"))).drop("rank")


def retain_captures(captures: DataFrame, per_page: int) -> DataFrame:
    """``outcome`` of every capture: kept, or why not, in arrival order within phase and page.

    A digest that was kept before is a duplicate; null digests never are; the page's budget comes last
    (0: no budget).
    """
    ok = captures.withColumn("valid", F.when(~F.startswith(F.coalesce("status", F.lit("")), F.lit("2")), "skipped_status").when(~is_html(F.col("mimetype")), "skipped_mimetype"))
    same = Window.partitionBy("phase", "page", "digest", F.col("valid").isNull()).orderBy("ordinal")
    ok = ok.withColumn("candidate", F.col("valid").isNull() & (F.col("digest").isNull() | (F.row_number().over(same) == 1)))
    running = Window.partitionBy("phase", "page").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok = ok.withColumn("place", F.sum(F.col("candidate").cast("long")).over(running))
    kept = F.col("candidate") & (F.lit(per_page == 0) | (F.col("place") <= per_page))
    ok = ok.withColumn("kept_digest", F.max(kept.cast("int")).over(same.rowsBetween(Window.unboundedPreceding, -1)))
    outcome = F.coalesce("valid", F.when(kept, "kept").when(F.col("digest").isNotNull() & (F.col("kept_digest") == 1), "skipped_dup_digest").otherwise("skipped_dup_url"))
    return ok.withColumn("outcome", outcome).drop("valid", "candidate", "place", "kept_digest")


def earliest_per(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each key in the order given."""
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= n).drop("rn")


def exact_duplicates(docs: DataFrame, scope: list[str]) -> DataFrame:
    """``representative`` of every document with equal normalized text in its scope: the smallest id."""
    h = docs.withColumn("content_hash", content_hash(F.col("text")))
    return h.withColumn("representative", F.min("doc_id").over(Window.partitionBy(*scope, "content_hash")))


def value_shares(rows: DataFrame, column: str) -> DataFrame:
    """Counts of a column's values and their percentages."""
    n = rows.groupBy(column).agg(F.count("*").alias("n"))
    return n.select(column, "n", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("percent"))


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that were not processed yet."""
    return rows.join(done.select(key), key, "left_anti")


def overwrite_windows(old: DataFrame, new: DataFrame, column: str, windows: list[str]) -> DataFrame:
    """Old rows outside the windows and new rows of the windows."""
    return old.filter(~F.col(column).isin(windows)).unionByName(new.filter(F.col(column).isin(windows)))


def quality_gates(docs: DataFrame) -> DataFrame:
    """Counts that the run's gates test: failures among all, and texts."""
    ok = F.count_if(F.col("fetch_status") == "ok")
    return docs.agg(F.count("*").alias("total"), ok.alias("ok"), F.round((F.count("*") - ok) / F.count("*"), 6).alias("failed_fraction"))


def gate(passed: Column, message: str) -> Column:
    """True, or an error that ends the run."""
    return F.when(passed, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def checked(docs: DataFrame, least: int = 1, most_failed: float = 0.2) -> DataFrame:
    """The gates' counts if enough documents were fetched and too few failed; an error otherwise."""
    fits = (F.col("ok") >= least) & (F.coalesce("failed_fraction", F.lit(1.0)) <= most_failed)
    return quality_gates(docs).withColumn("passed", gate(fits, "too few documents were fetched, or too many failed"))


def seed_coverage(seeds: DataFrame, most_failed: float = 0.1) -> DataFrame:
    """Seeds visited and failed, and whether so many may fail (none visited may not): one row."""
    failed, visited = F.count_if(F.col("failed")), F.count_if(F.col("visited"))
    s = seeds.agg(visited.alias("visited"), failed.alias("failed"))
    return s.withColumn("passed", (F.col("visited") > 0) & (F.col("failed") <= most_failed * F.col("visited")))


def active_seeds(seeds: DataFrame, order: str, limit: int | None = None) -> DataFrame:
    """Active seeds with a url, the first ``limit`` of them in order."""
    if limit is not None and limit < 1:
        raise ValueError("limits are positive")
    out = seeds.filter(F.col("active") & (F.coalesce(F.trim("url"), F.lit("")) != ""))
    return out if limit is None else out.orderBy(order).limit(limit)


def comparable(docs: DataFrame) -> DataFrame:
    """Fetched documents with a text that is not blank."""
    return docs.filter((F.col("fetch_status") == "ok") & (F.length(F.trim("text")) > 0))


def small_enough(chunks: DataFrame, text: str = "text", most: int = 30 << 20) -> DataFrame:
    """Chunks whose text has fewer bytes than a store takes."""
    return chunks.filter(F.octet_length(text) < most)


def current(points: DataFrame, version: int = 2) -> DataFrame:
    """The points, if all were written by this version of dedup; an error otherwise."""
    return points.filter(gate(F.col("dedupe_version").eqNullSafe(F.lit(version)), f"points of another version than {version}"))


def first_rows(rows: DataFrame, group: str, ordinal: str, most: int | None) -> DataFrame:
    """The first rows of each collection in file order; all without a number."""
    if most is None:
        return rows
    if most < 1:
        raise ValueError("limits are positive")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(ordinal))).filter(F.col("place") <= most).drop("place")


def collection_order(rows: DataFrame) -> DataFrame:
    """Rows in the order of a published collection: event time, capture time (none last), url, digest."""
    url = F.coalesce("capture_url", "seed_url", F.lit(""))
    return rows.orderBy(F.asc_nulls_last("event_time"), F.asc_nulls_last("capture_time"), url, F.coalesce("digest", F.lit("")))


def collection_summary(before: DataFrame, phases: list[str], phase: str = "phase", assigned: str = "assigned_phase", source: str = "date_source") -> DataFrame:
    """(measure, name, n): documents, documents whose phase moved, documents of every phase (0 included) and date source."""
    spark = before.sparkSession
    spine = spark.createDataFrame([(p,) for p in phases], "name string")
    n = before.groupBy(F.col(assigned).alias("name")).agg(F.count("*").alias("n"))
    counts = spine.join(n, "name", "left").select(F.lit("phase").alias("measure"), "name", F.coalesce("n", F.lit(0)).alias("n"))
    sources = before.groupBy(F.coalesce(source, F.lit("undated")).alias("name")).agg(F.count("*").alias("n")).select(F.lit("date_source").alias("measure"), "name", "n")
    total = before.agg(F.count("*").alias("documents"), F.count_if(~F.col(phase).eqNullSafe(F.col(assigned))).alias("moved"))
    total = total.select(F.explode(F.array(F.struct(F.lit("documents").alias("name"), F.col("documents").alias("n")), F.struct(F.lit("moved").alias("name"), F.col("moved").alias("n")))).alias("x"))
    return counts.unionByName(sources).unionByName(total.select(F.lit("corpus").alias("measure"), "x.name", "x.n"))


def outcome_counts(rows: DataFrame, group: list[str], outcome: str, outcomes: list[str]) -> DataFrame:
    """A row a group with the number of rows of each outcome, 0 where there is none."""
    return rows.groupBy(*group).agg(F.count("*").alias("total"), *[F.count_if(F.col(outcome) == o).alias(o) for o in outcomes])


def build_registry(hosts: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(domain, tier) of distinct hosts; an authoritative host below another authoritative one is left out.

    ``hosts`` and ``extra`` have (domain, tier). A host that is authoritative, or below one that is, is in no other tier.
    """
    every = hosts.select("domain", "tier")
    every = every if extra is None else every.unionByName(extra.select("domain", "tier"))
    every = every.filter("domain is not null and domain <> ''").distinct()
    top = every.filter("tier = 'authoritative'").select(F.col("domain").alias("covers"))
    above = every.select("domain", "tier", F.explode(domain_chain(F.col("domain"))).alias("up")).filter((F.col("up") != F.col("domain")) | (F.col("tier") != "authoritative"))
    covered = above.join(top, F.col("up") == F.col("covers"), "left_semi").select("domain", "tier").distinct()
    return every.join(covered, ["domain", "tier"], "left_anti")


def category_counts(rows: DataFrame, columns: list[str], most: int = 20) -> DataFrame:
    """(field, value, n, rank): the most frequent values of each column."""
    flat = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").filter("value is not null")
    n = flat.groupBy("field", "value").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= most)


def backfilled(points: DataFrame, rows: DataFrame, key: str, column: str, order: str) -> DataFrame:
    """Points with the value of the last row of their key that has one, and whether their key was found."""
    last = rows.filter(F.col(column).isNotNull()).groupBy(F.col(key).alias("of")).agg(F.max_by(column, order).alias("value"))
    out = points.join(last, F.col(key) == F.col("of"), "left")
    return out.withColumns({column: F.coalesce("value", column), "matched": F.col("of").isNotNull()}).drop("of", "value")


def strangers(chunks: DataFrame, docs: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks whose identity no document has: empty if all is well."""
    return chunks.join(docs.select(*keys).distinct(), keys, "left_anti")


def first_points(shards: DataFrame, key: str = "point_id", order: tuple[str, ...] = ("shard", "row")) -> DataFrame:
    """Each point once, from the first shard that has it, and how many others were left out."""
    out = shards.groupBy(key).agg(F.min_by(F.struct(*shards.columns), F.struct(*order)).alias("x"), (F.count("*") - 1).alias("left_out"))
    return out.select("x.*", "left_out")


def date_coverage(rows: DataFrame, group: str, dated: str, ok: Column) -> DataFrame:
    """Rows of each group, those that were fetched, and those of either with a date."""
    has = F.col(dated).isNotNull()
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(has).alias("dated"), F.count_if(ok).alias("n_ok"), F.count_if(ok & has).alias("dated_ok"))


def cluster_counts(clustered: DataFrame, group: list[str]) -> DataFrame:
    """(group, n, n_clusters, singletons, largest, redundancy) of rows with their cluster."""
    per = clustered.groupBy(*group, "cluster").agg(F.count("*").alias("k"))
    return per.groupBy(*group).agg(F.sum("k").alias("n"), F.count("*").alias("n_clusters"), F.count_if(F.col("k") == 1).alias("singletons"), F.max("k").alias("largest"), F.round(1 - F.count("*") / F.sum("k"), 6).alias("redundancy"))


def history_estimate(runs: DataFrame, group: str, seconds: str) -> DataFrame:
    """Median duration of a group's runs, and the range of all."""
    return runs.groupBy(group).agg(F.median(seconds).alias("median"), F.min(seconds).alias("least"), F.max(seconds).alias("most"), F.count("*").alias("runs"))


def missing_languages(docs: DataFrame, detected: Column, column: str = "language") -> DataFrame:
    """Documents with the detected language where they have none."""
    return docs.withColumn(column, F.coalesce(column, detected))
