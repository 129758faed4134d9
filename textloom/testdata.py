"""The driver's tables as the canonical tables of a web-archive corpus, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tiers of the synthetic sources; what is in none of them falls back to its collection's tier.
TIERS = {"low": ["src0", "src1", "src2", "src3", "src4"], "authoritative": ["src5", "src6", "src7", "src8", "src9"], "mixed": ["src10", "src11", "src12", "src13", "src14"]}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, with derived dates, collection and outcome."""
    d = read(spark, sf_dir, "documents")
    day = lambda first, expr: F.expr(f"date_add(date '{first}', cast({expr} as int))")
    return d.select(
        "doc_id",
        "text",
        F.col("lang").alias("language"),
        F.concat("source", F.lit(".example.org")).alias("host"),
        "source",
        F.expr("case doc_id % 3 when 0 then 13559 when 1 then 13529 else 4887 end").alias("collection_id"),
        F.when(F.col("doc_id") % 5 != 0, day("2020-01-15", "doc_id * 37 % 1250")).alias("publish_date"),
        day("2020-02-01", "doc_id * 53 % 1180").alias("capture_date"),
        F.when(F.col("doc_id") % 23 == 0, "extract_failed").otherwise("ok").alias("fetch_status"),
        F.expr("date_format(coalesce(case when doc_id % 5 <> 0 then date_add(date '2020-01-15', cast(doc_id * 37 % 1250 as int)) end, date_add(date '2020-02-01', cast(doc_id * 53 % 1180 as int))), 'yyyy-MM')").alias("month"),
        F.concat(F.lit("https://"), "source", F.lit(".example.org/")).alias("seed_url"),
        F.concat(F.lit("https://www."), "source", F.lit(".example.org/item/"), (F.col("doc_id") % 7).cast("string")).alias("capture_url"),
        F.col("source").alias("seed_id"),
        F.lit(None).cast("string").alias("digest"),
        F.when(F.col("doc_id") % 4 == 0, "fallback").otherwise("article").alias("extraction_mode"),
    )


DOCUMENTS = """docs AS (
  SELECT doc_id, text, lang AS language, source || '.example.org' AS host, source,
    CASE doc_id % 3 WHEN 0 THEN 13559 WHEN 1 THEN 13529 ELSE 4887 END AS collection_id,
    CASE WHEN doc_id % 5 <> 0 THEN date '2020-01-15' + CAST(doc_id * 37 % 1250 AS INTEGER) END AS publish_date,
    date '2020-02-01' + CAST(doc_id * 53 % 1180 AS INTEGER) AS capture_date,
    CASE WHEN doc_id % 23 = 0 THEN 'extract_failed' ELSE 'ok' END AS fetch_status,
    strftime(coalesce(CASE WHEN doc_id % 5 <> 0 THEN date '2020-01-15' + CAST(doc_id * 37 % 1250 AS INTEGER) END, date '2020-02-01' + CAST(doc_id * 53 % 1180 AS INTEGER)), '%Y-%m') AS month,
    'https://www.' || source || '.example.org/item/' || (doc_id % 7) AS capture_url, CASE WHEN doc_id % 4 = 0 THEN 'fallback' ELSE 'article' END AS extraction_mode FROM documents)"""


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"{s}.example.org", t) for t, hosts in TIERS.items() for s in hosts], "domain string, tier string")


REGISTRY = "reg(domain, tier) AS (VALUES " + ", ".join(f"('{s}.example.org', '{t}')" for t, hosts in TIERS.items() for s in hosts) + ")"


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures in arrival order."""
    p = read(spark, sf_dir, "pages")
    return p.select(
        F.col("page_id").alias("ordinal"),
        F.regexp_replace("url", r"/\d+.*$", "/item").alias("page"),
        "url",
        F.when(F.col("page_id") % 11 == 0, F.lit(None)).otherwise(F.sha2(F.col("html"), 256)).alias("digest"),
        F.when(F.col("page_id") % 13 == 0, "404").otherwise("200").alias("status"),
        F.when(F.col("page_id") % 7 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("mimetype"),
        F.concat(F.lit("P"), (F.col("page_id") % 2 + 1).cast("string")).alias("phase"),
    )


CAPTURES = r"""caps AS (
  SELECT page_id AS ordinal, regexp_replace(url, '/\d+.*$', '/item') AS page, url,
    CASE WHEN page_id % 11 = 0 THEN NULL ELSE sha256(html) END AS digest, CASE WHEN page_id % 13 = 0 THEN '404' ELSE '200' END AS status,
    CASE WHEN page_id % 7 = 0 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS mimetype, 'P' || (page_id % 2 + 1) AS phase FROM pages)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks with month, tier, host and topic."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("point_id"),
        F.transform("embedding", lambda x: x.cast("double")).alias("v"),
        F.date_format(F.expr("add_months(date '2020-02-01', cast(vec_id % 12 as int))"), "yyyy-MM").alias("month"),
        F.expr("case vec_id % 3 when 0 then 'low' when 1 then 'authoritative' else 'mixed' end").alias("tier"),
        F.expr("case when vec_id % 12 < 10 then 'P1_global_onset' when vec_id % 12 = 10 then 'P2_pre_vaccine' else 'P3_vaccine_rollout' end").alias("phase"),
        F.concat(F.lit("host"), (F.col("vec_id") % 11).cast("string")).alias("host"),
        F.when(F.col("label") == 9, -1).otherwise(F.col("label")).alias("topic"),
    )


CHUNKS = """chunks AS (
  SELECT vec_id AS point_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v, strftime(date '2020-02-01' + to_months(CAST(vec_id % 12 AS INTEGER)), '%Y-%m') AS month,
    CASE WHEN vec_id % 12 < 10 THEN 'P1_global_onset' WHEN vec_id % 12 = 10 THEN 'P2_pre_vaccine' ELSE 'P3_vaccine_rollout' END AS phase,
    CASE vec_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'authoritative' ELSE 'mixed' END AS tier, 'host' || (vec_id % 11) AS host, CASE WHEN label = 9 THEN -1 ELSE label END AS topic FROM embeddings)"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a gazetteer with names that two places share."""
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg((F.count("*") * 1000).alias("population")), "n_nationkey", "left")
    at = ["cast(n_nationkey * 7 % 140 - 70 as double) as lat", "cast(n_nationkey * 29 % 340 - 170 as double) as lon"]
    one = n.selectExpr("n_nationkey as place_id", "n_name as name", "array('alt ' || n_nationkey % 10) as alternates", "'C' || n_nationkey as country_code", "coalesce(population, 0) as population", *at)
    two = n.filter("n_nationkey % 4 = 0").selectExpr("n_nationkey + 100 as place_id", "n_name as name", "array('other ' || n_nationkey) as alternates", "'C' || (n_nationkey + 1) % 25 as country_code", "cast(n_nationkey * 1000 as bigint) as population", *at)
    return one.unionByName(two)


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "nation").selectExpr("n_name as country_name", "'C' || n_nationkey as country_code")


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mentions, ten an article, some with a country around them."""
    return read(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as mention_id", "o_orderkey div 10 as article_id",
        "case o_orderkey % 3 when 0 then 'NATION_' || o_custkey % 25 when 1 then ' Nation_' || o_custkey % 25 || ' ' else 'Alt ' || o_custkey % 12 end as surface",
        "case when o_orderkey % 4 = 0 then 'In Nation_' || o_orderkey % 25 || ' today' end as context",
    )


PLACES = """pop AS (SELECT c_nationkey AS n_nationkey, count(*) * 1000 AS n FROM customer GROUP BY 1),
 places AS (SELECT n_nationkey AS place_id, lower(n_name) AS name, 'alt ' || (n_nationkey % 10) AS alternate, 'C' || n_nationkey AS cc, coalesce(n, 0) AS population,
   CAST(n_nationkey * 7 % 140 - 70 AS DOUBLE) AS lat, CAST(n_nationkey * 29 % 340 - 170 AS DOUBLE) AS lon FROM nation LEFT JOIN pop USING (n_nationkey)
  UNION ALL SELECT n_nationkey + 100, lower(n_name), 'other ' || n_nationkey, 'C' || ((n_nationkey + 1) % 25), n_nationkey * 1000, CAST(n_nationkey * 7 % 140 - 70 AS DOUBLE), CAST(n_nationkey * 29 % 340 - 170 AS DOUBLE) FROM nation WHERE n_nationkey % 4 = 0),
 mentions AS (SELECT o_orderkey AS mention_id, o_orderkey // 10 AS article_id,
   CASE o_orderkey % 3 WHEN 0 THEN 'NATION_' || (o_custkey % 25) WHEN 1 THEN ' Nation_' || (o_custkey % 25) || ' ' ELSE 'Alt ' || (o_custkey % 12) END AS surface,
   CASE WHEN o_orderkey % 4 = 0 THEN 'In Nation_' || (o_orderkey % 25) || ' today' END AS context FROM orders)"""
