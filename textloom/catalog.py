"""Registry of the analytics queries and of the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import testdata as T
from textloom.functions import html as H
from textloom.functions import text as X
from textloom.functions import times as D
from textloom.functions import urls as U
from textloom.operators import corpus as C
from textloom.operators import evolution as E
from textloom.operators import places as P
from textloom.operators import semantics as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


_PHASE_SQL = """CASE WHEN d BETWEEN date '2020-01-31' AND date '2020-11-30' THEN 'P1_global_onset' WHEN d BETWEEN date '2020-12-01' AND date '2020-12-31' THEN 'P2_pre_vaccine'
 WHEN d BETWEEN date '2021-01-01' AND date '2021-05-31' THEN 'P3_vaccine_rollout' WHEN d BETWEEN date '2021-06-01' AND date '2021-11-30' THEN 'P4_delta_wave'
 WHEN d BETWEEN date '2021-12-01' AND date '2022-06-30' THEN 'P5_omicron_wave' WHEN d BETWEEN date '2022-07-01' AND date '2023-05-05' THEN 'P6_transition_end' END"""
_EVENT = f"ev AS (SELECT *, coalesce(publish_date, capture_date) AS d FROM docs), ph AS (SELECT *, coalesce({_PHASE_SQL}, 'outside_study') AS phase FROM ev)"
_TIERED = """tiered AS (SELECT p.*, coalesce(r.tier, CASE p.collection_id WHEN 13559 THEN 'low' ELSE 'mixed' END) AS tier FROM ph p LEFT JOIN reg r ON p.host = r.domain)"""


def _dated(spark: SparkSession, sf: str) -> DataFrame:
    d = T.documents(spark, sf)
    p, c = F.col("publish_date"), F.col("capture_date")
    return d.withColumns({"d": D.event_time(p, c), "phase": D.event_phase(p, c)})


def _tiered(spark: SparkSession, sf: str) -> DataFrame:
    return C.with_tier(_dated(spark, sf), "host", T.registry(spark), F.when(F.col("collection_id") == 13559, "low").otherwise("mixed"))


@query(r"""
WITH a AS (SELECT page_id, lower(regexp_extract(url, '^([^:]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
b AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(lower(x), 'utm_') AND NOT regexp_matches(lower(x), '^(fbclid|gclid|msclkid)='))) AS params FROM a)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS canonical FROM b""")
def url_canonical(spark, sf):
    return T.read(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(r"SELECT regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def host_normalize(spark, sf):
    return T.read(spark, sf, "pages").groupBy(U.normalize_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(r"""
WITH h AS (SELECT page_id, string_split(regexp_replace(lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)), '^www\.', ''), '.') AS p FROM pages)
SELECT array_to_string(p[i:], '.') AS domain, count(*) AS n FROM (SELECT p, unnest(range(1, len(p))) AS i FROM h) GROUP BY 1""")
def domain_chain(spark, sf):
    return T.read(spark, sf, "pages").select(F.explode(U.domain_chain(U.normalize_host(F.col("url")))).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


@query(f"""WITH {T.DOCUMENTS}, {T.REGISTRY}, {_EVENT}, {_TIERED},
phases AS (SELECT DISTINCT phase FROM tiered), grid AS (SELECT * FROM phases, (VALUES ('low'), ('authoritative'), ('mixed')) t(tier)),
n AS (SELECT phase, tier, count(*) AS n_docs, count(DISTINCT host) AS n_hosts FROM tiered GROUP BY ALL)
SELECT phase, tier, coalesce(n_docs, 0) AS n_docs, coalesce(n_hosts, 0) AS n_hosts, round(100.0 * coalesce(n_docs, 0) / sum(coalesce(n_docs, 0)) OVER (PARTITION BY phase), 6) AS share
FROM grid LEFT JOIN n USING (phase, tier)""")
def tier_by_phase_grid(spark, sf):
    t = _tiered(spark, sf)
    grid = t.select("phase").distinct().crossJoin(spark.createDataFrame([(x,) for x in S.TIERS], "tier string"))
    n = t.groupBy("phase", "tier").agg(F.count("*").alias("n_docs"), F.count_distinct("host").alias("n_hosts"))
    out = grid.join(n, ["phase", "tier"], "left").na.fill(0, ["n_docs", "n_hosts"])
    return out.withColumn("share", F.round(100.0 * F.col("n_docs") / F.sum("n_docs").over(Window.partitionBy("phase")), 6))


@query(f"WITH {T.DOCUMENTS}, {T.REGISTRY}, {_EVENT}, {_TIERED} SELECT tier, count(*) AS n FROM tiered GROUP BY 1")
def tier_lookup(spark, sf):
    return _tiered(spark, sf).groupBy("tier").agg(F.count("*").alias("n"))


@query(f"WITH {T.DOCUMENTS}, {_EVENT} SELECT doc_id, strftime(d, '%Y-%m-%d') AS event_date, phase, CASE WHEN publish_date IS NOT NULL THEN 'publish_date' ELSE 'capture_timestamp' END AS date_source FROM ph")
def event_time_policy(spark, sf):
    return _dated(spark, sf).select("doc_id", F.date_format("d", "yyyy-MM-dd").alias("event_date"), "phase", D.date_source(F.col("publish_date"), F.col("capture_date")).alias("date_source"))


@query(f"WITH {T.DOCUMENTS}, {_EVENT} SELECT phase, count(*) AS n, count(*) FILTER (fetch_status = 'ok') AS n_ok FROM ph GROUP BY 1")
def phase_counts(spark, sf):
    return _dated(spark, sf).groupBy("phase").agg(F.count("*").alias("n"), F.count_if(F.col("fetch_status") == "ok").alias("n_ok"))


@query(f"WITH {T.DOCUMENTS}, {_EVENT} SELECT printf('%04d-W%02d', isoyear(d), week(d)) AS iso_week, count(*) AS n FROM ph GROUP BY 1")
def iso_week_counts(spark, sf):
    return _dated(spark, sf).groupBy(D.iso_week(F.col("d")).alias("iso_week")).agg(F.count("*").alias("n"))


@query(f"""WITH {T.DOCUMENTS}, {_EVENT}, m AS (SELECT date_trunc('month', d) AS m FROM ph), s AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM m)
SELECT strftime(s.m, '%Y-%m') AS month, count(m.m) AS n FROM s LEFT JOIN m ON s.m = m.m GROUP BY 1""")
def month_spine(spark, sf):
    m = _dated(spark, sf).select(F.trunc("d", "month").alias("m"))
    spine = m.agg(F.min("m").alias("a"), F.max("m").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("s"))
    n = m.groupBy("m").agg(F.count("*").alias("n"))
    return spine.join(n, F.col("s") == F.col("m"), "left").select(F.date_format("s", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


_RETAIN = f"""WITH {T.CAPTURES},
v AS (SELECT *, CASE WHEN NOT starts_with(status, '2') THEN 'skipped_status' WHEN lower(trim(split_part(mimetype, ';', 1))) NOT IN ('text/html', 'application/xhtml+xml') THEN 'skipped_mimetype' END AS valid FROM caps),
c AS (SELECT *, valid IS NULL AND (digest IS NULL OR row_number() OVER (PARTITION BY phase, page, digest, valid IS NULL ORDER BY ordinal) = 1) AS cand FROM v),
k AS (SELECT *, sum(cand::INT) OVER (PARTITION BY phase, page ORDER BY ordinal) AS place FROM c),
o AS (SELECT *, coalesce(cand AND place <= 2, false) AS kept FROM k),
f AS (SELECT *, max(kept::INT) OVER (PARTITION BY phase, page, digest, valid IS NULL ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dup FROM o),
r AS (SELECT ordinal, phase, coalesce(valid, CASE WHEN kept THEN 'kept' WHEN digest IS NOT NULL AND dup = 1 THEN 'skipped_dup_digest' ELSE 'skipped_dup_url' END) AS outcome FROM f)"""


@query(_RETAIN + " SELECT ordinal, outcome FROM r")
def capture_retention(spark, sf):
    return C.retain_captures(T.captures(spark, sf), 2).select("ordinal", "outcome")


@query(_RETAIN + " SELECT phase, outcome, count(*) AS n FROM r GROUP BY ALL")
def capture_retention_stats(spark, sf):
    return C.retain_captures(T.captures(spark, sf), 2).groupBy("phase", "outcome").agg(F.count("*").alias("n"))


@query(f"WITH {T.CAPTURES} SELECT phase, page, ordinal FROM caps QUALIFY row_number() OVER (PARTITION BY phase, page ORDER BY ordinal, url) <= 2")
def captures_per_url_phase(spark, sf):
    return C.earliest_per(T.captures(spark, sf), ["phase", "page"], ["ordinal", "url"], 2).select("phase", "page", "ordinal")


@query(r"SELECT doc_id, len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) AS n_words, length(text) AS n_code_points, len(regexp_extract_all(text, '\d+(?:[.,]\d+)*')) AS n_numbers FROM documents")
def text_features(spark, sf):
    t = F.col("text")
    return T.read(spark, sf, "documents").select("doc_id", X.word_count(t).alias("n_words"), F.char_length(t).alias("n_code_points"), F.size(X.numbers(t)).alias("n_numbers"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*') AS w FROM documents)
SELECT doc_id, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS n_shingles FROM w""")
def shingle_counts(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", F.size(X.shingles(X.normalize_text(F.col("text")))).alias("n_shingles"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
n AS (SELECT *, replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), 'ß', 'ss') AS norm, len(regexp_extract_all(line, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')) AS w FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, norm ORDER BY i) AS seen FROM n)
SELECT doc_id, count(*) FILTER (w >= 20 AND seen > 1) AS n_removed FROM k GROUP BY 1""")
def repeated_blocks(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.without_repeated_blocks(F.col("text"))["removed"].alias("n_removed"))


_HASH = r"sha256(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss'))"


@query(f"WITH {T.DOCUMENTS} SELECT doc_id, min(doc_id) OVER (PARTITION BY collection_id, host, month, language, {_HASH}) AS representative FROM docs")
def exact_duplicates(spark, sf):
    return C.exact_duplicates(T.documents(spark, sf), ["collection_id", "host", "month", "language"]).select("doc_id", "representative")


@query(f"WITH g AS (SELECT lang, count(*) AS k FROM documents GROUP BY lang, {_HASH}) SELECT lang, sum(k)::BIGINT AS n, count(*) AS n_groups, max(k) AS largest, round(1 - count(*) / sum(k), 6) AS redundancy FROM g GROUP BY 1")
def redundancy_by_language(spark, sf):
    g = T.read(spark, sf, "documents").groupBy("lang", X.content_hash(F.col("text")).alias("h")).agg(F.count("*").alias("k"))
    return g.groupBy("lang").agg(F.sum("k").alias("n"), F.count("*").alias("n_groups"), F.max("k").alias("largest"), F.round(1 - F.count("*") / F.sum("k"), 6).alias("redundancy"))


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1")
def language_share(spark, sf):
    return C.value_shares(T.read(spark, sf, "documents"), "lang")


@query(f"WITH {T.DOCUMENTS} SELECT fetch_status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM docs GROUP BY 1")
def fetch_health(spark, sf):
    return C.value_shares(T.documents(spark, sf), "fetch_status")


@query("SELECT round(avg(n_chars), 6) AS mean, median(n_chars) AS median, round(stddev_samp(n_chars), 6) AS std, min(n_chars) AS least, max(n_chars) AS most FROM documents")
def length_stats(spark, sf):
    n = F.col("n_chars")
    return T.read(spark, sf, "documents").agg(F.round(F.avg(n), 6).alias("mean"), F.median(n).alias("median"), F.round(F.stddev_samp(n), 6).alias("std"), F.min(n).alias("least"), F.max(n).alias("most"))


@query(f"WITH {T.DOCUMENTS}, {T.REGISTRY}, {_EVENT}, {_TIERED} SELECT tier, count(*) AS n, round(avg(length(text)), 6) AS mean, quantile_cont(length(text), 0.25) AS q1, quantile_cont(length(text), 0.5) AS q2, quantile_cont(length(text), 0.75) AS q3 FROM tiered GROUP BY 1")
def length_describe_by_tier(spark, sf):
    n = F.char_length("text")
    return _tiered(spark, sf).groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean"), F.percentile(n, 0.25).alias("q1"), F.percentile(n, 0.5).alias("q2"), F.percentile(n, 0.75).alias("q3"))


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars < (SELECT avg(n_chars) + stddev_samp(n_chars) FROM documents)")
def outlier_trim(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", "n_chars")
    bound = d.agg((F.avg("n_chars") + F.stddev_samp("n_chars")).alias("bound"))  # one row
    return d.crossJoin(F.broadcast(bound)).filter("n_chars < bound").drop("bound")


@query(f"WITH {T.DOCUMENTS}, {T.REGISTRY}, {_EVENT}, {_TIERED} SELECT phase, count(*) FILTER (tier = 'low') AS low, count(*) FILTER (tier = 'authoritative') AS authoritative, count(*) FILTER (tier = 'mixed') AS mixed FROM tiered GROUP BY 1")
def phase_tier_pivot(spark, sf):
    return _tiered(spark, sf).groupBy("phase").pivot("tier", list(S.TIERS)).count().na.fill(0)


@query(f"WITH {T.DOCUMENTS}, {_EVENT} SELECT strftime(date_trunc('week', d), '%Y-%m-%d') AS week, count(*) AS n FROM ph GROUP BY 1")
def week_counts(spark, sf):
    return _dated(spark, sf).groupBy(F.date_format(F.date_trunc("week", "d"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n"))


@query(r"SELECT lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS domain, count(*) AS n FROM pages GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def top_domains(spark, sf):
    return T.read(spark, sf, "pages").groupBy(F.lower(F.regexp_extract("url", r"^[^:]+://([^/?#]*)", 1)).alias("domain")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "domain").limit(20)


def _metrics_sql(period: str) -> str:
    return f"""WITH {T.CHUNKS}, g AS (SELECT * FROM (SELECT DISTINCT {period} AS period FROM chunks), (VALUES ('low'), ('authoritative'), ('mixed')) t(tier)),
u AS (SELECT {period} AS period, tier, host, topic, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM chunks),
e AS (SELECT period, tier, topic, unnest(u) AS x, unnest(range(1, len(u) + 1)) AS dim FROM u),
s AS (SELECT period, tier, dim, sum(x) AS s FROM e GROUP BY ALL), q AS (SELECT period, tier, sum(s * s) AS q FROM s GROUP BY ALL),
b AS (SELECT period, tier, count(*) AS n, count(DISTINCT host) AS hosts, count(*) FILTER (topic >= 0) AS a FROM u GROUP BY ALL),
t AS (SELECT period, tier, topic, count(*) AS k FROM u WHERE topic >= 0 GROUP BY ALL), p AS (SELECT period, tier, k / sum(k) OVER (PARTITION BY period, tier) AS p FROM t),
h AS (SELECT period, tier, abs(sum(p * log2(p))) AS h, count(*) AS m FROM p GROUP BY ALL), kk AS (SELECT count(DISTINCT topic) AS k FROM chunks WHERE topic >= 0),
ts AS (SELECT period, tier, topic, dim, sum(x) AS s FROM e WHERE topic >= 0 GROUP BY ALL), tn AS (SELECT period, tier, topic, sqrt(sum(s * s)) AS norm FROM ts GROUP BY ALL), nn AS (SELECT period, tier, sum(norm) AS norms FROM tn GROUP BY ALL),
cs AS (SELECT period, tier, dim, sum(s / norm) AS c FROM ts JOIN tn USING (period, tier, topic) GROUP BY ALL), cq AS (SELECT period, tier, sum(c * c) AS cq FROM cs GROUP BY ALL)
SELECT period, tier, coalesce(n, 0) AS n_chunks, coalesce(a, 0) AS n_assigned, coalesce(hosts, 0) AS n_sources, coalesce(m, 0) AS n_topics, round(CASE WHEN n > 0 THEN a / n END, 6) AS assigned_fraction,
 CASE WHEN n IS NULL THEN 'empty' WHEN n < 20 THEN 'too_small' ELSE 'ok' END AS status,
 round(CASE WHEN n >= 20 THEN greatest(0.0, least(2.0, 1 - (q - n) / (n * (n - 1)))) END, 6) AS dispersion, round(CASE WHEN n >= 20 AND a >= 20 THEN norms / a END, 6) AS cohesion,
 round(CASE WHEN n >= 20 AND a >= 20 AND m > 1 THEN greatest(0.0, least(2.0, 1 - (cq - m) / (m * (m - 1)))) END, 6) AS topic_spread, round(CASE WHEN n >= 20 AND a >= 20 THEN h END, 6) AS entropy_bits,
 round(CASE WHEN n >= 20 AND a >= 20 THEN CASE WHEN k > 1 THEN h / log2(k) ELSE 0.0 END END, 6) AS entropy_normalized, round(CASE WHEN n >= 20 AND a >= 20 THEN pow(2.0, h) END, 6) AS effective_topics
FROM g LEFT JOIN b USING (period, tier) LEFT JOIN q USING (period, tier) LEFT JOIN h USING (period, tier) LEFT JOIN nn USING (period, tier) LEFT JOIN cq USING (period, tier), kk"""


_MEASURES = ("assigned_fraction", "dispersion", "cohesion", "topic_spread", "entropy_bits", "entropy_normalized", "effective_topics")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query(_metrics_sql("month"))
def tier_metrics_month(spark, sf):
    return _rounded(S.tier_metrics(T.chunks(spark, sf).withColumnRenamed("month", "period"), "period"), *_MEASURES)


@query(_metrics_sql("phase"))
def tier_metrics_phase(spark, sf):
    return _rounded(S.tier_metrics(T.chunks(spark, sf).withColumnRenamed("phase", "period"), "period"), *_MEASURES)


_NEIGHBOURS = f"""WITH {T.CHUNKS}, u AS (SELECT *, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM chunks),
j AS (SELECT a.point_id, b.point_id AS ref_id, round(greatest(0.0, least(2.0, 1 - list_dot_product(a.u, b.u))), 9) AS d FROM u a JOIN u b ON a.phase = b.phase AND b.tier = 'authoritative' AND a.host <> b.host),
m AS (SELECT point_id, count(*) AS n, min(struct_pack(d := d, ref_id := ref_id)) AS best FROM j GROUP BY 1),
r AS (SELECT c.point_id, c.phase, c.tier, coalesce(n, 0) AS n_reference, CASE WHEN n >= 3 THEN best.d END AS distance, CASE WHEN n >= 3 THEN best.ref_id END AS neighbour, CASE WHEN n >= 3 THEN 'ok' ELSE 'insufficient_reference' END AS status FROM chunks c LEFT JOIN m USING (point_id)),
y AS (SELECT phase, tier, count(*) AS n_queries, count(distance) AS n_matched, CASE WHEN count(distance) >= 20 THEN round(avg(distance), 6) END AS mean_distance, CASE WHEN count(distance) >= 20 THEN round(median(distance), 6) END AS median_distance,
 CASE WHEN count(distance) >= 20 THEN round(quantile_cont(distance, 0.9), 6) END AS p90_distance FROM r GROUP BY ALL)"""


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return S.authoritative_neighbours(T.chunks(spark, sf), "phase")


@query(_NEIGHBOURS + " SELECT point_id, phase, tier, n_reference, round(distance, 6) AS distance, neighbour, status FROM r")
def authoritative_neighbours(spark, sf):
    return _rounded(_near(spark, sf), "distance")


@query(_NEIGHBOURS + " SELECT * FROM y")
def neighbour_summary(spark, sf):
    return _rounded(S.neighbour_summary(_near(spark, sf), "phase"), "mean_distance", "median_distance", "p90_distance")


@query(_NEIGHBOURS + f", z AS (SELECT period AS phase, tier, n_chunks, status, dispersion, entropy_normalized FROM ({_metrics_sql('phase')})) SELECT z.*, n_queries, n_matched, mean_distance, median_distance, p90_distance FROM z LEFT JOIN y USING (phase, tier)")
def phase_report_join(spark, sf):
    c = T.chunks(spark, sf)
    m = S.tier_metrics(c, "phase").select("phase", "tier", "n_chunks", "status", "dispersion", "entropy_normalized")
    return _rounded(S.phase_report(m, S.neighbour_summary(_near(spark, sf), "phase"), "phase"), "dispersion", "entropy_normalized", "mean_distance", "median_distance", "p90_distance")


_TERMS = r"t AS (SELECT lang, unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) AS term FROM documents), n AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL)"


@query(f"WITH {_TERMS} SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM n QUALIFY rank <= 10")
def top_words(spark, sf):
    return S.top_terms(S.term_counts(T.read(spark, sf, "documents"), "lang"), "lang").select("lang", "term", "n", "rank")


@query(f"""WITH {T.DOCUMENTS}, {_EVENT}, s AS (SELECT min(d) AS a, max(d) AS b FROM ph), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS e, b FROM s),
frames AS (SELECT DISTINCT e FROM days WHERE dayofweek(e) = 0 OR e = b)
SELECT strftime(e, '%Y-%m-%d') AS frame_end, count(*) AS n, count(DISTINCT host) AS n_hosts FROM frames JOIN ph ON d BETWEEN e - 27 AND e GROUP BY 1""")
def trailing_window_counts(spark, sf):
    f = E.trailing_frames(_dated(spark, sf).select("d", "host"), "d")
    return f.groupBy(F.date_format("frame_end", "yyyy-MM-dd").alias("frame_end")).agg(F.count("*").alias("n"), F.count_distinct("host").alias("n_hosts"))


_STARTS = """(date '2020-01-31', 'P1_global_onset'), (date '2020-12-01', 'P2_pre_vaccine'), (date '2021-01-01', 'P3_vaccine_rollout'),
 (date '2021-06-01', 'P4_delta_wave'), (date '2021-12-01', 'P5_omicron_wave'), (date '2022-07-01', 'P6_transition_end')"""


@query(f"WITH {T.DOCUMENTS}, {_EVENT}, f AS (SELECT DISTINCT last_day(d) AS e FROM ph), ev2(event_date, event) AS (VALUES {_STARTS}) SELECT strftime(e, '%Y-%m-%d') AS frame_end, event, row_number() OVER (PARTITION BY e ORDER BY event_date DESC, event) AS rank FROM f JOIN ev2 ON event_date <= e QUALIFY rank <= 2")
def recent_milestones(spark, sf):
    events = spark.createDataFrame([(str(a), n) for n, a, _ in D.PHASES], "event_date string, event string").withColumn("event_date", F.to_date("event_date"))
    frames = _dated(spark, sf).select(F.last_day("d").alias("e")).distinct()
    return E.recent_events(frames, events, "e", 2).select(F.date_format("e", "yyyy-MM-dd").alias("frame_end"), "event", "rank")


@query(f"WITH {T.DOCUMENTS}, {T.REGISTRY}, {_EVENT}, {_TIERED} SELECT source, tier, count(*) AS n FROM tiered GROUP BY source, tier QUALIFY row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, tier) = 1")
def mode_tier(spark, sf):
    return E.most_frequent(_tiered(spark, sf), "source", "tier")


@query()
def html_extract(spark, sf):
    e = T.read(spark, sf, "pages").select("page_id", H.extract(F.col("html")).alias("e"))
    return e.select("page_id", "e.title", "e.mode", F.char_length("e.text").alias("n_chars"))


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, sf):
    return C.resume(T.read(spark, sf, "documents"), T.read(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT lang, count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT lang, n_chars AS v FROM documents WHERE lang NOT IN ('en', 'fr') UNION ALL SELECT lang, n_chars + 1 FROM documents WHERE lang IN ('en', 'fr')) GROUP BY 1")
def window_overwrite_union(spark, sf):
    d = T.read(spark, sf, "documents").select("lang", F.col("n_chars").cast("long").alias("v"))
    return C.overwrite_windows(d, d.withColumn("v", F.col("v") + 1), "lang", ["en", "fr"]).groupBy("lang").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query(f"WITH {T.DOCUMENTS} SELECT count(*) AS total, count(*) FILTER (fetch_status = 'ok') AS ok, round(count(*) FILTER (fetch_status <> 'ok') / count(*), 6) AS failed_fraction FROM docs")
def quality_gates(spark, sf):
    return C.quality_gates(T.documents(spark, sf))


_RESOLVED = f"""WITH {T.PLACES},
 cand AS (SELECT m.mention_id, p.*, 0 AS alt FROM mentions m JOIN places p ON p.name = lower(trim(m.surface)) UNION ALL SELECT m.mention_id, p.*, 1 FROM mentions m JOIN places p ON p.alternate = lower(trim(m.surface))),
 pick AS (SELECT * FROM cand QUALIFY alt = min(alt) OVER (PARTITION BY mention_id)),
 ctx AS (SELECT m.mention_id, 'C' || n_nationkey AS code FROM mentions m JOIN nation ON contains(lower(m.context), lower(n_name))),
 fit AS (SELECT p.*, EXISTS (SELECT 1 FROM ctx WHERE ctx.mention_id = p.mention_id AND code = p.cc) AS inside FROM pick p),
 pool AS (SELECT * FROM fit QUALIFY inside = bool_or(inside) OVER (PARTITION BY mention_id)),
 two AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY mention_id) AS k, ln(greatest(population, 1)) AS a, ln(greatest(lead(population) OVER w, 1)) AS b FROM pool WINDOW w AS (PARTITION BY mention_id ORDER BY population DESC, place_id)),
 res AS (SELECT m.*, t.place_id, t.cc, t.lat, t.lon, CASE WHEN k = 1 THEN 1.0::DOUBLE WHEN k > 1 THEN least(1.0::DOUBLE, CASE WHEN a <= b THEN 0.3::DOUBLE ELSE greatest(0.3::DOUBLE, least(0.95::DOUBLE, (a - b) / greatest(a, 1.0::DOUBLE))) END
   + CASE WHEN m.mention_id IN (SELECT mention_id FROM ctx) THEN 0.15::DOUBLE ELSE 0::DOUBLE END) END AS confidence FROM mentions m LEFT JOIN two t ON t.mention_id = m.mention_id AND r = 1),
 col AS (SELECT article_id, place_id, min_by(surface, mention_id) AS toponym, any_value(cc) AS cc, any_value(lat) AS lat, any_value(lon) AS lon, count(*) AS n, avg(confidence) AS confidence FROM res WHERE place_id IS NOT NULL GROUP BY ALL)"""


def _resolved(spark: SparkSession, sf: str) -> DataFrame:
    return P.resolve(T.mentions(spark, sf), T.places(spark, sf), T.countries(spark, sf))


def _collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return P.collapse(_resolved(spark, sf), "article_id", "mention_id")


@query(_RESOLVED + " SELECT mention_id, place_id, round(confidence, 6) AS confidence FROM res")
def place_resolution(spark, sf):
    return _resolved(spark, sf).select("mention_id", "place.place_id", F.round("confidence", 6).alias("confidence"))


@query(_RESOLVED + " SELECT article_id, place_id, toponym, n AS mention_count, round(confidence, 6) AS confidence FROM col")
def mention_collapse(spark, sf):
    return _collapsed(spark, sf).select("article_id", "place_id", "toponym", "mention_count", F.round("confidence", 6).alias("confidence"))


@query(_RESOLVED + """, s AS (SELECT article_id, count(*) AS n_places, sum(n) AS w, sum(n * cos(radians(lat)) * cos(radians(lon))) AS x, sum(n * cos(radians(lat)) * sin(radians(lon))) AS y, sum(n * sin(radians(lat))) AS z FROM col GROUP BY 1),
c AS (SELECT *, degrees(asin(greatest(-1.0, least(1.0, z / greatest(sqrt(x * x + y * y + z * z), 1e-12))))) AS clat, degrees(atan2(y, x)) AS clon FROM s),
d AS (SELECT article_id, sum(n * 2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lon - clon) / 2), 2))))) AS far FROM col JOIN c USING (article_id) GROUP BY 1)
SELECT article_id, n_places, round(clat, 4) AS centroid_lat, round(clon, 4) AS centroid_lon, round(CASE WHEN n_places = 1 THEN 0.0 ELSE far / w END, 3) AS dispersion_km FROM c JOIN d USING (article_id)""")
def centroid_dispersion(spark, sf):
    c = P.centroids(_collapsed(spark, sf), "article_id")
    return c.select("article_id", "n_places", F.round("centroid_lat", 4).alias("centroid_lat"), F.round("centroid_lon", 4).alias("centroid_lon"), F.round("dispersion_km", 3).alias("dispersion_km"))


@query(_RESOLVED + ", k AS (SELECT article_id, cc, sum(n) AS k FROM col GROUP BY ALL), p AS (SELECT *, k / sum(k) OVER (PARTITION BY article_id) AS p FROM k) SELECT article_id, round(abs(sum(p * log2(p))), 6) AS entropy_bits, count(*) AS n_countries FROM p GROUP BY 1")
def country_entropy(spark, sf):
    return P.country_entropy(_collapsed(spark, sf), "article_id").select("article_id", F.round(F.abs("entropy_bits"), 6).alias("entropy_bits"), "n_countries")


@query(_RESOLVED + """, pr AS (SELECT DISTINCT article_id, article_id % 3 AS tier, cc FROM col), m AS (SELECT tier, count(DISTINCT article_id) AS n_mapped FROM pr GROUP BY 1)
SELECT tier, cc AS country_code, count(*) AS n_articles, any_value(n_mapped) AS n_mapped, round(100.0 * count(*) / any_value(n_mapped), 6) AS percent FROM pr JOIN m USING (tier) GROUP BY ALL""")
def country_attention(spark, sf):
    docs = T.mentions(spark, sf).select("article_id", (F.col("article_id") % 3).alias("tier")).distinct()
    return P.attention(docs, _collapsed(spark, sf), "article_id", ["tier"]).select("tier", "country_code", "n_articles", "n_mapped", F.round("percent", 6).alias("percent"))


@query(f"WITH {T.DOCUMENTS}, {T.REGISTRY}, {_EVENT}, {_TIERED} SELECT strftime(d, '%Y-%m') AS month, count(*) FILTER (tier = 'low') AS low, count(*) FILTER (tier = 'authoritative') AS authoritative, count(*) FILTER (tier = 'mixed') AS mixed FROM tiered GROUP BY 1")
def month_tier_pivot(spark, sf):
    return _tiered(spark, sf).groupBy(F.date_format("d", "yyyy-MM").alias("month")).pivot("tier", list(S.TIERS)).count().na.fill(0)


@query(f"WITH {T.DOCUMENTS}, {T.REGISTRY}, {_EVENT}, {_TIERED} SELECT tier, host, count(*) AS n, row_number() OVER (PARTITION BY tier ORDER BY count(*) DESC, host) AS rank FROM tiered GROUP BY tier, host QUALIFY rank <= 3")
def top_hosts_per_tier(spark, sf):
    n = _tiered(spark, sf).groupBy("tier", "host").agg(F.count("*").alias("n"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("n"), "host"))).filter("rank <= 3")


def queries() -> dict[str, Query]:
    from textloom import catalog_corpus, catalog_topics  # noqa: F401  they add theirs

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
