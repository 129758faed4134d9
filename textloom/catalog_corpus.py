"""Further queries of the corpus: dedup, registry, preparation, places, identities, streams, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import testdata as T
from textloom.catalog import _EVENT, _HASH, _RESOLVED, _STARTS, _TIERED, _collapsed, _dated, _tiered, query
from textloom.functions import text as X
from textloom.functions import times as D
from textloom.functions import urls as U
from textloom.operators import corpus as C
from textloom.operators import dedupe as DD
from textloom.operators import evolution as E
from textloom.operators import places as P
from textloom.operators import semantics as S
from textloom.plans.lineage import cut
from textloom.sinks import exports
from textloom.streaming import counts as K

_BLOCKS = r"""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs WHERE fetch_status = 'ok'),
ln AS (SELECT *, replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), 'ß', 'ss') AS norm, len(regexp_extract_all(line, '[\p{L}\p{N}]+(?:[''’][\p{L}\p{N}]+)*')) AS w FROM l),
lk AS (SELECT *, w >= 20 AND row_number() OVER (PARTITION BY doc_id, norm, w >= 20 ORDER BY i) > 1 AS gone FROM ln),
cl AS (SELECT doc_id, trim(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), ' ' || chr(9) || chr(10) || chr(13)) AS body, count(*) FILTER (gone) AS removed FROM lk GROUP BY 1)"""
_EXACT = rf"""WITH {T.DOCUMENTS}, {_BLOCKS}, k AS (SELECT d.*, coalesce(c.body, d.text) AS body, coalesce(removed, 0) AS removed, d.fetch_status = 'ok' AND trim(coalesce(c.body, '')) <> '' AS fair FROM docs d LEFT JOIN cl c USING (doc_id)),
h AS (SELECT *, sha256(replace(lower(trim(regexp_replace(body, '\s+', ' ', 'g'))), 'ß', 'ss')) AS hash FROM k),
f AS (SELECT *, first_value(doc_id) OVER (PARTITION BY fair, collection_id, host, month, language, hash ORDER BY (extraction_mode <> 'article')::INT, (publish_date IS NULL)::INT, -length(body), strftime(capture_date, '%Y-%m-%d'), doc_id) AS best FROM h),
a AS (SELECT doc_id, CASE WHEN fair THEN best ELSE doc_id END AS representative, CASE WHEN fair AND best <> doc_id THEN 'drop' ELSE 'keep' END AS action, CASE WHEN NOT fair THEN 'not_comparable' WHEN best <> doc_id THEN 'exact' ELSE 'retained' END AS reason, removed FROM f)"""


def _audit(spark: SparkSession, sf: str, threshold: float) -> DataFrame:
    return DD.audit(T.documents(spark, sf).withColumn("origin", F.col("doc_id")).drop("month"), "origin", threshold)


@query()
def dedupe_decisions(spark, sf):
    return _audit(spark, sf, 0.9).select(F.col("origin").alias("doc_id"), "representative", "action", "reason", F.round("similarity", 6).alias("similarity"))


@query(_EXACT + " SELECT doc_id, representative, action, reason, removed AS removed_blocks FROM a")
def dedupe_exact(spark, sf):
    return _audit(spark, sf, 1.0).select(F.col("origin").alias("doc_id"), "representative", "action", "reason", "removed_blocks")


@query(_EXACT + """ SELECT 2 AS version, 1.0::DOUBLE AS threshold, count(*) AS input_documents, count(*) FILTER (action = 'keep') AS retained_documents, count(*) FILTER (action = 'drop') AS removed_documents,
 count(*) FILTER (reason = 'exact') AS exact_duplicates, count(*) FILTER (reason = 'near') AS near_duplicates, count(*) FILTER (reason = 'not_comparable') AS not_comparable, sum(removed)::BIGINT AS repeated_blocks_removed FROM a""")
def dedupe_stats(spark, sf):
    return DD.stats(_audit(spark, sf, 1.0), 1.0)


_NEGATIONS = "['no', 'not', 'never', 'without', 'cannot', 'can''t', 'don''t', 'doesn''t', 'isn''t', 'wasn''t', 'won''t']"


@query(rf"""WITH t AS (SELECT doc_id, replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss') AS x FROM documents), w AS (SELECT doc_id, x, regexp_extract_all(x, '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*') AS w FROM t)
SELECT doc_id, array_to_string(regexp_extract_all(x, '\d+(?:[.,]\d+)*'), ' ') AS numbers,
 array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains({_NEGATIONS}, w[i])), lambda i: array_to_string(w[greatest(1, i - 3):i + 3], ' ')), '|') AS negations FROM w""")
def claim_markers(spark, sf):
    c = X.claim_markers(X.normalize_text(F.col("text")))
    d = T.read(spark, sf, "documents").select("doc_id", c.alias("c"))
    return d.select("doc_id", F.array_join("c.numbers", " ").alias("numbers"), F.array_join("c.negations", "|").alias("negations"))


_SETS = rf"""w AS (SELECT doc_id, source, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*') AS w, {_HASH} AS hash FROM documents WHERE text IS NOT NULL),
g AS (SELECT hash, min(doc_id) AS id, any_value(w) AS w FROM w GROUP BY 1), s AS (SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS x FROM g),
z AS (SELECT id, count(*) AS n FROM s GROUP BY 1), c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE k / (za.n + zb.n - k) >= 0.9 UNION SELECT b, a FROM c JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE k / (za.n + zb.n - k) >= 0.9),
reach(id, to_id) AS (SELECT id, id FROM g UNION SELECT reach.id, e.b FROM reach JOIN e ON e.a = reach.to_id), cl AS (SELECT id, min(to_id) AS cluster FROM reach GROUP BY 1)"""


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    return DD.similar_clusters(T.read(spark, sf, "documents").select("doc_id", "text"), "doc_id")


@query(f"WITH RECURSIVE {_SETS} SELECT w.doc_id, cluster FROM w JOIN g USING (hash) JOIN cl ON cl.id = g.id")
def redundancy_clusters(spark, sf):
    return _clusters(spark, sf)


@query(f"""WITH RECURSIVE {T.REGISTRY}, {_SETS}, t AS (SELECT w.doc_id, cluster, coalesce(r.tier, 'unknown') AS tier FROM w JOIN g USING (hash) JOIN cl ON cl.id = g.id LEFT JOIN reg r ON r.domain = w.source || '.example.org'), k AS (SELECT tier, cluster, count(*) AS k FROM t GROUP BY ALL)
SELECT tier, sum(k)::BIGINT AS n, count(*) AS n_clusters, count(*) FILTER (k = 1) AS singletons, max(k) AS largest, round(1 - count(*) / sum(k), 6) AS redundancy FROM k GROUP BY 1""")
def redundancy_by_tier(spark, sf):
    d = T.documents(spark, sf).select("doc_id", "host").join(_clusters(spark, sf), "doc_id")
    return C.cluster_counts(C.with_tier(d, "host", T.registry(spark)), ["tier"])


@query(f"WITH RECURSIVE {_SETS} SELECT cluster, count(*) AS size, min(w.doc_id) AS exemplar FROM w JOIN g USING (hash) JOIN cl ON cl.id = g.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def largest_clusters(spark, sf):
    return _clusters(spark, sf).groupBy("cluster").agg(F.count("*").alias("size"), F.min("doc_id").alias("exemplar")).orderBy(F.desc("size"), "cluster").limit(5)


@query("""WITH h AS (SELECT DISTINCT CASE WHEN source IN ('src1', 'src2', 'src3') THEN 'www.src1.example.org' ELSE source || '.example.org' END AS domain, CASE WHEN lang = 'en' THEN 'authoritative' ELSE 'mixed' END AS tier FROM documents UNION SELECT 'src1.example.org', 'authoritative'),
a AS (SELECT domain FROM h WHERE tier = 'authoritative')
SELECT domain, tier FROM h WHERE NOT EXISTS (SELECT 1 FROM a WHERE ends_with(h.domain, '.' || a.domain) OR (h.domain = a.domain AND h.tier <> 'authoritative'))""")
def registry_prune(spark, sf):
    d = T.read(spark, sf, "documents")
    host = F.when(F.col("source").isin("src1", "src2", "src3"), "www.src1.example.org").otherwise(F.concat("source", F.lit(".example.org")))
    hosts = d.select(host.alias("domain"), F.when(F.col("lang") == "en", "authoritative").otherwise("mixed").alias("tier"))
    return C.build_registry(hosts, spark.createDataFrame([("src1.example.org", "authoritative")], "domain string, tier string"))


@query(f"WITH {T.DOCUMENTS}, {T.REGISTRY}, {_EVENT}, {_TIERED}, h AS (SELECT DISTINCT host, tier FROM tiered) SELECT tier, count(*) AS n FROM h GROUP BY 1")
def registry_tier_counts(spark, sf):
    return _tiered(spark, sf).select("host", "tier").distinct().groupBy("tier").agg(F.count("*").alias("n"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = _dated(spark, sf).withColumnRenamed("doc_id", "point_id")
    e = T.read(spark, sf, "embeddings").select(F.col("vec_id").alias("of"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return d.join(e, F.col("point_id") == F.col("of"), "left").drop("of")


@query(f"WITH {T.DOCUMENTS}, {_EVENT} SELECT doc_id FROM ph WHERE collection_id IN (13559, 13529) AND d BETWEEN date '2020-01-31' AND date '2023-05-05'")
def study_scope(spark, sf):
    return S.in_study(_dated(spark, sf), "d", [13559, 13529], "2020-01-31", "2023-05-05").select("doc_id")


@query(rf"""WITH {T.DOCUMENTS}, {_EVENT}, c AS (SELECT ph.*, date_trunc('month', d) AS win, regexp_replace(trim(text), '\s+', ' ', 'g') AS same FROM ph JOIN embeddings ON vec_id = doc_id WHERE lower(language) = 'en' AND len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')) >= 8)
SELECT doc_id AS point_id, strftime(win, '%Y-%m') AS month FROM c QUALIFY row_number() OVER (PARTITION BY win, host, same ORDER BY d, doc_id) = 1""")
def monthly_dedupe(spark, sf):
    return S.prepared(_chunks(spark, sf), "d").select("point_id", F.date_format("window", "yyyy-MM").alias("month"))


@query("SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS dimensions, count(*) FILTER (len(embedding) = 0) AS empty, 0::BIGINT AS not_finite, 0::BIGINT AS zero FROM embeddings")
def vector_faults(spark, sf):
    return S.vector_faults(T.read(spark, sf, "embeddings"), "embedding")


@query(f"""WITH {T.DOCUMENTS}, {_EVENT}, p AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN 'P1_global_onset' ELSE phase END AS was FROM ph),
names(name) AS (VALUES ('P1_global_onset'), ('P2_pre_vaccine'), ('P3_vaccine_rollout'), ('P4_delta_wave'), ('P5_omicron_wave'), ('P6_transition_end'), ('outside_study'), ('undated'))
SELECT 'phase' AS measure, name, (SELECT count(*) FROM p WHERE phase = name) AS n FROM names UNION ALL SELECT 'date_source', CASE WHEN publish_date IS NOT NULL THEN 'publish_date' ELSE 'capture_timestamp' END, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'corpus', 'documents', count(*) FROM p UNION ALL SELECT 'corpus', 'moved', count(*) FILTER (was <> phase) FROM p""")
def collection_summary(spark, sf):
    p = _dated(spark, sf).withColumnRenamed("phase", "assigned_phase")
    p = p.withColumns({"phase": F.when(F.col("doc_id") % 2 == 0, "P1_global_onset").otherwise(F.col("assigned_phase")), "date_source": D.date_source(F.col("publish_date"), F.col("capture_date"))})
    return C.collection_summary(p, [*[n for n, _, _ in D.PHASES], "outside_study", "undated"])


@query(f"WITH {T.DOCUMENTS}, {_EVENT} SELECT phase, count(*) AS n, count(publish_date) AS dated, count(*) FILTER (fetch_status = 'ok') AS n_ok, count(*) FILTER (fetch_status = 'ok' AND publish_date IS NOT NULL) AS dated_ok FROM ph GROUP BY 1")
def date_coverage(spark, sf):
    return C.date_coverage(_dated(spark, sf), "phase", "publish_date", F.col("fetch_status") == "ok")


@query(f"WITH {T.DOCUMENTS} SELECT collection_id, count(*) AS total, count(*) FILTER (fetch_status = 'ok') AS ok, count(*) FILTER (fetch_status = 'extract_failed') AS extract_failed, count(*) FILTER (fetch_status = 'fetch_failed') AS fetch_failed FROM docs GROUP BY 1")
def normalize_counters(spark, sf):
    return C.outcome_counts(T.documents(spark, sf), ["collection_id"], "fetch_status", ["ok", "extract_failed", "fetch_failed"])


@query("""WITH f AS (SELECT 'lang' AS field, lang AS value FROM documents UNION ALL SELECT 'source', source FROM documents) SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS rank FROM f WHERE value IS NOT NULL GROUP BY field, value QUALIFY rank <= 20""")
def inventory_counts(spark, sf):
    return C.category_counts(T.read(spark, sf, "documents"), ["lang", "source"])


@query("""SELECT 'records' AS measure, NULL::VARCHAR AS field, NULL::VARCHAR AS value, count(*) AS n FROM embeddings UNION ALL SELECT 'entries', 'embedding', NULL, sum(len(embedding))::BIGINT FROM embeddings""")
def inventory_lists(spark, sf):
    return exports.inventory(T.read(spark, sf, "embeddings"), [], ["embedding"])


@query("""WITH r AS (SELECT source, max_by(lang, doc_id) FILTER (lang IS NOT NULL) AS lang FROM documents GROUP BY 1) SELECT p.page_id, coalesce(r.lang, 'none') AS lang, r.source IS NOT NULL AS matched FROM (SELECT page_id, 'src' || (page_id % 23) AS source FROM pages) p LEFT JOIN r USING (source)""")
def date_backfill(spark, sf):
    p = T.read(spark, sf, "pages").select("page_id", F.concat(F.lit("src"), (F.col("page_id") % 23).cast("string")).alias("source"), F.lit("none").alias("lang"))
    return C.backfilled(p, T.read(spark, sf, "documents").select("source", "lang", "doc_id"), "source", "lang", "doc_id").select("page_id", "lang", "matched")


@query("SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)")
def provenance_check(spark, sf):
    return C.strangers(T.read(spark, sf, "embeddings").select("vec_id"), T.read(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), ["vec_id"])


@query("WITH s AS (SELECT doc_id % 500 AS point_id, doc_id // 500 AS shard, doc_id AS row FROM documents) SELECT point_id, min_by(shard, struct_pack(shard, row)) AS shard, min_by(row, struct_pack(shard, row)) AS row, count(*) - 1 AS left_out FROM s GROUP BY 1")
def point_dedupe(spark, sf):
    s = T.read(spark, sf, "documents").selectExpr("doc_id % 500 as point_id", "doc_id div 500 as shard", "doc_id as row")
    return C.first_points(s)


@query()
def chunk_ids(spark, sf):
    d = T.documents(spark, sf)
    made = U.chunk_id(F.lit("corpus"), F.col("collection_id"), F.col("capture_url"), F.col("month"), F.col("language"), X.content_hash(F.col("text")))
    return d.select("doc_id", made.alias("chunk_id"), U.article_id(F.col("collection_id"), F.col("capture_url"), F.col("capture_date"), F.col("publish_date"), F.col("text")).alias("article_id"))


_FRAMES = f"""{T.DOCUMENTS}, {_EVENT}, s AS (SELECT min(d) AS a, max(d) AS b FROM ph), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS e, b FROM s), frames AS (SELECT DISTINCT e FROM days WHERE dayofweek(e) = 0 OR e = b)"""


@query(f"WITH {_FRAMES}, fr AS (SELECT e, lag(e) OVER (ORDER BY e) AS before FROM frames), ev2(event_date, event) AS (VALUES {_STARTS}) SELECT strftime(e, '%Y-%m-%d') AS frame_end, strftime(before, '%Y-%m-%d') AS previous, event FROM fr JOIN ev2 ON event_date <= e AND (before IS NULL OR event_date > before)")
def arriving_milestones(spark, sf):
    events = spark.createDataFrame([(a, n) for n, a, _ in D.PHASES], "event_date string, event string").withColumn("event_date", F.to_date("event_date"))
    d = _dated(spark, sf).select("d")
    out = E.arriving_events(E.frame_spine(d, d), events, "frame_end")
    return out.select(F.date_format("frame_end", "yyyy-MM-dd").alias("frame_end"), F.date_format("previous", "yyyy-MM-dd").alias("previous"), "event")


@query(f"WITH {_FRAMES} SELECT strftime(e, '%Y-%m-%d') AS frame_end, strftime(lag(e) OVER (ORDER BY e), '%Y-%m-%d') AS previous FROM frames")
def frame_spine(spark, sf):
    from pyspark.sql import Window

    d = _dated(spark, sf).select("d")
    f = E.frame_spine(d, d)
    return f.select(F.date_format("frame_end", "yyyy-MM-dd").alias("frame_end"), F.date_format(F.lag("frame_end").over(Window.orderBy("frame_end")), "yyyy-MM-dd").alias("previous"))


@query(_RESOLVED.replace("WITH ", f"WITH {T.DOCUMENTS}, ", 1) + """, art AS (SELECT DISTINCT article_id, article_id % 3 AS tier, date '2020-02-02' + CAST(article_id * 7 % 300 AS INTEGER) AS d FROM mentions), last AS (SELECT max(d) AS b FROM art),
dy AS (SELECT CAST(unnest(generate_series((SELECT min(d) FROM art), b, INTERVAL 1 DAY)) AS DATE) AS e, b FROM last), fr AS (SELECT DISTINCT e FROM dy WHERE dayofweek(e) = 0 OR e = b),
pr AS (SELECT DISTINCT article_id, cc FROM col WHERE cc <> 'C3'), x AS (SELECT e, tier, article_id, cc FROM fr JOIN art ON d BETWEEN e - 27 AND e JOIN pr USING (article_id)), n AS (SELECT e, tier, count(DISTINCT article_id) AS n_mapped FROM x GROUP BY ALL)
SELECT strftime(e, '%Y-%m-%d') AS frame_end, tier, cc AS country_code, count(*) AS n_articles, any_value(n_mapped) AS n_mapped, round(100.0 * count(*) / any_value(n_mapped), 6) AS percent FROM x JOIN n USING (e, tier) GROUP BY ALL""")
def country_attention_frames(spark, sf):
    docs = T.mentions(spark, sf).select("article_id").distinct().select("article_id", (F.col("article_id") % 3).alias("tier"), F.expr("date_add(date '2020-02-02', cast(article_id * 7 % 300 as int))").alias("d"))
    framed = E.trailing_frames(docs, "d")
    shown = _collapsed(spark, sf).filter("country_code <> 'C3'")
    out = P.attention(framed, shown, "article_id", ["frame_end", "tier"])
    return out.select(F.date_format("frame_end", "yyyy-MM-dd").alias("frame_end"), "tier", "country_code", "n_articles", "n_mapped", F.round("percent", 6).alias("percent"))


@query(_RESOLVED + " SELECT article_id, count(*) AS n_places, sum(n)::BIGINT AS n_mentions, string_agg(toponym, '|' ORDER BY place_id) AS toponyms FROM col GROUP BY 1")
def nested_mentions(spark, sf):
    n = P.nested(_collapsed(spark, sf), "article_id")
    return n.select("article_id", F.size("mentions").cast("long").alias("n_places"), F.aggregate("mentions", F.lit(0).cast("long"), lambda a, x: a + x["mention_count"]).alias("n_mentions"), F.array_join(F.transform("mentions", lambda x: x["toponym"]), "|").alias("toponyms"))


@query(r"""SELECT doc_id, coalesce(len(text) > 100000, false) AS long, substr(text, greatest(0, 300 - 250) + 1, least(310 + 250, length(text)) - greatest(0, 300 - 250)) AS around FROM documents""")
def text_context(spark, sf):
    t = F.col("text")
    return T.read(spark, sf, "documents").select("doc_id", (F.size(X.text_windows(t)) > 1).alias("long"), X.context(t, F.lit(300), F.lit(310)).alias("around"))


@query()
def language_detect(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.detect_language(F.col("text")).alias("language"))


@query()
def chunk_text(spark, sf):
    d = T.read(spark, sf, "documents").select("doc_id", F.explode(X.sentence_chunks(F.col("text"))).alias("c"))
    return d.select("doc_id", "c.begin", "c.end", "c.token_count", F.char_length("c.text").alias("n_chars"))


@query()
def encode(spark, sf):
    return T.read(spark, sf, "documents").select("doc_id", X.encode(F.col("text")).alias("v"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50")
def first_documents(spark, sf):
    return C.first_rows(T.read(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 50).select("doc_id")


@query("SELECT n_nationkey, n_name FROM nation WHERE 'C' || n_nationkey NOT IN ('AQ', '-99')")
def renderable_countries(spark, sf):
    n = T.read(spark, sf, "nation").select("n_nationkey", "n_name", F.concat(F.lit("C"), F.col("n_nationkey").cast("string")).alias("country_code"))
    return P.renderable(n).select("n_nationkey", "n_name")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return T.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT strftime(time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d') AS week, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_weekly_counts(spark, sf):
    return K.windowed_counts(_events(spark, sf), "ts", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("week"), "event_type", "n")


@query("""WITH w AS (SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS b, event_type FROM events), x AS (SELECT b - i * INTERVAL 7 DAY AS start, event_type FROM w, (SELECT unnest([0, 1, 2, 3]) AS i)) SELECT strftime(start, '%Y-%m-%d') AS start, event_type, count(*) AS n FROM x GROUP BY ALL""")
def stream_sliding_attention(spark, sf):
    return K.sliding_counts(_events(spark, sf), "ts", ["event_type"]).select(F.date_format("start", "yyyy-MM-dd").alias("start"), "event_type", "n")


@query("""WITH o AS (SELECT user_id, ts, ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    s = K.sessions(_events(spark, sf), "ts", ["user_id"])
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("SELECT item_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n_words FROM benchmark")
def benchmark_lengths(spark, sf):
    return T.read(spark, sf, "benchmark").select("item_id", X.word_count(F.col("text")).alias("n_words"))


@query("SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY 1")
def conversation_roles(spark, sf):
    return T.read(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"))


@query(f"WITH {T.DOCUMENTS}, {_EVENT} SELECT doc_id, row_number() OVER (ORDER BY d NULLS LAST, capture_date NULLS LAST, capture_url, doc_id) AS place FROM ph ORDER BY 2 LIMIT 100")
def collection_order(spark, sf):
    from pyspark.sql import Window

    d = _dated(spark, sf).select("doc_id", F.col("d").alias("event_time"), F.col("capture_date").alias("capture_time"), "capture_url", "seed_url", F.format_string("%020d", "doc_id").alias("digest"))
    top = C.collection_order(d).limit(100)
    return top.select("doc_id", F.row_number().over(Window.orderBy("event_time", "capture_time", "capture_url", "digest")).alias("place"))


@query()
def dedupe_output(spark, sf):
    d = T.documents(spark, sf).withColumn("origin", F.col("doc_id")).drop("month")
    records = cut(DD.audit(d, "origin", 0.9))
    return DD.deduplicated(d, records).select("doc_id", "word_count", "char_count", "deduplication")
