"""Queries of topics over months, with the SQL that checks them.

A document's topic is its language: the driver's texts are of four languages, so that topics of successive months are
alike where they should be. Months of fewer than 24 documents are unobserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom import testdata as T
from textloom.catalog import _EVENT, query
from textloom.operators import evolution as E
from textloom.operators import topics as O
from textloom.plans.lineage import cut

_LEAST = 24
_STOP = "[" + ", ".join(f"'{w}'" for w in O.STOP_WORDS) + "]"
_MONTHS = rf"""{T.DOCUMENTS}, {_EVENT}, m AS (SELECT doc_id, CAST(date_trunc('month', d) AS DATE) AS win, 'topic:' || strftime(date_trunc('month', d), '%Y-%m-%d') || ':' || language AS node, language AS topic, capture_url, text FROM ev),
spine AS (SELECT CAST(unnest(generate_series(min(win), max(win), INTERVAL 1 MONTH)) AS DATE) AS win FROM m), cnt AS (SELECT win, count(*) AS n_docs, count(DISTINCT node) AS n_topics FROM m GROUP BY 1),
obs AS (SELECT win, n_docs FROM cnt WHERE n_docs >= {_LEAST})"""
_PARTS = rf"""{_MONTHS}, t AS (SELECT win, node, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))) AS term FROM m JOIN obs USING (win)),
n AS (SELECT win, node, term, count(*) AS k FROM t GROUP BY ALL), p AS (SELECT win, node, term, k, k / sum(k) OVER (PARTITION BY node) AS p FROM n), norm AS (SELECT node, sqrt(sum(p * p)) AS norm FROM p GROUP BY 1),
step AS (SELECT a.win, b.win AS nxt FROM obs a JOIN obs b ON b.win = a.win + INTERVAL 1 MONTH),
pr AS (SELECT a.node AS source, b.node AS target, sum(a.p * b.p) / (any_value(x.norm) * any_value(y.norm)) AS cosine, sum(least(a.p, b.p)) / (2 - sum(least(a.p, b.p))) AS wj,
  greatest(0.0, least(1.0, 1 + sum(a.p * log2(a.p / (a.p + b.p)) + b.p * log2(b.p / (a.p + b.p))) / 2)) AS js
  FROM p a JOIN step ON step.win = a.win JOIN p b ON b.win = step.nxt AND b.term = a.term JOIN norm x ON x.node = a.node JOIN norm y ON y.node = b.node GROUP BY ALL),
nodes AS (SELECT win, node, count(*) AS size, count(*) / any_value(n_docs) AS prevalence FROM m JOIN obs USING (win) GROUP BY ALL),
ed AS (SELECT *, cosine AS similarity FROM pr WHERE round(cosine, 9) >= 0.45)"""


def _members(spark: SparkSession, sf: str) -> DataFrame:
    d = T.documents(spark, sf).withColumn("window", F.trunc(F.coalesce("publish_date", "capture_date"), "month"))
    node = F.concat(F.lit("topic:"), F.date_format("window", "yyyy-MM-dd"), F.lit(":"), F.col("language"))
    return d.select(F.col("doc_id").alias("point_id"), "window", node.alias("node"), F.col("language").alias("topic"), "capture_url", "seed_url", "text")


def _coverage(members: DataFrame) -> DataFrame:
    return O.coverage(members, members, "window", _LEAST)


class _Slices:
    """Members, coverage and term shares: texts are read once, for the shares."""

    def __init__(self, spark: SparkSession, sf: str):
        self.members = _members(spark, sf)
        self.coverage = cut(_coverage(self.members))
        self.parts = cut(O.shares(self.members, self.coverage))
        self.nodes = O.records(self.members, self.coverage, self.parts)
        self.pairs = cut(O.neighbours(self.parts, self.coverage))

    def edges(self, threshold: float = 0.45) -> DataFrame:
        return O.edges(self.pairs, self.coverage, self.nodes, threshold)


@query(f"WITH {_MONTHS} SELECT strftime(s.win, '%Y-%m') AS month, coalesce(n_docs, 0) AS n_docs, CASE WHEN n_docs >= {_LEAST} THEN n_topics ELSE 0 END AS n_topics, CASE WHEN n_docs IS NULL THEN 'empty' WHEN n_docs < {_LEAST} THEN 'too_small' ELSE 'ok' END AS status, coalesce(n_docs >= {_LEAST}, false) AS observed, CASE WHEN n_docs >= {_LEAST} THEN 0.0::DOUBLE END AS outlier_fraction FROM spine s LEFT JOIN cnt USING (win)")
def topic_coverage(spark, sf):
    return _coverage(_members(spark, sf)).select(F.date_format("window", "yyyy-MM").alias("month"), "n_docs", "n_topics", "status", "observed", F.round("outlier_fraction", 6).alias("outlier_fraction"))


@query(rf"""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM documents),
f AS (SELECT doc_id, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS term FROM t)
SELECT term, count(*) AS df FROM f GROUP BY 1 HAVING df >= 2 AND df <= 0.95 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 20000""")
def term_document_frequency(spark, sf):
    return O.vocabulary(T.read(spark, sf, "documents").select("doc_id", "text"), "doc_id", pairs=True)


@query(f"WITH {_PARTS} SELECT node, term, k AS n, round(p, 9) AS p FROM p")
def term_distribution(spark, sf):
    m = _members(spark, sf)
    return O.shares(m, _coverage(m)).select("node", "term", "n", F.round("p", 9).alias("p"))


@query(f"""WITH {_PARTS}, r AS (SELECT node, term, row_number() OVER (PARTITION BY node ORDER BY p DESC, term) AS r FROM p), w AS (SELECT node, string_agg(term, ', ' ORDER BY r) FILTER (r <= 10) AS top_words, string_agg(term, ' · ' ORDER BY r) FILTER (r <= 3) AS label FROM r GROUP BY 1)
SELECT node, size, round(prevalence, 6) AS prevalence, top_words, label FROM nodes JOIN w USING (node)""")
def topic_nodes(spark, sf):
    return _Slices(spark, sf).nodes.select("node", "size", F.round("prevalence", 6).alias("prevalence"), "top_words", "label")


@query(f"""WITH {_PARTS} SELECT source, target, round(similarity, 6) AS similarity, round(js, 6) AS js_divergence, round(b.prevalence - a.prevalence, 6) AS prevalence_delta, strftime(CAST(b.win + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE), '%Y-%m-%d') AS available_on
FROM ed JOIN nodes a ON a.node = source JOIN nodes b ON b.node = target""")
def topic_edges_cosine(spark, sf):
    e = _Slices(spark, sf).edges()
    return e.select("source", "target", *[F.round(c, 6).alias(c) for c in ("similarity", "js_divergence", "prevalence_delta")], F.date_format("available_at", "yyyy-MM-dd").alias("available_on"))


@query(f"WITH {_PARTS} SELECT source, target, round(wj, 6) AS similarity FROM pr WHERE round(wj, 9) >= 0.3")
def topic_edges_jaccard(spark, sf):
    s = _Slices(spark, sf)
    return O.edges(s.pairs, s.coverage, s.nodes, 0.3, "weighted_jaccard").select("source", "target", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PARTS} SELECT source, target, round(js, 6) AS divergence FROM pr")
def js_divergence(spark, sf):
    return _Slices(spark, sf).pairs.select("source", "target", F.round("js_divergence", 6).alias("divergence"))


@query(f"""WITH {_PARTS}, best AS (SELECT target AS node, max(cosine) AS best FROM pr GROUP BY 1), i AS (SELECT target AS node, count(*) AS k, bool_or(js >= 0.35) AS moved FROM ed GROUP BY 1), o AS (SELECT source AS node, count(*) AS k FROM ed GROUP BY 1),
x AS (SELECT node, coalesce(i.k, 0) AS in_degree, coalesce(o.k, 0) AS out_degree, best, coalesce(moved, false) AS shift_candidate, win - INTERVAL 1 MONTH IN (SELECT win FROM obs) AS hb, win + INTERVAL 1 MONTH IN (SELECT win FROM obs) AS ha
  FROM nodes LEFT JOIN best USING (node) LEFT JOIN i USING (node) LEFT JOIN o USING (node)),
y AS (SELECT *, CASE WHEN hb THEN in_degree = 0 END AS birth, CASE WHEN ha THEN out_degree = 0 END AS death, out_degree > 1 AS split, in_degree > 1 AS merge FROM x)
SELECT node, in_degree, out_degree, NOT hb AS left_censored, NOT ha AS right_censored, birth, death, split, merge, CASE WHEN hb THEN round(1 - coalesce(best, 0), 6) END AS novelty, shift_candidate,
 coalesce(nullif(concat_ws(' + ', CASE WHEN birth THEN 'birth' END, CASE WHEN death THEN 'death' END, CASE WHEN split THEN 'split' END, CASE WHEN merge THEN 'merge' END, CASE WHEN shift_candidate THEN 'shift_candidate' END), ''), 'continuation / censored') AS event FROM y""")
def topic_events(spark, sf):
    s = _Slices(spark, sf)
    return O.events(s.nodes, s.pairs, s.edges(), s.coverage).drop("window").withColumn("novelty", F.round("novelty", 6))


_PARENTS = ", f AS (SELECT * FROM ed QUALIFY row_number() OVER (PARTITION BY target ORDER BY similarity DESC, source) = 1), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY similarity DESC, target) = 1 AS continues FROM f)"
_TRACKS = _PARENTS + """, chain(node, track) AS (SELECT node, node FROM nodes WHERE node NOT IN (SELECT target FROM c WHERE continues) UNION ALL SELECT c.target, chain.track FROM chain JOIN c ON c.source = chain.node AND c.continues),
art AS (SELECT node, count(DISTINCT capture_url) AS articles FROM m JOIN obs USING (win) GROUP BY 1), tr AS (SELECT nodes.*, track, articles FROM nodes JOIN chain USING (node) JOIN art USING (node)),
st AS (SELECT track, sum(articles) AS article_months, count(*) AS months, sum(articles) * sqrt(count(*)) AS score FROM tr GROUP BY 1)"""


@query(f"WITH {_PARTS}{_PARENTS} SELECT source, target, round(similarity, 6) AS similarity, continues FROM c")
def primary_parents(spark, sf):
    return O.primary_parents(_Slices(spark, sf).edges()).withColumn("similarity", F.round("similarity", 6))


def _tracked(s: _Slices) -> tuple[DataFrame, DataFrame]:
    parents = cut(O.primary_parents(s.edges()))
    pages = s.members.select("point_id", F.substring_index("capture_url", "#", 1).alias("article_id"))
    seen = s.members.join(s.coverage.filter("observed").select("window"), "window")
    nodes = s.nodes.select("node", "window", "size", "prevalence").join(O.articles(seen, pages), "node")
    return O.tracks(nodes, parents), parents


@query(f"WITH RECURSIVE {_PARTS}{_TRACKS} SELECT node, track FROM tr")
def lineage_tracks(spark, sf):
    return _tracked(_Slices(spark, sf))[0].select("node", "track")


@query(f"WITH {_MONTHS} SELECT node, count(DISTINCT capture_url) AS articles FROM m JOIN obs USING (win) GROUP BY 1")
def articles_per_topic(spark, sf):
    m = _members(spark, sf)
    pages = m.select("point_id", F.substring_index("capture_url", "#", 1).alias("article_id"))
    return O.articles(m.join(_coverage(m).filter("observed").select("window"), "window"), pages)


@query(f"WITH RECURSIVE {_PARTS}{_TRACKS} SELECT track, article_months::BIGINT AS article_months, months, round(score, 6) AS score FROM st")
def track_statistics(spark, sf):
    return O.track_statistics(_tracked(_Slices(spark, sf))[0]).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_PARTS}{_TRACKS}, g AS (SELECT s.win, track FROM spine s, st), k AS (SELECT win, track, sum(articles) AS n FROM tr GROUP BY ALL)
SELECT strftime(g.win, '%Y-%m') AS month, g.track, CASE WHEN g.win IN (SELECT win FROM obs) THEN coalesce(n, 0)::BIGINT END AS articles FROM g LEFT JOIN k USING (win, track)""")
def track_counts(spark, sf):
    s = _Slices(spark, sf)
    return O.track_counts(_tracked(s)[0], s.coverage).select(F.date_format("window", "yyyy-MM").alias("month"), "track", "articles")


@query()
def topic_forest(spark, sf):
    return O.forest(*_tracked(_Slices(spark, sf)))


@query(f"WITH {_PARTS}, a AS (SELECT win, count(*) AS k FROM nodes GROUP BY 1) SELECT strftime(s.win, '%Y-%m') AS month, coalesce(k, 0) AS new, sum(coalesce(k, 0)) OVER (ORDER BY s.win)::BIGINT AS shown FROM spine s LEFT JOIN a USING (win)")
def cumulative_reveal(spark, sf):
    s = _Slices(spark, sf)
    return O.revealed(s.nodes, s.coverage).select(F.date_format("window", "yyyy-MM").alias("month"), "new", "shown")


@query(f"WITH {_MONTHS} SELECT node, row_number() OVER (PARTITION BY win ORDER BY count(*) DESC, node) AS rank FROM m GROUP BY win, node")
def node_rank_in_window(spark, sf):
    return E.largest(_members(spark, sf), ["node"], ["window"], 1 << 30).select("node", "rank")


@query(rf"""WITH {_MONTHS}, q AS (SELECT doc_id, 'Q' || quarter(win) AS win, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains({_STOP}, x))) AS w FROM m), t AS (SELECT doc_id, win, unnest(w) AS term FROM q),
v AS (SELECT term, count(*) AS df FROM t GROUP BY 1 HAVING df >= 3 AND df <= 0.8 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 1200), h AS (SELECT t.* FROM t JOIN v USING (term)), n AS (SELECT win, count(*) AS n FROM q GROUP BY 1),
d AS (SELECT win, term, count(*) AS df FROM h GROUP BY ALL), c AS (SELECT x.win, x.term AS a, y.term AS b, count(*) AS together FROM h x JOIN h y ON x.doc_id = y.doc_id AND x.term < y.term GROUP BY ALL HAVING together >= 3)
SELECT c.win AS "window", a, b, together, round(ln(together * n / (da.df * db.df)) / -ln(together / n), 6) AS npmi FROM c JOIN n USING (win) JOIN d da ON da.win = c.win AND da.term = a JOIN d db ON db.win = c.win AND db.term = b
WHERE together < n AND round(ln(together * n / (da.df * db.df)) / -ln(together / n), 6) >= 0.15""")
def term_field(spark, sf):
    return O.npmi(_quarters(spark, sf), "point_id", "quarter")


def _quarters(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).select("point_id", "text", F.concat(F.lit("Q"), F.quarter("window").cast("string")).alias("quarter"))


@query()
def term_communities(spark, sf):
    return O.term_fields(cut(O.npmi(_quarters(spark, sf), "point_id", "quarter")))


@query(f"WITH {T.CHUNKS} SELECT topic, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, topic) AS rank FROM chunks WHERE topic >= 0 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_topics(spark, sf):
    return E.largest(T.chunks(spark, sf).filter("topic >= 0"), ["topic"], [], 5)


@query(f"WITH {T.CHUNKS} SELECT month, tier, topic, count(*) AS n, row_number() OVER (PARTITION BY month, tier ORDER BY count(*) DESC, topic) AS rank FROM chunks WHERE topic >= 0 GROUP BY month, tier, topic QUALIFY rank <= 2")
def top_topics_per_month_tier(spark, sf):
    return E.largest(T.chunks(spark, sf).filter("topic >= 0"), ["topic"], ["month", "tier"], 2)


@query(f"WITH {T.CHUNKS}, n AS (SELECT month, tier, count(*) AS n FROM chunks GROUP BY ALL) SELECT month, min(n) AS least FROM n GROUP BY 1 ORDER BY count(DISTINCT tier) DESC, 2 DESC, 1 LIMIT 1")
def preview_month(spark, sf):
    return E.preview_period(T.chunks(spark, sf).groupBy("month", "tier").agg(F.count("*").alias("n")), "month", "tier", "n")


@query(f"WITH {T.CHUNKS}, n AS (SELECT month, tier, count(*) AS n FROM chunks GROUP BY ALL) SELECT month, tier, n, sum(n) OVER (PARTITION BY tier ORDER BY month)::BIGINT AS total FROM n")
def tier_running_totals(spark, sf):
    return E.running_totals(T.chunks(spark, sf).groupBy("month", "tier").agg(F.count("*").alias("n")), "tier", "month", "n")


@query()
def topic_plane(spark, sf):
    c = T.chunks(spark, sf).filter("topic >= 0")
    p = cut(O.plane(c, "point_id")).join(c.select("point_id", "topic", F.col("month").alias("window")), "point_id")
    return O.intertopic_map(p, p.select("window").distinct())


@query()
def topic_model(spark, sf):
    from textloom.functions.geo import unit

    c = T.chunks(spark, sf).select("point_id", F.to_date(F.concat("month", F.lit("-01"))).alias("window"), unit(F.col("v")).alias("v"))
    m = O.topic_slices(c, "window", "point_id", min_docs=20, min_size=5)
    return m.groupBy("node").agg(F.count("*").alias("size"))
