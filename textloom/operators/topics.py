"""Topics over windows: coverage of a dense spine, links between adjacent observed windows, events, lineages.

``members`` has (node, window, point_id) and further columns; ``windows`` are first days of months. A topic is a node
of one window. Windows without enough documents are unobserved: nothing is linked across them, and births and
deaths beside them are unknown.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.lineage import cut

#: Terms of a text: words of two word characters or more, lower-cased.
TERM = r"[\p{L}\p{N}_]{2,}"
#: Words that say nothing of a topic: fixed values.
STOP_WORDS = (
    "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "but", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "he", "her", "him", "his", "how",
    "if", "in", "into", "is", "it", "its", "me", "more", "most", "my", "no", "not", "of", "on", "one", "only", "or", "other", "our", "out", "over", "she", "should", "so", "some", "such", "than", "that", "the", "their", "them",
    "then", "there", "these", "they", "this", "those", "through", "to", "up", "was", "we", "were", "what", "when", "where", "which", "while", "who", "will", "with", "would", "you", "your",
)


def terms(text: Column, stop: tuple[str, ...] = STOP_WORDS, pairs: bool = False) -> Column:
    """The terms of a text in order, without stop words; with ``pairs`` also those of two successive terms."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)), lambda w: ~w.isin(*stop))
    if not pairs:
        return words
    two = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.when(i < F.size(w), F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1))))
    return F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.concat(w, F.filter(two(w), lambda x: x.isNotNull()))).otherwise(w)), 0)


def vocabulary(docs: DataFrame, key: str, pairs: bool = False, min_df: int = 2, max_df: float = 0.95, features: int = 20_000) -> DataFrame:
    """(term, df): the most frequent terms by number of documents, within the bounds."""
    t = docs.select(key, F.explode(F.array_distinct(terms(F.col("text"), pairs=pairs))).alias("term"))
    n = docs.agg(F.count("*").alias("n"))  # one row
    df = t.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))
    return df.select("term", "df").orderBy(F.desc("df"), "term").limit(features)


def coverage(docs: DataFrame, members: DataFrame, window: str = "window", min_docs: int = 50) -> DataFrame:
    """(window, n_docs, n_topics, outlier_fraction, status, observed, window_end) of every month from first to last.

    Nodes count only in windows of ``min_docs`` documents or more.
    """
    spine = docs.agg(F.min(window).alias("a"), F.max(window).alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("window"))
    n = docs.groupBy(F.col(window).alias("window")).agg(F.count("*").alias("n_docs"))
    m = members.groupBy("window").agg(F.count_distinct("node").alias("n_topics"), F.count_distinct("point_id").alias("assigned"))
    out = spine.join(n, "window", "left").join(m, "window", "left")
    many, enough = F.coalesce("n_docs", F.lit(0)), F.coalesce("n_docs", F.lit(0)) >= min_docs
    topics = F.when(enough, F.coalesce("n_topics", F.lit(0))).otherwise(0)
    status = F.when(many == 0, "empty").when(~enough, "too_small").when(topics == 0, "no_topics").otherwise("ok")
    end = F.add_months("window", 1).cast("timestamp") - F.expr("interval 1 microsecond")
    return out.select("window", many.alias("n_docs"), topics.alias("n_topics"), F.when(enough, 1 - F.coalesce("assigned", F.lit(0)) / many).alias("outlier_fraction"), status.alias("status"), (topics > 0).alias("observed"), end.alias("window_end"))


def shares(members: DataFrame, observed: DataFrame, words: DataFrame | None = None, pairs: bool = False) -> DataFrame:
    """(window, node, term, n, p): terms of each node of an observed window, and their shares of the node.

    ``members`` has a column text; ``words`` is the vocabulary, all terms without it.
    """
    m = members.join(observed.filter("observed").select("window"), "window")
    t = m.select("window", "node", F.explode(terms(F.col("text"), pairs=pairs)).alias("term"))
    if words is not None:
        t = t.join(words.select("term"), "term")
    n = t.groupBy("window", "node", "term").agg(F.count("*").alias("n"))
    total = n.groupBy(F.col("node").alias("of")).agg(F.sum("n").alias("total"))
    return n.join(total, F.col("node") == F.col("of")).select("window", "node", "term", "n", (F.col("n") / F.col("total")).alias("p"))


def records(members: DataFrame, observed: DataFrame, parts: DataFrame) -> DataFrame:
    """(node, window, size, prevalence, top_words, label) of the nodes that have terms."""
    size = members.groupBy("window", "node").agg(F.count_distinct("point_id").alias("size"))
    top = parts.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("p"), "term"))).filter("rank <= 10")
    top = top.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("t"))  # ten terms
    out = size.join(observed.filter("observed").select("window", "n_docs"), "window").join(top, "node")
    return out.select("node", "window", "size", (F.col("size") / F.col("n_docs")).alias("prevalence"), F.array_join("t", ", ").alias("top_words"), F.array_join(F.slice("t", 1, 3), " · ").alias("label"))


def neighbours(parts: DataFrame, observed: DataFrame) -> DataFrame:
    """(source, target, source_window, target_window, cosine, weighted_jaccard, js_divergence) of nodes that share a term.

    Only nodes of two successive months that are both observed meet. Shares of a node sum to 1, so sums over the
    terms that both have are enough for all three; nodes that share none have 0, 0 and 1, and no row.
    """
    seen = observed.filter("observed").select("window")
    step = seen.join(seen.select(F.col("window").alias("w")), F.add_months("window", 1) == F.col("w")).select("window", "w")
    norm = parts.groupBy("node").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    a = parts.join(step, "window").select(F.col("node").alias("source"), F.col("window").alias("source_window"), "w", "term", "p")
    b = parts.select(F.col("node").alias("target"), F.col("window").alias("w"), "term", F.col("p").alias("q"))
    p, q = F.col("p"), F.col("q")
    both = a.join(b, ["w", "term"]).groupBy("source", "target", "source_window", F.col("w").alias("target_window"))
    s = both.agg(F.sum(p * q).alias("dot"), F.sum(F.least(p, q)).alias("low"), F.sum(p * F.log2(p / (p + q)) + q * F.log2(q / (p + q))).alias("js"))
    s = s.join(norm.select(F.col("node").alias("source"), F.col("norm").alias("na")), "source").join(norm.select(F.col("node").alias("target"), F.col("norm").alias("nb")), "target")
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return s.select("source", "target", "source_window", "target_window", clip(F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"), (F.col("low") / (2 - F.col("low"))).alias("weighted_jaccard"), clip(1 + F.col("js") / 2).alias("js_divergence"))


def edges(pairs: DataFrame, observed: DataFrame, nodes: DataFrame, threshold: float = 0.45, metric: str = "cosine", centroids: DataFrame | None = None) -> DataFrame:
    """Pairs of at least this similarity, with what changed between them; known when the target's window has ended."""
    if not 0 < threshold <= 1 or metric not in ("cosine", "weighted_jaccard"):
        raise ValueError("0 < threshold <= 1, and cosine or weighted_jaccard")
    e = pairs.withColumn("similarity", F.col(metric)).filter(F.round("similarity", 9) >= threshold)
    e = e.join(observed.select(F.col("window").alias("target_window"), F.col("window_end").alias("available_at")), "target_window")
    one, two = (nodes.select(F.col("node").alias(n), F.col("prevalence").alias(f"prevalence_{n}")) for n in ("source", "target"))
    e = e.join(one, "source").join(two, "target").withColumn("prevalence_delta", F.col("prevalence_target") - F.col("prevalence_source"))
    columns = ["source", "target", "source_window", "target_window", "available_at", "similarity", "js_divergence", "prevalence_delta"]
    if centroids is not None:  # (node, c)
        one, two = (centroids.select(F.col("node").alias(n), F.col("c").alias(f"c_{n}")) for n in ("source", "target"))
        e = e.join(one, "source", "left").join(two, "target", "left")
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        a, b = F.col("c_source"), F.col("c_target")
        e = e.withColumn("embedding_cosine", dot(a, b) / F.sqrt(dot(a, a) * dot(b, b)))
        columns.append("embedding_cosine")
    return e.select(*columns)


def centroids(members: DataFrame) -> DataFrame:
    """(node, c): the mean vector (column v) of each node."""
    x = members.select("node", F.posexplode("v").alias("dim", "x")).groupBy("node", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return x.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("c"))  # a number a dimension


def events(nodes: DataFrame, pairs: DataFrame, links: DataFrame, observed: DataFrame, metric: str = "cosine", shift: float = 0.35) -> DataFrame:
    """Degrees, novelty, censoring and events of every node.

    Novelty is one less the best similarity to any node of the month before, linked or not. Birth, death and
    novelty are null where that month, or the next, is missing or unobserved.
    """
    best = pairs.groupBy(F.col("target").alias("node")).agg(F.max(metric).alias("best"))
    into = links.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_degree"), F.bool_or(F.col("js_divergence") >= shift).alias("moved"))
    out = links.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out_degree"))
    seen = observed.filter("observed")
    before = seen.select(F.add_months("window", 1).alias("window"), F.lit(True).alias("has_before"))
    after = seen.select(F.add_months("window", -1).alias("window"), F.lit(True).alias("has_after"))
    n = nodes.select("node", "window").join(before, "window", "left").join(after, "window", "left")
    for part in (best, into, out):
        n = n.join(part, "node", "left")
    n = n.na.fill(0, ["in_degree", "out_degree"]).na.fill(False, ["has_before", "has_after", "moved"])
    n = n.select(
        "node", "window", "in_degree", "out_degree", (~F.col("has_before")).alias("left_censored"), (~F.col("has_after")).alias("right_censored"),
        F.when(F.col("has_before"), F.col("in_degree") == 0).alias("birth"), F.when(F.col("has_after"), F.col("out_degree") == 0).alias("death"),
        (F.col("out_degree") > 1).alias("split"), (F.col("in_degree") > 1).alias("merge"),
        F.when(F.col("has_before"), 1 - F.coalesce("best", F.lit(0.0))).alias("novelty"), F.col("moved").alias("shift_candidate"),
    )
    names = F.concat_ws(" + ", *[F.when(F.col(x), F.lit(x)) for x in ("birth", "death", "split", "merge", "shift_candidate")])
    return n.withColumn("event", F.when(names == "", "continuation / censored").otherwise(names))


def primary_parents(links: DataFrame) -> DataFrame:
    """The best source of each target, then, of those that are left, whether it is the source's best."""
    first = links.groupBy("target").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "source")).alias("x")).select(F.col("x.source").alias("source"), "target", (-F.col("x.s")).alias("similarity"))
    best = first.groupBy("source").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "target")).alias("x")).select(F.col("source").alias("of"), F.col("x.target").alias("best"))
    return first.join(best, F.col("source") == F.col("of")).select("source", "target", "similarity", (F.col("target") == F.col("best")).alias("continues"))


def tracks(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """``nodes`` with ``track``: the first node of the chain of continuations that each belongs to.

    ``parents`` is as of primary_parents(). Chains are halved each round, so rounds are the logarithm of the windows.
    """
    up = parents.filter("continues").select(F.col("target").alias("node"), F.col("source").alias("track"))
    at = cut(nodes.join(up, "node", "left").withColumn("track", F.coalesce("track", "node")))
    while True:
        further = at.select(F.col("node").alias("track"), F.col("track").alias("next"))
        jumped = cut(at.join(further, "track"))
        at = jumped.drop("track").withColumnRenamed("next", "track")
        if jumped.filter("track <> next").isEmpty():
            return at


def articles(members: DataFrame, pages: DataFrame) -> DataFrame:
    """(node, articles): different pages of each node. ``pages`` has a row a point: (point_id, article_id)."""
    checked = members.join(pages.select(F.col("point_id").alias("page_point"), "article_id"), F.col("point_id") == F.col("page_point"), "left")
    missing = F.coalesce(F.col("article_id"), F.lit("")) == ""
    article = F.when(missing, F.raise_error(F.lit("every member needs the url of its page"))).otherwise(F.col("article_id"))
    return checked.groupBy("node").agg(F.count_distinct(article).alias("articles"))


def track_statistics(tracked: DataFrame) -> DataFrame:
    """(track, article_months, months, score) of nodes with their track and articles."""
    s = tracked.groupBy("track").agg(F.sum("articles").alias("article_months"), F.count("*").alias("months"))
    return s.withColumn("score", F.col("article_months") * F.sqrt("months"))


def track_counts(tracked: DataFrame, observed: DataFrame) -> DataFrame:
    """(window, track, articles) of every month and track: 0 where the track is absent, null where the month is unobserved."""
    grid = observed.select("window", "observed").crossJoin(tracked.select("track").distinct())  # months by tracks, as they are drawn
    n = tracked.groupBy("window", "track").agg(F.sum("articles").alias("n"))
    return grid.join(n, ["window", "track"], "left").select("window", "track", F.when(F.col("observed"), F.coalesce("n", F.lit(0))).alias("articles"))


def forest(tracked: DataFrame, parents: DataFrame, most: int = 12) -> DataFrame:
    """(track, parent_track, first_window, article_months, place): the tracks that are drawn, siblings together.

    By falling score a track comes in with all of its ancestors, if they fit within ``most``. Candidates are the
    tracks; their table (a row a track) is taken in order on the driver until ``most`` are chosen, so only as many
    rows as it takes come there, in blocks.
    """
    stats = track_statistics(tracked)
    roots = tracked.filter("node = track").select("track", F.col("window").alias("first_window"))
    up = parents.filter("not continues").select(F.col("target").alias("track"), F.col("source").alias("node"))
    up = up.join(tracked.select("node", F.col("track").alias("parent_track")), "node").select("track", "parent_track")
    table = cut(stats.join(roots, "track").join(up, "track", "left"))
    parent: dict[str, str | None] = {}
    rows: dict[str, dict] = {}
    chosen: list[str] = []

    def load(names: list[str]) -> None:
        while missing := [n for n in names if n and n not in parent]:
            for r in table.filter(F.col("track").isin(missing)).collect():
                parent[r["track"]], rows[r["track"]] = r["parent_track"], r.asDict()
            names = [parent[n] for n in missing]

    ordered = table.orderBy(F.desc("score"), F.desc("article_months"), "track").select("track").limit(64 * most)
    for r in ordered.collect():
        load([r["track"]])
        chain, at = [], r["track"]
        while at and at not in chosen:
            chain.append(at)
            at = parent[at]
        if len(chosen) + len(chain) <= most:
            chosen += chain
        if len(chosen) == most:
            break
    out: list[str] = []
    heap = [(rows[t]["first_window"], t) for t in chosen if parent[t] is None]
    heapq.heapify(heap)

    def visit(t: str) -> None:
        out.append(t)
        for _, child in sorted((rows[c]["first_window"], c) for c in chosen if parent[c] == t):
            visit(child)

    while heap:
        visit(heapq.heappop(heap)[1])
    kind = dict(table.dtypes)
    data = [(t, parent[t], rows[t]["first_window"], rows[t]["article_months"], i) for i, t in enumerate(out)]
    return tracked.sparkSession.createDataFrame(data, f"track string, parent_track string, first_window {kind['first_window']}, article_months long, place int")


def revealed(nodes: DataFrame, observed: DataFrame) -> DataFrame:
    """(window, new, shown): nodes that a frame adds, and all that it shows."""
    n = nodes.groupBy("window").agg(F.count("*").alias("new"))
    out = observed.select("window").join(n, "window", "left").na.fill(0, ["new"])
    return out.withColumn("shown", F.sum("new").over(Window.orderBy("window")))  # a row a month


def _together(features: int):
    """(window, i, j, together) of a task's documents: products of their 0/1 matrices over the vocabulary with themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        names = ["window", "i", "j", "together"]
        for batch in batches:
            windows = batch.column(0).to_pylist()
            for w in sorted(set(windows), key=str):
                at = pa.array([k for k, x in enumerate(windows) if x == w], pa.int64())
                for k in range(0, len(at), 2048):
                    t = batch.column(1).take(at[k : k + 2048])
                    held = np.zeros((len(t), features), np.float32)
                    held[pc.list_parent_indices(t).to_numpy(), t.flatten().to_numpy()] = 1
                    total[w] = total.get(w, 0) + np.triu((held.T @ held)).astype(np.int64)
            if len(total) > 8:  # a few windows' matrices at once
                yield from _rows(total, names, batch.column(0).type)
                total = {}
        if total:
            yield from _rows(total, names, batch.column(0).type)

    return run


def _rows(total: dict, names: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for w, m in total.items():
        a, b = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array([w] * len(a), kind), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(m[a, b])], names=names)


def npmi(docs: DataFrame, key: str, window: str, features: int = 1200, min_df: int = 3, max_df: float = 0.8, min_together: int = 3, least: float = 0.15) -> DataFrame:
    """(window, a, b, together, npmi) of terms that occur in the same documents of a window.

    The vocabulary is the ``features`` terms of most documents of the whole corpus. Each task counts the pairs of its
    documents in a matrix of that many, squared, and counts are summed over the tasks: no document's pairs become rows.
    """
    chosen = sorted(r["term"] for r in vocabulary(docs, key, False, min_df, max_df, features).collect())  # at most features rows
    spark = docs.sparkSession
    words = spark.createDataFrame(list(enumerate(chosen)), "at int, term string")
    t = docs.select(key, F.col(window).alias("window"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    held = t.join(F.broadcast(words), "term").groupBy(key, "window").agg(F.collect_list("at").alias("t")).select("window", "t")
    kind = dict(held.dtypes)["window"]
    counts = held.mapInArrow(_together(len(chosen)), f"window {kind}, i int, j int, together long")
    counts = counts.groupBy("window", "i", "j").agg(F.sum("together").alias("together"))
    alone = counts.filter("i = j").select("window", F.col("i").alias("at"), F.col("together").alias("df"))
    n = docs.groupBy(F.col(window).alias("window")).agg(F.count("*").alias("n"))
    pairs = counts.filter((F.col("i") < F.col("j")) & (F.col("together") >= min_together))
    pairs = pairs.join(alone.select("window", F.col("at").alias("i"), F.col("df").alias("df_a")), ["window", "i"]).join(alone.select("window", F.col("at").alias("j"), F.col("df").alias("df_b")), ["window", "j"]).join(n, "window")
    x, size = F.col("together"), F.col("n")
    value = F.round(F.ln(x * size / (F.col("df_a") * F.col("df_b"))) / -F.ln(x / size), 6)
    one, two = words.select(F.col("at").alias("i"), F.col("term").alias("a")), words.select(F.col("at").alias("j"), F.col("term").alias("b"))
    out = pairs.filter(x < size).join(F.broadcast(one), "i").join(F.broadcast(two), "j")
    return out.select("window", "a", "b", "together", value.alias("npmi")).filter(F.col("npmi") >= least)


def communities(nodes: list[str], links: list[tuple[str, str, float]], rounds: int = 20) -> dict[str, str]:
    """Node -> community, by greedy moves that raise the modularity, level by level; in a fixed order, so reruns agree."""
    weight: dict[str, dict[str, float]] = {n: {} for n in nodes}
    for a, b, w in links:
        weight[a][b] = weight[a].get(b, 0.0) + w
        weight[b][a] = weight[b].get(a, 0.0) + w
    home = {n: n for n in nodes}
    level, inner = weight, dict.fromkeys(nodes, 0.0)
    total = sum(sum(x.values()) for x in weight.values()) or 1.0
    while True:
        of = {n: n for n in level}
        degree = {n: sum(level[n].values()) + 2 * inner[n] for n in level}
        held = dict(degree)
        moved_any = False
        for _ in range(rounds):
            moved = False
            for n in sorted(level):
                near: dict[str, float] = defaultdict(float)
                for m, w in level[n].items():
                    near[of[m]] += w
                held[of[n]] -= degree[n]
                gain = {c: w - held[c] * degree[n] / total for c, w in near.items()}
                gain.setdefault(of[n], -held[of[n]] * degree[n] / total)
                best = min(gain, key=lambda c: (-round(gain[c], 12), c != of[n], c))
                moved |= best != of[n]
                of[n] = best
                held[best] += degree[n]
            moved_any |= moved
            if not moved:
                break
        home = {n: of[c] for n, c in home.items()}
        if not moved_any:
            break
        new: dict[str, dict[str, float]] = {c: {} for c in of.values()}
        new_inner = dict.fromkeys(new, 0.0)
        for n, near in level.items():
            new_inner[of[n]] += inner[n]
            for m, w in near.items():
                if of[n] == of[m]:
                    new_inner[of[n]] += w / 2
                else:
                    new[of[n]][of[m]] = new[of[n]].get(of[m], 0.0) + w
        level, inner = new, new_inner
    least: dict[str, str] = {}
    for n, c in home.items():
        least[c] = min(n, least.get(c, n))
    return {n: least[c] for n, c in home.items()}


def term_fields(graph: DataFrame, min_terms: int = 3) -> DataFrame:
    """(window, field, term): communities of a window's term graph, largest first, of three terms or more.

    A window's graph has at most the vocabulary squared links, so it is one group however large the corpus is.
    """
    kind = dict(graph.dtypes)["window"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        of = communities(names, list(pdf[["a", "b", "npmi"]].sort_values(["a", "b"]).itertuples(index=False, name=None)))
        groups: dict[str, list[str]] = defaultdict(list)
        for n in names:
            groups[of[n]].append(n)
        ranked = sorted((g for g in groups.values()), key=lambda g: (-len(g), g[0]))
        rows = [(pdf["window"].iloc[0], i, t) for i, g in enumerate(ranked) if len(g) >= min_terms for t in g]
        return pd.DataFrame(rows, columns=["window", "field", "term"])

    return graph.groupBy("window").applyInPandas(run, f"window {kind}, field int, term string")


def field_members(docs: DataFrame, fields: DataFrame, key: str, window: str) -> DataFrame:
    """(node, window, point_id): a document belongs to every field of its window that it has a term of."""
    t = docs.select(F.col(key).alias("point_id"), F.col(window).alias("window"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    node = F.concat(F.lit("field:"), F.date_format("window", "yyyy-MM-dd"), F.lit(":"), F.col("field").cast("string"))
    return t.join(fields, ["window", "term"]).select(node.alias("node"), "window", "point_id").distinct()


def cluster(v: np.ndarray, min_size: int = 20, seed: int = 42) -> np.ndarray:
    """Centroids of the groups of unit vectors: spherical k-means, groups below ``min_size`` left out."""
    rng = np.random.default_rng(seed)
    k = max(1, len(v) // (2 * min_size))
    c = v[rng.choice(len(v), min(k, len(v)), replace=False)]
    for _ in range(15):
        near = (v @ c.T).argmax(1)
        total = np.zeros_like(c)
        np.add.at(total, near, v)
        norm = np.linalg.norm(total, axis=1)
        c = total[norm > 0] / norm[norm > 0, None]
    return c[np.bincount((v @ c.T).argmax(1), minlength=len(c)) >= min_size]


def topic_slices(chunks: DataFrame, window: str, key: str, min_docs: int = 50, min_size: int = 20, far: float = 0.35, sample: int = 5000, seed: int = 42) -> DataFrame:
    """(node, window, point_id) of each window's own topics; a chunk farther than cosine ``far`` from all is in none.

    Centroids of a window are fitted on a bounded sample of it (``sample`` chunks, by hash), a matrix a window; every
    chunk is then assigned, without a shuffle of its own. ``chunks`` has unit vectors in v.
    """
    kind = dict(chunks.select(F.col(window).alias("w")).dtypes)["w"]
    own = chunks.select(F.col(window).alias("window"), F.col(key).alias("point_id"), F.col("v"))
    n = own.groupBy("window").agg(F.count("*").alias("n")).filter(F.col("n") >= max(min_docs, min_size, 6))
    slot = F.pmod(F.xxhash64(F.lit(seed), "point_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    drawn = own.join(n, "window").filter(slot < F.lit(float(sample)) / F.col("n"))
    name = f"window {kind}, topic int, c array<double>"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id")
        c = cluster(np.stack(pdf["v"].to_numpy()).astype(np.float64), max(1, round(min_size * len(pdf) / pdf["n"].iloc[0])), seed)
        return pd.DataFrame({"window": [pdf["window"].iloc[0]] * len(c), "topic": np.arange(len(c), dtype=np.int32), "c": list(c)})

    fitted = cut(drawn.groupBy("window").applyInPandas(fit, name))
    models = fitted.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("topic", "c"))).alias("model"))  # sample / (2 min_size) topics at most
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    best = F.array_max(F.transform("model", lambda m: F.struct(dot(m["c"], F.col("v")).alias("s"), (-m["topic"]).alias("t"))))
    near = own.join(models, "window").select("window", "point_id", best.alias("best")).filter(F.col("best.s") >= far)
    node = F.concat(F.lit("topic:"), F.date_format("window", "yyyy-MM-dd"), F.lit(":"), (-F.col("best.t")).cast("string"))
    return near.select(node.alias("node"), "window", "point_id")


def plane(chunks: DataFrame, key: str) -> DataFrame:
    """(key, x, y): the two principal components of all centred vectors, signs fixed by the largest loading."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    v = chunks.select(key, array_to_vector(F.transform("v", lambda x: x.cast("double"))).alias("features"))
    model = PCA(k=2, inputCol="features", outputCol="out").fit(v)
    pc_ = model.pc.toArray()
    pc_ = pc_ * np.sign(pc_[np.abs(pc_).argmax(0), [0, 1]])
    mean = v.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    at = lambda k: F.aggregate(F.zip_with("v", F.array(*[F.lit(float(x)) for x in pc_[:, k]]), lambda x, y: x.cast("double") * y), F.lit(float(-(mean @ pc_[:, k]))), lambda s, x: s + x)
    return chunks.select(key, at(0).alias("x"), at(1).alias("y"))


def intertopic_map(points: DataFrame, windows: DataFrame, most: int = 20) -> DataFrame:
    """(topic, window, n, x, y) of the largest topics in every window: their mean there, or over all where they are absent.

    ``points`` has (topic, window, x, y).
    """
    anchor = points.groupBy("topic").agg(F.count("*").alias("all"), F.avg("x").alias("ax"), F.avg("y").alias("ay")).orderBy(F.desc("all"), "topic").limit(most)
    per = points.groupBy("topic", "window").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    grid = windows.select("window").crossJoin(F.broadcast(anchor))  # most topics
    return grid.join(per, ["topic", "window"], "left").select("topic", "window", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", "ax").alias("x"), F.coalesce("y", "ay").alias("y"))
