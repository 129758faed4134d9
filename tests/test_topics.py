"""Topics over months with a missing and an unobserved month, against a plain version of the rules."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import topics as O


def month(i):
    return dt.date(2020 + (i - 1) // 12, (i - 1) % 12 + 1, 1)


TEXTS = {  # month -> topic -> words; month 4 has too few documents, month 5 none
    1: {"a": "red green blue", "b": "one two three"},
    2: {"a": "red green yellow", "b": "one two four"},
    3: {"a": "red green yellow", "c": "red green pink", "b": "nothing alike"},
    4: {"a": "red green yellow"},
    6: {"a": "red green yellow", "b": "one two three"},
    7: {"a": "red green yellow", "d": "red one"},
}


def rows():
    out = []
    for m, topics in TEXTS.items():
        for t, words in topics.items():
            for k in range(1 if m == 4 else 3):
                out.append((len(out), month(m), f"{m}:{t}", words, f"https://x.test/{k % 2}#{k}", [float(m), 1.0]))
    return out


def sliced(spark):
    members = spark.createDataFrame(rows(), "point_id long, window date, node string, text string, url string, v array<double>")
    cov = O.coverage(members, members, "window", 2)
    parts = O.shares(members, cov)
    return members, cov, parts, O.records(members, cov, parts), O.neighbours(parts, cov)


def test_events_and_lineage(spark):
    members, cov, parts, nodes, pairs = sliced(spark)
    got = {r["window"].month: (r["n_docs"], r["n_topics"], r["status"], r["observed"]) for r in cov.collect()}
    assert got == {1: (6, 2, "ok", True), 2: (6, 2, "ok", True), 3: (9, 3, "ok", True), 4: (1, 0, "too_small", False), 5: (0, 0, "empty", False), 6: (6, 2, "ok", True), 7: (6, 2, "ok", True)}
    share = {}
    for r in parts.collect():
        share.setdefault(r["node"], {})[r["term"]] = r["p"]
    assert "4:a" not in share
    links = O.edges(pairs, cov, nodes, 0.45, centroids=O.centroids(members))
    want = {}
    for a in share:
        for b in share:
            if int(b[0]) - int(a[0]) == 1:
                dot = sum(share[a].get(t, 0) * p for t, p in share[b].items())
                c = dot / math.sqrt(sum(x * x for x in share[a].values()) * sum(x * x for x in share[b].values()))
                js = 0.0
                for t in {*share[a], *share[b]}:
                    p, q = share[a].get(t, 0), share[b].get(t, 0)
                    js += sum(x * math.log2(2 * x / (p + q)) / 2 for x in (p, q) if x)
                if c >= 0.45:
                    want[a, b] = (round(c, 6), round(js, 6))
    assert {(r["source"], r["target"]): (round(r["similarity"], 6), round(r["js_divergence"], 6)) for r in links.collect()} == want
    assert all(str(r["available_at"]).endswith("23:59:59.999999") for r in links.collect())
    e = {r["node"]: r for r in O.events(nodes, pairs, links, cov).collect()}
    assert e["1:a"]["birth"] is None and e["1:a"]["novelty"] is None and e["1:a"]["left_censored"]
    assert e["3:b"]["birth"] is True and e["3:b"]["novelty"] == 1.0 and e["3:b"]["death"] is None and e["3:b"]["right_censored"]
    assert e["2:a"]["split"] and "split" in e["2:a"]["event"] and e["2:b"]["death"] is True
    assert e["6:a"]["birth"] is None and e["7:d"]["merge"] == (sum(t == "7:d" for _, t in want) > 1)
    parents = O.primary_parents(links)
    tracked = O.tracks(O.articles(members.join(cov.filter("observed").select("window"), "window"), members.select("point_id", F.substring_index("url", "#", 1).alias("article_id"))).join(nodes.select("node", "window"), "node"), parents)
    t = {r["node"]: (r["track"], r["articles"]) for r in tracked.collect()}
    assert t["3:a"] == ("1:a", 2) and t["3:c"][0] == "3:c" and t["6:a"][0] == "6:a"
    stats = {r["track"]: (r["article_months"], r["months"]) for r in O.track_statistics(tracked).collect()}
    assert stats["1:a"] == (6, 3)
    counts = {(r["window"].month, r["track"]): r["articles"] for r in O.track_counts(tracked, cov).collect()}
    assert counts[4, "1:a"] is None and counts[6, "1:a"] == 0 and counts[2, "1:a"] == 2
    drawn = O.forest(tracked, parents, 3).orderBy("place").collect()
    assert len(drawn) == 3 and drawn[0]["track"] == "1:a" and all(r["parent_track"] is None or r["parent_track"] in {x["track"] for x in drawn} for r in drawn)


def test_communities():
    links = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "xyz" for i in range(5) for j in range(i + 1, 5)] + [("x0", "y0", 0.2), ("y1", "z1", 0.2)]
    names = sorted({n for a, b, _ in links for n in (a, b)})
    got = O.communities(names, links)
    assert got == {n: f"{n[0]}0" for n in names}


def test_fields_and_models(spark):
    docs = spark.createDataFrame([(i, month(1 + i % 2), "alpha beta gamma delta" if i % 4 < 2 else "lorem ipsum dolor sit") for i in range(80)], "i long, w date, text string")
    graph = O.npmi(docs, "i", "w", min_together=2, max_df=1.0)
    fields = O.term_fields(graph)
    got = {}
    for r in fields.collect():
        got.setdefault((r["w" if "w" in r else "window"], r["field"]), set()).add(r["term"])
    assert set(map(frozenset, got.values())) == {frozenset("alpha beta gamma delta".split()), frozenset("lorem ipsum dolor sit".split())}
    assert O.field_members(docs, fields, "i", "w").count() == 80
    rng = np.random.default_rng(3)
    v = np.concatenate([c + 0.05 * rng.standard_normal((40, 8)) for c in np.eye(8)[:3]] + [-np.eye(8)[7:8]])
    v /= np.linalg.norm(v, axis=1)[:, None]
    chunks = spark.createDataFrame([(i, month(1), x.tolist()) for i, x in enumerate(v)], "i long, w date, v array<double>")
    m = O.topic_slices(chunks, "w", "i", min_docs=20, min_size=10).collect()
    home = {}
    for r in m:
        home.setdefault(r["node"], set()).add(r["point_id"] // 40)
    assert len(m) == 120 and all(len(x) == 1 for x in home.values())
    p = O.plane(chunks, "i").collect()
    x = v - v.mean(0)
    s = np.linalg.svd(x, compute_uv=False)
    assert abs(np.std([r["x"] for r in p]) * np.sqrt(len(p)) - s[0]) < 1e-6
