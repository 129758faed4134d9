"""Each operator on empty tables, nulls, repeated rows, ties, long texts, clashing columns and odd ids."""

import hashlib
import random

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textloom.llm import ann, bpe, compact_windows, components, exchange, jaccard_forest, langid, mixing, quality, registry, suffix_dedup, url_rules, vector_dedup
from textloom.llm.registry import VOCABULARY
from textloom.llm.shingles import K, shingles, words

DIR = "/root/testdata/sf0.001"
#: Names that operators use themselves.
CLASH = ("chunk", "row_id", "body", "rest", "digest", "sig", "size", "copies", "k", "v", "dim", "component", "host", "path", "rule", "key", "kind", "quality", "target", "id", "of", "same", "n", "t", "lang_pred", "score")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH})


def texts(rng, n, most=150):
    return [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(1, most))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, repeated rows, shared ids, null and textual ids, a text of over a million bytes."""
    rng = random.Random(11)
    some = texts(rng, 6)
    long = " ".join(texts(rng, 1500, 300))
    rows = [("1", some[0], "en", "a", 1), ("2", some[0], "en", None, None), ("2", some[1], None, "a", 5), ("3", None, None, None, None), ("4", "", "en", "b", 0), ("5", " \n\t", "en", "b", 3), ("6", some[2], "fr", "b", 9), ("6", some[2], "fr", "b", 9), (None, some[0], "en", "a", 1), ("seven", some[0], "en", "a", 1), ("8", long, "en", "a", len(long)), ("9", long, "en", "c", len(long)), ("10", "中" * 100, "zh", "c", 100)]
    assert len(long) > 1_000_000
    return clashing(spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long"))


def test_text_operators(odd):
    n = odd.count()
    joined = {(r["doc_id"], r["n_links"], r["class_id"], r["kept"]) for r in jaccard_forest.join(odd).collect()}
    assert {(1, 1, 1, True), (2, 1, 1, False), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (6, 1, 6, True), (6, 1, 6, False), (None, 0, None, True), (8, 1, 8, True), (9, 1, 8, False)} <= joined
    kept = jaccard_forest.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == n - 3
    cut = suffix_dedup.remove_repeats(odd).collect()
    assert len(cut) == n and {r["doc_id"]: len(r["kept"]) for r in cut if r["doc_id"] in (3, 4, 9)} == {3: 0, 4: 0, 9: 0}
    left = compact_windows.clean_documents(odd)
    assert left.columns == odd.columns and left.count() == n
    got = {r["doc_id"]: r["text"] for r in left.collect()}
    assert got["3"] is None and got["4"] == "" and got["9"].strip() == "" and got["seven"] == odd.filter("doc_id = 'seven'").first()["text"]


def test_per_row_operators(odd):
    n = odd.count()
    coded = bpe.encode(odd, VOCABULARY)
    assert coded.count() == n
    back = {hashlib.sha256(bytes(r["decoded"])).hexdigest() for r in bpe.decode(coded, VOCABULARY).collect()}
    assert back == {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in odd.select("text").collect()}
    spans = bpe.decode_spans(coded.withColumns({"begin": F.lit(7), "end": F.lit(19)}), VOCABULARY)
    text = {r["doc_id"]: (r["text"] or "").encode() for r in odd.filter("doc_id in ('1', '8', '10', '3')").collect()}
    for r in spans.filter("doc_id in ('1', '8', '10', '3')").collect():
        t, got = text[r["doc_id"]], bytes(r["decoded"])
        assert t[r["begin"] : r["begin"] + len(got)] == got and t[7:19] in got
    named = langid.identify(odd).collect()
    assert len(named) == n and all(r["lang_pred"] == "und" and r["score"] == 0 for r in named if r["doc_id"] in ("3", "4", "5"))
    labels = odd.sparkSession.createDataFrame([("1", 1), ("8", 0), ("10", None), ("nobody", 1), ("6", 7)], "doc_id string, quality int")
    model = quality.fit(odd, labels)
    scored = quality.score(odd, model).collect()
    assert len(scored) == n and not any(r["accepted"] for r in scored if r["doc_id"] in ("3", "4"))
    assert quality.filter_documents(odd, model).columns == odd.columns
    assert quality.fit(odd, labels.filter("quality = 1")) is None and quality.filter_documents(odd, None).count() == n - 2


def test_mix_and_urls(spark, odd):
    mixed = mixing.mix(odd).collect()
    assert len(mixed) == odd.count() and all(r["copies"] == 0 for r in mixed if r["size"] == 0)
    assert mixing.repeat_rows(odd).columns == odd.columns
    pages = clashing(spark.createDataFrame([(1, "http://a.b.test/p"), (1, "http://a.b.test/p"), (None, "http://b.test/"), (2, None), (3, "x"), (4, "http://b.test/" + "p" * 200_000)], "page_id long, url string"))
    rules = spark.createDataFrame([("b.test", "/", "allow"), ("a.b.test", "/", "block"), ("b.test", "/p", "block"), ("b.test", "/", "block"), (None, "/", "block"), ("c.test", None, "block")], "host string, path string, action string")
    got = sorted(((r["page_id"] or 0, r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules).collect()), key=str)
    assert got == [(0, "b.test/", "block"), (1, "a.b.test/", "block"), (1, "a.b.test/", "block"), (2, None, "allow"), (3, None, "allow"), (4, "b.test/p", "block")]
    assert url_rules.judge(pages.limit(0), rules).count() == 0 and {r["verdict"] for r in url_rules.judge(pages, rules.limit(0), default="block").collect()} == {"block"}


def test_vector_ties(spark):
    v = [[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [0.0, 2.0], [-1.0, 0.0], None, [0.0, 0.0], [float("inf"), 0.0], [], [1.0, 0.0, 0.0], [None, 1.0]]
    df = clashing(spark.createDataFrame([(i if i != 2 else 1, x) for i, x in enumerate(v)], "vec_id long, embedding array<double>"))
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_duplicates(df).collect())
    assert got[:5] == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False), (3, 1, 3, True), (4, 1, 3, False)] and all(g[1] == 0 and g[3] for g in got[5:])
    near = ann.search(df, F.col("vec_id").isin(0, 1), k=3).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in near if r["query_id"] == 0] == [(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 3, 0.0)]
    assert sorted((r["rank"], r["vec_id"]) for r in near if r["query_id"] == 1) == [(1, 0), (1, 0), (2, 1), (2, 1), (3, 3), (3, 3)]
    assert len(ann.search(df, F.col("vec_id") == 10, k=3).collect()) == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(docs, labels) is None
    for df in (jaccard_forest.keep_one(docs), compact_windows.clean_documents(docs), mixing.repeat_rows(docs), quality.filter_documents(docs, None), quality.score(docs, None), bpe.decode(bpe.encode(docs, VOCABULARY), VOCABULARY)):
        assert df.count() == 0


def test_sizes_without_an_estimate(spark):
    df = spark.createDataFrame([(i, "x" * 1000) for i in range(2000)], "i long, t string")
    assert exchange.size_in_bytes(df) >= 2_000_000 and exchange.partitions(df, 1 << 18) >= 8


def test_components_of_a_hub(spark):
    rng = random.Random(1)
    links = [(0, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(5000, 5400)] + [(rng.randrange(9000, 9200), rng.randrange(9000, 9200)) for _ in range(150)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == want


def test_links_of_many_near_copies(spark):
    rng = random.Random(8)
    base = texts(rng, 3, 120)
    rows = []
    for i in range(500):
        w = base[i % 3].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = "zz" + str(rng.randrange(50))
        rows.append((i, " ".join(w)))
    rows += [(500 + i, t) for i, t in enumerate(texts(rng, 300))]
    sets = [set(shingles(words(np.frombuffer(t.encode(), np.uint8))[0]).tolist()) for _, t in rows]
    close = [[j for j in range(len(rows)) if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(len(rows))]
    got = {r["doc_id"]: r for r in jaccard_forest.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    seen: dict[int, int] = {}
    for i in range(len(rows)):
        if i not in seen:
            todo = [i]
            seen[i] = i
            while todo:
                for j in close[todo.pop()]:
                    if j not in seen:
                        seen[j] = i
                        todo.append(j)
    lost = sum(got[i]["n_links"] != len(close[i]) for i in range(len(rows)))
    assert lost <= 2 and all(got[i]["class_id"] == seen[i] and got[i]["kept"] == (seen[i] == i) for i in range(len(rows)))


def test_forest_depths():
    alone = np.ones((1, jaccard_forest.TREES, jaccard_forest._LEVELS), int)
    crowded = alone.copy()
    crowded[:, :8] = np.array([4000, 3000, 2000, 1000, 500, 1])
    for sizes in (alone, crowded):
        d = jaccard_forest.depths(sizes, 0.8, 0.998)
        assert np.prod(1 - 0.8**d) <= 1 - jaccard_forest.FINE and d.max() <= 5
    assert jaccard_forest.depths(crowded, 0.8, 0.998)[0, :8].mean() > jaccard_forest.depths(crowded, 0.8, 0.998)[0, 8:].mean()


def test_passages_by_pairs(spark):
    """Against all pairs of documents; pieces that come from several documents are no passage."""
    rng = random.Random(4)
    base = [t.split() for t in (" ".join(texts(rng, 3, 60)) for _ in range(8))]
    docs = [" ".join(b) for b in base]
    for i in range(60):
        a, b = rng.choice(base), rng.choice(base)
        x, y = rng.randrange(max(1, len(a) - 60)), rng.randrange(max(1, len(b) - 60))
        w = texts(rng, 1, 40)[0].split() + a[x : x + rng.randint(30, 90)] + texts(rng, 1, 30)[0].split() + b[y : y + 60]
        for _ in range(rng.choice((0, 0, 1, 3))):
            w[rng.randrange(len(w))] = "new"
        docs.append(" ".join(w))
    pieces = " ".join(" ".join(b[8 * i : 8 * i + 9]) for i, b in enumerate(base))
    docs.append(pieces)
    got = {r["doc_id"]: r for r in compact_windows.remove_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    s = [shingles(words(np.frombuffer(t.encode(), np.uint8))[0]) if len(t.split()) >= 50 else np.zeros(0, np.uint64) for t in docs]
    differ = 0
    for i in range(len(docs)):
        gone = np.zeros(len(docs[i].split()), bool)
        for j in range(i):
            for a, b in compact_windows.passages(s[i], s[j], 46, 0.8):
                gone[a : b + K - 1] = True
        mine = np.zeros_like(gone)
        for a, b in zip(got[i]["span_begins"], got[i]["span_ends"]):
            mine[a:b] = True
        differ += not np.array_equal(gone, mine)
    assert got[len(docs) - 1]["sources"] == [] and differ <= 2


def test_compact_windows():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 40, 400).astype(np.uint64) << np.uint64(40)
    begin, end, t = np.array([0, 130, 133]), np.array([130, 133, 400]), 12
    l, c, r = compact_windows.compact_windows(h, begin, end, t)
    want = set()
    for b, e in zip(begin, end):
        for i in range(b, e):
            for j in range(i + t, e + 1):
                want.add(int(i + np.argmin(h[i:j])))
    assert sorted(c.tolist()) == sorted(want)
    for x, y, z in zip(l, c, r):
        b, e = next((b, e) for b, e in zip(begin, end) if b <= y < e)
        left = next((i + 1 for i in range(y - 1, b - 1, -1) if h[i] <= h[y]), b)
        right = next((i for i in range(y + 1, e) if h[i] < h[y]), e)
        assert x == max(left, y - t + 1) and z == min(right, y + t)


def test_planted_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((3000, 64))
    for i in range(200):
        v[2000 + i] = v[i % 40] + rng.uniform(0.05, 0.6) * rng.standard_normal(64)
    v[2500:2560] = v[7]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    want = (u @ u.T >= 0.9).sum(1) - 1
    assert want.sum() > 1000
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    assert [got[i] for i in range(len(v))] == want.tolist()


def test_cells_lose_no_pair(monkeypatch):
    monkeypatch.setattr(vector_dedup, "LEAF", 64)
    v = np.random.default_rng(3).standard_normal((2000, 64))
    v[1000:] = v[:1000] + 0.3 * np.random.default_rng(4).standard_normal((1000, 64))
    bounds, q = vector_dedup.fit_cells(v, len(v)), vector_dedup._rotated(v)
    for block in range(vector_dedup.BLOCKS):
        x = q[:, 16 * block : 16 * block + 16]
        code = vector_dedup.cells(x, bounds[block])
        radius = vector_dedup._radius(0.9, 16) * vector_dedup._GRID
        row, cell = vector_dedup.visits(x, bounds[block], radius)
        met = np.zeros((len(v), code.max() + 1), bool)
        met[row, np.minimum(cell, code.max())] = True
        met = (code[:, None] == code) | met[:, code] | met[:, code].T
        near = ((x * x).sum(1)[:, None] + (x * x).sum(1) - 2 * x @ x.T) <= radius**2
        assert near.sum() > len(v) and not (near & ~met).any()


def test_targets_by_sql(spark):
    """Sizes and targets of op3 as SQL gives them: water filling by rounds."""
    got = {r["doc_id"]: r for r in registry.op3_source_mix(spark, DIR).collect()}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    sizes = con.execute(r"SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents").fetchall()
    total: dict = {}
    for _, s, n in sizes:
        total[s] = total.get(s, 0) + n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * sum(total.values()), set(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 2 * total[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 2.0 * total[s]
            left -= want[s]
        open_ -= over
    taken: dict = {}
    for d, s, n in sizes:
        assert got[d]["size"] == n and got[d]["source_size"] == total[s] and abs(got[d]["target"] - want[s]) < 1e-6 * max(1, want[s]) and got[d]["taken"] <= 2 * n
        taken[s] = taken.get(s, 0) + got[d]["taken"]
    biggest = {s: max(n for _, x, n in sizes if x == s) for s in total}
    assert all(abs(taken[s] - want[s]) <= biggest[s] for s in total)


def test_equal_rows_are_counted_one_by_one(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x", "p")] * 200 + [(2, "w " * 9, "y", None)] * 50, "doc_id long, text string, source string, copies string")
    whole = {r["source"]: r["w"] for r in mixing.repeat_rows(df).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("w")).collect()}
    goal = {r["source"]: r["target"] for r in mixing.mix(df).select("source", "target").distinct().collect()}
    assert all(abs(whole[s] - goal[s]) <= 9 for s in goal)


def test_long_documents_settle():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = np.sort(rng.integers(1, 2000, 50))[::-1].astype(float)
        f = rng.random(50)
        out, held = mixing.pivotal(f, size, rng.random(50))
        assert abs((out * size).sum() - (f * size).sum()) < 1e-6 * size.sum()
        assert all(x in (0.0, 1.0) for i, x in enumerate(out) if i != held) and (held < 0 or held >= 25)


def test_mixing_keeps_expectations():
    size, f = np.array([9.0, 5, 4, 3, 2, 1]), np.array([0.3, 0.6, 0.5, 0.2, 0.7, 0.4])
    rng = np.random.default_rng(6)
    mean = np.mean([mixing.pivotal(f, size, rng.random(6))[0] for _ in range(20000)], 0)
    assert np.abs(mean - f).max() < 0.015


def test_held_out(spark):
    got = langid.identify(spark.read.parquet(f"{DIR}/documents.parquet")).collect()
    from zlib import crc32

    true = {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", "text").collect()}
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    fair = [r for r in got if r["held_out"] and true[r["doc_id"]]["lang"] and any(c.isalpha() for c in true[r["doc_id"]]["text"] or "")]
    assert sum(r["lang_pred"] == true[r["doc_id"]]["lang"] for r in fair) >= 0.9 * len(fair)


def test_views_share_no_input():
    a, b = quality.metadata("s", "en", 10), quality.metadata("s", "en", 10)
    assert (a == b).all() and len(set(a.tolist())) == 3 and quality.metadata(None, None, None).max() < quality._META


def test_quality_on_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    got = {r["doc_id"]: r["accepted"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    y = [(r["quality"], got[r["doc_id"]]) for r in labels.collect() if r["quality"] is not None and r["doc_id"] in got]
    assert sum(bool(a) == b for a, b in y) >= 0.95 * len(y)


def test_pipeline(spark):
    """Every stage against its rule, on what the stage before it left."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    assert [n for n, _ in p.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "mixing sources", "byte-level BPE"]
    made = [docs]
    for _, stage in p.STAGES:
        made.append(stage(spark, made[-1], DIR).cache())
    good, different, cut, mixed, coded = made[1:]
    assert all(x.columns == docs.columns for x in made[:5])
    accepted = {r["doc_id"] for r in quality.score(docs, quality.fit(docs, labels)).collect() if r["accepted"]}
    assert {r["doc_id"] for r in good.collect()} == accepted
    kept = {r["doc_id"] for r in jaccard_forest.join(good).collect() if r["kept"]}
    assert {r["doc_id"] for r in different.collect()} == kept
    clean = {r["doc_id"]: bytes(r["kept"]).decode() for r in compact_windows.remove_passages(different).collect()}
    assert {r["doc_id"]: r["text"] for r in cut.collect()} == clean and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    wanted = {r["source"]: r["target"] for r in mixing.mix(cut).select("source", "target").distinct().collect()}
    got = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("w")).collect()}
    longest = {r["source"]: r["w"] for r in cut.groupBy("source").agg(F.max(mixing.words(F.col("text"))).alias("w")).collect()}
    assert all(abs(got.get(s, 0) - wanted[s]) <= longest[s] for s in wanted) and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert coded.count() == mixed.count()
    assert sorted(r["decoded_sha256"] for r in coded.collect()) == sorted(hashlib.sha256(r["text"].encode()).hexdigest() for r in mixed.collect())
    ran = p.run(spark, DIR)
    assert ran.columns == coded.columns and ran.count() == coded.count()


def test_registry(spark):
    n = pq.read_table(f"{DIR}/documents.parquet").num_rows
    q = registry.queries()
    for name in ("op1_byte_bpe", "op2_jaccard_join", "op6_passage_dedup", "op10_suffix_dedup"):
        assert q[name](spark, DIR).count() == n
    assert q["op5_url_rules"](spark, DIR).count() == pq.read_table(f"{DIR}/pages.parquet").num_rows
