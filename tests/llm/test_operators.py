"""Operators against brute force, on small tables with nulls, empty texts, repeated rows and clashing columns."""

import base64
import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import ann, bpe, compact_windows, exchange, jaccard_forest, langid, mixing, quality, suffix_dedup, url_rules, vector_dedup
from textloom.llm.registry import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = [words(rng, rng.randint(1, 200)) for _ in range(40)]
    passage = words(rng, 70)
    texts += [texts[3], texts[3], texts[5] + " more", f"{words(rng, 30)} {passage} {words(rng, 30)}", f"{words(rng, 20)} {passage}", None, "", "   ", "x" * 5000, "a'b's 12\n\n x ß 中"]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, 1) for i, t in enumerate(texts)] + [(3, texts[3], None, "s0", None, 1), (None, texts[4], "en", "s0", None, 1)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_bpe(docs, rows):
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted(str((i, len(e := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())) for i, t, *_ in rows)
    got = sorted(str((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in bpe.round_trip_digests(docs, VOCABULARY).collect())
    assert got == want


def test_suffix_dedup(docs, rows):
    first = {}
    for i, t, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], i)
    want = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49 if i is not None else 0):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        want.append((i, bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    got = [(r["doc_id"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_jaccard_join(docs, rows):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w and i is not None else set())
    close = lambda a, b: bool(a) and len(a & b) >= 0.8 * len(a | b)
    want = sorted(sum(close(a, b) for k, b in enumerate(sets) if k != j) for j, a in enumerate(sets))
    got = jaccard_forest.join(docs).collect()
    assert sorted(r["n_links"] for r in got) == want
    assert len(jaccard_forest.keep_one(docs).collect()) == sum(r["kept"] for r in got)


def test_passages(docs, rows):
    got = {r["doc_id"]: r for r in compact_windows.remove_passages(docs).collect() if r["doc_id"] is not None}
    assert got[44]["sources"] == [43] and got[44]["span_begins"] == [20] and got[44]["span_ends"] == [90]
    assert not got[43]["sources"] and not got[0]["sources"]
    assert compact_windows.clean_documents(docs).columns == docs.columns


def test_passages_of_several_sources(spark):
    rng = random.Random(7)
    a, b, line, short, long = (words(rng, n) for n in (70, 70, 20, 30, 200))
    mixed = f"{line} {words(rng, 40)}"  # its line was first in another document
    texts = [f"{words(rng, 30)} {x} {words(rng, 30)}" for x in (a, b, line, short, long, mixed)]
    texts += [f"{a} {b}", f"{b} {words(rng, 5)} {a}", f"{long} {b}", f"{a} {short}", f"{a} {mixed}", f"{a} {b} {long}"]
    got = compact_windows.remove_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).cache()
    sources = {r["doc_id"]: r["sources"] for r in got.collect()}
    assert [sources[i] for i in range(6)] == [[]] * 6
    assert [sources[i] for i in range(6, 12)] == [[0, 1], [0, 1], [1, 4], [0], [0, 5], [0, 1, 4]]
    classes = {r["node"]: r["component"] for r in compact_windows.classes(got).collect()}
    assert {classes[i] for i in (0, 1, 4, 5, 6, 7, 8, 9, 10, 11)} == {0} and 2 not in classes and 3 not in classes


def test_mixing(docs, rows):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) < max(r["size"] for r in own) + 1e-6
    assert max(r["copies"] for r in got) <= 2


def test_url_rules(spark):
    pages = spark.createDataFrame([(1, "http://A.Example.org/es/x?q"), (2, "http://x.org/"), (3, None), (4, "nothing"), (5, "http://a.com/de/"), (6, "http://notorg/")], "page_id long, url string")
    rules = spark.createDataFrame([("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block")], "host string, path string, action string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.judge(pages, rules).collect()}
    assert got == {1: ("a.example.org", "/es/x", "example.org/es/", "block"), 2: ("x.org", "/", "org/", "allow"), 3: ("", "", None, "allow"), 4: ("", "", None, "allow"), 5: ("a.com", "/de/", "com/de/", "block"), 6: ("notorg", "/", None, "allow")}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((120, 16))
    v[50:60] = v[0] + 0.1 * rng.standard_normal((10, 16))
    v[60] = v[1]
    rows = [(i, [float(a) for a in x]) for i, x in enumerate(v)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    n = (u @ u.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) and [got[i]["n_links"] for i in range(120)] == n.tolist()
    assert got[60]["component_id"] == 1 and got[201]["kept"]
    near = ann.search(df, F.pmod("vec_id", F.lit(20)) == 0, k=5).collect()
    hit = 0
    for i in range(0, 120, 20):
        s = v @ v[i]
        s[i] = -np.inf
        hit += len({r["vec_id"] for r in near if r["query_id"] == i} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 27


def test_models(spark):
    rng = random.Random(2)
    text = lambda l, bad: " ".join(("###" if bad else "") + "".join(rng.choice("abcde" if l == "x" else "vwxyz") for _ in range(4)) for _ in range(60))
    rows = [(i, text("xy"[i % 2], i % 5 == 0), "xy"[i % 2], "s", 1, 1) for i in range(200)] + [(900, None, "x", None, None, 1), (901, "12 3", "x", None, None, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    assert all(got[i]["lang_pred"] == "xy"[i % 2] for i in range(200)) and got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(0, 200, 2)], "doc_id long, quality int")
    model = quality.fit(df, labels)
    assert all(r["accepted"] == (r["doc_id"] % 5 != 0) for r in quality.score(df, model).collect() if r["doc_id"] < 200)


def test_many_languages(spark):
    names = [f"l{i:03}" for i in range(420)]
    rows = [(10 * i + k, " ".join(chr(0x4E00 + i) * 3 for _ in range(5 + k)), n) for i, n in enumerate(names) for k in range(6 if i < 400 else 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, "text", "lang", "doc_id")
    assert model.labels == names
    right = [r["lang_pred"] == names[r["doc_id"] // 10] for r in langid.predict(df, model).collect() if r["doc_id"] >= 4000]
    assert len(right) == 100 and all(right)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for df in (bpe.encode(docs, VOCABULARY), suffix_dedup.remove_repeats(docs), jaccard_forest.join(docs), compact_windows.remove_passages(docs), mixing.mix(docs), langid.identify(docs)):
        assert df.count() == 0
    vec = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vector_dedup.near_duplicates(vec).count() == 0 and ann.search(vec, F.col("vec_id") == 0).count() == 0


def test_lists_are_fitted_in_blocks():
    x = np.random.default_rng(4).standard_normal((20_000, 8))
    tracemalloc.start()
    model = ann.Lists(x, 1_000_000, float(np.sqrt((x * x).sum(1).max())), 20, 0.95)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(model.c) == 4000 and most < 250e6  # all distances at once are 640 MB
    i, lists = model.probe(x[:2500], np.full(4000, 5), 20)
    assert (np.bincount(i) >= model.probes).all() and lists.max() < 4000


def test_sample_is_bounded(spark):
    df = spark.range(3000).selectExpr("7L as id", "id as row", "array(double(id), 1.0D) as v")
    assert 300 < len(ann._sample(df, 2, 500)) <= 500


def test_copies_of_all_chunks_are_sorted_once(monkeypatch):
    rng, sorted_bytes, plain = np.random.default_rng(5), [], suffix_dedup.two_stage
    monkeypatch.setattr(suffix_dedup, "two_stage", lambda t, *a: sorted_bytes.append(len(t)) or plain(t, *a))
    same = [rng.integers(97, 123, 70).astype(np.uint8) for _ in range(30)]
    longer = np.concatenate([same[0][:60], rng.integers(97, 123, 9).astype(np.uint8)])  # shares 11 strings with the first
    got = []
    for c in range(20):
        own = [*same, longer] if c == 7 else same
        n = np.array([len(x) for x in own])
        got.append((c, suffix_dedup.exchange.pack(np.concatenate(own), n, np.full(len(n), 100 - c), np.arange(len(n)), np.zeros(len(n), np.int64))))
    spans = {to: suffix_dedup.exchange.unpack(blob, 3) for to, blob in suffix_dedup._sort(50)(0, got)}
    assert sum(sorted_bytes) == 30 * 70 + 69
    assert 19 not in spans  # the smallest document keeps all
    for c in range(19):
        k, begin, end = spans[c]
        want = {(i, 0, 70) for i in range(30)} | ({(30, 0, 60)} if c == 7 else set())
        assert set(zip(k.tolist(), begin.tolist(), end.tolist(), strict=True)) == want


def test_passages_of_a_document_between(spark):
    # Parts of the last document's passage are in many documents before and after the only one that has it whole.
    rng = random.Random(11)
    own = words(rng, 80).split()

    def within(part):
        return " ".join([*words(rng, 40).split(), *part, *words(rng, 40).split()])

    parts = [own[i : i + 36] for i in range(0, 80, 4)] * 6
    texts = [*map(within, parts), within(own), *map(within, parts), within([*own[:40], "edited", *own[41:]])]
    whole, last = len(parts), len(texts) - 1
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for chunks in (1, 5):
        got = {r["doc_id"]: r for r in compact_windows.remove_passages(df, chunks=chunks).collect()}
        assert (got[last]["span_begins"], got[last]["span_ends"], got[last]["sources"]) == ([40], [120], [whole])
        assert not any(got[i]["span_begins"] for i in range(last))


def test_passages_that_a_document_has_twice(spark):
    # As above, twice in one document, and in two rows of one id; the stage of the pipeline that cuts passages does the same.
    rng = random.Random(14)
    own = words(rng, 240).split()
    parts = [own[i : i + 36] for i in range(0, 240, 6)] * 2

    def within(*parts):
        return " ".join(w for part in parts for w in [*words(rng, 40).split(), *part, *words(rng, 40).split()])

    edited, other = [*own[:120], "edited", *own[121:]], [*own[:80], "other", *own[81:]]
    texts = [*map(within, parts), within(own), *map(within, parts), within(edited, edited)]
    whole, last = len(parts), len(texts) - 1
    rows = [*enumerate(texts), (last + 1, within(other)), (last + 1, within(other))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunks in (1, 5):
        got = compact_windows.remove_passages(df, chunks=chunks).filter(F.col("doc_id") >= last).orderBy("doc_id").collect()
        assert [(r["span_begins"], r["span_ends"]) for r in got] == [([40, 360], [280, 600]), *[([40], [280])] * 2]
        assert got[0]["sources"] == [whole]
    kept = corpus_pipeline.cut_passages(spark, df, "").filter(F.col("doc_id") == last).first()["text"].split()
    assert kept == [w for i, w in enumerate(texts[last].split()) if not (40 <= i < 280 or 360 <= i < 600)]


def test_long_passages_of_a_document_between(spark):
    # Windows of passages of 160 words hold more shingles than a byte counts.
    rng = random.Random(12)
    own = words(rng, 300).split()
    parts = [own[i : i + 130] for i in range(0, 300, 10)] * 2

    def within(part):
        return " ".join([*words(rng, 40).split(), *part, *words(rng, 40).split()])

    texts = [*map(within, parts), within(own), *map(within, parts), within([*own[:150], "edited", *own[151:]])]
    whole, last = len(parts), len(texts) - 1
    got = {r["doc_id"]: r for r in compact_windows.remove_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_words=160, chunks=3).collect()}
    assert (got[last]["span_begins"], got[last]["span_ends"], got[last]["sources"]) == ([40], [340], [whole])
    assert not any(got[i]["span_begins"] for i in range(last))


def test_windows_of_a_recurring_shingle():
    # A signature at every tenth place has as many windows; the bucket gets the text around them once.
    text = words(random.Random(13), 400).encode()
    docs = pa.table({"doc_id": pa.array([5], pa.int64()), "row_id": pa.array([0], pa.int64()), "rest": pa.array([None], pa.int32()), "chunk": pa.array([0], pa.int32()), "body": pa.array([zstandard.ZstdCompressor().compress(text)], pa.binary())})
    c = np.arange(50, 300, 10)
    near = np.full(len(c), 23)
    windows = exchange.pack(np.append(np.full(len(c), 9), 9).astype(np.uint64), np.zeros(len(c) + 1, np.int32), np.append(c, 370).astype(np.int32), np.append(near, 5).astype(np.uint16), np.append(near, 5).astype(np.uint16))
    sent = compact_windows._open(46, 0.8, 1)(0, docs, [(-2, windows)])
    sig, doc, _, begin, size, x, settled = exchange.unpack(sent["load"][0].as_py(), 7)
    assert sig.tolist() == [9, 9] and doc.tolist() == [5, 5] and begin.tolist() == [27, 365] and size.tolist() == [290 + 23 - 27, 10] and len(x) == size.sum()
