"""Files, publication, snapshots, journals, archives and runs."""

import datetime as dt
import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.plans import pipeline as PL
from textloom.plans.config import KNOBS, schema, settings
from textloom.sinks import collections as K
from textloom.sinks import exports
from textloom.sinks.snapshots import Store
from textloom.sources import archive, files
from textloom.streaming.state import Cursor, Journal, upsert_stream


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_collections(spark, tmp_path):
    f = tmp_path / "corpus" / "normalized" / "c1"
    lines(f / "P1_first.jsonl", [{"collection_id": 1, "text": "a", "publish_date": "2020-03-01"}, "", {"collection_id": 1, "text": "b", "capture_timestamp": "20210704101500"}])
    lines(f / "undated.jsonl", [{"collection_id": 1, "text": "c"}])
    lines(f / "notes.jsonl", [{"text": "not one of them"}])
    assert sorted(r["text"] for r in files.documents(spark, str(f)).collect()) == ["a", "b", "c"]
    done = K.migrate(spark, str(f))
    assert done["status"] == "migrated" and done["records"] == 3 and K.migrate(spark, str(f))["status"] == "unchanged"
    assert sorted(r["text"] for r in files.documents(spark, str(f)).collect()) == ["a", "b", "c"]
    corpus = {r["text"]: r["phase"] for r in files.whole_corpus(spark, str(f.parent)).collect()}
    assert corpus == {"a": "P1_global_onset", "b": "P4_delta_wave", "c": "undated"}
    lines(f / "P2_later.jsonl", [{"collection_id": 1, "text": "else"}])
    with pytest.raises(ValueError, match="differ"):
        K.migrate(spark, str(f))
    lines(tmp_path / "bad" / "documents.jsonl", ["{not json"])
    with pytest.raises(Exception):
        files.documents(spark, str(tmp_path / "bad")).collect()


def test_publish(spark, tmp_path):
    d = files.documents(spark, str(tmp_path / "none"))
    assert d.count() == 0
    rows = spark.createDataFrame([(1, "x", "P1", dt.datetime(2021, 5, 1)), (1, "y", "P1", dt.datetime(2020, 5, 1)), (1, "z", None, None)], "collection_id long, text string, phase string, event_time timestamp")
    rows = rows.withColumns({"capture_time": F.lit(None).cast("timestamp"), "assigned_phase": F.when(F.col("text") == "x", "P1").otherwise("undated"), "date_source": F.lit(None).cast("string"), "capture_url": F.lit("u"), "seed_url": F.lit("s"), "digest": F.lit("d")})
    folder = str(tmp_path / "out" / "docs" / "c1")
    s = K.publish(rows, folder, ["P1", "undated"])
    assert s["documents"] == 3 and s["moved"] == 2 and s["counts"] == {"P1": 1, "undated": 2} and "backup" not in s
    assert [json.loads(r["value"])["text"] for r in spark.read.text(f"{folder}/documents.jsonl").coalesce(1).collect()] == ["y", "x", "z"]
    assert "backup" in K.publish(rows, folder, ["P1", "undated"])
    with pytest.raises(ValueError):
        K.publish(rows.withColumn("collection_id", F.monotonically_increasing_id()), folder, ["P1"])


def test_fingerprint(spark, tmp_path):
    lines(tmp_path / "a.jsonl", ['{"x": 1, "y": "b"}', "", '{"z": null}'])
    lines(tmp_path / "b.jsonl", ['{"y":"b",   "x":1}', '{"z":null}'])
    lines(tmp_path / "c.jsonl", ['{"z": null}', '{"x": 1, "y": "b"}'])
    a, b, c = (K.fingerprint(spark, [str(tmp_path / f"{n}.jsonl")]) for n in "abc")
    assert a == b and a["records"] == 2 and a["sha256"] != c["sha256"] and K.same_records(spark, [str(tmp_path / "a.jsonl")], [str(tmp_path / "c.jsonl")])


def test_sources(spark, tmp_path):
    (tmp_path / "g.txt").write_text("\n".join(["\t".join(["7", "Zürich", "Zurich", "Zuerich,X,Turicum", "47.4", "8.5", "P", "PPLA", "CH", "", "", "", "", "", "400000", "", "", "", ""]), "\t".join(["x"] * 19), "short\tline"]))
    g = files.gazetteer(spark, str(tmp_path / "g.txt")).collect()
    assert len(g) == 1 and g[0]["alternates"] == ["Zurich", "Zuerich", "Turicum"] and g[0]["population"] == 400000
    (tmp_path / "c.txt").write_text("# comment\nCH\tCHE\t756\tSZ\tSwitzerland\tBern\nXX\tXXX\t1\tX\t\tNone\n")
    assert [tuple(r) for r in files.countries(spark, str(tmp_path / "c.txt")).collect()] == [("CH", "Switzerland", "Bern")]
    (tmp_path / "r.json").write_text(json.dumps({"low": ["b.test", "a.test"], "authoritative": ["c.test"]}))
    reg = files.registry(spark, str(tmp_path / "r.json"))
    assert {tuple(r) for r in reg.collect()} == {("b.test", "low"), ("a.test", "low"), ("c.test", "authoritative")}
    exports.registry(reg, str(tmp_path / "r2.json"))
    assert {tuple(r) for r in files.registry(spark, str(tmp_path / "r2.json")).collect()} == {tuple(r) for r in reg.collect()}
    cdx = spark.createDataFrame([("k 20200101000000 http://a.test text/html 200 D - - 12 x f",), ("short",)], "value string")
    r = files.cdx(cdx).collect()
    assert len(r) == 1 and r[0]["length"] == 12 and r[0]["offset"] is None and r[0]["redirect"] is None
    p = tmp_path / "cache" / "5"
    p.mkdir(parents=True)
    (p / "D.html.gz").write_bytes(gzip.compress("<p>é</p>".encode()))
    caps = spark.createDataFrame([(5, "D"), (5, "E")], "collection_id long, digest string")
    hit, miss = files.with_html(caps, files.html_cache(spark, str(tmp_path / "cache")))
    assert hit.first()["html"] == "<p>é</p>" and [r["digest"] for r in miss.collect()] == ["E"]
    np.save(tmp_path / "v.npy", np.arange(6, dtype=np.float32).reshape(3, 2))
    lines(tmp_path / "m.jsonl", [{"row": i, "point_id": str(i)} for i in range(3)])
    assert {r["row"]: r["v"] for r in files.vectors(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "v.npy"), 2).collect()} == {0: [0.0, 1.0], 1: [2.0, 3.0], 2: [4.0, 5.0]}


def fake_client():
    def answer(path, params):
        if path == "/api/seed":
            n = 45
            rows = [{"id": i, "url": f"http://s{i}.test", "active": i % 2 == 0} for i in range(params["offset"], min(n, params["offset"] + params["limit"]))]
            return 200, {}, json.dumps(rows).encode()
        if path.startswith("/api/collection/"):
            return 200, {}, json.dumps({"id": int(path.rpartition("/")[2]), "name": "a collection"}).encode()
        days = [f"k 202001{d:02}000000 http://a.test text/html 200 D{d} - - 1 2 f" for d in range(1, 11)]
        return 200, {}, "\n".join([*days, "broken"]).encode()

    return answer


def test_archive(spark):
    p = archive.Pacing(0.0, sleep=lambda s: None)
    assert len(list(archive.seed_pages(fake_client(), 1, p))) == 45 and len(list(archive.seed_pages(fake_client(), 1, p, most=21))) == 21
    got = list(archive.capture_lines(fake_client(), 1, "a.test", p, "host", "20200103", "20200105", 2))
    assert [x.split()[5] for x in got] == ["D3", "D4"]
    with pytest.raises(ValueError):
        list(archive.capture_lines(fake_client(), 1, "a.test", p, "host", "20200103", collapse="digest"))
    now = dt.datetime(2021, 1, 1, tzinfo=dt.UTC)
    assert archive.retry_after_seconds("12") == 12 and archive.retry_after_seconds("Fri, 01 Jan 2021 00:00:30 GMT", now) == 30 and archive.retry_after_seconds("soon") == 0 == archive.retry_after_seconds(None)
    calls = []

    def busy(path, params):
        calls.append(path)
        return (429, {"Retry-After": "3"}, b"") if len(calls) < 3 else (200, {}, b"ok")

    slept = []
    pace = archive.Pacing(1.0, clock=lambda: sum(slept), sleep=slept.append)
    assert archive.fetch(busy, "/x", {}, pace) == b"ok" and sum(slept) >= 6 and pace.failed == {"/x": 2}
    assert archive.fetch(lambda *_: (404, {}, b""), "/x", {}, pace) is None
    with pytest.raises(RuntimeError):
        archive.fetch(lambda *_: (503, {}, b""), "/x", {}, archive.Pacing(0.0, sleep=lambda s: None), retries=1)
    meta, seeds = archive.probe(spark, "tests.test_files_state:fake_client", [3, 4])
    assert {r["url"] for r in meta.collect()} == {"a collection"} and seeds.count() == 10


def test_exports(spark, tmp_path):
    good = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "point_id long, v array<double>")
    assert exports.vectors(good, str(tmp_path / "v"), 4)["dimensions"] == 1
    with pytest.raises(ValueError):
        exports.vectors(good, str(tmp_path / "w"), 5)
    assert not K.exists(spark, str(tmp_path / "w"))
    exports.upsert(good, str(tmp_path / "p"))
    exports.upsert(good.filter("point_id < 2").withColumn("v", F.array(F.lit(9.0))).unionByName(spark.createDataFrame([(9, [1.0])], good.schema)), str(tmp_path / "p"))
    assert {r["point_id"]: r["v"][0] for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {0: 9.0, 1: 9.0, 2: 1.0, 3: 1.0, 9: 1.0}
    exports.report({"a": good.select("point_id")}, str(tmp_path / "r"), {"k": 1})
    assert spark.read.option("header", "true").csv(str(tmp_path / "r" / "a.csv")).count() == 4
    work = lambda d: d.select("point_id", F.lit(1).alias("n"))
    assert exports.append_unprocessed(good.limit(2), str(tmp_path / "g"), "point_id", work) == 2 and exports.append_unprocessed(good, str(tmp_path / "g"), "point_id", work) == 2
    exports.evolution({"nodes": good.select("point_id"), "centroids": good}, str(tmp_path / "e"), {})
    assert files.export(spark, str(tmp_path / "e"), "nodes").count() == 4


def test_snapshots(spark, tmp_path):
    store, made = Store(spark, str(tmp_path / "s")), []

    def make():
        made.append(1)
        return spark.range(5)

    a = store.build("first", "c1", {"k": 1}, [], "v1", make)
    assert store.build("first", "c1", {"k": 1}, [], "v1", make) == a and len(made) == 1
    b = store.build("second", "c1", {}, [a.name], "v1", lambda: store.read(a.name).filter("id > 1"))
    assert store.read(b.name).count() == 3 and store.reuse(a.name, "first", "c1", {"k": 1}, [], "v1") == a
    with pytest.raises(ValueError):
        store.reuse(a.name, "first", "c1", {"k": 2}, [], "v1")
    store.publish("now", [a, b])
    assert store.published("now") == {"first/c1": a.name, "second/c1": b.name}
    with pytest.raises(ValueError):
        store.publish("now", [a, a])
    spark.range(1).coalesce(1).write.mode("append").parquet(f"{a.path}/data")
    with pytest.raises(ValueError, match="changed"):
        store.verify(b.name)


def test_state(spark, tmp_path):
    j = Journal(spark, str(tmp_path / "j"), "one")
    assert j.read() is None and j.append(spark.range(3)) == 0 and j.append(spark.range(3, 5)) == 1
    spark.range(9).write.parquet(str(tmp_path / "j" / "data" / "0000000002"))  # a torn tail
    assert Journal(spark, str(tmp_path / "j"), "one").read().count() == 5
    with pytest.raises(ValueError):
        Journal(spark, str(tmp_path / "j"), "two")
    c = Cursor(spark, str(tmp_path / "c.json"), "one")
    assert c.load()["next"] == 0
    c.save(next=4, documents=4, chunks=7, complete=False)
    assert c.load()["chunks"] == 7
    with pytest.raises(ValueError):
        c.check(6)
    rows = spark.range(4).select(F.col("id").alias("point_id"), F.lit("a").alias("x"))
    rows.write.parquet(str(tmp_path / "in"))
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    q = upsert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def first_stage(max_captures_per_page=1, max_seeds=None, request_interval=2.0, max_failed_fraction=0.1):
    from pyspark.sql import SparkSession

    return SparkSession.getActiveSession().range(10)


def second_stage(rows, captures_per_url=1, min_documents=1, max_failed_fraction=0.2):
    return rows.filter("id < 4")


def test_runs(spark, tmp_path):
    assert PL.order({"b": ("a",), "a": (), "c": ("a", "b")}) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        PL.order({"a": ("b",), "b": ("a",)})
    with pytest.raises(ValueError):
        settings("dedupe", threshold=2)
    with pytest.raises(ValueError):
        settings("dedupe", unknown=2)
    assert len(schema()) == sum(map(len, KNOBS.values()))
    stages, work = {"harvest": (), "normalize": ("harvest",)}, {"harvest": first_stage, "normalize": second_stage}
    steps = PL.plan(stages, ["c1"], work, {"normalize": {"captures_per_url": 2}})
    store = Store(spark, str(tmp_path / "s"))
    made, told = PL.run(store, steps, work)
    assert [t["status"] for t in told] == ["built", "built"] and told[1]["records"] == 4
    assert [t["status"] for t in PL.run(store, steps, work)[1]] == ["reused", "reused"]
    control = PL.Control(spark, str(tmp_path / "pause"))
    control.pause()
    assert PL.run(store, steps, work, control)[1][-1]["status"] == "paused"
    assert "| harvest | c1 | built | 10 |" in PL.overview(told)[1]
    assert PL.estimate(10, 5, 10)["left"] == 10 and PL.estimate(0, 0, 5)["left"] is None
    p = PL.Progress(spark, str(tmp_path / "p.json"), 10)
    p.tell(5, final=True)
    assert json.loads(K.read_text(spark, str(tmp_path / "p.json")))["done"] == 5
