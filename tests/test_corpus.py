"""Gates, registry, preparation, neighbours, frames and places on small tables."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import corpus as C
from textloom.operators import evolution as E
from textloom.operators import places as P
from textloom.operators import semantics as S


def test_registry(spark):
    hosts = spark.createDataFrame([("health.gov", "authoritative"), ("data.health.gov", "authoritative"), ("blog.health.gov", "low"), ("health.gov", "mixed"), ("rumour.net", "low"), (None, "low")], "domain string, tier string")
    reg = C.build_registry(hosts, spark.createDataFrame([("lab.org", "authoritative")], "domain string, tier string"))
    assert {tuple(r) for r in reg.collect()} == {("health.gov", "authoritative"), ("rumour.net", "low"), ("lab.org", "authoritative")}
    asked = spark.createDataFrame([("x.data.health.gov",), ("rumour.net.evil",), ("a.rumour.net",), ("gov",)], "host string")
    got = {r["host"]: r["tier"] for r in C.with_tier(asked, "host", reg).collect()}
    assert got == {"x.data.health.gov": "authoritative", "rumour.net.evil": "unknown", "a.rumour.net": "low", "gov": "unknown"}
    both = spark.createDataFrame([("a.b.test", "low"), ("b.test", "authoritative")], "domain string, tier string")
    assert C.with_tier(spark.createDataFrame([("a.b.test",)], "host string"), "host", both).first()["tier"] == "authoritative"


def test_gates(spark):
    docs = spark.createDataFrame([("ok", "a text"), ("ok", " "), ("failed", None)], "fetch_status string, text string")
    assert C.checked(docs, 1, 0.5).first()["passed"] and C.comparable(docs).count() == 1
    with pytest.raises(Exception, match="too few documents"):
        C.checked(docs, 3, 0.5).collect()
    seeds = spark.createDataFrame([(1, True, "u", True, False), (2, True, "u", True, True), (3, False, "u", False, False), (4, True, "", False, False)], "o int, active boolean, url string, visited boolean, failed boolean")
    assert not C.seed_coverage(seeds, 0.4).first()["passed"] and C.seed_coverage(seeds, 0.5).first()["passed"]
    assert [r["o"] for r in C.active_seeds(seeds, "o", 5).collect()] == [1, 2]
    with pytest.raises(ValueError):
        C.active_seeds(seeds, "o", 0)
    with pytest.raises(Exception, match="another version"):
        C.current(spark.createDataFrame([(1,)], "dedupe_version int")).collect()
    assert C.small_enough(spark.createDataFrame([("é" * 5,), ("x" * 9,)], "text string"), most=10).count() == 1


def test_preparation(spark):
    d = dt.date(2021, 1, 1)
    many = "eight words are the least that may stay"
    rows = [
        (1, d, many, "EN", "u", [1.0, 0.0]), (2, d, many.replace(" ", "  "), "en", "u", [1.0, 0.0]), (3, d - dt.timedelta(1), many, "en", "u", [1.0, 0.0]), (4, d, many, "en", "v", [0.0, 3.0]), (5, None, many, "en", "u", [1.0]),
        (6, d, "too few words", "en", "u", [1.0]), (7, d, many, "fr", "u", [1.0]), (8, d, many, "en", "w", [0.0, 0.0]), (9, d, many, "en", "w", [float("nan"), 1.0]), (10, d, many, "en", "w", None), (11, d, None, "en", "w", [1.0]),
    ]
    df = spark.createDataFrame(rows, "point_id long, t date, text string, language string, seed_url string, v array<double>")
    got = S.prepared(df, "t").orderBy("point_id").collect()
    assert [r["point_id"] for r in got] == [1, 3, 4] and got[2]["v"] == [0.0, 1.0]
    f = S.vector_faults(df).first()
    assert (f["vectors"], f["dimensions"], f["empty"], f["not_finite"], f["zero"]) == (11, 2, 1, 1, 1)


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((300, 6))
    tier = ["authoritative" if i % 3 == 0 else "mixed" for i in range(300)]
    rows = [(i, "p" if i % 7 else None, tier[i], f"h{i % 4}", v[i].tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "point_id long, phase string, tier string, host string, v array<double>")
    monkeypatch.setattr(S, "BLOCK", 64)
    got = {r["point_id"]: r for r in S.authoritative_neighbours(df, "phase").collect()}
    u = v / np.linalg.norm(v, axis=1)[:, None]
    assert set(got) == {i for i in range(300) if i % 7}
    for i in got:
        c = [j for j in got if tier[j] == "authoritative" and j % 4 != i % 4]
        best = min(c, key=lambda j: (round(1 - float(u[i] @ u[j]), 9), j))
        assert got[i]["n_reference"] == len(c) and got[i]["neighbour"] == best


def test_frames(spark):
    day = dt.date(2021, 1, 1)
    rows = spark.createDataFrame([(day + dt.timedelta(i),) for i in (0, 2, 3, 40)], "d date")
    got = {}
    for r in E.trailing_frames(rows, "d").collect():
        got.setdefault(r["frame_end"], []).append(r["d"])
    spine = {r["frame_end"] for r in E.frame_spine(rows, rows).collect()}
    last = day + dt.timedelta(40)
    assert spine == {day + dt.timedelta(i) for i in range(41) if (day + dt.timedelta(i)).weekday() == 6} | {last}
    for e in spine:
        inside = [r["d"] for r in rows.collect() if e - dt.timedelta(27) <= r["d"] <= e]
        assert sorted(got.get(e, [])) == sorted(inside)
    events = spark.createDataFrame([(day, "a"), (day + dt.timedelta(2), "b"), (day + dt.timedelta(3), "c")], "event_date date, event string")
    frames = spark.createDataFrame([(day + dt.timedelta(2),), (day + dt.timedelta(9),)], "e date")
    assert sorted((r["e"], r["event"]) for r in E.arriving_events(frames, events, "e").collect()) == [(day + dt.timedelta(2), "a"), (day + dt.timedelta(2), "b"), (day + dt.timedelta(9), "c")]
    s = spark.range(1000).withColumn("g", F.col("id") % 3)
    assert sorted(r["id"] for r in E.sample_each(s, "g", "id", 5).collect()) == sorted(r["id"] for r in E.sample_each(s.repartition(7), "g", "id", 5).collect())


def test_places(spark):
    schema = "place_id long, name string, alternates array<string>, country_code string, population long, lat double, lon double"
    places = spark.createDataFrame([(1, "Altona", ["Altone"], "AA", 1000, 1.0, 1.0), (2, "Altona", [], "BB", 10, 2.0, 2.0), (3, "Bexford", ["Altona Nova", "altona"], "BB", 99, 3.0, 3.0), (4, "Nullton", [], "AA", None, 4.0, 4.0)], schema)
    states = spark.createDataFrame([("Aland Isle", "AA", "Nullton"), ("Bexland", "BB", "Bexford")], "country_name string, country_code string, capital string")
    asked = spark.createDataFrame([(1, "altona", None), (2, "Altona", "somewhere in Bexland"), (3, "ALTONE", None), (4, "Bexland", None), (5, "nowhere", None)], "i int, surface string, context string")
    got = {r["i"]: (r["place"] and r["place"]["place_id"], r["confidence"]) for r in P.resolve(asked, P.with_capitals(places, states), P.country_names(states)).collect()}
    assert got[1][0] == 1 and abs(got[1][1] - min(0.95, (np.log(1000) - np.log(10)) / np.log(1000))) < 1e-9
    assert got[2] == (2, 1.0) and got[3] == (1, 1.0) and got[4] == (3, 1.0) and got[5] == (None, None)
    docs = spark.createDataFrame([(1, "They met in Altona Nova, then (Bexford) saw German visitors. The end of Altona"), (2, None)], "a int, text string")
    names = spark.createDataFrame([("Altona",), ("Altona Nova",), ("Bexford",), ("German",)], "name string")
    found = P.mentions(docs, names, "a").orderBy("start_char").collect()
    text = docs.first()["text"]
    assert [text[r["start_char"] : r["end_char"]] for r in found] == ["Altona Nova", "Bexford", "Altona"] and all(r["surface"] in r["context"] for r in found)
