"""The stages of a corpus one after the other, and from the command line."""

import json

from pyspark.sql import functions as F

from textloom.__main__ import main
from textloom.plans import stages


def test_corpus(spark, tmp_path):
    text = "Altona is a town with many words to say about its harbour and its people. " * 3
    cdx = [(1, "s", "http://s.test/", i, "http://s.test/a", f"2020030{i + 1}000000", "text/html", st, d, None) for i, (st, d) in enumerate([("200", "D1"), ("200", "D1"), ("404", "D2"), ("200", "D3")])]
    cdx += [(1, "s", "http://s.test/", 9, "http://s.test/b", "20210801000000", "text/html", "200", "D4", None), (1, "s", "http://s.test/", 10, "http://s.test/c", "19990801000000", "text/html", "200", "D5", None)]
    found = spark.createDataFrame(cdx, "collection_id long, seed_id string, seed_url string, ordinal long, url string, timestamp string, mimetype string, status string, digest string, language string").drop("language")
    kept, counters = stages.harvest(found, 2)
    assert sorted(r["digest"] for r in kept.collect()) == ["D1", "D3", "D4"]
    assert {r["phase"]: (r["kept"], r["skipped_status"], r["skipped_dup_digest"]) for r in counters.collect()} == {"P1_global_onset": (2, 1, 1), "P4_delta_wave": (1, 0, 0)}
    cache = spark.createDataFrame([(1, "D1", f"<article><p>The {text}</p></article>"), (1, "D4", "<p>x</p>")], "collection_id long, digest string, html string")
    docs = stages.normalize(kept, cache, 1)
    got = {r["digest"]: r for r in docs.collect()}
    assert {d: r["fetch_status"] for d, r in got.items()} == {"D1": "ok", "D4": "extract_failed"} and got["D1"]["phase"] == "P1_global_onset" and got["D1"]["language"] == "en"
    docs = docs.withColumn("origin", F.col("digest"))
    left, audit, stats = stages.dedupe(docs)
    assert stats.first()["not_comparable"] == 1 and left.count() == 2
    chunks = stages.embed(docs, 20, 8)
    assert chunks.count() == len({r["point_id"] for r in chunks.collect()}) >= 1 and all(len(r["v"]) == 8 for r in chunks.collect())
    places = spark.createDataFrame([(1, "Altona", [], "AA", 1000, 10.0, 20.0)], "place_id long, name string, alternates array<string>, country_code string, population long, lat double, lon double")
    states = spark.createDataFrame([("Aland Isle", "AA", "Altona")], "country_name string, country_code string, capital string")
    g = stages.georef(docs, places, states).collect()
    assert len(g) == 1 and g[0]["mentions"][0]["mention_count"] == 3 and abs(g[0]["centroid_lat"] - 10) < 1e-9 and g[0]["entropy_bits"] == 0


def test_command_line(spark, tmp_path):
    f = tmp_path / "in"
    f.mkdir()
    row = {"collection_id": 1, "capture_url": "https://a.test/x", "language": "en", "fetch_status": "ok", "extraction_mode": "article", "text": "some words that are here twice", "capture_timestamp": "20200303000000"}
    (f / "P1_x.jsonl").write_text("\n".join(json.dumps(row | {"digest": d}) for d in "ab"))
    assert main(["migrate", str(f)], spark)["records"] == 2 and main(["status", str(f)], spark)["records"] == 2
    assert main(["rephase", str(f), str(tmp_path / "o" / "p" / "c1")], spark)["counts"]["P1_global_onset"] == 2
    assert main(["dedupe", str(f), str(tmp_path / "d")], spark)["exact_duplicates"] == 1
    assert main(["embed", str(tmp_path / "d" / "documents"), str(tmp_path / "e")], spark)["chunks"] == 1
