"""HTML extraction on small pages, and streaming counts against their batch form."""

from pyspark.sql import functions as F

from textloom.functions.html import extract
from textloom.streaming.counts import first_seen, windowed_counts


def test_extract(spark):
    long = "word " * 30
    pages = [(1, f"<title> A  b</title><nav>menu</nav><article><p>{long}</p><script>x()</script><p>end &amp; more</p></article>"), (2, f"<body>{long}</body>"), (3, "<p>short</p>"), (4, None), (5, "")]
    got = {r["i"]: r["e"] for r in spark.createDataFrame(pages, "i int, h string").select("i", extract(F.col("h")).alias("e")).collect()}
    assert tuple(got[1]) == ("A b", f"{long.strip()}\nend & more", "article")
    assert tuple(got[2]) == (None, long.strip(), "fallback")
    assert all(tuple(got[i]) == (None, None, None) for i in (3, 4, 5))


def test_streams(spark, tmp_path):
    rows = [("2020-01-01 00:00:00", "a"), ("2020-01-01 05:00:00", "a"), ("2020-01-09 00:00:00", "b")]
    df = spark.createDataFrame(rows, "s string, k string").select(F.to_timestamp("s").alias("t"), "k")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out, want in (("counts", lambda x: windowed_counts(x, "t", ["k"]), 2), ("seen", lambda x: first_seen(x, "t", ["k"]), 2)):
        q = out(stream).writeStream.format("memory").queryName(name).outputMode("complete" if name == "counts" else "append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(name).count() == want
    assert sorted(r["n"] for r in windowed_counts(df, "t", ["k"]).collect()) == [1, 2]
