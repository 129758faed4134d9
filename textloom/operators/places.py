"""Places: resolution of names against a gazetteer, mentions of an article, spread and attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.geo import haversine_km

#: Bounds of the confidence of an ambiguous name, and what a country in the context adds: fixed values.
LEAST, MOST, CONTEXT = 0.3, 0.95, 0.3


def _key(name: Column) -> Column:
    return F.lower(F.trim(name))


def lookup(places: DataFrame) -> DataFrame:
    """(key, candidates): places of each name, most populous first; alternates count only where no name is equal.

    ``places``: (place_id, name, alternates, country_code, population, lat, lon).
    """
    place = F.struct((-F.coalesce("population", F.lit(0))).alias("order"), "place_id", "name", "country_code", "lat", "lon")
    places = places.select("name", "alternates", place.alias("p"))
    names = places.select(_key(F.col("name")).alias("key"), "p").filter("key <> ''")
    alternates = places.select(F.explode("alternates").alias("a"), "p").select(_key(F.col("a")).alias("key"), "p").filter("key <> ''")
    both = names.withColumn("rank", F.lit(0)).unionByName(alternates.withColumn("rank", F.lit(1)))
    sets = both.groupBy("key").agg(F.collect_set(F.when(F.col("rank") == 0, F.col("p"))).alias("n"), F.collect_set(F.when(F.col("rank") == 1, F.col("p"))).alias("a"))
    return sets.select("key", F.array_sort(F.when(F.size("n") > 0, F.col("n")).otherwise(F.col("a"))).alias("candidates"))


def resolve(mentions: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """The place (``place``, null if none) and ``confidence`` of each mention (surface, context).

    A single candidate is certain. Of several, those in a country that the context names go first, if there are
    any; then the most populous wins, the surer the further the next one is behind. ``countries``
    (country_name, country_code) are the states of the world, some hundreds: one array on every executor.
    """
    named = countries.filter(F.length("country_name") >= 3).agg(F.collect_set(F.struct(F.lower("country_name").alias("name"), F.col("country_code").alias("code"))).alias("states"))
    m = mentions.withColumn("key", _key(F.col("surface"))).join(lookup(places), "key", "left").crossJoin(F.broadcast(named))
    around = F.lower("context")
    m = m.withColumn("codes", F.when(F.col("context").isNull(), F.array().cast("array<string>")).otherwise(F.transform(F.filter("states", lambda s: F.contains(around, s["name"])), lambda s: s["code"])))
    m = m.withColumn("near", F.filter("candidates", lambda c: F.array_contains("codes", c["country_code"])))
    m = m.withColumn("pool", F.when(F.size("near") > 0, F.col("near")).otherwise(F.col("candidates")))
    top, second = (F.greatest(-F.get("pool", i)["order"], F.lit(1)).cast("double") for i in (0, 1))
    gap = F.when(top <= second, LEAST).otherwise(F.greatest(F.lit(LEAST), F.least(F.lit(MOST), (F.ln(top) - F.ln(second)) / F.greatest(F.ln(top), F.lit(1.0)))))
    raised = F.when(F.size("codes") > 0, F.least(F.lit(1.0), gap + CONTEXT / 2)).otherwise(gap)
    sure = F.when(F.col("candidates").isNull(), None).when(F.size("pool") == 1, 1.0).otherwise(raised)
    return m.select(*mentions.columns, F.get("pool", 0).dropFields("order").alias("place"), sure.alias("confidence"))


def collapse(resolved: DataFrame, article: str, order: str) -> DataFrame:
    """One row an article and place: the first surface, the number of mentions and their mean confidence."""
    r = resolved.filter("place is not null").select(article, order, "surface", "confidence", "place.*")
    return r.groupBy(article, "place_id").agg(
        F.min_by("surface", order).alias("toponym"), F.first("country_code").alias("country_code"), F.first("lat").alias("lat"), F.first("lon").alias("lon"),
        F.count("*").alias("mention_count"), F.avg("confidence").alias("confidence"),
    )


def centroids(collapsed: DataFrame, article: str) -> DataFrame:
    """Centroid of the article's places on the sphere, weighted by mentions, and the mean distance to it in km."""
    w, lat, lon = F.col("mention_count"), F.radians("lat"), F.radians("lon")
    s = collapsed.groupBy(article).agg(
        F.sum(w * F.cos(lat) * F.cos(lon)).alias("x"), F.sum(w * F.cos(lat) * F.sin(lon)).alias("y"), F.sum(w * F.sin(lat)).alias("z"),
        F.sum(w).alias("w"), F.count("*").alias("n_places"),
    )
    norm = F.greatest(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")), F.lit(1e-12))
    c = s.select(article, "w", "n_places", F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("z") / norm)))).alias("centroid_lat"), F.degrees(F.atan2("y", "x")).alias("centroid_lon"))
    far = collapsed.join(c, article).groupBy(article).agg(F.sum(w * haversine_km(F.col("centroid_lat"), F.col("centroid_lon"), F.col("lat"), F.col("lon"))).alias("far"))
    return c.join(far, article).select(article, "n_places", "centroid_lat", "centroid_lon", F.when(F.col("n_places") == 1, 0.0).otherwise(F.col("far") / F.col("w")).alias("dispersion_km"))


def country_entropy(collapsed: DataFrame, article: str) -> DataFrame:
    """Entropy in bits of the article's mentions over countries; articles without a country have no row."""
    n = collapsed.filter("country_code <> ''").groupBy(article, "country_code").agg(F.sum("mention_count").alias("k"))
    return n.groupBy(article).agg((F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k")).alias("entropy_bits"), F.count("*").alias("n_countries"))


def attention(docs: DataFrame, collapsed: DataFrame, article: str, groups: list[str]) -> DataFrame:
    """Articles that name each country, and their percentage of the group's articles that name any.

    ``docs`` has one row an article; an article counts once a country, so percentages may sum to more than 100.
    """
    pairs = collapsed.filter("country_code <> ''").select(article, "country_code").distinct().join(docs.select(article, *groups), article)
    mapped = pairs.groupBy(*groups).agg(F.count_distinct(article).alias("n_mapped"))
    n = pairs.groupBy(*groups, "country_code").agg(F.count("*").alias("n_articles"))
    return n.join(mapped, groups).withColumn("percent", 100 * F.col("n_articles") / F.col("n_mapped"))


def with_capitals(places: DataFrame, countries: DataFrame) -> DataFrame:
    """The places, of which each country's capital also has the country's name among its names.

    The capital is the most populous place of that name in the country, else anywhere. ``countries``: (country_name,
    country_code, capital), some hundreds. A name that a place gets this way counts as its own name, so the rows of
    such places are repeated with it.
    """
    c = countries.filter("capital <> ''").select("country_name", F.col("country_code").alias("state"), _key(F.col("capital")).alias("key"))
    met = places.join(F.broadcast(c), _key(F.col("name")) == F.col("key"))
    home = (F.col("state") == F.col("country_code")).cast("int")
    best = met.groupBy("state", "country_name").agg(F.max_by("place_id", F.struct(home, F.coalesce("population", F.lit(0)), -F.col("place_id"))).alias("chosen"))
    named = places.join(F.broadcast(best), F.col("place_id") == F.col("chosen")).withColumns({"name": F.col("country_name"), "alternates": F.array().cast("array<string>")})
    return places.unionByName(named.select(*places.columns))


def country_names(countries: DataFrame) -> DataFrame:
    """(country_name, country_code): names and codes by which a context names a country."""
    return countries.select("country_name", "country_code").unionByName(countries.select(F.col("country_code").alias("country_name"), "country_code")).filter("country_name <> ''").distinct()


def mentions(docs: DataFrame, names: DataFrame, article: str, most_words: int = 4) -> DataFrame:
    """(article, start_char, end_char, surface, context) of known names in texts: the matcher that needs no model.

    Texts are cut into windows (see text_windows()) and words are matched as they are written, up to ``most_words``
    in a row; of overlapping names the longest stands. ``names`` has a column name.
    """
    from pyspark.sql import Window

    from textloom.functions.text import context, is_place_name, surface, text_windows

    w = docs.select(article, "text", F.explode(text_windows(F.col("text"))).alias("w"))
    spans = F.regexp_extract_all(F.col("w.text"), F.lit(r"\s*[^\s]+"), F.lit(0))
    step = lambda a, x: F.struct((a["at"] + F.char_length(x)).alias("at"), F.concat(a["words"], F.array(F.struct((a["at"] + F.char_length(x) - F.char_length(F.ltrim(x))).alias("begin"), F.regexp_replace(F.trim(x), r"^[\p{P}]+|[\p{P}]+$", "").alias("word")))).alias("words"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,word:string>>").alias("words"))
    words = w.select(article, "text", F.col("w.begin").alias("shift"), F.aggregate(spans, start, step)["words"].alias("words"))
    one = words.select(article, "text", "shift", "words", F.posexplode("words").alias("i", "x")).filter(F.col("x.word").rlike(r"^\p{Lu}"))
    runs = one.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(most_words)))).filter(F.col("i") + F.col("n") <= F.size("words"))
    last = F.element_at("words", F.col("i") + F.col("n"))
    said = F.array_join(F.transform(F.slice("words", F.col("i") + 1, F.col("n")), lambda x: x["word"]), " ")
    lead = F.char_length(F.regexp_extract(F.substring("text", F.col("shift") + F.col("x.begin") + 1, F.lit(8)), r"^[\p{P}]*", 0))
    begin = F.col("shift") + F.col("x.begin") + lead
    end = F.col("shift") + last["begin"] + F.char_length(last["word"]) + F.when(F.col("n") == 1, lead).otherwise(0)
    found = runs.select(article, "text", begin.alias("start_char"), end.alias("end_char"), said.alias("surface"))
    known = names.select(surface(F.col("name")).alias("known")).distinct()
    found = found.withColumn("key", surface(F.col("surface"))).filter(is_place_name(F.col("key"))).join(known, F.col("key") == F.col("known"), "left_semi")
    found = found.dropDuplicates([article, "start_char", "end_char", "surface"])
    before = F.max("end_char").over(Window.partitionBy(article).orderBy("start_char", F.desc("end_char")).rowsBetween(Window.unboundedPreceding, -1))
    kept = found.withColumn("before", before).filter(F.col("before").isNull() | (F.col("start_char") >= F.col("before")))
    return kept.select(article, "start_char", "end_char", F.regexp_replace("surface", r"(?i)^the ", "").alias("surface"), context(F.col("text"), F.col("start_char"), F.col("end_char")).alias("context"))


def nested(collapsed: DataFrame, article: str) -> DataFrame:
    """(article, mentions): the article's places as one list, in order of place; an article's places are few."""
    return collapsed.groupBy(article).agg(F.array_sort(F.collect_list(F.struct("place_id", "toponym", "country_code", "lat", "lon", "mention_count", "confidence"))).alias("mentions"))


def renderable(countries: DataFrame, code: str = "country_code") -> DataFrame:
    """Countries that a map shows: not Antarctica, and none without a code."""
    return countries.filter(~F.col(code).isin("AQ", "-99"))
