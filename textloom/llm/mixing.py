"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a target number of words: a share by weight of ``factor`` times all words, stopped at
``most`` times the source's own words, the excess reshared by weight until no source is above. A
document's expected copies are target / words of its source; the whole part is taken at once, and the
fractional parts are rounded together, longest first. The pivotal step pairs the longest open document, of
fraction p and a words, with the next shorter ones: with probability p its fraction becomes 1 and the (1 - p) a
words come from them, else it becomes 0 and its p a words go to them, in the same proportions both ways, which
keeps every document's expectation. So the longest document is settled at once, wherever the shorter ones
together have room for its words; where they have not, it moves words with the next one alone until one of the
two is settled. Words are conserved at every step, so a source misses its target by less than the words of
the one document that is left open at the end, a short one.

The steps run as a reduction tree: documents fall by a hash into leaves of their source, every leaf
leaves at most one fraction behind, and those meet ``FAN`` leaves at a time on the next level. No source,
however large, is ever in one task: a leaf has about ``LEAF`` documents. All chance comes from hashes of
document ids and the seed, so reruns agree whatever the partitioning.

Null texts have no words; documents without words are never taken. A null source is a source of its own
and sorts last. Rows with the same id and text are rows of their own, taken in any order among themselves.
Texts of any length count whole. Further columns, whatever their names, are not looked at (repeat_rows()
carries them along). An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, mix64

#: Documents of a leaf, about; leaves that meet on the next level.
LEAF, FAN = 4096, 64
#: The table of sources is broadcast up to so many rows, and joined by a shuffle beyond.
SMALL = 10_000
#: A word: a run of other characters than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_NEAR = 1e-9


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), factor: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size).

    Stopping at the caps and resharing is filling water to one level: target = min(cap, level * weight).
    With sources in order of cap / weight, a source is stopped if the level that is left for it and all
    after it is above its own; running sums give every source's level at once. Runs over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "all_words": F.sum("source_size").over(whole) * F.lit(float(factor)),
        "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(after),
    })
    per = per.withColumn("level", (F.col("all_words") - F.col("full")) / F.col("open"))
    per = per.withColumn("stopped", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("stopped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(whole)["level"]
    per = per.withColumn("target", F.when(F.col("stopped"), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight"))))
    return per.select("source", "source_size", "n_docs", "target")


def pivotal(fraction: np.ndarray, size: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounded fractions, and the index of the one that stays open, or -1; documents come longest first."""
    out = np.where((fraction <= _NEAR) | (fraction >= 1 - _NEAR), np.round(fraction), fraction)
    open_ = np.flatnonzero((out > 0) & (out < 1)).tolist()
    at = 0  # open_[:at] is done with
    while len(open_) - at > 1:
        i = open_[at]
        p, a = float(out[i]), float(size[i])
        # Words by which each partner moves for each word of the longest one, as far as its room goes both ways.
        partners, room, n = [], 0.0, at + 1
        while n < len(open_) and room < a:
            j = open_[n]
            most = min(out[j] * size[j] / (1 - p), (1 - out[j]) * size[j] / p, a - room)
            partners.append((j, most))
            room += most
            n += 1
        up = chance[i] < p
        if room >= a * (1 - 1e-12):
            for j, w in partners:
                out[j] += (-(1 - p) if up else p) * w / size[j]
            out[i] = 1.0 if up else 0.0
        else:
            j, b = open_[at + 1], float(size[open_[at + 1]])
            q = float(out[j])
            most_up, most_down = min((1 - p) * a, q * b), min(p * a, (1 - q) * b)
            move = most_up if chance[j] * (most_up + most_down) < most_down else -most_down
            out[i], out[j] = p + move / a, q - move / b
            partners = [(j, 0.0)]
        for j in (i, *(j for j, _ in partners)):
            if out[j] <= _NEAR or out[j] >= 1 - _NEAR:
                out[j] = round(out[j])
        tail = [j for j in open_[at : at + 1 + len(partners)] if 0 < out[j] < 1]
        at += 1 + len(partners) - len(tail)
        open_[at : at + len(tail)] = tail
    return out, open_[at] if at < len(open_) else -1


def _rounder(seed: int, level: int):
    """Rounds a group's documents, long ones first; the open one keeps its fraction for the next level."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "slot"], ascending=[False, True], kind="stable").reset_index(drop=True)
        slot = pdf["slot"].to_numpy(np.int64)
        chance = (mix64(slot, seed * 1000 + level) >> np.uint64(11)).astype(np.float64) / 2.0**53
        rounded, held = pivotal(pdf["fraction"].to_numpy(np.float64), pdf["size"].to_numpy(np.float64), chance)
        pdf["fraction"] = rounded
        pdf["open"] = np.arange(len(pdf)) == held
        return pdf

    return settle


_SCHEMA = "id {}, source string, size long, fraction double, slot long, leaf long, open boolean"


def _level(df: DataFrame, kind: str, seed: int, level: int) -> DataFrame:
    return df.select("id", "source", "size", "fraction", "slot", "leaf", F.lit(False).alias("open")).groupBy("source", "leaf").applyInPandas(_rounder(seed, level), _SCHEMA.format(kind))


def mix(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    factor: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """(key, source, size, source_size, target, copies) of every document; copies is how often it is taken."""
    own = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), words(F.col(f"`{text}`").cast("string")).alias("size"))
    return mix_sizes(own, key, weights, factor, most, seed)


def mix_sizes(own: DataFrame, key: str, weights: tuple[float, ...] = (3.0, 1.0, 2.0), factor: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """mix() of (id, source, size)."""
    kind = dict(own.dtypes)["id"]
    sizes = cut(own)
    goal = cut(targets(sizes.select("source", "size"), weights, factor, most).withColumnRenamed("source", "of"))
    sources, largest = goal.agg(F.count("*"), F.max("n_docs")).first()
    largest = largest or 0
    goal = F.broadcast(goal) if sources <= SMALL else goal
    expected = F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))
    joined = sizes.join(goal, F.col("source").eqNullSafe(F.col("of"))).select(
        "id", "source", "size", "source_size", "target", "n_docs", F.when((F.col("source_size") > 0) & (F.col("size") > 0), expected).otherwise(0.0).alias("copies")
    )
    whole = F.floor(F.col("copies") + F.lit(_NEAR))
    joined = joined.withColumns({"whole": whole.cast("long"), "fraction": F.greatest(F.lit(0.0), F.col("copies") - whole), "slot": F.xxhash64(F.lit(seed), "id", "size")})
    leaves = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / F.lit(LEAF)))
    joined = joined.withColumn("leaf", F.pmod(F.shiftright("slot", 8), leaves))
    # The tree: what a level leaves open goes on; a row counts on the level on which it was settled.
    own_level = cut(_level(joined, kind, seed, 0))
    settled = [own_level.filter("not open")]
    waiting = own_level.filter("open")
    for level in range(1, 1 + max(1, math.ceil(math.log(max(2.0, largest / LEAF + 1), FAN)))):
        own_level = cut(_level(waiting.withColumn("leaf", F.expr(f"leaf div {FAN}")), kind, seed, level))
        settled.append(own_level.filter("not open"))
        waiting = own_level.filter("open")
    last = (F.pmod(F.xxhash64(F.lit(seed + 1), "source", "slot"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.col("fraction")).cast("double")
    settled.append(waiting.withColumn("fraction", last))
    rounded = settled[0]
    for part in settled[1:]:
        rounded = rounded.unionByName(part)
    # The whole copies follow from the source alone, so they are added without a join by document.
    rounded = rounded.join(goal, F.col("source").eqNullSafe(F.col("of")))
    base = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.floor(expected + F.lit(_NEAR))).otherwise(0)
    return rounded.select(
        F.col("id").alias(key),
        "source",
        "size",
        "source_size",
        "target",
        (base + F.round("fraction")).cast("long").alias("copies"),
    )


def repeat_rows(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", **how) -> DataFrame:
    """The documents with all their columns, each row as often as the mix takes it.

    Rows that are equal in all columns stand for each other: n of them that are taken c times together give
    c // n copies each and the rest from one of them, so no group of equal rows is ever numbered in one task.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    column = dict(zip(docs.columns, names, strict=True))
    body, of = F.col(column[text]).cast("string"), F.col(column[source]).cast("string")
    same = F.concat_ws(":", F.coalesce(F.col(column[key]).cast("string"), F.lit("")), F.xxhash64(*names).cast("string"), F.xxhash64(F.lit(1), *names).cast("string"))
    per = cut(plain.select(same.alias("same"), words(body).alias("size"), of.alias("source")).groupBy("same").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("source").alias("source")))
    each = per.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(F.concat_ws("#", "same", F.col("i").cast("string")).alias("id"), "source", "size")
    taken = mix_sizes(each, "id", **how).filter("copies > 0").groupBy(F.substring_index("id", "#", 1).alias("same")).agg(F.sum("copies").alias("taken"))
    taken = cut(taken.join(per.select("same", "n"), "same").select(F.col("same").alias("of"), F.expr("cast(taken div n as int)").alias("low"), F.expr("cast(taken % n as int)").alias("more")))
    keyed = plain.withColumn("same", same)
    again = lambda rows, n: rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col(n)))).select(*names)
    whole = again(keyed.join(taken.filter("low > 0"), F.col("same") == F.col("of")), "low")
    if taken.filter("more > 0").isEmpty():  # as it is without equal rows
        return whole.toDF(*docs.columns)
    rest = again(keyed.join(taken.filter("more > 0"), F.col("same") == F.col("of")).dropDuplicates(["same"]), "more")
    return whole.unionByName(rest).toDF(*docs.columns)
