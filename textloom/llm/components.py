"""Connected components of links, by distributed iterations.

Large-star and small-star steps (Kiveris et al., 2014) turn any link table into stars around the smallest
id of each component in a logarithmic number of rounds. Before the first round every partition replaces
its links by a spanning forest, which bounds them by its nodes. Minima are combined before the shuffle, cut by
a checkpoint and joined back: the join's sides are then plain shuffles, which Spark splits where a hub's links are
many, so they need not meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars (node, smallest node of its component) of the links a[i], b[i], without the centres."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:  # hooking by minimum, then pointer jumping
        lo = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], lo)
        np.minimum.at(label, label[y], lo)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        if np.array_equal(before, label):
            break
    out = label != np.arange(len(nodes))
    return nodes[out], nodes[label[out]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    for x in batches:
        a = np.concatenate([a, x.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, x.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 2_000_000:  # a forest of what has come so far; beyond memory's bound it goes out as it is
            a, b = forest(a, b)
            if len(a) > 1_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)
                a, b = a[:0], b[:0]
    a, b = forest(a, b)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, forested: bool = False) -> DataFrame:
    """(node, component) of every linked node; component is the smallest node that links lead to.

    Ids are integers. Links of a node with itself and null ends are left out. No links: no rows. Links that tasks have
    made forests of already (``forested``) go through no further worker.
    """
    pairs = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a <> b")
    stars = cut(pairs if forested else pairs.mapInArrow(_local, "a long, b long"))
    state = None
    for _ in range(rounds):
        both = stars.select(F.col("a").alias("n"), F.col("b").alias("o")).union(stars.select("b", "a"))
        # Large star: larger neighbours go to the smallest one, the node itself included.
        low = cut(both.groupBy("n").agg(F.min("o").alias("m")))
        large = cut(both.filter("o > n").join(low, "n").select(F.col("o").alias("a"), F.least("n", "m").alias("b")).distinct())
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a")
        stars = cut(small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select("b", F.col("m"))).distinct())
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
