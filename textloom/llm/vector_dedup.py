"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c are at squared distance 2 - 2c. After a rotation the dimensions are split into
``BLOCKS`` blocks; of any pair within the distance, at least one block is within its share of the squared
distance. Every block is range-joined under that budget: quantiles of a bounded sample split the block's
coordinates, one after the other, into cells, about one for ``LEAF`` vectors; a row meets the rows of its own
cell, and visits each later cell that has a point within the budget, by the distance from the row to the
cell's box over all split coordinates. The candidates of all blocks are verified exactly, with the original
vectors in double precision. A pair counts in the first block whose budget it meets, so that no list of pairs
is needed to count links: rotated coordinates are rounded to integers, which makes block distances exact and
alike in every task.

How much the cells spare grows with the table, as more coordinates are split: of vectors without any
structure (64 dimensions, cosine 0.9) half of all pairs still meet in a block at 8 splits, a fifth at 12 and
less than a tenth at 16; clustered vectors are spared far more. See the README for measured shares.

Equal vectors are joined into one first, with their number. The rows of a cell, and its visitors, are each cut
into chunks of at most ``CHUNK``; a task takes two chunks, and pairs never leave it: only counts of links and a
spanning forest do. Null, empty, zero or non-finite vectors link with nothing; vectors of different lengths do
not link. Ids are integers; a row whose id is null (or no integer) links with nothing and is kept. Rows that
repeat an id are rows of their own. Further columns, whatever their names, are not looked at. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, mix64
from textloom.llm.components import components, forest
from textloom.llm.vectors import matrix, rotation, usable

#: Blocks of dimensions; rows of a chunk at most; vectors of a cell, about; splits of a block at most.
BLOCKS, CHUNK, LEAF, SPLITS = 4, 32_768, 16_384, 14
#: Vectors that the cells' bounds are fitted on.
SAMPLE = 20_000
_GRID = float(1 << 20)
_ROWS = 512


def _rotated(v: np.ndarray) -> np.ndarray:
    """Rotated unit vectors on the integer grid, zeros added up to a multiple of ``BLOCKS`` dimensions."""
    u = v / np.abs(v).max(1, keepdims=True)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    out = np.zeros((len(v), -(-v.shape[1] // BLOCKS) * BLOCKS))
    out[:, : v.shape[1]] = np.rint(u @ rotation(v.shape[1]) * _GRID)
    return out


def _radius(cosine: float, dims: int) -> float:
    """Of a block, with room for the rounding to the grid."""
    return (np.sqrt(max(0.0, 2 - 2 * cosine) / BLOCKS) + 2 * np.sqrt(dims) / _GRID) * (1 + 1e-12)


def fit_cells(v: np.ndarray, rows: int) -> list[list[np.ndarray]]:
    """For each block, the inner bounds of its coordinates' parts: 2^k parts where a coordinate is split k times."""
    q = _rotated(v)
    width = q.shape[1] // BLOCKS
    splits = min(SPLITS, max(0, int(np.ceil(np.log2(max(1, rows / LEAF))))))
    out = []
    for block in range(BLOCKS):
        times = [splits // width + (c < splits % width) for c in range(width)]
        out.append([np.quantile(q[:, block * width + c], np.arange(1, 1 << n) / (1 << n)) if n and len(q) else np.zeros(0) for c, n in enumerate(times)])
    return out


def cells(q: np.ndarray, bounds: list[np.ndarray]) -> np.ndarray:
    """The cell of each row, by its coordinates in one block."""
    out = np.zeros(len(q), np.int64)
    for c, edge in enumerate(bounds):
        if len(edge):
            out = out * (len(edge) + 1) + np.searchsorted(edge, q[:, c], "right")
    return out


def visits(q: np.ndarray, bounds: list[np.ndarray], radius: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell): cells after a row's own that come within the radius of it."""
    row, code, far = np.arange(len(q)), np.zeros(len(q), np.int64), np.zeros(len(q))
    for c, edge in enumerate(bounds):
        if len(edge):
            n = len(edge) + 1
            low, high = np.concatenate([[-np.inf], edge]), np.concatenate([edge, [np.inf]])
            x = q[row, c][:, None]
            gap = np.maximum(0.0, np.maximum(low - x, x - high))
            total = far[:, None] + gap * gap
            i, j = np.nonzero(total <= radius * radius)
            row, code, far = row[i], code[i] * n + j, total[i, j]
    later = code > cells(q, bounds)[row]
    return row[later], code[later]


def _verify(x: np.ndarray, y: np.ndarray, qx: np.ndarray, qy: np.ndarray, block: int, width: int, budget: float, cosine: float, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (i, j) that are links and meet no earlier block's budget."""
    fresh = np.ones(len(i), bool)
    for b in range(block):
        d = qx[i, b * width : (b + 1) * width] - qy[j, b * width : (b + 1) * width]
        fresh &= (d * d).sum(1) > budget
    i, j = i[fresh], j[fresh]
    a, b = x[i], y[j]
    linked = np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b)) >= cosine
    return i[linked], j[linked]


def _tile(cosine: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        block, alone = key[1].as_py(), key[5].as_py()
        side = rows["side"].to_numpy()
        ids, many, v = rows["rep"].to_numpy(), rows["many"].to_numpy(), matrix(rows["v"])
        v = v / np.abs(v).max(1, keepdims=True)
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        q = _rotated(v) if len(v) else v
        links, heads, tails = np.zeros(len(v), np.int64), [], []
        if len(left) and len(right):
            width = q.shape[1] // BLOCKS
            budget = (_GRID * _radius(cosine, width)) ** 2
            part = q[:, block * width : (block + 1) * width]
            half = (part * part).sum(1) / 2
            one = np.ones(len(v))
            a, b = np.column_stack([part, half, one])[left], np.column_stack([part, -one, -half])[right]
            for s in range(0, len(left), _ROWS):
                for t in range(s if alone else 0, len(right), 4096):
                    near = a[s : s + _ROWS] @ b[t : t + 4096].T >= -budget / 2
                    at = np.flatnonzero(near.ravel())
                    for k in range(0, len(at), 50_000):
                        i, j = np.divmod(at[k : k + 50_000], near.shape[1])
                        i, j = left[i + s], right[j + t]
                        if alone:
                            i, j = i[i < j], j[i < j]
                        i, j = _verify(v, v, q, q, block, width, budget, cosine, i, j)
                        np.add.at(links, i, many[j])
                        np.add.at(links, j, many[i])
                        x, y = forest(ids[i], ids[j])
                        heads.append(x)
                        tails.append(y)
                    if len(heads) > 64:
                        x, y = forest(np.concatenate(heads), np.concatenate(tails))
                        heads, tails = [x], [y]
        got = np.flatnonzero(links)
        x, y = forest(np.concatenate(heads), np.concatenate(tails)) if heads else (ids[:0], ids[:0])
        return pa.table({
            "rep": pa.array(np.concatenate([ids[got], x]), pa.int64()),
            "links": pa.array(np.concatenate([links[got], np.zeros(len(x), np.int64)]), pa.int64()),
            "to": pa.array([None] * len(got) + y.tolist(), pa.int64()),
        })

    return run


def _blocks(rows: pa.RecordBatch, dims: np.ndarray, column: int, model: dict[int, list[list[np.ndarray]]]):
    """(dim, block, rows, their coordinates, bounds, radius) of a batch."""
    for d in np.unique(dims).tolist():
        own = np.flatnonzero(dims == d)
        q = _rotated(matrix(rows.column(column).take(pa.array(own))))
        width = q.shape[1] // BLOCKS
        for block in range(BLOCKS):
            yield d, block, own, q[:, block * width : (block + 1) * width], model[d][block], width


def _deal(cosine: float, model: dict[int, list[list[np.ndarray]]], parts: dict[tuple[int, int, int], tuple[int, int]]):
    """Copies of each row for every tile that it is part of: (cell, a, b, alone) tells tiles of a block apart.

    A cell with n chunks of its own and m of visitors has the tiles of any two of its own and of each own one with
    each of the visitors'.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                rows = batch.slice(s, 1024)
                ids = rows.column(0).to_numpy()
                home = mix64(ids, 41)
                out: dict[str, list[np.ndarray]] = {k: [] for k in ("at", "dim", "block", "cell", "a", "b", "alone", "side")}

                def add(d, block, at, cell, a, b, alone, side, out=out):
                    for name, x, kind in (("at", at, np.int64), ("dim", d, np.int32), ("block", block, np.int32), ("cell", cell, np.int64), ("a", a, np.int32), ("b", b, np.int32), ("alone", alone, bool), ("side", side, np.int8)):
                        out[name].append(np.broadcast_to(np.asarray(x, kind), (len(at),)))

                for d, block, own, q, bounds, width in _blocks(rows, rows.column(1).to_numpy(), 3, model):
                    code = cells(q, bounds)
                    for x in np.unique(code).tolist():
                        here = own[code == x]
                        n, m = parts[d, block, x]
                        chunk = (home[here] % np.uint64(n)).astype(np.int64)
                        for j in range(n):
                            add(d, block, here, x, np.minimum(chunk, j), np.maximum(chunk, j), chunk == j, chunk > j)
                        for j in range(m):
                            add(d, block, here, x, chunk, -1 - j, False, 0)
                    row, code = visits(q, bounds, _radius(cosine, width) * _GRID)
                    for x in np.unique(code).tolist():
                        if (d, block, x) in parts:
                            here = own[row[code == x]]
                            n, m = parts[d, block, x]
                            for j in range(n):
                                add(d, block, here, x, j, -1 - (home[here] % np.uint64(m)).astype(np.int64), False, 1)
                c = {k: np.concatenate(x) if x else np.zeros(0, np.int64) for k, x in out.items()}
                for k in range(0, len(c["at"]), 8192):
                    p = {n: x[k : k + 8192] for n, x in c.items()}
                    take = rows.take(pa.array(p["at"]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p[n]) for n in ("dim", "block", "cell", "a", "b", "alone", "side")] + [take.column(0), take.column(2), take.column(3)],
                        names=["dim", "block", "cell", "a", "b", "alone", "side", "rep", "many", "v"],
                    )

    return run


def _sizes(cosine: float, model: dict[int, list[list[np.ndarray]]]):
    """(dim, block, cell, n, visitors) of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                rows = batch.slice(s, 2048)
                for d, block, _, q, bounds, width in _blocks(rows, rows.column(0).to_numpy(), 1, model):
                    own, far = cells(q, bounds), visits(q, bounds, _radius(cosine, width) * _GRID)[1]
                    x, at = np.unique(np.concatenate([own, far]), return_inverse=True)
                    n, m = np.bincount(at[: len(own)], minlength=len(x)), np.bincount(at[len(own) :], minlength=len(x))
                    yield pa.RecordBatch.from_arrays([pa.array([d] * len(x), pa.int32()), pa.array([block] * len(x), pa.int32()), pa.array(x), pa.array(n), pa.array(m)], names=["dim", "block", "cell", "n", "m"])

    return run


def near_duplicates(df: DataFrame, vector: str = "embedding", key: str = "vec_id", cosine: float = 0.9) -> DataFrame:
    """(key, n_links, component_id, kept) of every row: links are pairs with at least this cosine."""
    own = df.select(F.col(f"`{key}`").try_cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    good = cut(own.filter(usable(F.col("v")) & F.col("id").isNotNull()))
    reps = cut(good.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("many")).select("rep", F.size("v").alias("dim"), "many", "v"))
    model: dict[int, list[list[np.ndarray]]] = {}
    for r in reps.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row a length of vectors
        share = min(1.0, SAMPLE / r["n"])
        drawn = reps.filter((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64(F.lit(5), "rep"), F.lit(1_000_003)) <= F.lit(int(1_000_003 * share))))
        model[r["dim"]] = fit_cells(np.array([x["v"] for x in drawn.select("rep", "v").orderBy("rep").limit(SAMPLE).select("v").collect()], np.float64).reshape(-1, r["dim"]), r["n"])
    # At most BLOCKS * 2^SPLITS cells a length of vectors, however many rows.
    counts = reps.select("dim", "v").mapInArrow(_sizes(cosine, model), "dim int, block int, cell long, n long, m long").groupBy("dim", "block", "cell").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    parts = {(r["dim"], r["block"], r["cell"]): (-(-r["n"] // CHUNK), -(-r["m"] // CHUNK)) for r in counts.filter("n > 0").collect()}
    dealt = reps.mapInArrow(_deal(cosine, model, parts), f"dim int, block int, cell long, a int, b int, alone boolean, side byte, rep long, many long, v {dict(reps.dtypes)['v']}")
    found = cut(dealt.groupBy("dim", "block", "cell", "a", "b", "alone").applyInArrow(_tile(cosine), "rep long, links long, to long"))
    joined = components(found.filter("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")), forested=True)
    links = found.filter("to is null").groupBy("rep").agg(F.sum("links").alias("links"))
    per_rep = reps.select("rep", "many", "v").join(links, "rep", "left").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    per_rep = per_rep.select(F.col("v").alias("rv"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = good.join(per_rep, F.col("v") == F.col("rv")).select("id", "n_links", "component_id")
    alone = own.filter(~usable(F.col("v")) | F.col("id").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
