"""Approximate nearest neighbours by inner product: inverted lists with an adaptive dimension scan.

One more dimension, sqrt(M^2 - |x|^2) for rows and 0 for queries, turns the largest inner product into the
smallest distance. Lists are the cells of k-means centroids fitted on a bounded sample; every row is in a list.
A query probes as many of its nearest lists as hold ``aim`` of the true neighbours of sample queries, and more
of them until they hold k other rows. Within a list, rotated vectors are read in blocks of ``COLUMNS``
dimensions: the distance so far, scaled to all dimensions, is an estimate whose error falls with the dimensions
read, and a candidate is abandoned as soon as a test at ``EPSILON`` says that it will not be among the best.
What is left is scored exactly, on the original vectors in double precision.

There are about ``FINE * sqrt(n)`` lists for n rows: the sample grows with them (``EACH`` rows a list, at least
``SAMPLE``), until it has ``MOST`` bytes; then there are no more lists, only longer ones, and the model stops growing.
Fitting works in blocks, so the driver holds the sample twice and little besides. Lists near each other form groups; a group
is cut into chunks of ``CHUNK`` rows and ``ASKS`` queries, so a hot one is many tasks, and a query goes to a
group once with the lists that it probes there. A task returns k rows a query.

Vectors that are null, empty, zero or not finite take no part; a query meets rows of its own length only, and
every row but itself: rows that repeat its id are candidates, and each of them that is a query has its own
list. Ties go to the smaller id. Ids are integers; rows whose id is null (or no integer) take no part. Further
columns, whatever their names, are not looked at. Queries are given by a condition, so they grow with the table.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import cut, mix64
from textloom.llm.vectors import matrix, rotation, usable

#: Rows that centroids and the number of probes are fitted on, at least, and for each list; lists by the root of
#: the rows; rows and queries of a task's chunk.
SAMPLE, EACH, FINE, CHUNK, ASKS = 20_000, 16, 4.0, 16_384, 8192
#: Bytes of the sample as doubles; numbers in a block of a matrix of distances.
MOST, BLOCK = 64 << 20, 1 << 22
#: Dimensions of a block; the test's width in standard errors.
COLUMNS, EPSILON = 16, 2.4


def _augment(x: np.ndarray, bound: float) -> np.ndarray:
    rest = np.maximum(0.0, bound * bound - np.einsum("ij,ij->i", x, x))
    return np.column_stack([x, np.sqrt(rest)])


def _centroids(x: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = _near(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], c)
    return c


def _near(q: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centroids of each query, nearest first."""
    out = np.empty((len(q), min(n, len(c))), np.int64)
    half = (c * c).sum(1) / 2
    step = max(1, min(1024, BLOCK // len(c)))
    for i in range(0, len(q), step):
        d = half - q[i : i + step] @ c.T
        if out.shape[1] == 1:
            out[i : i + step, 0] = d.argmin(1)
        else:
            out[i : i + step] = np.argsort(d, 1, kind="stable")[:, : out.shape[1]]
    return out


def _most(d: int) -> int:
    """Rows of the sample at most."""
    return max(1024, MOST // (8 * d))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids and vectors of a batch as two binaries: rows as objects take the driver many times the memory."""
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()]), pa.array([matrix(b.column(1)).tobytes()])], names=["ids", "v"])


def _sample(drawn: DataFrame, d: int, most: int) -> np.ndarray:
    """About ``most`` of the rows at most, by id; ids that repeat may have drawn many more."""
    n = drawn.count()
    if n > 1.2 * most:
        drawn = drawn.filter(F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(1_000_003)) <= F.lit(int(1_000_003 * most / n)))
    got = drawn.select("id", "v").mapInArrow(_packed, "ids binary, v binary").collect()
    ids = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["ids"], np.int64) for r in got)])
    x = np.concatenate([np.zeros((0, d)), *(np.frombuffer(r["v"]).reshape(-1, d) for r in got)])
    del got
    return x[np.lexsort((*x.T[::-1], ids))[:most]]


class Lists:
    """The model of one length of vectors: centroids, their groups, and how many lists a query probes."""

    def __init__(self, x: np.ndarray, rows: int, bound: float, k: int, aim: float):
        self.bound = bound
        wide = _augment(x, bound)
        self.c = _centroids(wide, max(1, min(round(FINE * np.sqrt(rows)), _most(x.shape[1]) // EACH)))
        self.group = _near(self.c, _centroids(self.c, max(1, round(np.sqrt(len(self.c)) * 2))), 1)[:, 0]
        self.probes = self._fit(x, wide, k, aim)

    def _fit(self, x: np.ndarray, wide: np.ndarray, k: int, aim: float) -> int:
        """Lists that hold ``aim`` of the true neighbours, within the sample, of sample queries."""
        own = np.arange(0, len(x), max(1, len(x) // 400))
        k = min(k, len(x) - 1)
        if k < 1 or len(self.c) < 2:
            return len(self.c)
        home, places = _near(wide, self.c, 1)[:, 0], []
        step = max(1, BLOCK // len(x))
        for i in range(0, len(own), step):
            some = own[i : i + step]
            s = -(x[some] @ x.T)
            s[np.arange(len(some)), some] = np.inf
            best = np.argpartition(s, k - 1, 1)[:, :k]
            order = _near(np.column_stack([x[some], np.zeros(len(some))]), self.c, len(self.c))
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.arange(len(self.c))[None, :], 1)
            places.append(np.take_along_axis(place, home[best], 1).ravel())
        at = np.sort(np.concatenate(places))
        return int(at[min(len(at) - 1, int(np.ceil(aim * len(at))))]) + 1

    def probe(self, q: np.ndarray, size: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, list): the nearest lists of each query, and further ones until they hold k rows besides it."""
        out, step = [], max(1, BLOCK // len(self.c))
        for x in range(0, len(q), step):
            part = q[x : x + step]
            order = _near(np.column_stack([part, np.zeros(len(part))]), self.c, len(self.c))
            held = np.cumsum(size[order], 1)
            enough = np.minimum((held < k + 1).sum(1) + 1, len(self.c))
            n = np.maximum(enough, self.probes)
            i, j = np.nonzero(np.arange(len(self.c)) < n[:, None])
            lists = order[i, j]
            full = size[lists] > 0
            out.append((i[full] + x, lists[full]))
        i, lists = zip(*out, strict=True)
        return np.concatenate(i), np.concatenate(lists)


def scan(q: np.ndarray, qrow: np.ndarray, probe: np.ndarray, x: np.ndarray, xrow: np.ndarray, xid: np.ndarray, list_of: np.ndarray, bound: float, k: int, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row of x, score) of the k best rows for each query, as the adaptive scan finds them.

    The rows of x are sorted by list; ``probe[query, list]`` says which lists a query reads.
    """
    turn = rotation(x.shape[1] + 1)
    rq = np.column_stack([q, np.zeros(len(q))]) @ turn
    rx = _augment(x, bound) @ turn
    dims = rx.shape[1]
    score, best = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
    order_id = np.append(xid, np.iinfo(np.int64).max)
    limit = (q * q).sum(1) + bound * bound  # distance = limit - 2 * inner product

    def keep(i: np.ndarray, j: np.ndarray) -> None:
        """Exact scores of the pairs (i, j) go into the lists of the best."""
        s = np.einsum("ij,ij->i", q[i], x[j])
        other = qrow[i] != xrow[j]
        i, s, j = i[other], s[other], j[other]
        rows = np.unique(i)
        all_i = np.concatenate([np.repeat(rows, k), i])
        all_s = np.concatenate([score[rows].ravel(), s])
        all_j = np.concatenate([best[rows].ravel(), j])
        order = np.lexsort((order_id[all_j], -all_s, all_i))
        all_i = all_i[order]
        first = np.searchsorted(all_i, rows)
        take = order[(first[:, None] + np.arange(k)).ravel()]
        score[rows], best[rows] = all_s[take].reshape(-1, k), all_j[take].reshape(-1, k)

    ends = np.append(np.flatnonzero(list_of[1:] != list_of[:-1]) + 1, len(x))
    begin = 0
    for end in ends.tolist():
        asks = np.flatnonzero(probe[:, list_of[begin]])
        for s in range(begin, end, step):
            e = min(s + step, end)
            for a in range(0, len(asks), 256):
                own = asks[a : a + 256]
                worst = np.maximum(0.0, limit[own] - 2 * score[own, -1])
                read = min(COLUMNS, dims)
                y, z = rq[own, :read], rx[s:e, :read]
                part = (y * y).sum(1)[:, None] + (z * z).sum(1) - 2 * (y @ z.T)
                bar = lambda d: d / dims * (1 + EPSILON / np.sqrt(d)) ** 2 if d < dims else 1 + 1e-9
                i, j = np.nonzero(part <= (worst * bar(read))[:, None])
                part = part[i, j]
                while read < dims and len(i):
                    more = min(COLUMNS, dims - read)
                    d = rq[own[i], read : read + more] - rx[j + s, read : read + more]
                    part = part + np.einsum("ij,ij->i", d, d)
                    read += more
                    go = part <= worst[i] * bar(read)
                    i, j, part = i[go], j[go], part[go]
                if len(i):
                    keep(own[i], j + s)
        begin = end
    i, j = np.nonzero(score > -np.inf)
    return i, best[i, j], score[i, j]


def _homes(model: dict[int, Lists]):
    """(row, id, dim, list, v, query) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim = b.column(3).to_numpy()
            home = np.zeros(len(dim), np.int32)
            for d in np.unique(dim).tolist():
                at = np.flatnonzero(dim == d)
                m = model[d]
                home[at] = _near(_augment(matrix(b.column(2).take(pa.array(at))), m.bound), m.c, 1)[:, 0]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), pa.array(home), b.column(2), b.column(4)], names=["row", "id", "dim", "list", "v", "query"])

    return run


def _deal(model: dict[int, Lists], size: dict[int, np.ndarray], chunks: dict[tuple[int, int], tuple[int, int]], k: int):
    """(dim, grp, rows, asks, row, id, list, lists, v): rows for their group, queries for each group that they probe.

    A group of n chunks of rows and m of queries has n * m tasks; rows go to m of them and queries to n.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                b = batch.slice(s, 2048)
                dims, lists = b.column(2).to_numpy(), b.column(3).to_numpy()
                asks, slot = b.column(5).to_numpy(zero_copy_only=False), mix64(b.column(0).to_numpy(), 51)
                for d in np.unique(dims).tolist():
                    m = model[d]
                    own = np.flatnonzero(dims == d)
                    out: list[tuple[int, int, int, int, bytes | None]] = []
                    for i, g in zip(own.tolist(), m.group[lists[own]].tolist(), strict=True):
                        n, many = chunks[d, g]
                        out += [(i, g, int(slot[i] % np.uint64(n)), a, None) for a in range(many)]
                    q = own[asks[own]]
                    if len(q):
                        i, l = m.probe(matrix(b.column(4).take(pa.array(q))), size[d], k)
                        g = m.group[l]
                        order = np.lexsort((l, g, i))
                        i, l, g = i[order], l[order], g[order]
                        cuts = np.flatnonzero((np.diff(i) != 0) | (np.diff(g) != 0)) + 1
                        for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(i)], strict=True):
                            at, grp = int(q[i[x]]), int(g[x])
                            n, many = chunks[d, grp]
                            out += [(at, grp, a, int(slot[at] % np.uint64(many)), l[x:y].astype(np.int32).tobytes()) for a in range(n)]
                    for x in range(0, len(out), 8192):
                        at, grp, r, a, probed = zip(*out[x : x + 8192], strict=True)
                        rows = b.take(pa.array(at))
                        yield pa.RecordBatch.from_arrays(
                            [rows.column(2), pa.array(grp, pa.int32()), pa.array(r, pa.int32()), pa.array(a, pa.int32()), rows.column(0), rows.column(1), rows.column(3), pa.array(probed, pa.binary()), rows.column(4)],
                            names=["dim", "grp", "rows", "asks", "row", "id", "list", "lists", "v"],
                        )

    return run


def search(df: DataFrame, queries: Column, vector: str = "embedding", key: str = "vec_id", k: int = 20, aim: float = 0.95, seed: int = 9) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of every row for which ``queries`` holds."""
    own = df.select(F.col(f"`{key}`").try_cast("long").alias("id"), F.col(f"`{vector}`").alias("v"), queries.alias("query"))
    own = own.filter(usable(F.col("v")) & F.col("id").isNotNull()).select(F.monotonically_increasing_id().alias("row"), "id", "v", F.size("v").alias("dim"), F.coalesce("query", F.lit(False)).alias("query"))
    own = cut(own)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    model: dict[int, Lists] = {}
    for r in own.groupBy("dim").agg(F.count("*").alias("n"), F.max(norm).alias("bound")).collect():  # a row a length
        d, n, bound = r["dim"], r["n"], r["bound"] * (1 + 1e-9)
        sample = min(max(SAMPLE, round(EACH * FINE * np.sqrt(n))), _most(d))
        drawn = own.filter((F.col("dim") == d) & (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_003)) <= F.lit(int(1_000_003 * min(1.0, sample / n)))))
        x = _sample(drawn, d, sample)
        model[d] = Lists(x if len(x) else np.zeros((1, d)), n, bound, k, aim)
    homes = cut(own.mapInArrow(_homes(model), f"row long, id long, dim int, list int, v {dict(own.dtypes)['v']}, query boolean"))
    size = {d: np.zeros(len(m.c), np.int64) for d, m in model.items()}
    for r in homes.groupBy("dim", "list").count().collect():  # a row a list
        size[r["dim"]][r["list"]] = r["count"]
    asked = {r["dim"]: r["count"] for r in homes.filter("query").groupBy("dim").count().collect()}
    chunks = {}
    for d, m in model.items():
        held = np.bincount(m.group, size[d], int(m.group.max()) + 1)
        for g, n in enumerate(held.tolist()):
            chunks[d, g] = (max(1, -(-int(n) // CHUNK)), max(1, -(-asked.get(d, 0) // ASKS)))
    bounds = {d: m.bound for d, m in model.items()}
    dealt = homes.mapInArrow(_deal(model, size, chunks, k), f"dim int, grp int, rows int, asks int, row long, id long, list int, lists binary, v {dict(own.dtypes)['v']}")

    def run(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        is_query = ~rows["lists"].is_null().to_numpy()
        qi, xi = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        ids, row, lists = rows["id"].to_numpy(), rows["row"].to_numpy(), rows["list"].to_numpy()
        if len(qi) and len(xi):
            xi = xi[np.lexsort((ids[xi], lists[xi]))]
            v = matrix(rows["v"])
            names, at = np.unique(lists[xi], return_inverse=True)
            probe = np.zeros((len(qi), len(names)), bool)
            for k_, load in enumerate(rows["lists"].take(pa.array(qi)).to_pylist()):
                l = np.frombuffer(load, np.int32)
                probe[k_, np.searchsorted(names, l[np.isin(l, names)])] = True
            a, b, s = scan(v[qi], row[qi], probe, v[xi], row[xi], ids[xi], at, bounds[group[0].as_py()], k)
            a, b = qi[a], xi[b]
        else:
            a, b, s = qi[:0], xi[:0], np.zeros(0)
        return pa.table({"query_row": pa.array(row[a], pa.int64()), "query_id": pa.array(ids[a], pa.int64()), "row": pa.array(row[b], pa.int64()), "id": pa.array(ids[b], pa.int64()), "score": pa.array(s, pa.float64())})

    found = dealt.groupBy("dim", "grp", "rows", "asks").applyInArrow(run, "query_row long, query_id long, row long, id long, score double")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
