"""N-gram Jaccard join with a MinHash LSH forest.

Texts are sets of word shingles. Equal sets are joined into one first, with their number. Each set gets a
signature of ``TREES * DEPTH`` MinHash values; tree i takes ``DEPTH`` of them as its label, and the sorted
labels of a tree are a prefix trie. A set asks in every tree for the sets that share a prefix of its label. It
shortens these prefixes from the whole label on: first in all trees alike, until partners of the target
similarity s are found with probability ``recall``, 1 - (1 - s^d)^TREES at length d (no knowledge of the table
has a part in this, so the bound holds for every pair); then each set by itself, again and again in the tree
where the next shorter prefix brings the fewest more sets, until the product of 1 - s^d over its trees' lengths
says that ``FINE`` are found. So prefixes stay longer where a trie is crowded and get short where that is cheap.
The number of sets below each prefix is counted in rounds between chunks and buckets (see exchange.py) that
add counts up before anything is sent, so a prefix that a third of all sets have is one number a chunk.

What meets by a prefix is first compared by the whole signatures: only pairs whose agreement does not speak
against the similarity (``DOUBT`` standard errors below it) are edges, and only edges are closed into
groups, so texts that merely share boilerplate do not chain. Sets below one short prefix are cut into tiles
of ``TILE`` sets, so a crowded prefix is many tasks.

All pairs within a group are then verified exactly, on the shingles themselves: every set goes to its
group's task once. Shingles of one set only are left out, shingles that the same sets have are joined into one
weighted column, and the overlaps are matrix products of blocks of sets. Groups of more than ``TILE`` sets
are cut into tiles of two parts each. Pairs never leave a task: only numbers of links and a spanning
forest do, so a group of any size costs rows in proportion to its sets, and no link within it is lost.

Null and empty texts have no shingles and link with nothing; texts of fewer words than a shingle are one
shingle. Ids are integers; a row whose id is null (or is no integer) links with nothing and is kept. Rows that
share an id are rows of their own for numbers of links; of rows with one id and one class the first is kept.
Texts of any length are used whole. Further columns, whatever their names, are not looked at. An empty table
gives an empty result. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import exchange
from textloom.llm.common import cut, mix64, tidy
from textloom.llm.components import components, forest
from textloom.llm.shingles import sets_of

#: Similarity, recall of candidates at it by prefixes of one length and by those shortened further, trees and
#: label values of each, shortest prefix, sets of a task's part.
SIMILARITY, RECALL, FINE, TREES, DEPTH, SHORTEST, TILE = 0.8, 0.998, 0.9998, 16, 8, 3, 4096
#: Standard errors of a signature's agreement that an edge may lie below the similarity.
DOUBT = 4.5
_LEVELS = DEPTH - SHORTEST + 1
_A = mix64(np.arange(TREES * DEPTH, dtype=np.uint64), 7) | np.uint64(1)
_B = mix64(np.arange(TREES * DEPTH, dtype=np.uint64), 8)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of each MinHash value, a row a set; sets are not empty."""
    out = np.empty((len(sets), len(_A)), np.uint16)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= 1 << 17):
            size += len(sets[j])
            j += 1
        s = np.concatenate(sets[i:j])
        begin = np.cumsum([0, *[len(x) for x in sets[i : j - 1]]])
        h = np.empty_like(s)
        for k in range(len(_A)):
            np.multiply(s, _A[k], out=h)
            h += _B[k]
            out[i:j, k] = mix64(np.minimum.reduceat(h, begin)).astype(np.uint16)
        i = j
    return out


def prefixes(sig: np.ndarray) -> np.ndarray:
    """Hashes of each set's prefixes of SHORTEST to DEPTH values: [set, tree, level]."""
    v = sig.reshape(len(sig), TREES, DEPTH).astype(np.uint64)
    out = np.empty((len(sig), TREES, _LEVELS), np.uint64)
    h = np.broadcast_to(mix64(np.arange(TREES, dtype=np.uint64), 21), (len(sig), TREES))
    for d in range(DEPTH):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + v[:, :, d], 22)
        if d >= SHORTEST - 1:
            out[:, :, d - SHORTEST + 1] = h
    return out


def depths(sizes: np.ndarray, similarity: float, recall: float) -> np.ndarray:
    """Prefix lengths [set, tree] from the numbers of sets below each prefix [set, tree, level]."""
    base = next((d for d in range(DEPTH, SHORTEST, -1) if 1 - (1 - similarity**d) ** TREES >= recall), SHORTEST)
    d = np.full(sizes.shape[:2], base)
    miss = lambda x: np.log1p(-(float(similarity) ** x))
    while True:
        total = miss(d).sum(1)
        rows = np.flatnonzero((total > np.log(1 - max(FINE, min(recall, 1 - 1e-12)))) & (d > SHORTEST).any(1))
        if not len(rows):
            return d
        now = d[rows]
        level = np.maximum(now - SHORTEST, 1)
        here = np.take_along_axis(sizes[rows], level[:, :, None], 2)[:, :, 0]
        more = np.take_along_axis(sizes[rows], level[:, :, None] - 1, 2)[:, :, 0]
        price = np.where(now > SHORTEST, (more - here) * 16.0 - now, np.inf)  # of equal prices the longest prefix
        d[rows, price.argmin(1)] -= 1


def _sets(key: tuple[pa.Scalar, ...], docs: pa.Table) -> pa.Table:
    """(doc_id, row_id, chunk, digest, shingles, sig) of every document."""
    sets = sets_of(exchange.unsqueeze(docs["body"]))
    full = [i for i, s in enumerate(sets) if len(s)]
    digest: list[bytes | None] = [None] * len(sets)
    sig: list[bytes | None] = [None] * len(sets)
    for i, x in zip(full, signatures([sets[i] for i in full]), strict=True):
        digest[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
        sig[i] = x.tobytes()
    tidy()
    return pa.table({"doc_id": docs["doc_id"], "row_id": docs["row_id"], "chunk": docs["chunk"], "digest": pa.array(digest, pa.binary()), "shingles": pa.array([len(s) for s in sets], pa.int64()), "sig": pa.array(sig, pa.binary())})


def _signatures(reps: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(reps["sig"].to_pylist()), np.uint16).reshape(reps.num_rows, -1)


def _count(keys: np.ndarray, buckets: int):
    """Messages (prefix, number of sets) to the prefixes' buckets."""
    k, n = np.unique(keys, return_counts=True)
    if len(k):
        yield from exchange.by_bucket((k % np.uint64(buckets)).astype(np.int64), k, n.astype(np.uint32))


def _total(bucket: int, got: list[tuple[int, bytes]]):
    """Numbers of sets of the prefixes that more than one set has, to all chunks that have them."""
    parts = [exchange.unpack(load, 2) for _, load in got]
    k, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    sender = np.repeat(np.arange(len(got)), [len(p[0]) for p in parts])
    order = np.argsort(k, kind="stable")
    k, n, sender = k[order], n[order].astype(np.int64), sender[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    total = np.repeat(np.add.reduceat(n, first), np.diff(np.append(first, len(k))))
    many = total > 1
    for at, blob in exchange.by_bucket(sender[many], k[many], total[many]):
        yield got[at][0], blob


def _lookup(got: list[tuple[int, bytes]], keys: np.ndarray) -> np.ndarray:
    """The numbers that were told for the keys, 1 for those that nothing was told of."""
    parts = [exchange.unpack(load, 2) for _, load in got]
    k, n = (np.concatenate([p[i] for p in parts]) for i in range(2))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.minimum(np.searchsorted(k, keys), len(k) - 1)
    return np.where(k[at] == keys, n[at], 1)


def _shortest(buckets: int):
    def emit(chunk: int, reps: pa.Table):
        yield from _count(prefixes(_signatures(reps))[:, :, 0].ravel(), buckets)

    return emit


def _deeper(buckets: int):
    """All prefixes of the sets and trees that are not alone below their shortest prefix."""

    def use(chunk: int, reps: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        if not reps.num_rows or not got:
            return exchange.rows_of(chunk, iter(()))
        p = prefixes(_signatures(reps))
        return exchange.rows_of(chunk, _count(p[_lookup(got, p[:, :, 0]) > 1].ravel(), buckets))

    return use


def _deal(buckets: int, similarity: float, recall: float):
    """Sets to the tiles of their prefixes: (tile, side, alone, set, tree, depth, signature)."""

    def use(chunk: int, reps: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        if not reps.num_rows or not got:
            return exchange.rows_of(chunk, iter(()))
        sig = _signatures(reps)
        p = prefixes(sig)
        sizes = _lookup(got, p.ravel()).reshape(p.shape)
        d = depths(sizes, similarity, recall)
        ids = reps["row_id"].to_numpy()
        x, tree = np.nonzero(sizes[:, :, 0] > 1)
        node, parts, depth = p[x, tree, 0], -(-sizes[x, tree, 0] // TILE), d[x, tree]
        own = (mix64(ids[x], 31) % parts.astype(np.uint64)).astype(np.int64)
        again = np.repeat(np.arange(len(x)), parts)
        other = np.arange(len(again)) - np.repeat(np.cumsum(parts) - parts, parts)
        a, b = np.minimum(own[again], other), np.maximum(own[again], other)
        tile = mix64(node[again] + (a * 1_000_003 + b).astype(np.uint64), 32)
        columns = (tile, (own[again] > other).astype(np.uint8), (a == b).astype(np.uint8), ids[x][again], tree[again].astype(np.uint8), depth[again].astype(np.uint8))
        return exchange.rows_of(chunk, messages((tile % np.uint64(buckets)).astype(np.int64), columns, sig, x[again]))

    def messages(bucket, columns, sig, x):
        order = np.argsort(bucket, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(bucket[order])) + 1, len(order))
        i = 0
        for j in ends.tolist() if len(order) else []:
            at = order[i:j]
            yield int(bucket[at[0]]), exchange.pack(*(c[at] for c in columns), sig[x[at]].ravel())
            i = j

    return use


def least_agreement(similarity: float) -> int:
    """Of TREES * DEPTH values, how many an edge's signatures share at least."""
    n = TREES * DEPTH
    return max(1, int(np.floor(n * similarity - DOUBT * np.sqrt(n * similarity * (1 - similarity)))))


def edges(label: np.ndarray, depth: np.ndarray, side: np.ndarray, alone: bool, sig: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of a tile's edges: (row, row) whose prefixes meet and whose signatures do not disagree."""
    order = np.lexsort(label.T[::-1])
    label, depth, side, sig = label[order], depth[order], side[order], sig[order]
    n = len(order)
    # In sorted order the rows that share a prefix of d values with a row are a run: [lo, hi).
    lo, hi = np.empty(n, np.int64), np.empty(n, np.int64)
    differs = label[1:] != label[:-1]
    for d in np.unique(depth).tolist():
        start = np.flatnonzero(np.concatenate([[True], differs[:, :d].any(1)]))
        end = np.append(start[1:], n)
        run = np.searchsorted(start, np.arange(n), "right") - 1
        mine = depth == d
        lo[mine], hi[mine] = start[run[mine]], end[run[mine]]
    comp = np.arange(n)
    heads, tails = [], []
    for i in range(0, n, 128):
        j = min(n, i + 128)
        for s in range(int(lo[i:j].min()), int(hi[i:j].max()), 512):
            e = min(n, s + 512)
            if comp[i] == comp[s] and (comp[i:j] == comp[i]).all() and (comp[s:e] == comp[s]).all():
                continue
            at = np.arange(s, e)
            meet = (at >= lo[i:j, None]) & (at < hi[i:j, None]) & (comp[i:j, None] != comp[s:e])
            if not alone:
                meet &= side[i:j, None] != side[s:e]
            x, y = np.nonzero(meet)
            for k in range(0, len(x), 1 << 15):
                p, q = x[k : k + (1 << 15)] + i, y[k : k + (1 << 15)] + s
                good = (sig[p] == sig[q]).sum(1) >= least
                if good.any():
                    heads.append(p[good])
                    tails.append(q[good])
            if heads:
                p, q = forest(np.concatenate(heads), np.concatenate(tails))
                heads, tails = [p], [q]
                comp = np.arange(n)
                comp[p] = q
    p, q = (np.concatenate(heads), np.concatenate(tails)) if heads else (order[:0], order[:0])
    return order[p], order[q]


def _edges(similarity: float):
    least = least_agreement(similarity)

    def reduce(bucket: int, got: list[tuple[int, bytes]]):
        parts = [exchange.unpack(load, 7) for _, load in got]
        tile, side, alone, ids, tree, depth, sig = (np.concatenate([p[i] for p in parts]) for i in range(7))
        sig = sig.reshape(len(tile), TREES * DEPTH)
        order = np.argsort(tile, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], tile[order][1:] != tile[order][:-1]]))
        size = np.diff(np.append(first, len(order)))
        heads, tails = [], []
        # Pairs of sets alone with each other in their tile, all at once.
        two = first[size == 2]
        x, y = order[two], order[two + 1]
        mine = np.arange(DEPTH)
        same = np.take_along_axis(sig[x], tree[x][:, None].astype(np.int64) * DEPTH + mine, 1) == np.take_along_axis(sig[y], tree[y][:, None].astype(np.int64) * DEPTH + mine, 1)
        common = np.where(same.all(1), DEPTH, same.argmin(1))
        good = (common >= np.minimum(depth[x], depth[y])) & ((side[x] != side[y]) | (alone[x] == 1)) & ((sig[x] == sig[y]).sum(1) >= least)
        heads.append(ids[x[good]])
        tails.append(ids[y[good]])
        for f, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            at = order[f : f + n]
            t = int(tree[at[0]]) * DEPTH
            p, q = edges(sig[at, t : t + DEPTH], depth[at], side[at], bool(alone[at[0]]), sig[at], least)
            heads.append(ids[at[p]])
            tails.append(ids[at[q]])
        a, b = forest(np.concatenate(heads), np.concatenate(tails))
        return pa.table({"a": pa.array(a.astype(np.int64)), "b": pa.array(b.astype(np.int64))})

    return reduce


def _fetch(key: tuple[pa.Scalar, ...], docs: pa.Table, asked: pa.Table) -> pa.Table:
    """Shingles of the sets that are asked for, from their documents' chunk."""
    names = ("grp", "rep", "many", "parts")
    want = {r: v for r, *v in zip(*(asked[c].to_pylist() for c in ("row_id", *names)), strict=True)}
    if not want or not docs.num_rows:
        return pa.table({**{n: pa.array([], pa.int64()) for n in names}, "s": pa.array([], pa.binary())})
    part = docs.take(pa.array([i for i, r in enumerate(docs["row_id"].to_pylist()) if r in want], pa.int64()))
    rows = [want[r] for r in part["row_id"].to_pylist()]
    sets = [s.tobytes() for s in sets_of(exchange.unsqueeze(part["body"]))]
    return pa.table({**{n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)}, "s": pa.array(sets, pa.binary())})


def _columns(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(set, column, weight of columns, columns): shingles of two sets or more; those of the same sets are one column."""
    value = np.concatenate(sets)
    of = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, of = value[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
    size = np.diff(np.append(first, len(value)))
    # Two independent sums over the sets that have a shingle tell which shingles have the same sets.
    sums = [np.add.reduceat(mix64(of.astype(np.uint64), seed), first) for seed in (1, 2)]
    pattern = np.unique(np.column_stack(sums), axis=0, return_inverse=True)[1].ravel()
    many = size > 1
    chosen = np.flatnonzero(many)
    kinds, at, weight = np.unique(pattern[chosen], return_index=True, return_counts=True)
    one = chosen[at]
    column = np.repeat(np.arange(len(one)), size[one])
    place = np.repeat(first[one], size[one]) + np.arange(len(column)) - np.repeat(np.cumsum(size[one]) - size[one], size[one])
    return of[place], column, weight, len(kinds)


def _verify(similarity: float):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        alone = key[1].as_py() == key[2].as_py()
        side, ids, many = rows["side"].to_numpy(), rows["rep"].to_numpy(), rows["many"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in rows["s"].to_pylist()]
        size = np.array([len(x) for x in sets], np.int64)
        links, heads, tails = np.zeros(len(sets), np.int64), [ids[:0]], [ids[:0]]
        left = np.flatnonzero(side == 0)
        right = left if alone else np.flatnonzero(side == 1)
        if len(left) and len(right) and len(sets) > 1:
            of, column, weight, n = _columns(sets)
            order = np.argsort(of, kind="stable")
            of, column = of[order], column[order]
            begin = np.searchsorted(of, np.arange(len(sets) + 1))

            def block(at: np.ndarray, lo: int, hi: int, scaled: bool) -> np.ndarray:
                out = np.zeros((len(at), hi - lo), np.float32)
                for r, a in enumerate(at.tolist()):
                    c = column[begin[a] : begin[a + 1]]
                    c = c[(c >= lo) & (c < hi)]
                    out[r, c - lo] = weight[c] if scaled else 1.0
                return out

            for i in range(0, len(left), 512):
                x = left[i : i + 512]
                for j in range(i if alone else 0, len(right), 512):
                    y = right[j : j + 512]
                    shared = np.zeros((len(x), len(y)))
                    for lo in range(0, n, 8192):
                        hi = min(n, lo + 8192)
                        shared += block(x, lo, hi, True) @ block(y, lo, hi, False).T
                    near = shared >= similarity * (size[x][:, None] + size[y] - shared) - 1e-6
                    near &= shared > 0
                    a, b = np.nonzero(near)
                    a, b = x[a], y[b]
                    if alone:
                        a, b = a[a < b], b[a < b]
                    np.add.at(links, a, many[b])
                    np.add.at(links, b, many[a])
                    p, q = forest(ids[a], ids[b])
                    heads.append(p)
                    tails.append(q)
        got = np.flatnonzero(links)
        p, q = forest(np.concatenate(heads), np.concatenate(tails))
        return pa.table({"rep": pa.array(np.concatenate([ids[got], p]), pa.int64()), "links": pa.array(np.concatenate([links[got], np.zeros(len(p), np.int64)]), pa.int64()), "to": pa.array([None] * len(got) + q.tolist(), pa.int64())})

    return run


def join(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text: str = "text", key: str = "doc_id", chunks: int | None = None) -> DataFrame:
    """(doc_id, row_id, chunk, n_links, class_id, kept) of every row.

    ``n_links`` is the number of other rows at this similarity or more; ``class_id`` the smallest id that
    links lead to; one row of each class is ``kept``, the first of those with its id. Rows without an id
    keep themselves.
    """
    return join_table(exchange.chunked(docs, chunks or exchange.sizes(docs)[0], text, key), similarity, recall)


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with all their columns, one of each class. Texts are read where they lie, not dealt out again."""
    table = exchange.chunked(docs, exchange.sizes(docs)[0], text, key, carry=True)
    kept = join_table(table, similarity, recall).filter("kept").select("chunk", "row_id")

    def use(group: tuple[pa.Scalar, ...], rows: pa.Table, chosen: pa.Table) -> pa.Table:
        want = np.sort(chosen["row_id"].to_numpy())
        own = rows["row_id"].to_numpy()
        at = np.minimum(np.searchsorted(want, own), max(0, len(want) - 1))
        part = rows.take(pa.array(np.flatnonzero(want[at] == own) if len(want) else own[:0]))
        none = part["body"].is_null().to_pylist()
        body = [None if z else b for b, z in zip(exchange.unsqueeze(part["body"]), none, strict=True)]
        return pa.table({"rest": part["rest"], "body": pa.array(body, pa.binary())})

    got = table.groupBy("chunk").cogroup(kept.groupBy("chunk")).applyInArrow(use, f"rest {dict(table.dtypes)['rest']}, body binary")
    return exchange.restored(got, docs, text, F.when(F.col("body").isNotNull(), F.col("body").cast("string")))


def join_table(table: DataFrame, similarity: float, recall: float) -> DataFrame:
    """The join over a table made by exchange.chunked()."""
    sets = cut(table.groupBy("chunk").applyInArrow(_sets, "doc_id long, row_id long, chunk int, digest binary, shingles long, sig binary"))
    full = sets.filter("digest is not null and doc_id is not null")
    # One row a set; its smallest id stands for it. Copies are counted before the shuffle. Ids may repeat with
    # other texts, so sets are named by a row of theirs.
    least = F.min_by(F.struct("row_id", "chunk"), F.struct("doc_id", "row_id"))
    reps = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("many"), least.alias("of"), F.first("sig").alias("sig"))
    width = exchange.width(table)
    reps = exchange.stored(reps.select("digest", "rep", "many", F.col("of.row_id").alias("row_id"), F.col("of.chunk").alias("chunk"), "sig"), width)
    slim = reps.select("row_id", "chunk", "sig")
    company = exchange.answer(exchange.ask(slim, _shortest(width)), _total, width)
    counted = exchange.answer(exchange.meet(slim, company, _deeper(width), exchange.MESSAGE), _total, width)
    dealt = exchange.meet(slim, counted, _deal(4 * width, similarity, recall), exchange.MESSAGE)
    near = exchange.gather(dealt, _edges(similarity), 4 * width, "a long, b long")
    groups = cut(components(near, forested=True).select(F.col("node").alias("row_id"), F.col("component").alias("grp")))
    parts = groups.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("long").alias("parts"))
    asked = groups.join(parts, "grp").join(reps.select("row_id", "chunk", "many"), "row_id").select("chunk", "row_id", "grp", F.col("row_id").alias("rep"), "many", "parts")
    got = table.groupBy("chunk").cogroup(asked.groupBy("chunk")).applyInArrow(_fetch, "grp long, rep long, many long, parts long, s binary")
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b"), (own > j).cast("int").alias("side")))
    tiles = got.withColumn("t", F.explode(every)).select("grp", F.col("t.a").alias("a"), F.col("t.b").alias("b"), F.col("t.side").alias("side"), "rep", "many", "s")
    found = cut(tiles.groupBy("grp", "a", "b").applyInArrow(_verify(similarity), "rep long, links long, to long"))
    links = found.filter("to is null").groupBy("rep").agg(F.sum("links").alias("links"))
    linked = components(found.filter("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")), forested=True)
    # Classes are named by their smallest document id.
    per = reps.select("digest", F.col("row_id").alias("set_id"), "rep", "many").join(linked.select(F.col("node").alias("set_id"), "component"), "set_id", "left").join(links.withColumnRenamed("rep", "set_id"), "set_id", "left")
    per = cut(per.withColumn("component", F.coalesce("component", "set_id")))
    names = per.groupBy("component").agg(F.min("rep").alias("class_id"))
    per = per.join(names, "component").select(F.col("digest").alias("d"), (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), "class_id")
    rows = full.select("doc_id", "row_id", "chunk", "digest").join(per, F.col("digest") == F.col("d")).select("doc_id", "row_id", "chunk", "n_links", "class_id")
    first = F.row_number().over(Window.partitionBy("doc_id", "class_id").orderBy("row_id")) == 1
    rows = rows.withColumn("kept", (F.col("doc_id") == F.col("class_id")) & first)
    rest = sets.filter("digest is null or doc_id is null").select("doc_id", "row_id", "chunk", F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("class_id"), F.lit(True).alias("kept"))
    return rows.unionByName(rest)
