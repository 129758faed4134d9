"""Exact substring dedup with suffix arrays sorted in two stages.

A byte goes if a string of ``length`` bytes that covers it also starts in a document with a smaller id.

Strings that are equal have equal minimizers: the seed of ``SEED`` bytes with the least hash within the
string. So the corpus is cut at minimizers. Round one: chunks of documents tell the bucket of every
minimizer the smallest and largest document that has it; buckets answer with the minimizers that more
than one document has. Round two: chunks send the stretches of text around those minimizers (all strings
of ``length`` bytes that have it as theirs) to its bucket, each different stretch once a chunk, from its
smallest document. A bucket joins its stretches into one text and sorts its suffixes in two stages: only
suffixes smaller than their successors are sorted directly, all others are induced by scanning the
buckets of first bytes in order. Adjacent common prefixes of ``length`` bytes give the groups of equal
strings, each group its smallest document, and the answers to the chunks are the spans that go. Copies
of a stretch need no sorting: all of them but those of the smallest document go whole, in the chunk or, where
they come from several, in the bucket.

A seed that very many stretches have, all different (a licence line, a stem of urls), is split before round
two: its strings go by a second minimizer, the least seed of theirs by another hash, which equal strings
share too. So the bucket of a hot seed gets only the strings that agree in a second seed.

Everything is exact, whatever hashes collide, except for seeds' order, which only decides where to cut.
An item that a third of all documents hold comes to its bucket once a chunk. Null texts are empty; texts
below ``length`` bytes keep all; matches never cross documents. Rows that share an id are one document:
they do not remove each other's bytes. Ids are integers; rows whose id is null (or no integer) keep all. Texts of
any length are used whole. Further columns, whatever their names, are not looked at. An empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import exchange
from textloom.llm.common import cut, mix64

#: Bytes of a minimizer's seed; bytes of text that temporaries are made for at once.
SEED, _PART = 20, 1 << 20
#: Stretches of a seed in all chunks from which on its strings are split by a second seed.
HOT = 2048
#: Buckets of round two for each of round one: a suffix array's temporaries are many times its text.
FINER = 4


def _least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w values in a row, by doubling."""
    out, have = h, 1
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(out) - (w - have)], out[w - have :])
    return out


def _least(raw: np.ndarray, length: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all seeds, and of each string of ``length`` bytes the place of its least one."""
    n = len(raw)
    h = np.zeros(n - SEED + 1, np.uint64)
    for i in range(SEED):
        h *= np.uint64(0x100000001B3)
        h += raw[i : i + len(h)]
    h = mix64(h, salt)
    # The hash's upper bits with the place in the lower ones: the least is also the first of its equals.
    at = np.arange(len(h), dtype=np.uint64)
    tagged = (h & ~np.uint64(0xFFFFFFFF)) | (at & np.uint64(0xFFFFFFFF))
    return h, (_least_in_window(tagged, length - SEED + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def minimizers(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, begin, windows, look) of the stretches of one text of ``length`` bytes or more.

    Stretch k has the strings that start at begin[k] to begin[k] + windows[k] - 1 and share a minimizer. ``look`` is a
    hash of both ends of a stretch: stretches that are alike look alike.
    """
    h, place = _least(raw, length, 0)
    begin = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    windows = np.diff(np.append(begin, len(place)))
    look = h[begin] ^ (h[begin + windows + length - 1 - SEED] << np.uint64(1)) ^ windows.astype(np.uint64)
    return h[place[begin]] >> np.uint64(8), begin, windows, look  # 56 bits tell seeds apart well enough, and more would only travel


def split(raw: np.ndarray, ends: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, stretch, begin in it, windows): stretches, one after the other in ``raw``, cut by second minimizers."""
    h, place = _least(raw, length, 1)
    start = np.concatenate([[0], ends[:-1]])
    windows = ends - start - length + 1
    of = np.repeat(np.arange(len(ends)), windows)
    at = np.arange(len(of)) + np.repeat(start - (np.cumsum(windows) - windows), windows)
    first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (place[at[1:]] != place[at[:-1]])]))
    own = of[first]
    return mix64(h[place[at[first]]] ^ mix64(key[own], 3)) >> np.uint64(8), own, at[first] - start[own], np.diff(np.append(first, len(of)))


def _stretches(length: int, bodies: list[bytes]):
    """Concatenated (hash, document's place in the chunk, begin, windows, look) of all stretches."""
    out: list[tuple[np.ndarray, ...]] = []
    for k, body in enumerate(bodies):
        if len(body) >= length:
            raw = np.frombuffer(body, np.uint8)
            for s in range(0, max(1, len(raw) - length + 1), _PART):  # windows that start in [s, s + _PART)
                h, begin, windows, look = minimizers(raw[s : s + _PART + length - 1], length)
                out.append((h, np.full(len(h), k, np.int64), begin + s, windows, look))
    if not out:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _ids(docs: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Ids and texts; a document without an id counts as empty."""
    ids = docs["doc_id"]
    bodies = exchange.unsqueeze(docs["body"])
    none = ids.is_null().to_pylist()
    return ids.fill_null(0).to_numpy().astype(np.int64), [b"" if z else b for b, z in zip(bodies, none, strict=True)]


def _tell(length: int, buckets: int):
    """Round one, chunks: the smallest and largest document of each minimizer, and its stretches that look different."""

    def emit(chunk: int, docs: pa.Table):
        ids, bodies = _ids(docs)
        h, k, _, _, look = _stretches(length, bodies)
        order = np.lexsort((look, h))
        h, d, look = h[order], ids[k[order]], look[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        if len(h):
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (look[1:] != look[:-1])])
            many = np.add.reduceat(new.astype(np.uint32), first)
            yield from exchange.by_bucket((h[first] % np.uint64(buckets)).astype(np.int64), h[first], lo := np.minimum.reduceat(d, first), np.maximum.reduceat(d, first) - lo, many)

    return emit


def _shared(bucket: int, got: list[tuple[int, bytes]]):
    """Round one, buckets: which minimizers more than one document has, and which are hot, to all chunks that have them."""
    parts = [exchange.unpack(load, 4) for _, load in got]
    h = np.concatenate([p[0] for p in parts])
    lo = np.concatenate([p[1] for p in parts])
    hi = lo + np.concatenate([p[2] for p in parts])
    many = np.concatenate([p[3] for p in parts]).astype(np.int64)
    sender = np.repeat(np.arange(len(got)), [len(p[0]) for p in parts])
    order = np.argsort(h, kind="stable")
    h, lo, hi, many, sender = h[order], lo[order], hi[order], many[order], sender[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(first, len(h)))
    keep = np.repeat(np.minimum.reduceat(lo, first) < np.maximum.reduceat(hi, first), size)
    hot = np.repeat(np.add.reduceat(many, first) > HOT, size).astype(np.uint8)
    for at, blob in exchange.by_bucket(sender[keep], h[keep], hot[keep]):
        yield got[at][0], blob


def _send(length: int, buckets: int):
    """Round two, chunks: different stretches of shared minimizers to buckets; copies' spans to itself (-1)."""

    def use(chunk: int, docs: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
        if not docs.num_rows or not got:
            return exchange.rows_of(chunk, iter(()))
        ids, bodies = _ids(docs)
        h, k, begin, windows, _ = _stretches(length, bodies)
        parts = [exchange.unpack(load, 2) for _, load in got]
        wanted, hot = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.argsort(wanted, kind="stable")
        wanted, hot = wanted[order], hot[order]
        at = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
        keep = wanted[at] == h
        h, k, begin, size, hot = h[keep], k[keep], begin[keep], windows[keep] + length - 1, hot[at[keep]] == 1
        if hot.any():
            cold = ~hot
            found = [(h[cold], k[cold], begin[cold], size[cold])]
            rows = np.flatnonzero(hot)
            for i in range(0, len(rows), 8192):
                r = rows[i : i + 8192]
                raw = np.frombuffer(b"".join([bodies[a][b : b + c] for a, b, c in zip(k[r].tolist(), begin[r].tolist(), size[r].tolist(), strict=True)]), np.uint8)
                key, own, at, n = split(raw, np.cumsum(size[r]), h[r], length)
                found.append((key, k[r][own], begin[r][own] + at, n + length - 1))
            h, k, begin, size = (np.concatenate(x) for x in zip(*found, strict=True))
        return exchange.rows_of(chunk, messages(ids, bodies, h, k, begin, size))

    def messages(ids, bodies, h, k, begin, size):
        text = [bodies[a][b : b + c] for a, b, c in zip(k.tolist(), begin.tolist(), size.tolist(), strict=True)]
        whole = copies(text, ids[k])
        # Copies go whole. The smallest document's stretch is asked for, and so are its repeats there.
        if whole.any():
            yield -1, exchange.pack(k[whole], begin[whole], begin[whole] + size[whole])
        rest = np.flatnonzero(~whole)
        if len(rest):
            bucket = (h[rest] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rest, bucket = rest[order], bucket[order]
            ends = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(rest))
            i = 0
            for j in ends.tolist():
                part = rest[i:j]
                blob = np.frombuffer(b"".join([text[x] for x in part.tolist()]), np.uint8)
                yield int(bucket[i]), exchange.pack(blob, size[part], ids[k[part]], k[part], begin[part])
                i = j

    return use


def _types(t: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; ``last`` marks ends of strings, after which comes less than any byte."""
    n = len(t)
    up, differs = np.zeros(n, bool), np.ones(n, bool)
    up[:-1] = t[:-1] < t[1:]
    differs[:-1] = t[:-1] != t[1:]
    up[last], differs[last] = False, True
    nxt = np.where(differs, np.arange(n), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    return up[nxt]


def _words(t: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as big-endian integers; t has eight zero bytes at its end."""
    out = np.zeros(len(t) - 8, np.uint64)
    for i in range(8):
        out <<= np.uint64(8)
        out |= t[i : i + len(out)]
    return out


def sort_direct(words: np.ndarray, at: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """The places ``at`` in the order of their first ``depth`` bytes; ``room`` is how many bytes their string has left."""
    group = np.zeros(len(at), np.int64)
    open_ = np.arange(len(at))
    out = at.copy()
    for d in range(0, depth, 8):
        if not len(open_):
            break
        here = out[open_]
        left = room[here] - d
        key = np.where(left > 0, words[np.minimum(here + d, len(words) - 1)], np.uint64(0))
        cut_ = np.clip(8 - left, 0, 8).astype(np.uint64) * np.uint64(8)
        key = np.where(cut_ >= 64, np.uint64(0), (key >> np.minimum(cut_, np.uint64(63))) << np.minimum(cut_, np.uint64(63)))
        order = np.argsort(key, kind="stable")
        order = order[np.argsort(group[open_][order], kind="stable")]
        out[open_] = here[order]
        g, key = group[open_], key[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (key[1:] != key[:-1])])
        label = np.maximum.accumulate(np.where(new, open_, 0))
        group[open_] = label
        size = np.diff(np.append(np.flatnonzero(new), len(open_)))
        open_ = open_[np.repeat(size > 1, size)]
    return out


def two_stage(t: np.ndarray, ends: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The places in ``wanted`` (a mask over t), in the order of their suffixes' first ``depth`` bytes.

    ``ends`` has where each string of t ends. A suffix that is larger than its successor is never compared:
    it is put in its bucket when the scan comes by its successor. So successors of wanted places are needed
    too, up to the next place that is sorted directly.
    """
    n = len(t)
    last = np.zeros(n, bool)
    last[ends - 1] = True
    small = _types(t, last)
    # A place is needed if it is wanted, or if a run of larger suffixes leads from a wanted place to it.
    stop = small | last
    reach = np.where(wanted, np.arange(n), -1)
    reach = np.maximum.accumulate(reach)
    stops = np.where(np.concatenate([[True], stop[:-1]]), np.arange(n), -1)
    need = wanted | (reach >= np.maximum.accumulate(stops)) & (reach >= 0)
    room = (np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - np.arange(n)).astype(np.int64)
    direct = np.flatnonzero(need & small)
    words = _words(np.concatenate([t, np.zeros(8, np.uint8)]))
    direct = sort_direct(words, direct, room, depth)
    by_byte = np.searchsorted(t[direct], np.arange(257))
    large = need & ~small
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(places: np.ndarray, floor: int) -> None:
        """Predecessors of sorted places go to the ends of their buckets, in order; floor: only larger bytes."""
        before = places - 1
        before = before[(before >= 0)]
        before = before[large[before] & ~last[before]]
        b = t[before]
        before, b = before[b > floor], b[b > floor]
        order = np.argsort(b, kind="stable")
        before, b = before[order], b[order]
        cuts = np.flatnonzero(np.diff(b)) + 1
        for x in np.split(before, cuts) if len(before) else []:
            induced[int(t[x[0]])].append(x)

    tails = np.flatnonzero(large & last)  # single bytes before an end come first in their buckets
    for x in range(256):
        own = tails[t[tails] == x]
        if len(own):
            induced[x].append(own)
    done: list[np.ndarray] = []
    for byte in range(256):
        new = np.concatenate(induced[byte]) if induced[byte] else np.zeros(0, np.int64)
        front = []
        while len(new):  # runs of the byte induce within its own bucket
            front.append(new)
            before = new - 1
            before = before[before >= 0]
            new = before[large[before] & ~last[before] & (t[before] == byte)]
        bucket = np.concatenate([*front, direct[by_byte[byte] : by_byte[byte + 1]]])
        if len(bucket):
            induce(bucket, byte)
            done.append(bucket)
    sa = np.concatenate(done) if done else np.zeros(0, np.int64)
    return sa[wanted[sa]]


def same_prefix(t: np.ndarray, sa: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """Whether each suffix has its first ``depth`` bytes in common with the one before it."""
    words = _words(np.concatenate([t, np.zeros(8, np.uint8)]))
    same = np.ones(len(sa), bool)
    same[:1] = False
    same &= room[sa] >= depth
    same[1:] &= room[sa[:-1]] >= depth
    live = np.flatnonzero(same)
    for d in [*range(0, depth - 7, 8), *([depth - 8] if depth % 8 and depth > 8 else [])]:
        a, b = sa[live] + d, sa[live - 1] + d
        ok = words[a] == words[b]
        same[live[~ok]] = False
        live = live[ok]
    if depth < 8:
        for d in range(depth):
            ok = t[sa[live] + d] == t[sa[live - 1] + d]
            same[live[~ok]] = False
            live = live[ok]
    return same


def copies(text: list[bytes], doc: np.ndarray) -> np.ndarray:
    """Which stretches a smaller document has too, byte for byte: all of their strings go."""
    least: dict[bytes, int] = {}
    docs = doc.tolist()
    for t, d in zip(text, docs, strict=True):
        if d < least.setdefault(t, d):
            least[t] = d
    return np.array([d > least[t] for t, d in zip(text, docs, strict=True)], bool)


def _sort(length: int):
    """Round two, buckets: spans of strings that an earlier document has, to the chunks they came from."""

    def reduce(bucket: int, got: list[tuple[int, bytes]]):
        parts = [exchange.unpack(load, 5) for _, load in got]
        raw = b"".join([p[0].tobytes() for p in parts])
        size, doc, k, begin = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3, 4))
        sender = np.repeat(np.arange(len(got)), [len(p[1]) for p in parts])
        ends = np.cumsum(size).tolist()
        text = [raw[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        # Copies go whole here too, so each different stretch is sorted once, whatever the number of chunks.
        whole = copies(text, doc)
        spans = [(sender[whole], k[whole], begin[whole], begin[whole] + size[whole])]
        text, (sender, size, doc, k, begin) = [text[i] for i in np.flatnonzero(~whole).tolist()], (x[~whole] for x in (sender, size, doc, k, begin))
        spans.append(rest(np.frombuffer(b"".join(text), np.uint8), sender, size, doc, k, begin))
        to, k, begin, end = (np.concatenate(x) for x in zip(*spans, strict=True))
        for to, blob in exchange.by_bucket(to, k, begin, end) if len(k) else ():
            yield got[to][0], blob

    def rest(t, sender, size, doc, k, begin):
        ends = np.cumsum(size)
        owner = np.repeat(np.arange(len(size)), size)
        room = ends[owner] - np.arange(len(t))
        sa = two_stage(t, ends, room >= length, length)
        same = same_prefix(t, sa, room, length)
        first = np.flatnonzero(~same)
        of = doc[owner[sa]]
        least = np.repeat(np.minimum.reduceat(of, first), np.diff(np.append(first, len(sa))))
        gone = np.sort(sa[of > least])
        o = owner[gone]
        at = begin[o] + gone - (ends[o] - size[o])
        run = np.ones(len(gone), bool)
        run[1:] = (gone[1:] != gone[:-1] + 1) | (o[1:] != o[:-1])
        i = np.flatnonzero(run)
        j = np.append(i[1:], len(gone))[: len(i)] - 1
        return sender[o[i]], k[o[i]], at[i], at[j] + length

    return reduce


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of one text joined where they overlap or touch."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], begin[1:] > end[:-1]])
    return begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]


def _finish(chunk: int, docs: pa.Table, got: list[tuple[int, bytes]]) -> pa.Table:
    """(doc_id, row_id, kept, n_bytes, span_begins, span_ends): what is left of each text."""
    spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    if got:
        parts = [exchange.unpack(load, 3) for _, load in got]
        k, b, e = (np.concatenate([p[i] for p in parts]) for i in range(3))
        order = np.argsort(k, kind="stable")
        k, b, e = k[order], b[order], e[order]
        cuts = np.flatnonzero(np.diff(k)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(k)], strict=True):
            spans[int(k[i])] = merged(b[i:j], e[i:j])
    kept, size, begins, ends = [], [], [], []
    for k, body in enumerate(exchange.unsqueeze(docs["body"]) if docs.num_rows else []):
        b, e = (x.tolist() for x in spans[k]) if k in spans else ([], [])
        kept.append(b"".join(body[x:y] for x, y in zip([0, *e], [*b, len(body)], strict=True)))
        size.append(len(body))
        begins.append(b)
        ends.append(e)
    return pa.table({
        "doc_id": docs["doc_id"] if docs.num_rows else pa.array([], pa.int64()), "row_id": docs["row_id"] if docs.num_rows else pa.array([], pa.int64()),
        "kept": pa.array(kept, pa.binary()), "n_bytes": pa.array(size, pa.int64()), "span_begins": pa.array(begins, pa.list_(pa.int64())), "span_ends": pa.array(ends, pa.list_(pa.int64())),
    })


def remove_repeats(docs: DataFrame, length: int = 50, text: str = "text", key: str = "doc_id", chunks: int | None = None) -> DataFrame:
    """(doc_id, row_id, kept, n_bytes, span_begins, span_ends) of every row: its text without repeated bytes."""
    if length <= SEED:
        raise ValueError(f"length has to be above {SEED}")
    chunks, buckets = (chunks, chunks) if chunks else exchange.sizes(docs)
    table = exchange.chunked(docs, chunks, text, key)
    shared = exchange.answer(exchange.ask(table, _tell(length, buckets)), _shared, buckets)
    sent = cut(exchange.meet(table, shared, _send(length, FINER * buckets), "to int, sender int, load binary"))
    own = sent.filter("to < 0").select(F.col("sender").alias("to"), F.lit(-1).alias("sender"), "load")
    spans = exchange.answer(sent.filter("to >= 0"), _sort(length), FINER * buckets).unionByName(own)
    return exchange.meet(table, spans, _finish, "doc_id long, row_id long, kept binary, n_bytes long, span_begins array<long>, span_ends array<long>")
