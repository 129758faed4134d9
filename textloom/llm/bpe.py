"""Byte-level BPE encoding and decoding.

Texts are joined into one array of code points. A class array gives each code point its class, and
each character then stands for a transition function over eight lexer states. Function composition is
associative, so a blocked prefix scan over a table of the (finite) monoid of these functions gives the
state before every character, hence all piece boundaries at once, without regex. Pieces go through a
bounded cache; those that are not in it are merged together, a whole batch at a time, as a matrix.

Byte offsets of the pieces are kept with the ids: by them the pieces around any span of a text are decoded
without the rest of it (decode_spans()).

Null and empty texts have no tokens and decode to no bytes. Rows, also repeated ones and those that share an id,
are independent; ids may be of any type, also null. Further columns, whatever their names, are not looked at. An
empty table gives an empty result. Nothing is shuffled; memory depends on ``_SLICE`` bytes of text and the
longest text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import codepoints, documents_only, slices, tidy, utf8_column

_SLICE = 1 << 20
#: Pieces kept in a worker's cache; when full it becomes the older one and a new one starts.
CACHE_PIECES = 150_000
#: Pieces of more bytes are merged one by one with a heap.
MATRIX_BYTES = 40

# Symbols: a character's class, with what follows it where that matters.
_L, _N, _O, _A1, _A2, _WC, _SP, _WL, _SEP = range(9)
# States: what is open before a character. _C1 and _C2 have so many letters of a contraction to come.
_ST, _SL, _SN, _SO, _SW, _PEND, _C1, _C2 = range(8)


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, whether a piece begins at this character)."""
    if symbol == _SEP:
        return _ST, True
    if symbol == _L:
        if state == _C2:
            return _C1, False
        if state == _C1:
            return _ST, False
        return _SL, state not in (_SL, _PEND)
    if symbol == _N:
        return _SN, state not in (_SN, _PEND)
    if symbol == _O:
        return _SO, state not in (_SO, _PEND)
    if symbol in (_A1, _A2):
        if state in (_SO, _PEND):
            return _SO, False
        return (_C1 if symbol == _A1 else _C2), True
    if symbol == _WC:
        return _SW, state != _SW
    return (_PEND if symbol == _SP else _ST), True


@lru_cache(1)
def _lexer() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(composition table, function table, generator of each symbol, begins table)."""
    gens = [tuple(_step(s, y)[0] for s in range(8)) for y in range(9)]
    ident = tuple(range(8))
    ids, todo = {ident: 0}, [ident]
    while todo:
        f = todo.pop()
        for g in gens:
            h = tuple(g[x] for x in f)
            if h not in ids:
                ids[h] = len(ids)
                todo.append(h)
    funcs = list(ids)
    comp = np.array([[ids[tuple(b[x] for x in a)] for b in funcs] for a in funcs], np.uint16)
    table = np.array(funcs, np.uint8)
    begins = np.array([[_step(s, y)[1] for y in range(9)] for s in range(8)], bool)
    return comp, table, np.array([ids[g] for g in gens], np.uint16), begins


#: White space of the pattern's ``\s``: fixed values of the Unicode property White_Space.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> tuple[np.ndarray, np.ndarray]:
    """For every code point its class (letter, number, other, white) and its UTF-8 length."""
    n = 0x110000
    kind = np.full(n, _O, np.uint8)
    for i in range(n):
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            kind[i] = _L
        elif c == "N":
            kind[i] = _N
    kind[_WHITE] = _WC
    width = np.full(n, 4, np.uint8)
    width[:0x10000], width[:0x800], width[:0x80] = 3, 2, 1
    width[0xDC80:0xDD00] = 1
    return kind, width


def boundaries(cp: np.ndarray, starts: np.ndarray, columns: int = 64) -> np.ndarray:
    """Indexes at which pieces begin; ``starts`` has where each text begins in ``cp`` (none of them empty)."""
    kind, _ = classes()
    comp, table, gens, begins = _lexer()
    n = len(cp)
    sym = kind[cp]
    last = np.zeros(n, bool)  # the last character of its text
    last[starts[1:] - 1] = True
    last[n - 1] = True
    white = sym == _WC
    before_black = np.zeros(n, bool)
    before_black[:-1] = ~white[1:]
    tail = white & before_black & ~last
    sym[tail] = np.where(cp[tail] == 0x20, _SP, _WL)
    at = np.flatnonzero(cp == 0x27)
    if len(at):
        room = np.concatenate([starts[1:], [n]])
        room = room[np.searchsorted(starts, at, "right") - 1] - at
        one, two = cp[np.minimum(at + 1, n - 1)], cp[np.minimum(at + 2, n - 1)]
        c = lambda x: np.uint32(ord(x))
        single = (room > 1) & ((one == c("s")) | (one == c("t")) | (one == c("m")) | (one == c("d")))
        double = (room > 2) & ((((one == c("r")) | (one == c("v"))) & (two == c("e"))) | ((one == c("l")) & (two == c("l"))))
        sym[at[single]] = _A1
        sym[at[double & ~single]] = _A2
    # The first character of a text resets the lexer: its function is the one of the symbol after a separator.
    first = np.zeros(n, bool)
    first[starts] = True
    gen = gens[sym]
    gen[first] = comp[gens[_SEP], gen[first]]
    size, flat = comp.shape[0], comp.ravel()
    rows = -(-n // columns)
    f = np.zeros(rows * columns, np.uint16)
    f[:n] = gen
    f = np.ascontiguousarray(f.reshape(rows, columns).T)
    acc = np.empty_like(f)
    acc[0] = f[0]
    for k in range(1, columns):
        acc[k] = flat[acc[k - 1].astype(np.int32) * size + f[k]]
    # Scan over the rows' totals by doubling, then each row's first state.
    total, step = acc[-1].copy(), 1
    while step < rows:
        total[step:] = flat[total[:-step].astype(np.int32) * size + total[step:]]
        step *= 2
    begin = np.zeros(rows, np.uint8)
    begin[1:] = table[total[:-1], _ST]
    state = np.empty((columns, rows), np.uint8)
    state[0] = begin
    state[1:] = table.ravel()[acc[:-1].astype(np.int32) * 8 + begin]
    state = state.T.ravel()[:n]
    return np.flatnonzero(begins.ravel()[state.astype(np.int16) * 9 + sym] | first)


class Vocabulary:
    """Ranks of a byte-level BPE, as ``base64 rank`` lines, with the tables that merging and decoding need."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        size = max(self.ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.length = np.array([len(t) for t in self.tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.byte_id = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        pairs = {}
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        bits = max(4, (len(pairs) * 3).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, 1 << 30, np.int64)
        keys = np.array(list(pairs), np.int64)
        for k, h, v in zip(keys.tolist(), self._slot(keys).tolist(), pairs.values(), strict=True):
            while self.keys[h] != -1:
                h = (h + 1) & self.mask
            self.keys[h], self.values[h] = k, v
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _rank(self, keys: np.ndarray) -> np.ndarray:
        """Rank of each pair key, 2**30 where the pair does not merge."""
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], 1 << 30)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            more = ~hit & (found != -1)
            open_, slot = open_[more], slot[more]
        return out

    def _merge_one(self, piece: bytes) -> bytes:
        """A long piece, by a heap of mergeable pairs over a linked list."""
        n = len(piece)
        tok = [piece[i : i + 1] for i in range(n)]
        nxt, prv, live = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = nxt[i] if live[i] else -1
            if j < 0 or len(tok[i]) + len(tok[j]) != size:
                continue
            tok[i] += tok[j]
            live[j], nxt[i] = False, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
                if (r := self.ranks.get(tok[i] + tok[nxt[i]])) is not None:
                    heapq.heappush(heap, (r, i, len(tok[i]) + len(tok[nxt[i]])))
            if (p := prv[i]) >= 0 and (r := self.ranks.get(tok[p] + tok[i])) is not None:
                heapq.heappush(heap, (r, p, len(tok[p]) + len(tok[i])))
        return np.array([self.ranks[t] for t, a in zip(tok, live, strict=True) if a], "<u4").tobytes()

    def _merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of similar length together: a row each, one merge of each row a round."""
        n, width = len(pieces), max(map(len, pieces))
        size = np.fromiter(map(len, pieces), np.int64, n)
        grid = np.zeros((n, width), np.uint8)
        grid[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_id[grid]
        none, columns = 1 << 30, np.arange(width)
        rank = np.full((n, width + 1), none, np.int32)  # of each id with its right neighbour
        pair = columns[1:] < size[:, None]
        rank[:, 1:width][pair] = self._rank((ids[:, :-1] << 32 | ids[:, 1:])[pair])
        done, order = [], np.arange(n)
        while True:  # column 0 of rank is never a pair: rank[:, i + 1] belongs to ids[:, i]
            at = rank[:, 1:].argmin(1)
            row = np.arange(len(at))
            best = rank[row, at + 1]
            go = best < none
            if not go.all():
                done.append((order[~go], ids[~go], size[~go]))
                order, ids, rank, size, at, best = order[go], ids[go], rank[go], size[go], at[go], best[go]
                row = np.arange(len(at))
            if not len(order):
                break
            move = columns + (columns > at[:, None])
            np.minimum(move, width - 1, out=move)
            ids = np.take_along_axis(ids, move, 1)
            rank[:, 1:] = np.take_along_axis(rank[:, 1:], move, 1)
            size -= 1
            ids[row, at] = best
            rank[row, size] = none
            left, right = at > 0, at + 1 < size
            rank[row[left], at[left]] = self._rank(ids[row[left], at[left] - 1] << 32 | best[left])
            rank[row, at + 1] = none
            rank[row[right], at[right] + 1] = self._rank(best[right].astype(np.int64) << 32 | ids[row[right], at[right] + 1])
        out: list[bytes] = [b""] * n
        for where, part, k in done:
            flat, ends = part[columns < k[:, None]].astype("<u4").tobytes(), np.cumsum(k) * 4
            for w, x, y in zip(where.tolist(), (ends - k * 4).tolist(), ends.tolist(), strict=True):
                out[w] = flat[x:y]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as little-endian unsigned 32-bit integers."""
        out = list(map(self.cache.get, pieces))
        at = [i for i, o in enumerate(out) if o is None]
        if at:
            found: dict[bytes, bytes] = {}
            rest = []
            for p in dict.fromkeys([pieces[i] for i in at]):
                if (o := self.older.get(p)) is not None:
                    found[p] = o
                elif (r := self.ranks.get(p)) is not None:
                    found[p] = r.to_bytes(4, "little")
                elif len(p) > MATRIX_BYTES:
                    found[p] = self._merge_one(p)
                else:
                    rest.append(p)
            rest.sort(key=len)
            for i in range(0, len(rest), 8192):
                part = rest[i : i + 8192]
                found.update(zip(part, self._merge_many(part), strict=True))
            for i in at:
                out[i] = found[pieces[i]]
            if len(self.cache) + len(found) > CACHE_PIECES:
                self.cache, self.older = {}, self.cache
            self.cache.update((p, v) for p, v in found.items() if len(p) <= 64)
        return out

    def encode_batch(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """(ids, byte offsets of the pieces) of each text, both packed as unsigned 32-bit integers."""
        ids, spans = [b""] * (len(offsets) - 1), [b""] * (len(offsets) - 1)
        for i, j in slices(offsets, _SLICE):
            rows = i + np.flatnonzero(np.diff(offsets[i : j + 1]))
            if not len(rows):
                continue
            base = int(offsets[i])
            text = raw[base : offsets[j]].tobytes()
            cp = codepoints(text)
            byte_at = np.concatenate([[0], np.cumsum(classes()[1][cp], dtype=np.int64)])
            first_byte = offsets[rows] - base
            starts = np.searchsorted(byte_at, first_byte)
            cuts = byte_at[boundaries(cp, starts)]
            ends = np.append(cuts[1:], len(text))
            pieces = [text[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
            coded = self.encode_pieces(pieces)
            piece_of = np.append(np.searchsorted(cuts, first_byte), len(cuts)).tolist()
            for k, (row, a, b) in enumerate(zip(rows.tolist(), piece_of[:-1], piece_of[1:], strict=True)):
                ids[row] = b"".join(coded[a:b])
                spans[row] = (cuts[a:b] - first_byte[k]).astype("<u4").tobytes()
        return ids, spans

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids."""
        t = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.length[t]
        total = int(size.sum())
        ends = np.cumsum(size)
        return self.blob[np.repeat(self.start[t] - (ends - size), size) + np.arange(total)].tobytes()


    def decode_pieces(self, ids: bytes, offsets: bytes, begin: int, end: int) -> tuple[int, bytes]:
        """(first byte, bytes) of the pieces that have a byte in [begin, end): only their tokens are decoded."""
        at = np.frombuffer(offsets, "<u4").astype(np.int64)
        t = np.frombuffer(ids, "<u4")
        ends = np.cumsum(self.length[t.astype(np.int64)])
        total = int(ends[-1]) if len(ends) else 0
        if not len(at) or begin >= min(end, total):
            return min(begin, total), b""
        first = int(at[max(0, np.searchsorted(at, begin, "right") - 1)])
        last = np.searchsorted(at, end, "left")
        past = int(at[last]) if last < len(at) else total
        i, j = np.searchsorted(ends, first, "right"), np.searchsorted(ends, past, "left") + 1
        return first, self.decode(t[i:j].tobytes())


@lru_cache(2)
def _vocabulary(lines: bytes) -> Vocabulary:
    return Vocabulary(lines)


class _Encode:
    def __init__(self, shared, decode: bool):
        self.shared, self.decode = shared, decode

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        v = _vocabulary(self.shared.value)
        for b in batches:
            raw, offsets, _ = utf8_column(b.column(b.num_columns - 1))
            for i, j in slices(offsets, 4 << 20):
                ids, spans = v.encode_batch(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                out = [pa.array(ids, pa.binary()), pa.array(spans, pa.binary())]
                names = ["ids", "piece_offsets"]
                if self.decode:
                    out.append(pa.array([v.decode(x) for x in ids], pa.binary()))
                    names.append("decoded")
                keep = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*keep.columns[:-1], *out], names=[*keep.schema.names[:-1], *names])
                tidy()
        v.cache, v.older = {}, {}  # the worker may go on with another stage
        tidy()


class _Decode:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(self.shared.value)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                out = pa.array([v.decode(x or b"") for x in part.column(part.num_columns - 1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=[*part.schema.names, "decoded"])


def _shared(df: DataFrame, vocabulary: str):
    with open(vocabulary, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, whatever the corpus


def encode(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id", decoded: bool = False) -> DataFrame:
    """(key, ids, piece_offsets): packed ids of each whole text and the byte offset of each of its pieces.

    With ``decoded``, also the bytes that the ids decode to, made in the same pass.
    """
    kind = dict(df.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]
    own = df.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").cast("string").alias("doc_text"))
    out = own.mapInArrow(_Encode(_shared(df, vocabulary), decoded), f"doc_key {kind}, ids binary, piece_offsets binary" + ", decoded binary" * decoded)
    return out.withColumnRenamed("doc_key", key)


def decode(df: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, ids, decoded): the bytes that packed ids stand for."""
    own = documents_only(df, key, ids)
    kind = dict(own.dtypes)[key]
    out = own.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{ids}`").alias("ids")).mapInArrow(
        _Decode(_shared(df, vocabulary)), f"doc_key {kind}, ids binary, decoded binary"
    )
    return out.withColumnRenamed("doc_key", key)


def decode_spans(df: DataFrame, vocabulary: str, key: str = "doc_id", begin: str = "begin", end: str = "end") -> DataFrame:
    """(key, begin, decoded): the pieces around a span of bytes of each encoded text, found by the offsets that encode()
    kept; only their tokens are decoded. ``df`` has key, ids, piece_offsets, begin and end."""
    own = df.select(F.col(f"`{key}`").alias("k"), "ids", "piece_offsets", F.col(f"`{begin}`").cast("long").alias("b"), F.col(f"`{end}`").cast("long").alias("e"))
    shared = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(shared.value)
        for x in batches:
            rows = [v.decode_pieces(i or b"", o or b"", b or 0, e or 0) for i, o, b, e in zip(*(x.column(c).to_pylist() for c in range(1, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["k", "begin", "decoded"])

    return own.mapInArrow(run, f"k {dict(own.dtypes)['k']}, begin long, decoded binary").withColumnRenamed("k", key)


def round_trip_digests(df: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_pieces) of every document, of what encode() makes."""
    return encode(df, vocabulary, decoded=True).select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.length("piece_offsets") / 4).cast("long").alias("n_pieces"),
    )
