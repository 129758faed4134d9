"""Words and word shingles of texts as 64-bit hashes.

Words are runs of bytes between ASCII white space; A-Z count as a-z. A shingle is ``K`` words in a row.
"""

from __future__ import annotations

import numpy as np

from textloom.llm.common import mix64

#: Words of a shingle.
K = 5
_BYTE = mix64(np.arange(256, dtype=np.uint64), 101)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MULTIPLIER = 0x5851F42D4C957F2D
_POWERS = np.ones(256, np.uint64)
for _i in range(1, 256):
    _POWERS[_i] = np.uint64(int(_POWERS[_i - 1]) * _MULTIPLIER & 0xFFFFFFFFFFFFFFFF)


def words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, begins, ends) of the words of one text."""
    black = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], black, [False]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end
    # The place in its word of every black byte; white ones count as nothing.
    place = np.arange(begin[0], len(raw)) - np.repeat(begin, np.diff(np.append(begin, len(raw))))
    raw, black = raw[begin[0] :], black[begin[0] :]
    value = _BYTE[raw] * _POWERS[place & 255]
    if len(raw) > 255:
        value += (place >> 8).astype(np.uint64)
    value[~black] = 0
    begin_here = begin - begin[0]
    return mix64(np.add.reduceat(value, begin_here) + (end - begin).astype(np.uint64)), begin, end


def shingles(h: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the shingles of a text with these word hashes; a text of fewer words is one shingle."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= h[j : j + n]
        out ^= out >> np.uint64(29)
    return mix64(out, min(k, len(h)))


#: Bytes that temporaries are made for at once.
_PART = 1 << 20


def batches(bodies: list[bytes]):
    """Runs of texts of about ``_PART`` bytes, one text at least: (first, past the last)."""
    i = 0
    while i < len(bodies):
        j, size = i, 0
        while j < len(bodies) and (j == i or size + len(bodies[j]) <= _PART):
            size += len(bodies[j])
            j += 1
        yield i, j
        i = j


def word_counts(bodies: list[bytes]) -> np.ndarray:
    """Words of each text."""
    raw = np.frombuffer(b" ".join(bodies) + b" ", np.uint8)
    black = ~_SPACE[raw]
    first = black.copy()
    first[1:] &= ~black[:-1]
    ends = np.cumsum([len(x) + 1 for x in bodies])
    total = np.concatenate([[0], np.cumsum(first)])
    return np.diff(np.concatenate([[0], total[ends]]))


def of_texts(bodies: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, where each text's hashes begin, words a text, begins and ends of all words) of the shingles of texts."""
    n = np.array([len(x) for x in bodies], np.int64)
    start = np.concatenate([[0], np.cumsum(n + 1)])
    h, b, e = words(np.frombuffer(b" ".join(bodies) + b" ", np.uint8))
    first = np.searchsorted(b, start)
    many = np.diff(first)
    owner = np.repeat(np.arange(len(bodies)), many)
    size = np.where(many >= k, many - k + 1, np.minimum(many, 1))
    begin = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(begin[-1]), np.uint64)
    if len(h) >= k:
        rolled = shingles(h, k)
        inside = owner[: len(rolled)] == owner[k - 1 :]
        place = begin[owner[: len(rolled)]] + np.arange(len(rolled)) - first[owner[: len(rolled)]]
        out[place[inside]] = rolled[inside]
    for i in np.flatnonzero((many > 0) & (many < k)).tolist():
        out[begin[i]] = shingles(h[first[i] : first[i + 1]], k)[0]
    shift = start[owner]
    return out, begin, many, b - shift, e - shift


def sets_of(bodies: list[bytes], k: int = K) -> list[np.ndarray]:
    """The sorted different shingles of each text."""
    out: list[np.ndarray] = []
    for i, j in batches(bodies):
        s, begin, *_ = of_texts(bodies[i:j], k)
        doc = np.repeat(np.arange(j - i), np.diff(begin))
        order = np.lexsort((s, doc))
        s, doc = s[order], doc[order]
        new = np.concatenate([[True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])]) if len(s) else np.zeros(0, bool)
        out += np.split(s[new], np.searchsorted(doc[new], np.arange(1, j - i)))
    return out
