"""Text features, shingles and claim markers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: Words that negate a claim: fixed values.
NEGATIONS = ("no", "not", "never", "without", "cannot", "can't", "don't", "doesn't", "isn't", "wasn't", "won't")
#: Words that name people, not places: fixed values.
DEMONYMS = (
    "american", "americans", "british", "english", "french", "german", "germans",
    "chinese", "japanese", "indian", "indians", "italian", "italians", "russian",
    "russians", "spanish", "european", "europeans", "asian", "asians", "african",
    "africans", "western", "westerners", "westerner", "easterner", "easterners",
    "northerner", "northerners", "southerner", "southerners",
)
WORDS = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
NUMBERS = r"\d+(?:[.,]\d+)*"


def fold(x: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", x).casefold().split())


@F.pandas_udf(StringType())
def _unicode_folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else fold(x))


def normalize_text(text: Column) -> Column:
    """NFKC, case folded, white space collapsed: built-in for ASCII; only other texts go through an Arrow kernel."""
    ascii_ = F.octet_length(text) == F.char_length(text)
    plain = F.lower(F.trim(F.regexp_replace(text, r"[\t-\r\x1c-\x20]+", " ")))
    return F.coalesce(_unicode_folded(F.when(~ascii_, text)), plain)


def content_hash(text: Column) -> Column:
    return F.sha2(normalize_text(text), 256)


def text_key(text: Column) -> Column:
    """The text with runs of white space as one space: what repeated captures are recognised by."""
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def tokens(text: Column) -> Column:
    """The words of a normalized text."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it uses the value."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct word shingles of a normalized text; a shorter text is one, a text without words has none."""

    def of(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return _let(tokens(text), of)


_hashes: dict[str, int] = {}


def shingle_set(text: str, k: int = 5) -> np.ndarray:
    """The shingles of a normalized text as distinct 64-bit hashes in order: those of ``shingles``, made by numpy."""
    w = _WORDS.findall(text)
    if not w:
        return np.zeros(0, np.int64)
    if len(_hashes) > 500_000:
        _hashes.clear()
    for x in set(w):
        if x not in _hashes:
            _hashes[x] = int.from_bytes(blake2b(x.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
    h = np.array([_hashes[x] for x in w], np.uint64)
    k = min(k, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : len(h) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


@F.pandas_udf(ArrayType(LongType()))
def shingle_sets(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else shingle_set(fold(x)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if one of them is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def claim_markers(text: Column) -> Column:
    """Numbers in order, and three words around each negation, of a normalized text."""

    def around(w: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: F.get(w, i - 1).isin(*NEGATIONS))
        first = lambda i: F.greatest(i - 3, F.lit(1))
        return F.transform(at, lambda i: F.array_join(F.slice(w, first(i), i + 4 - first(i)), " "))

    return F.struct(numbers(text).alias("numbers"), _let(tokens(text), around).alias("negations"))


_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def without_repeated_blocks(text: Column, min_words: int = 20) -> Column:
    """(text, removed): lines of so many words or more that came before on the page go; short lines stay."""

    @F.pandas_udf("text string, removed long")
    def run(s: pd.Series) -> pd.DataFrame:
        out = []
        for x in s:
            if x is None:
                out.append((None, 0))
                continue
            seen: set[str] = set()
            lines, gone = [], 0
            for line in x.splitlines(keepends=True):
                if sum(1 for _ in _WORDS.finditer(line)) >= min_words:
                    if (same := fold(line)) in seen:
                        gone += 1
                        continue
                    seen.add(same)
                lines.append(line)
            out.append(("".join(lines).strip(), gone))
        return pd.DataFrame(out, columns=["text", "removed"])

    return run(text)


def minhash(shingle_list: Column, permutations: int = 128, seed: int = 42) -> Column:
    """MinHash values of a set of shingles, one a permutation; null for an empty set."""
    values = F.transform(F.sequence(F.lit(1), F.lit(permutations)), lambda i: F.array_min(F.transform(shingle_list, lambda x: F.xxhash64(F.lit(seed), i, x))))
    return F.when(F.size(shingle_list) > 0, values)


def bands(signature: Column, count: int = 8, rows: int = 16) -> Column:
    """Hashes of a signature's bands, numbered: sets that share one are candidates."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda b: F.xxhash64(b, F.slice(signature, b * rows + 1, rows)))


def context(text: Column, begin: Column, end: Column, around: int = 250) -> Column:
    """The characters around a span (from ``begin``, counted from 0, to before ``end``)."""
    first = F.greatest(begin - around, F.lit(0))
    return F.substring(text, first + 1, F.least(end + around, F.char_length(text)) - first)


def is_place_name(name: Column) -> Column:
    """Whether a name is there at all and is not that of a people."""
    return (F.length(name) > 0) & ~F.lower(name).isin(*DEMONYMS)


def text_windows(text: Column, most: int = 100_000, size: int = 50_000, overlap: int = 2000) -> Column:
    """(begin, text) of a text's windows: one up to ``most`` characters, else windows of ``size`` that overlap."""
    n = F.char_length(text)
    count = F.ceil((n - overlap) / F.lit(size - overlap)).cast("int")
    long = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.struct((i * (size - overlap)).alias("begin"), F.substring(text, i * (size - overlap) + 1, F.lit(size)).alias("text")))
    return F.when(n > most, long).otherwise(F.array(F.struct(F.lit(0).alias("begin"), text.alias("text"))))


def date_prefix(value: Column) -> Column:
    """The date that the first ten characters write; null if they write none."""
    return F.try_to_timestamp(F.substring(value, 1, 10), F.lit("yyyy-MM-dd")).cast("date")


#: Words that tell languages: a short profile each, as fixed values.
PROFILES = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "with", "was"),
    "fr": ("le", "la", "les", "et", "de", "des", "est", "une", "dans", "pour"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "ein", "eine", "mit", "von"),
    "es": ("el", "los", "las", "y", "del", "es", "una", "en", "por", "con"),
}


def detect_language(text: Column, characters: int = 80) -> Column:
    """The language whose profile the first characters meet most often, ties by code; null without a meeting."""
    words_ = F.regexp_extract_all(F.lower(F.substring(text, 1, characters)), F.lit(r"\p{L}+"), F.lit(0))
    met = lambda profile: F.size(F.filter(words_, lambda w: w.isin(*profile)))
    hits = [F.struct((-met(profile)).alias("n"), F.lit(code).alias("code")) for code, profile in PROFILES.items()]
    best = F.array_min(F.array(*hits))
    return F.when(best["n"] < 0, best["code"])


def sentence_chunks(text: Column, words_each: int = 128) -> Column:
    """(begin, end, token_count, text) of chunks: whole sentences, packed until the next would exceed so many words."""
    sentence = F.regexp_extract_all(text, F.lit(r"(?s)[^.!?\n]*(?:[.!?\n]+\s*|$)"), F.lit(0))
    sentence = F.filter(sentence, lambda x: F.length(x) > 0)
    empty = F.struct(F.array().cast("array<struct<begin:int,end:int,token_count:int>>").alias("done"), F.lit(0).alias("begin"), F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(a: Column, x: Column) -> Column:
        n, size = word_count(x), F.char_length(x)
        full = (a["n"] > 0) & (a["n"] + n > words_each)
        closed = F.struct(a["begin"].alias("begin"), a["end"].alias("end"), a["n"].alias("token_count"))
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(closed))).otherwise(a["done"]).alias("done"), F.when(full, a["end"]).otherwise(a["begin"]).alias("begin"),
            (a["end"] + size).alias("end"), (F.when(full, 0).otherwise(a["n"]) + n).alias("n"),
        )

    def close(a: Column) -> Column:
        return F.when(a["n"] > 0, F.concat(a["done"], F.array(F.struct(a["begin"].alias("begin"), a["end"].alias("end"), a["n"].alias("token_count"))))).otherwise(a["done"])

    spans = F.aggregate(sentence, empty, step, close)
    return F.transform(spans, lambda c: F.struct(c["begin"].alias("begin"), c["end"].alias("end"), c["token_count"].alias("token_count"), F.substring(text, c["begin"] + 1, c["end"] - c["begin"]).alias("text")))


def encode(text: Column, dims: int = 64) -> Column:
    """A unit vector of a text's hashed word counts: the encoder that needs no model; null without words."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            v = np.zeros(dims)
            for w in _WORDS.findall((x or "").lower()):
                h = crc32(w.encode())
                v[h % dims] += 1 if h >> 16 & 1 else -1
            n = np.sqrt(v @ v)
            out.append(v / n if n else None)
        return pd.Series(out)

    return run(text)


def surface(name: Column) -> Column:
    """A place name as it is looked up: white space collapsed, a leading article gone, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"(?i)^the ", ""))


def is_html(mimetype: Column) -> Column:
    return F.coalesce(F.lower(F.trim(F.substring_index(mimetype, ";", 1))).isin("text/html", "application/xhtml+xml"), F.lit(False))
