"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character 1- to 3-grams of the lower-cased text with digits and runs of white space
folded. A document's value of a feature is its share of the text's n-grams times the feature's inverse
document frequency, so a score is a mean of weights over the n-grams and needs no sparse vectors.
Document frequencies cover every training document. The weights are trained by FTRL-proximal with an
elastic net (most of them are exactly 0) on a bounded sample, by default 500 documents a language; a held
part of the sample sets the temperature of the softmax. Every value of ``lang`` is a language, however many
there are: sample and weights (``DIMENSIONS`` numbers a language, on the driver and each worker) grow with them.

Texts are used whole. ``und`` with score 0 is given to null texts and texts without a letter, and to all
texts if nothing could be learned. Rows, also repeated ones, are independent; an empty table gives an
empty result. Texts of any length are used whole; ids may be of any type, also null; further columns, whatever
their names, are not looked at. Only ``df`` counts (``DIMENSIONS`` numbers a task) and the sample's features leave executors.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import codepoints, slices, tidy, utf8_column

#: Hash buckets of n-grams; documents a language in the training sample, at most about.
DIMENSIONS, SAMPLE_EACH = 1 << 15, 500
#: Tasks that count document frequencies, at most: each sends DIMENSIONS rows.
COUNTERS = 4096
_SLICE = 1 << 18


@lru_cache(1)
def _fold() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every code point (digits and white space folded), and whether it is a letter."""
    n = 0x110000
    low = np.arange(n, dtype=np.uint32)
    letter = np.zeros(n, bool)
    for i in range(n):
        ch = chr(i)
        kind = unicodedata.category(ch)
        if kind[0] == "L":
            letter[i] = True
            if kind in ("Lu", "Lt") and len(x := ch.lower()) == 1:
                low[i] = ord(x)
        elif kind == "Nd":
            low[i] = ord("0")
        elif kind[0] in "ZC":
            low[i] = ord(" ")
    return low, letter


def ngrams(raw: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, feature ids, where each row's ids begin, whether a row has a letter) for parts of a batch."""
    low, letter = _fold()
    shift = np.uint32(32 - int(dimensions - 1).bit_length())
    for i, j in slices(offsets, _SLICE):
        rows = i + np.flatnonzero(np.diff(offsets[i : j + 1]))
        if not len(rows):
            continue
        # A space before each text keeps n-grams of different texts apart; grams over the seam are dropped.
        text = raw[offsets[i] : offsets[j]].tobytes()
        cp = codepoints(text)
        size = np.ones(len(cp), np.int64)
        size[cp >= 0x80], size[cp >= 0x800], size[cp >= 0x10000] = 2, 3, 4
        size[(cp >= 0xDC80) & (cp < 0xDD00)] = 1
        at = np.searchsorted(np.cumsum(size) - size, offsets[rows] - offsets[i])
        row_of = np.zeros(len(cp), np.int32)
        row_of[at[1:]] = 1
        row_of = np.cumsum(row_of, dtype=np.int32)
        has = np.bincount(row_of, letter[cp], len(rows)) > 0
        c = low[cp]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row_of[1:] != row_of[:-1])
        c, row_of = c[keep], row_of[keep]
        k1, k2, k3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
        g1 = ((c * k1) ^ (c >> np.uint32(7))) * k3
        two = (c[:-1] * k2 + c[1:] * k1) * k3
        two ^= two >> np.uint32(15)
        three = (two[:-1] + c[2:] * k2) * k1
        three ^= three >> np.uint32(13)
        ids = np.full((len(c), 3), dimensions, np.int32)  # the value past the end counts as no n-gram
        ids[:, 0] = (g1 * k2) >> shift
        same2 = row_of[:-1] == row_of[1:]
        ids[:-1, 1] = np.where(same2, (two * k2) >> shift, dimensions)
        ids[:-2, 2] = np.where(row_of[:-2] == row_of[2:], (three * k3) >> shift, dimensions)
        begin = np.searchsorted(row_of, np.arange(len(rows))) * 3
        yield rows, ids.ravel(), begin, has


def crc_fold(key: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a task's texts: one row of packed counts."""
    total, n = np.zeros(DIMENSIONS + 1, np.int64), 0
    for b in batches:
        raw, offsets, _ = utf8_column(b.column(0))
        for rows, ids, begin, _has in ngrams(raw, offsets):
            n += len(rows)
            for x, y in zip(begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True):
                if y - x < 3 * DIMENSIONS // 4:
                    total[np.unique(ids[x:y]) if y - x < 3000 else np.flatnonzero(np.bincount(ids[x:y], minlength=DIMENSIONS + 1))] += 1
                else:
                    total += np.bincount(ids[x:y], minlength=DIMENSIONS + 1) > 0
    total[DIMENSIONS] = n
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMENSIONS + 1, dtype=np.int32)), pa.array(total)], names=["feature", "df"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, slot, ids, shares): sparse features of sample rows."""
    for b in batches:
        raw, offsets, _ = utf8_column(b.column(2))
        out: list[tuple[int, np.ndarray, np.ndarray]] = []
        for rows, ids, begin, has in ngrams(raw, offsets):
            for r, x, y, h in zip(rows.tolist(), begin.tolist(), [*begin[1:].tolist(), len(ids)], has.tolist(), strict=True):
                count = np.bincount(ids[x:y], minlength=DIMENSIONS + 1)[:DIMENSIONS]
                at = np.flatnonzero(count)
                if h:
                    out.append((r, at.astype(np.int32), (count[at] / count.sum()).astype(np.float32)))
        part = b.take(pa.array([r for r, _, _ in out], pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a.tobytes() for _, a, _ in out], pa.binary()), pa.array([v.tobytes() for _, _, v in out], pa.binary())], names=["lang", "slot", "ids", "shares"])


def train_ftrl(
    xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, classes: int, dimensions: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, passes: int = 4, seed: int = 11
) -> np.ndarray:
    """Weights [dimensions + 1, classes] (the last row is the bias) by FTRL-proximal."""
    z, n = np.zeros((dimensions + 1, classes)), np.zeros((dimensions + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(passes):
        for i in rng.permutation(len(xs)):
            at, x = xs[i]
            at, x = np.append(at, dimensions), np.append(x, 1.0)
            w = weights(at)
            score = x @ w
            p = np.exp(score - score.max())
            p /= p.sum()
            p[ys[i]] -= 1.0
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(dimensions + 1))


def best_temperature(scores: np.ndarray, ys: np.ndarray) -> float:
    """The divisor of scores with the least log loss, by golden section on its logarithm."""
    if not len(ys):
        return 1.0

    def loss(t: float) -> float:
        s = scores / np.exp(t)
        top = s.max(1)
        return float(np.mean(np.log(np.exp(s - top[:, None]).sum(1)) + top - s[np.arange(len(ys)), ys]))

    lo, hi, r = np.log(0.02), np.log(50.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


class Model:
    """Folded weights: idf, scale and temperature are in ``table``; a score is its mean over n-grams."""

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray):
        self.labels, self.table, self.bias = labels, table, bias

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, whether the text has a letter) of every text."""
        n = len(offsets) - 1
        out, letters = np.zeros((n, len(self.labels))), np.zeros(n, bool)
        for rows, ids, begin, has in ngrams(raw, offsets):
            grams = np.maximum(1, np.add.reduceat((ids < DIMENSIONS).astype(np.int32), begin))
            total = np.empty((len(rows), len(self.labels)))
            for k in range(len(self.labels)):
                total[:, k] = np.add.reduceat(self.table[k][ids], begin, dtype=np.float64)
            s = total / grams[:, None] + self.bias
            p = np.exp(s - s.max(1, keepdims=True))
            out[rows], letters[rows] = p / p.sum(1, keepdims=True), has
        return out, letters


def fit(docs: DataFrame, text: str, lang: str, key: str, seed: int = 5) -> Model | None:
    """A model from the rows with a text and a lang, or None if there are none."""
    own = docs.select(F.col(f"`{text}`").cast("string").alias("t"), F.col(f"`{lang}`").cast("string").alias("l"), F.xxhash64(F.lit(seed), F.col(f"`{key}`"), F.length(F.col(f"`{text}`"))).alias("slot")).filter("t is not null and l is not null")
    each = own.groupBy("l").count().collect()  # a row a language
    if not each:
        return None
    frequency = {r["feature"]: r["df"] for r in own.select("t").coalesce(COUNTERS).mapInArrow(_count_batches, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect()}
    df = np.array([frequency.get(i, 0) for i in range(DIMENSIONS + 1)], np.float64)
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    # Rows whose hash is below a language's share: about SAMPLE_EACH of each, whatever the table's size.
    share = docs.sparkSession.createDataFrame([(r["l"], min(1.0, SAMPLE_EACH / r["count"])) for r in each], "l string, share double")
    chosen = own.join(F.broadcast(share), "l").filter(F.pmod("slot", F.lit(1_000_003)) / F.lit(1_000_003.0) < F.col("share"))
    sample = chosen.select("l", "slot", "t").mapInArrow(_features, "lang string, slot long, ids binary, shares binary").collect()
    sample.sort(key=lambda r: (r["slot"], r["lang"], r["ids"]))
    labels = sorted({r["lang"] for r in sample})
    if not labels:
        return None
    xs = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["shares"], np.float32) * idf[np.frombuffer(r["ids"], np.int32)]) for r in sample]
    scale = 1.0 / max(1e-9, float(np.mean([np.sqrt((x * x).sum()) for _, x in xs])))
    xs = [(a, x * scale) for a, x in xs]
    ys = np.array([labels.index(r["lang"]) for r in sample])
    held = np.arange(len(xs)) % 5 == 4
    w = train_ftrl([x for x, h in zip(xs, held, strict=True) if not h], ys[~held], len(labels), DIMENSIONS)
    scores = np.array([x @ w[a] + w[-1] for (a, x), h in zip(xs, held, strict=True) if h]).reshape(-1, len(labels))
    t = best_temperature(scores, ys[held])
    table = np.zeros((len(labels), DIMENSIONS + 1), np.float32)
    table[:, :-1] = (w[:-1] * (idf * scale / t)[:, None]).T
    return Model(labels, table, w[-1] / t)


class _Predict:
    def __init__(self, shared):
        self.shared = shared

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = self.shared.value
        for b in batches:
            raw, offsets, _ = utf8_column(b.column(b.num_columns - 1))
            if m is None:
                best, top = ["und"] * b.num_rows, np.zeros(b.num_rows)
            else:
                p, letters = m.score(raw, offsets)
                at = p.argmax(1) if len(p) else np.zeros(0, int)
                best = [m.labels[i] if h else "und" for i, h in zip(at.tolist(), letters.tolist(), strict=True)]
                top = np.where(letters, p.max(1, initial=0.0), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(best, pa.string()), pa.array(top, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])
            tidy()


def predict(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every whole text."""
    own = docs.select(F.col(f"`{key}`").alias("doc_key"), F.col(f"`{text}`").cast("string").alias("t"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x DIMENSIONS numbers
    out = own.mapInArrow(_Predict(shared), f"doc_key {dict(own.dtypes)['doc_key']}, lang_pred string, score double")
    return out.withColumnRenamed("doc_key", key)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score); rows whose crc32(key) mod 4 is 2 are held out of learning."""
    model = fit(docs.filter(crc_fold(F.col(f"`{key}`")) != 2), text, lang, key)
    return predict(docs, model, text, key).select(key, (crc_fold(F.col(f"`{key}`")) == 2).alias("held_out"), "lang_pred", "score")
