"""Quality classifier by co-training.

Two views of a document that share no input: its text (hashed character 1- to 3-grams, and the shapes of its
bytes), and the page's metadata beside the text (source, language and the recorded number of characters, by
hash and by powers of two). A logistic classifier of each view is fitted on labelled documents. Both score all
documents; those that either is most sure of are the pool. Over rounds, each view labels the documents of
the pool that it is most sure of, the same number for every class in proportion to the labelled classes, and the
other one learns from those too. A view is the less sure of a document the less of it the view has ever learned from, so
that a language without labels is not taken for bad. At the end both views are calibrated on labelled documents that were held
out (Platt's method), and as the views are taken as independent given the class, a document's quality has the
sum of both logits less that of the share of good labels, which both contain.

The labelled sample is bounded: about ``LABELLED`` documents, drawn by hash. The pool has the ``ROUNDS * EACH``
different texts of all documents that a view is surest of, for each view and class. All documents are scored
on their whole texts, without a shuffle of texts.

Null and empty texts get quality 0 and are rejected. Null labels, labels other than 0 and 1 and labels of unknown
documents are left out; of several labels of a document the highest counts. Without labels of both classes
nothing is learned, quality is null and every text that is not empty is accepted. Null or missing metadata is a
value of its own. Repeated rows are scored alike; further columns, whatever their names, are not looked at; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut, tidy, utf8_column
from textloom.llm.langid import DIMENSIONS, ngrams

#: Labelled documents, about; rounds of co-training; pseudo-labels a round and view.
LABELLED, ROUNDS, EACH = 3000, 4, 200
#: Hash places of source and of language, and powers of two of the size.
_HASHED, _SIZES = 64, 24
_META = 2 * _HASHED + _SIZES + 1
_SHAPES = 16


def metadata(source: str | None, lang: str | None, size: int | None) -> np.ndarray:
    """The page-metadata view of one document: the places of its three features."""
    power = _SIZES if size is None or size < 0 else min(int(size).bit_length(), _SIZES - 1)
    return np.array([crc32(f"s:{source}".encode()) % _HASHED, _HASHED + crc32(f"l:{lang}".encode()) % _HASHED, 2 * _HASHED + power])


def content(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, feature ids, values) of the content view: shares of n-grams, scaled, and shares of byte shapes."""
    for rows, ids, begin, _ in ngrams(raw, offsets):
        for r, x, y in zip(rows.tolist(), begin.tolist(), [*begin[1:].tolist(), len(ids)], strict=True):
            count = np.bincount(ids[x:y], minlength=DIMENSIONS + 1)[:DIMENSIONS]
            at = np.flatnonzero(count)
            yield r, np.concatenate([at, DIMENSIONS + np.arange(_SHAPES)]), np.concatenate([count[at] / count.sum() * _SCALE, shape(raw[offsets[r] : offsets[r + 1]])])


_SCALE = 30.0
#: Which of the shapes a byte has: fixed classes of ASCII, the rest by lead and trail bytes.
_SHAPE_OF = np.array([0 if b in (32, 9) else 1 if b in (10, 13) else 2 if b < 32 else 3 if 48 <= b < 58 else 4 if 65 <= b < 91 else 5 if 97 <= b < 123 else 6 if b in b".,;:" else 7 if b in b"!?" else 8 if b in b"|/\\_-" else 9 if b < 128 else 10 if b < 192 else 11 for b in range(256)], np.uint8)


def shape(raw: np.ndarray) -> np.ndarray:
    return 10.0 * np.bincount(_SHAPE_OF[raw], minlength=_SHAPES) / max(1, len(raw))


class Logistic:
    """Weights of a two-class logistic model over dense rows or hashed ids, by AdaGrad with an L2 penalty."""

    def __init__(self, size: int, l2: float = 1e-4, rate: float = 0.3, passes: int = 6, seed: int = 23):
        self.w, self.g, self.b, self.gb = np.zeros(size), np.full(size, 1e-6), 0.0, 1e-6
        self.l2, self.rate, self.passes, self.seed = l2, rate, passes, seed

    def fit(self, xs: list[tuple[np.ndarray, np.ndarray]], ys: np.ndarray, weight: np.ndarray) -> Logistic:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.passes):
            for i in rng.permutation(len(xs)):
                at, x = xs[i]
                w = self.w[at]
                e = weight[i] * (1 / (1 + np.exp(-np.clip(x @ w + self.b, -30, 30))) - ys[i])
                g = e * x + self.l2 * w
                self.g[at] += g * g
                self.w[at] = w - self.rate * g / np.sqrt(self.g[at])
                self.gb += e * e
                self.b -= self.rate * e / np.sqrt(self.gb)
        return self

    def known(self) -> np.ndarray:
        """Which features the model has learned from."""
        return self.g > 1e-6

    def score(self, xs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Logits, nearer to 0 the less of a row the model has ever seen."""
        known = self.known()
        return np.array([(x @ self.w[at] + self.b) * x[known[at]].sum() / max(1e-9, x.sum()) for at, x in xs])


def platt(score: np.ndarray, ys: np.ndarray) -> tuple[float, float]:
    """(a, b) so that a * score + b is a calibrated logit: Newton steps on the log loss, with Platt's targets."""
    pos, neg = ys.sum(), len(ys) - ys.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(ys == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    if score.std() < 1e-6:  # a view that tells nothing apart has the share of the labels to say
        return 0.0, float(np.log(t.mean() / (1 - t.mean())))
    spread = score.std()
    s, a, b = score / spread, 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * s + b, -30, 30)))
        d = p - t
        w = p * (1 - p)
        h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [(d * s).sum() + 1e-3 * a, d.sum() + 1e-3 * b])
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
    return max(a, 0.0) / spread, b


def cotrain(view_a: list, view_b: list, ys: np.ndarray, sizes: tuple[int, int], rounds: int = ROUNDS, each: int = EACH) -> tuple[Logistic, Logistic, np.ndarray]:
    """Two models and the labels at the end; ys has 0, 1 or -1 for unlabelled documents."""
    views, labels = (view_a, view_b), [ys.copy(), ys.copy()]
    rate = float((ys == 1).sum() / max(1, (ys >= 0).sum()))

    def fit(v: int) -> Logistic:
        known = np.flatnonzero(labels[v] >= 0)
        y = labels[v][known]
        share = np.array([max(1, (y == c).sum()) for c in (0, 1)])
        weight = np.where(ys[known] >= 0, 1.0, 0.5) * (len(y) / 2 / share)[y]
        return Logistic(sizes[v]).fit([views[v][i] for i in known], y, weight)

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        grown = False
        for v in (0, 1):
            open_ = np.flatnonzero(labels[1 - v] < 0)
            if not len(open_):
                continue
            s = models[v].score([views[v][i] for i in open_])
            order = np.argsort(s, kind="stable")
            # Only what the view is sure of, and of both classes in proportion, so that none is learned from one alone.
            most = min(each, (s > 1).sum() / max(rate, 1e-9), (s < -1).sum() / max(1 - rate, 1e-9))
            n_pos, n_neg = round(most * rate), round(most * (1 - rate))
            for part, c in ((order[::-1][:n_pos], 1), (order[:n_neg], 0)):
                labels[1 - v][open_[part]] = c
                grown |= len(part) > 0
        if not grown:
            break
        models = [fit(0), fit(1)]
    return models[0], models[1], labels[0]


class Model:
    """Both views' weights, with (a, b) of their calibrated logits a * score + b, and the logit they share."""

    def __init__(self, a: Logistic, b: Logistic, cal: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0)), prior: float = 0.0):
        self.table, self.shape, self.bias = np.append(a.w[:DIMENSIONS], 0.0), a.w[DIMENSIONS:], a.b
        self.meta, self.meta_bias, self.cal, self.prior = b.w, b.b, cal, prior
        known = a.known()
        self.known, self.known_shape, self.known_meta = np.append(known[:DIMENSIONS], False).astype(np.int32), known[DIMENSIONS:], b.known()

    def views(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Scores of (.., text, source, lang, n_chars) rows by either view; nan for texts without anything."""
        raw, offsets, _ = utf8_column(batch.column(1))
        first = np.full(batch.num_rows, np.nan)
        for rows, ids, begin, _ in ngrams(raw, offsets):
            grams = np.maximum(1, np.add.reduceat((ids < DIMENSIONS).astype(np.int32), begin))
            first[rows] = np.add.reduceat(self.table[ids], begin) / grams * _SCALE + self.bias
            seen = np.add.reduceat(self.known[ids], begin) / grams * _SCALE
            for r, ngram in zip(rows.tolist(), seen.tolist(), strict=True):
                bytes_ = shape(raw[offsets[r] : offsets[r + 1]])
                first[r] = (first[r] + bytes_ @ self.shape) * (ngram + bytes_[self.known_shape].sum()) / (_SCALE + bytes_.sum())
        known: dict[tuple, float] = {}
        second = np.empty(batch.num_rows)
        for r, facts in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)):
            if facts not in known:
                at = metadata(*facts)
                known[facts] = (float(self.meta[at].sum()) + self.meta_bias) * float(self.known_meta[at].mean())
            second[r] = known[facts]
        return first, second

    def score(self, batch: pa.RecordBatch) -> np.ndarray:
        first, second = self.views(batch)
        (a1, b1), (a2, b2) = self.cal
        return 1 / (1 + np.exp(-np.clip((a1 * first + b1) + (a2 * second + b2) - self.prior, -30, 30)))


def _views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(slot, label, ids, values, meta) of sample rows."""
    for b in batches:
        raw, offsets, _ = utf8_column(b.column(2))
        facts = list(zip(*(b.column(i).to_pylist() for i in (3, 4, 5)), strict=True))
        rows, ids, values, meta = [], [], [], []
        for r, at, x in content(raw, offsets):
            rows.append(r)
            ids.append(at.astype(np.int32).tobytes())
            values.append(x.astype(np.float32).tobytes())
            meta.append(metadata(*facts[r]).astype(np.int32).tobytes())
        part = b.take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary()), pa.array(values, pa.binary()), pa.array(meta, pa.binary())], names=["slot", "label", "ids", "vals", "meta"])


_SAMPLE = "slot long, label int, ids binary, vals binary, meta binary"


def _columns(docs: DataFrame, key: str) -> list[Column]:
    """Key, text and metadata; a column that is not there counts as null."""
    have = {c.lower() for c in docs.columns}
    pick = lambda n, t: F.col(f"`{n}`").cast(t) if n in have else F.lit(None).cast(t)
    return [F.col(f"`{key}`").alias("k"), pick("text", "string").alias("t"), pick("source", "string").alias("s"), pick("lang", "string").alias("l"), pick("n_chars", "long").alias("n")]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", seed: int = 29) -> Model | None:
    """A model from bounded samples, or None without labels of both classes."""
    known = labels.select(F.col(f"`{key}`").alias("lk"), F.col(f"`{label}`").cast("int").alias("y")).filter("lk is not null and y in (0, 1)")
    known = known.groupBy("lk").agg(F.max("y").alias("y"))
    slot = F.pmod(F.xxhash64(F.lit(seed), "lk"), F.lit(1_000_003))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    if len(counts) < 2:
        return None
    # Of the rarer class twice its share, so that it is learned from enough documents.
    share = {y: min(1.0, LABELLED / 2 / n) for y, n in counts.items()}
    chosen = known.filter(slot < F.when(F.col("y") == 1, int(share[1] * 1_000_003)).otherwise(int(share[0] * 1_000_003)))
    own = docs.select(*_columns(docs, key)).filter("t is not null")
    slot_k = F.xxhash64(F.lit(seed), "k")
    chosen = chosen.limit(2 * LABELLED)
    labelled = own.join(F.broadcast(chosen), F.col("k") == F.col("lk")).select(slot_k.alias("slot"), "y", "t", "s", "l", "n")
    rows = labelled.mapInArrow(_views, _SAMPLE).collect()
    rows.sort(key=lambda r: (r["slot"], r["label"], r["ids"]))
    ys = np.array([r["label"] for r in rows])
    held = (ys >= 0) & (np.arange(len(ys)) % 4 == 3)
    if not all(((ys == c) & ~held).any() for c in (0, 1)):
        return None
    a, b = _features(rows)
    learn, test = np.flatnonzero(~held), np.flatnonzero(held)
    sizes = (DIMENSIONS + _SHAPES, _META)
    first = cotrain([a[i] for i in learn], [b[i] for i in learn], ys[learn], sizes, 0)
    rows = _pool(own, Model(first[0], first[1]), chosen, slot_k)
    rows.sort(key=lambda r: (r["slot"], r["ids"]))
    more_a, more_b = _features(rows)
    model_a, model_b, _ = cotrain([a[i] for i in learn] + more_a, [b[i] for i in learn] + more_b, np.concatenate([ys[learn], np.full(len(rows), -1)]), sizes)
    cal = tuple(platt(x.score([v[i] for i in test]), ys[test]) for x, v in ((model_a, a), (model_b, b)))
    good = (ys[test].sum() + 1) / (len(test) + 2)
    return Model(model_a, model_b, cal, float(np.log(good / (1 - good))))


def _features(rows: list) -> tuple[list, list]:
    a = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["vals"], np.float32).astype(np.float64)) for r in rows]
    return a, [(np.frombuffer(r["meta"], np.int32), np.ones(3)) for r in rows]


def _pool(own: DataFrame, model: Model, chosen: DataFrame, slot: Column) -> list:
    """Features of the documents that a view is surest of, of all that are not in the labelled sample."""
    spark = own.sparkSession
    shared = spark.sparkContext.broadcast(model)  # DIMENSIONS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            first, second = shared.value.views(x)
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(5), pa.array(np.nan_to_num(first)), pa.array(np.nan_to_num(second))], names=["k", "h", "first", "second"])
            tidy()

    kind = dict(own.dtypes)["k"]
    body = F.xxhash64("t")
    scored = own.filter("t <> ''").withColumn("h", body).mapInArrow(run, f"k {kind}, h long, first double, second double")
    scored = scored.join(F.broadcast(chosen.select("lk")), F.col("k") == F.col("lk"), "left_anti")
    texts = cut(scored.groupBy("h").agg(F.min_by(F.struct("first", "second", "k"), "k").alias("x")).select("h", "x.*"))
    most = ROUNDS * EACH
    sure = [texts.orderBy(o, "h").limit(most).select("h", "k") for name in ("first", "second") for o in (F.asc(name), F.desc(name))]
    keys = sure[0]
    for part in sure[1:]:
        keys = keys.unionByName(part)
    keys = keys.distinct().select(F.col("h").alias("ph"), F.col("k").alias("pk"))  # 4 * ROUNDS * EACH rows at most
    rows = own.join(F.broadcast(keys), (F.col("k") == F.col("pk")) & (body == F.col("ph")))
    rows = rows.groupBy("k").agg(F.min(F.struct("t", "s", "l", "n")).alias("x")).select("k", "x.*")  # of rows with one id and text
    return rows.select(slot.alias("slot"), F.lit(-1).alias("y"), "t", "s", "l", "n").mapInArrow(_views, _SAMPLE).collect()


def score(docs: DataFrame, model: Model | None, key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """(key, quality, accepted) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers
    kind = dict(docs.select(F.col(f"`{key}`").alias("k")).dtypes)["k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = shared.value.score(b)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.nan_to_num(q, nan=0.0))], names=["k", "quality"])
            tidy()

    own = docs.select(*_columns(docs, key))
    if model is None:
        return own.select(F.col("k").alias(key), F.lit(None).cast("double").alias("quality"), (F.coalesce(F.length("t"), F.lit(0)) > 0).alias("accepted"))
    return own.mapInArrow(run, f"k {kind}, quality double").select(F.col("k").alias(key), "quality", (F.col("quality") >= threshold).alias("accepted"))


def filter_documents(docs: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows that the model accepts, with all their columns; whole rows go through, nothing is joined."""
    if model is None:
        return docs.filter(F.coalesce(F.length(F.col("`text`").cast("string")), F.lit(0)) > 0)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(docs.columns))]
    have = {c.lower(): n for c, n in zip(docs.columns, names, strict=True)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick = [b.column(names.index(have[c])) if c in have else pa.nulls(b.num_rows) for c in ("doc_id", "text", "source", "lang", "n_chars")]
            q = np.nan_to_num(shared.value.score(pa.RecordBatch.from_arrays(pick, names=list("ktsln"))), nan=0.0)
            yield b.filter(pa.array(q >= threshold))
            tidy()

    plain = docs.toDF(*names)
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
