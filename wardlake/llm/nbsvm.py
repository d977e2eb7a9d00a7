"""Quality classifier: naive Bayes support vectors on n-gram indicators.

Features of a text are the distinct 1- and 2-grams of its lower-cased words and
the distinct 1- to 3-grams of word shapes (runs of lower case, upper case,
digits, other signs; whether the word repeats one of the two before it), hashed
into a fixed number of buckets. Each indicator is scaled by its log-count ratio
between the classes; a linear hinge-loss model is fitted on the scaled, length
one rows by dual coordinate descent, and its margin turned into a probability by
a logistic curve fitted on the training margins.

The model is one vector of ``BUCKETS`` weights whatever the size of the corpus.
It is fitted on at most ``train_rows`` labelled rows, taken by the smallest hash
of their key; every text is scored whole. NULL and empty texts have no feature
and get the score of margin zero. Without rows of both classes every score is
the share of class 1 (one half without labels). Repeated labels of a key count
once (the larger label), a NULL label not at all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.words import Words, binary_column, chunks, mix

BITS = 19
BUCKETS = 1 << BITS
TRAIN_ROWS = 6000
EPOCHS, COST, BLEND = 12, 1.0, 0.25

_SHAPE = np.full(256, ord("#"), dtype=np.uint8)
_SHAPE[[9, 10, 11, 12, 13, 32]] = 32
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = ord("a"), ord("A"), ord("0"), ord("a")
for _sign in b"!\"$%&'*+,-./:;<=>?@|~(){}[]_^\\`":
    _SHAPE[_sign] = _sign
_U = np.uint64


def _shapes(values: np.ndarray, offsets: np.ndarray) -> Words:
    """The texts with every run of one class cut to one byte; the words stay in order."""
    shape = _SHAPE[values]
    keep = np.ones(len(shape), dtype=bool)
    keep[1:] = (shape[1:] != shape[:-1]) | (shape[1:] == 32)
    keep[offsets[:-1][offsets[:-1] < len(shape)]] = True
    where = np.concatenate(([0], np.cumsum(keep)))
    return Words(shape[keep], where[offsets])


def text_features(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every distinct feature of some texts, sorted by text."""
    plain, shape = Words(values, offsets, lower=True), _shapes(values, offsets)
    n, texts = len(plain.hash), len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(plain.first))
    place = np.arange(n) - plain.first[owner]
    word, form = plain.hash, shape.hash
    again = np.zeros(n, dtype=np.uint64)
    for back in (1, 2):
        if n > back:
            again[back:] |= ((word[back:] == word[:-back]) & (place[back:] >= back)).astype(np.uint64) << _U(back)
    form = mix(form ^ (again * _U(0x9E3779B97F4A7C15)))
    keys = []

    def add(hashes: np.ndarray, kind: int, length: int) -> None:
        ok = place[length - 1 :] >= length - 1
        bucket = mix(hashes[ok] ^ _U(kind)) >> _U(64 - BITS)
        keys.append((owner[length - 1 :][ok].astype(np.uint64) << _U(BITS)) | bucket)

    add(word, 11, 1)
    add(form, 21, 1)
    if n > 1:
        add(word[:-1] * _U(3) + mix(word[1:]), 12, 2)
        add(form[:-1] * _U(3) + mix(form[1:]), 22, 2)
    if n > 2:
        add(form[:-2] * _U(5) + mix(form[1:-1] * _U(3) + mix(form[2:])), 23, 3)
    # few shapes, many places: make each kind distinct before all are sorted together
    keys[1:2] = [np.unique(keys[1])]
    if n > 1:
        keys[3:4] = [np.unique(keys[3])]
    if n > 2:
        keys[4:5] = [np.unique(keys[4])]
    distinct = np.unique(np.concatenate(keys))
    return (distinct >> _U(BITS)).astype(np.int64), (distinct & _U(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    square: np.ndarray
    slope: float
    shift: float

    def margins(self, owner: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        top = np.bincount(owner, self.weight[bucket], texts)
        norm = np.sqrt(np.bincount(owner, self.square[bucket], texts))
        return np.divide(top, norm, out=np.zeros(texts), where=norm > 0)

    def scores(self, owner: np.ndarray, bucket: np.ndarray, texts: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(owner, bucket, texts) + self.shift, -40, 40)))


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """From the distinct buckets of each training text and its label (0 or 1)."""
    zero = np.zeros(BUCKETS)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        return Model(zero, zero, 0.0, 40.0 if share == 1 else -40.0 if share == 0 else 0.0)
    sign = np.where(labels == 1, 1.0, -1.0)
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y == k]), minlength=BUCKETS) + 1.0 for k in (1, 0)]
    seen = (counts[0] + counts[1]) > 2
    ratio = np.where(seen, np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum()), 0.0)
    square = ratio**2
    norms = np.array([np.sqrt(square[r].sum()) for r in rows])
    scaled = [ratio[r] / n if n > 0 else ratio[r] for r, n in zip(rows, norms, strict=True)]
    # rarer class weighs as much as the commoner one
    most = COST * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    w, bias, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            r, x, y = rows[i], scaled[i], sign[i]
            gradient = y * (w[r] @ x + bias) - 1
            new = min(max(alpha[i] - gradient / (1.0 + (norms[i] > 0)), 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[r] += step * x
                bias += step
                alpha[i] = new
    used = seen & (ratio != 0)
    # between naive Bayes (one weight for every ratio) and the support vectors
    w = np.where(used, (1 - BLEND) * np.abs(w[used]).mean() + BLEND * w, 0.0)
    margin = np.array([w[r] @ x + bias for r, x in zip(rows, scaled, strict=True)])
    slope, shift = 1.0, 0.0
    target = np.where(labels == 1, (labels.sum() + 1) / (labels.sum() + 2), 1 / ((labels == 0).sum() + 2))
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40)))
        d, h = p - target, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * margin).sum(), d.sum()])
        m = np.array([[(h * margin**2).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(m, g)
        slope, shift = slope - move[0], shift - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return Model(w * ratio, square, slope, shift + slope * bias)


def features(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """The kept columns and ``buckets`` (binary, 32-bit numbers) of every text."""
    picked = df.select(*keep, text)
    schema = picked.withColumn(text, F.lit(None).cast("binary")).withColumnRenamed(text, "buckets").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary_column(batch, text)
            for lo, hi, values, offsets in chunks(texts):
                owner, bucket = text_features(values, offsets)
                ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                made = [bucket[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(made, pa.binary())], schema.names)

    return picked.mapInArrow(work, schema)


def train(docs: DataFrame, labels: DataFrame, allowed: Column, train_rows: int = TRAIN_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on the labelled rows for which ``allowed`` (over the key) holds, at most ``train_rows`` of them."""
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & allowed).groupBy(key).agg(F.max(label).alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(3), key), key).limit(train_rows).select(F.col(key).alias("k"), "y")
    some = docs.join(F.broadcast(chosen), docs[key] == F.col("k")).select("k", "y", docs[text].alias("text"))
    rows = features(some, "text", "k", "y").toPandas().drop_duplicates("k").sort_values("k")
    return fit([np.frombuffer(b, dtype="<u4") for b in rows["buckets"]], rows["y"].to_numpy().astype(int))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with ``score`` (a column of that name is replaced); texts stay whole."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = binary_column(batch, text)
            found = [m.scores(*text_features(values, offsets), hi - lo) for lo, hi, values, offsets in chunks(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], schema.names)

    return docs.select(*keep).mapInArrow(work, schema)
