"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are n-grams of words (one and two) and of word shapes (one to three; a word like the one before it has a
shape of its own), hashed to a fixed number of weights. A feature's value is its share of the text's n-grams of that
kind. Training runs in one task over a sample of at most ``max_labelled`` labelled texts; scoring is a sparse dot
product for each text, with the weights broadcast (2 ** ``bits`` floats at most, whatever the corpus).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import own_name

BITS = 18
#: The bound of the labelled sample that training reads.
MAX_LABELLED = 12_000
THRESHOLD = 0.3
_MEMO = 300_000
_PIECE = 1 << 17
_SHAPE = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KINDS = 5
#: n-gram shares are multiplied by this, so that steps are of order one.
_SCALE = 8.0


class _Words(dict):
    """Hashes of a word and of its shape, 32 bits each, remembered up to a bound."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) >= _MEMO:
            self.clear()
        shape = _RUN.sub(rb"\1", w.translate(_SHAPE))
        got = self[w] = xxhash.xxh32_intdigest(w, 1) << 32 | xxhash.xxh32_intdigest(shape[:64], 2)
        return got


_WORDS = _Words()


def indices(text: bytes, bits: int = BITS) -> list[np.ndarray]:
    """For each kind of n-gram, the weights' indices that the text's n-grams hash to, in order, repeats included."""
    w = text.split()
    if not w:
        return [np.empty(0, np.int64)] * _KINDS
    both = np.fromiter(map(_WORDS.__getitem__, w), np.uint64, len(w))
    word, shape = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    shape[1:][word[1:] == word[:-1]] = np.uint64(7)
    shift = np.uint64(64 - bits)

    def slot(h: np.ndarray) -> np.ndarray:
        return (((h ^ (h >> np.uint64(29))) * _M3) >> shift).astype(np.int64)

    a, b, c = word * _M1, word * _M2, shape * _M1 + np.uint64(1)
    ab = c[:-1] + shape[1:] * _M2
    return [slot(a), slot(a[:-1] + b[1:]), slot(c), slot(ab), slot(ab[:-1] * _M2 + shape[2:] * _M1)]


def vector(text: bytes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and their values."""
    kinds = indices(text, bits)
    idx = np.concatenate(kinds)
    val = np.concatenate([np.full(len(k), _SCALE / max(1, len(k))) for k in kinds])
    u, inv = np.unique(idx, return_inverse=True)
    return u, np.bincount(inv, val, len(u))


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss; the bias is the last coordinate and isn't regularised."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def bias(self) -> float:
        return float(-self.z[-1] / ((self.beta + np.sqrt(self.n[-1])) / self.alpha))

    def learn(self, idx: np.ndarray, val: np.ndarray, y: int) -> None:
        w, b = self.weights(idx), self.bias()
        g = 1 / (1 + np.exp(-np.clip(w @ val + b, -35, 35))) - y
        for at, x, old in ((idx, val, w), (-1, 1.0, b)):
            step = g * x
            sigma = (np.sqrt(self.n[at] + step * step) - np.sqrt(self.n[at])) / self.alpha
            self.z[at] += step - sigma * old
            self.n[at] += step * step


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = 3, seed: int = 7) -> Ftrl:
    model, rng = Ftrl(bits), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            model.learn(*rows[k])
    return model


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is divisible by 5. A null id counts as the text of no characters: held out."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, float]:
    """Weights and bias, learnt from labelled rows that aren't held out.

    Of an id labelled twice the largest label counts; of texts that share an id the smallest. Beyond ``max_labelled``
    ids, those with the smallest hash are taken. Without labelled rows all weights are zero.
    """
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    key = own_name("id", docs)
    chosen = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias(key))
        .agg(F.max(label_col).cast("int").alias("y"))
        .withColumn("h", F.xxhash64(key))
        .orderBy("h", key)
        .limit(max_labelled)
    )
    # at most max_labelled rows of three numbers: safe to broadcast
    texts = docs.select(F.col(id_col).alias(key), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    sample = texts.groupBy(key, "h", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b in batches:
            for i, y, h, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), pc.cast(b.column(3), pa.binary()), strict=True):
                u, v = vector(t.as_py(), bits)
                rows.append((h, i, u.astype(np.int32), v.astype(np.float32), y))
        rows.sort(key=lambda r: r[:2])
        model = train([(u, v, y) for _, _, u, v, y in rows], bits)
        w = model.weights(slice(0, -1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1], pa.int32()), pa.array(np.r_[w[at], model.bias()])], ["k", "w"])

    schema = StructType([StructField("k", IntegerType()), StructField("w", DoubleType())])
    got = sample.select(key, "y", "h", "text").coalesce(1).mapInArrow(run, schema).toArrow()
    k, w = got.column(0).to_numpy(), got.column(1).to_numpy()
    weights = np.zeros(1 << bits, np.float32)
    weights[k[k >= 0]] = w[k >= 0]
    return weights, float(w[k < 0][0]) if (k < 0).any() else 0.0


def _score(texts: Iterator[bytes], weights: np.ndarray, bias: float, bits: int) -> Iterator[float]:
    for t in texts:
        s = bias
        for k in indices(t, bits):
            if len(k):
                s += _SCALE * float(weights[k].sum(dtype=np.float64)) / len(k)
        yield 1 / (1 + float(np.exp(-max(-35.0, min(35.0, s)))))


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS, threshold: float = THRESHOLD, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col``: how likely the label is 1. Null and empty texts get the bias alone.

    Only the text is looked at; other columns pass through, and one named like ``score_col`` is replaced.
    """
    from pyspark.sql.functions import pandas_udf

    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def of(texts):
        import pandas as pd

        weights, bias = shared.value
        return pd.Series(list(_score(((t or "").encode() for t in texts), weights, bias, bits)), dtype="float64")

    return docs.withColumn(score_col, of(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; repeated rows and ids get equal results.

    Null and empty texts are scored by the bias alone. A null id counts as held out. Without labels every score is 0.5. An empty
    table gives no rows. Other columns are not looked at.
    """
    model = fit(docs, labels, max_labelled, id_col=id_col, text_col=text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score(narrow, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, with all their columns, whatever these are called.

    Each row is judged by its own text, so that of repeated rows or ids all with that text stay or go. Null and empty texts are
    judged by the bias alone. Without labels all stay. An empty table gives no rows.
    """
    model = fit(docs, labels, max_labelled)
    name = own_name("score", docs)
    kept = score(docs, model, score_col=name).where(F.col(name) >= threshold)
    return kept.select(*docs.columns)
