"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words (lower case, punctuation dropped), pairs of
neighbours, and pairs with one word between them, each hashed to one of 2**18
coordinates; a feature is there or not, however often. Training (McMahan et al.,
2013) keeps a rate for each coordinate, and its L1 term leaves few weights, which
are broadcast as sparse arrays: 2**18 pairs at the very most.

It learns from at most ``TRAIN_ROWS`` labelled ids, those of least hash among
all whose crc32(doc_id) mod 5 is not 0, one text each, and of these from the first
with ``TRAIN_FEATURES`` features together: a bounded sample, so the driver never
holds more than their feature numbers. Scoring covers every whole text.

Edge cases: a null or empty text has the bias alone; a very long one is scored
whole; an id with several texts is learnt from by the least of them; labels that are null or
without an id do not count; an id with several labels is toxic if one says so;
without any label the score is 0; repeated rows are scored as often as they come;
empty tables give no rows. Columns besides those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, chunks, cut, encode, mix

BITS, TRAIN_ROWS, TRAIN_FEATURES, EPOCHS, FOLDS = 18, 10_000, 30_000_000, 6, 5
ALPHA, BETA, L1, L2 = 2.0, 1.0, 4.0, 0.1
_PUNCTUATION = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


def features(text: str, words: WordHashes) -> np.ndarray:
    """Coordinates of a text's features, with repeats."""
    h = words.of(encode(text.lower()).translate(_PUNCTUATION).split())
    with np.errstate(over="ignore"):
        grams = [h] + [mix(h[:-gap] * np.uint64(2 * gap + 1) + h[gap:]) for gap in (1, 2) if len(h) > gap]
    return (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Weights:
    index: np.ndarray
    value: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.index] = self.value
        return out


def fit(rows: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> Weights:
    """Follow the regularised leader over the rows (arrays of distinct coordinates), in a shuffled order."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            zx, nx = z[x], n[x]
            w = weights(zx, nx, L1)
            b = float(weights(np.array(bz), np.array(bn), 0.0))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y[i]
            sigma = (np.sqrt(nx + g * g) - np.sqrt(nx)) / ALPHA
            z[x], n[x] = zx + g - sigma * w, nx + g * g
            bz, bn = bz + g - (np.sqrt(bn + g * g) - np.sqrt(bn)) / ALPHA * b, bn + g * g
    w = weights(z, n, L1)
    index = np.flatnonzero(w)
    return Weights(index.astype(np.int32), w[index].astype(np.float32), float(weights(np.array(bz), np.array(bn), 0.0)) if len(rows) else -745.0)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([np.unique(features(t, words)).tobytes() for t in texts], pa.binary())], ["doc_id", "toxic", "x"])


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Weights:
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows), "labels")
    # at most ``rows`` pairs of numbers
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    made = cut(found.mapInArrow(_featurise, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, x binary"), "features")
    size = F.sum(F.octet_length("x") / 4).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # ``rows`` rows at most
    kept = made.select("doc_id", size.alias("so_far"), F.octet_length("x")).where(F.col("so_far") <= TRAIN_FEATURES)
    got = made.join(F.broadcast(kept.select("doc_id")), "doc_id").toArrow().sort_by("doc_id")
    return fit([np.frombuffer(x, np.int32) for x in got.column("x").to_pylist()], np.array(got.column("toxic").to_pylist(), float))


def _score(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, words, bias = weights.value.dense(), WordHashes(), weights.value.bias
        on = w != 0
        for batch, texts in chunks(batches):
            sums = []
            for t in texts:
                x = features(t, words)
                sums.append(bias + float(w[np.unique(x[on[x]])].sum()))
            score = 1 / (1 + np.exp(-np.clip(np.array(sums), -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.where(score < 1e-300, 0.0, score))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, weights: Weights) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    return score(docs, train(docs, labels)).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
