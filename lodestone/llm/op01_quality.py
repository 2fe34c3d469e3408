"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader, sparse dot products.

Terms are the 1- and 2-grams of words and of runs of marks, hashed to 2**BITS ids. A term's value is its share of
the text's terms times SCALE, so scores do not depend on length. FTRL-proximal sees a bounded sample of labelled
rows (MAX_ROWS of them, EPOCHS times) in one task; every whole text is then scored where it lies, by one pass
without a shuffle.

Defined cases: a null or empty text has no terms and gets the bias alone; without usable labels every score is 0.5;
null ids are scored as any row; repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, features
from .labelled import labelled_sample, trained

BITS = 18
N_MAX = 2
SCALE = 16.0
MAX_ROWS = 6000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.01
PART, HELD_OUT = 3, 1


class Ftrl:
    """FTRL-proximal over sparse examples, with an unpenalised bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> None:
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.bias, self.bias_n = 0.0, 0.0
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray | slice) -> np.ndarray:
        z = self.z[ids]
        step = (self.beta + np.sqrt(self.n[ids])) / self.alpha + self.l2
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / step)

    def update(self, ids: np.ndarray, x: np.ndarray, w: np.ndarray, error: float) -> None:
        g, old = error * x, self.n[ids]
        self.z[ids] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / self.alpha * w
        self.n[ids] = old + g * g
        self.bias_n += error * error
        self.bias -= self.alpha * error / (self.beta + self.bias_n**0.5)


def sigmoid(v: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(v, -35, 35)))


def examples(batches: Iterator[pa.RecordBatch], terms) -> tuple[list[np.ndarray], list[np.ndarray], list[float]]:
    """Distinct term ids, counts and label of each text."""
    ids, counts, ys = [], [], []
    for batch in batches:
        data, offsets = common.text_buffer(batch.column("text"))
        ys += batch.column("y").to_pylist()
        for first, end, part, at in common.chunks(data, offsets):
            t, text = terms(part, at)
            order = np.argsort(text, kind="stable")
            cuts = np.searchsorted(text[order], np.arange(end - first + 1))
            for k in range(end - first):
                u, c = np.unique(t[order[cuts[k] : cuts[k + 1]]], return_counts=True)
                ids.append(u)
                counts.append(c)
    return ids, counts, ys


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, counts, ys = examples(batches, lambda d, o: features.word_and_mark_terms(d, o, N_MAX, BITS))
    if not ys:
        return
    model = Ftrl(1 << BITS)
    share = (sum(ys) + 1) / (len(ys) + 2)
    model.bias = float(np.log(share / (1 - share)))
    for _ in range(EPOCHS):
        for u, c, y in zip(ids, counts, ys, strict=True):
            x = c * (SCALE / max(1, c.sum()))
            w = model.weights(u)
            model.update(u, x, w, float(sigmoid(model.bias + w @ x)) - y)
    w = model.weights(slice(None))
    kept = np.flatnonzero(w)
    yield pa.RecordBatch.from_pydict({"bias": [model.bias], "terms": [kept.astype("<i4").tobytes()], "weights": [w[kept].astype("<f4").tobytes()], "factors": [b""]})


def dense(model: dict | None, bits: int) -> tuple[float, np.ndarray]:
    w = np.zeros(1 << bits)
    if model:
        w[np.frombuffer(model["terms"], "<i4")] = np.frombuffer(model["weights"], "<f4")
    return (model["bias"] if model else 0.0), w


def score_quality(documents: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score): the probability that a text is labelled 1. The model is at most 2**BITS weights."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w = dense(held.value, BITS)
        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            out = np.full(batch.num_rows, bias)
            for first, end, part, at in common.chunks(data, offsets):
                t, text = features.word_and_mark_terms(part, at, N_MAX, BITS)
                total = np.bincount(text, w[t], end - first)
                out[first:end] += SCALE * total / np.maximum(1, np.bincount(text, minlength=end - first))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sigmoid(out))], ["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scores, "doc_id long, score double")


def train_quality(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict | None:
    return trained(labelled_sample(documents, labels, "quality", common.remainder(F.col("doc_id"), PART) != HELD_OUT, max_rows), train)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = train_quality(documents, common.table(spark, sf_dir, "labels"))
    return score_quality(documents, model).select(
        "doc_id",
        (common.remainder(F.col("doc_id"), PART) == HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
