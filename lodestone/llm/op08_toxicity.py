"""Toxicity: a factorisation machine over hashed terms.

score = sigmoid(bias + sum of w_i + sum over pairs of <v_i, v_j>), over the distinct lower-cased words of a text
and the first PREFIXES bytes of longer ones, so inflected and joined forms share terms. The
linear part is learnt by FTRL-proximal, whose L1 term keeps only words seen often enough to be believed. Factors
(AdaGrad) carry what two words mean together, such as an insult next to the mention of a group. Two kinds of terms have them: those with a
linear weight, and, after the first pass, those that are neutral on their own but stand in at least MIN_TEXTS texts that the model
still gets wrong (by HARD or more on average), as only a pair can explain those. Other words take no part, so long clean texts do not gather noise.

It learns from a bounded sample of labelled rows (MAX_ROWS, in one task) and scores every whole text where it lies.
Defined cases: a null or empty text has no terms and gets the bias alone; without usable labels every score is 0.5; very long texts are
scored whole; null ids, repeated rows and empty tables as any; other columns pass through `score_toxicity`, but for one that has the score's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common, features
from .labelled import labelled_sample, trained
from .op01_quality import Ftrl, dense, examples, sigmoid

BITS = 20
RANK = 4
PREFIXES = (4, 5, 6)
MAX_ROWS = 8000
EPOCHS = 4
ALPHA, L1, L2 = 0.5, 2.0, 0.01
FACTOR_RATE, FACTOR_L2, FACTOR_START = 0.05, 1e-3, 0.01
MIN_TEXTS, HARD = 20, 0.35
PART, HELD_OUT = 5, 0


def pairs(v: np.ndarray) -> float:
    """Sum over pairs of inner products of the rows."""
    s = v.sum(0)
    return 0.5 * float(s @ s - (v * v).sum())


def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, _, ys = examples(batches, lambda d, o: features.lower_word_terms(d, o, PREFIXES, BITS))
    if not ys:
        return
    model = Ftrl(1 << BITS, ALPHA, 1.0, L1, L2)
    v = np.random.default_rng(7).normal(0, FACTOR_START, (1 << BITS, RANK)).astype(np.float32)
    seen = np.full((1 << BITS, RANK), 1e-2, np.float32)
    share = (sum(ys) + 1) / (len(ys) + 2)
    model.bias = float(np.log(share / (1 - share)))
    texts = np.bincount(np.concatenate(ids), minlength=1 << BITS)
    hard = np.zeros(1 << BITS, bool)
    for _ in range(EPOCHS):
        wrong = np.zeros(1 << BITS, np.float32)
        for u, y in zip(ids, ys, strict=True):
            w = model.weights(u)
            on = u[(w != 0) | hard[u]]
            f = v[on]
            error = float(sigmoid(model.bias + w.sum() + pairs(f))) - y
            wrong[u] += abs(error)
            model.update(u, np.ones(len(u)), w, error)
            if len(on) > 1:
                g = error * (f.sum(0) - f) + FACTOR_L2 * f
                seen[on] += g * g
                v[on] = f - FACTOR_RATE * g / np.sqrt(seen[on])
        hard |= (texts >= MIN_TEXTS) & (wrong >= HARD * np.maximum(1, texts))
    w = model.weights(slice(None))
    kept = np.flatnonzero((w != 0) | (hard & (seen > 0.02).any(1)))
    yield pa.RecordBatch.from_pydict({"bias": [model.bias], "terms": [kept.astype("<i4").tobytes()], "weights": [w[kept].astype("<f4").tobytes()], "factors": [v[kept].astype("<f4").tobytes()]})


def score_toxicity(documents: DataFrame, model: dict | None, name: str = "toxicity") -> DataFrame:
    """`documents` with a column `name`, the probability that a text is labelled toxic. Other columns pass through."""
    held = documents.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w = dense(held.value, BITS)
        at_row = np.full(1 << BITS, -1, np.int32)
        v = np.zeros((0, RANK))
        if held.value:
            kept = np.frombuffer(held.value["terms"], "<i4")
            at_row[kept] = np.arange(len(kept))
            v = np.frombuffer(held.value["factors"], "<f4").reshape(-1, RANK).astype(np.float64)
        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            out = np.full(batch.num_rows, bias)
            for first, end, part, at in common.chunks(data, offsets):
                t, text = features.lower_word_terms(part, at, PREFIXES, BITS)
                on = at_row[t] >= 0
                key = np.unique((text[on] << BITS) | t[on])
                t, text = key & ((1 << BITS) - 1), key >> BITS
                out[first:end] += np.bincount(text, w[t], end - first)
                for k in range(RANK):
                    f = v[at_row[t], k]
                    out[first:end] += 0.5 * (np.bincount(text, f, end - first) ** 2 - np.bincount(text, f * f, end - first))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sigmoid(out))], [*batch.schema.names, name])

    documents = documents.drop(name)
    return documents.mapInArrow(scores, StructType([*documents.schema.fields, StructField(name, DoubleType())]))


def train_toxicity(documents: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> dict | None:
    return trained(labelled_sample(documents, labels, "toxic", common.remainder(F.col("doc_id"), PART) != HELD_OUT, max_rows), train)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    model = train_toxicity(documents, common.table(spark, sf_dir, "labels"))
    scored = score_toxicity(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return scored.select(
        "doc_id",
        (common.remainder(F.col("doc_id"), PART) == HELD_OUT).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
