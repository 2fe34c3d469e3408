"""Bounded samples of labelled texts, and the one training task that reads them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODEL_SCHEMA = "bias double, terms binary, weights binary, factors binary"


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int) -> DataFrame:
    """At most `max_rows` pairs (text, y) of rows of `labels` for which `learn` (of column doc_id) holds.

    The sample is the same for equal tables: ids in the order of a hash. Labels that are neither 0 nor 1, and ids
    with contradicting labels, are left out; of rows that repeat an id or a text one stays.
    """
    marked = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & learn)
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most"))
        .where("y = most").select("doc_id", "y")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    # At most max_rows ids of 8 bytes: a broadcast whose size does not depend on the tables.
    return (
        documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(marked), "doc_id")
        .groupBy(F.xxhash64("text").alias("h"))
        .agg(F.min_by(F.struct("text", "y"), "doc_id").alias("kept"))
        .select("h", "kept.text", "kept.y")
    )


def trained(sample: DataFrame, train) -> dict | None:
    """Runs `train` (batches of text, y -> one model batch) in one task over the bounded sample, in a fixed order."""
    row = sample.repartition(1).sortWithinPartitions("h").select("text", "y").mapInArrow(train, MODEL_SCHEMA).first()
    return row.asDict() if row else None
