"""Token counts of flat, unindexed token files.

A token file is a run of 16-bit ids in which an end-of-document id closes every document; nothing says where. Files are
read in blocks that cut documents anywhere. Each block is searched for the separator with one vector comparison and
gives the lengths that lie inside it, its open head and its open tail. A prefix scan over the blocks' summaries finds how
much of an open document each block inherits, also over blocks without a separator. The scan has two levels (blocks
in groups of GROUP, then groups), so neither a window nor a task grows with a file.

Defined cases: an empty document has 0 tokens; ids after the last separator of a file are one more document, marked as
not terminated; an empty file has no documents. Of tables: null and empty texts have 0 tokens; null ids and repeated rows are rows as any
other; very long texts run over as many blocks as they need; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .op09_bpe import RANK_FILE, read_ranks

EOD = 50256
BLOCK_TOKENS = 1 << 17
GROUP = 1024
WHOLE_BYTES, LEAST_RECORD = 32 << 20, 4096


def token_blocks(documents: DataFrame, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, eod: int = EOD, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file long, block long, payload binary, doc_ids array<long>): one flat token file for each task, cut into blocks.

    doc_ids are the ids of the documents that the block's separators close, in order; only names, no places.
    """
    held = documents.sparkSession.sparkContext.broadcast((ranks, pattern))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("flat", pat_str=held.value[1], mergeable_ranks=held.value[0], special_tokens={})
        file, block, kept, pending, names = TaskContext.get().partitionId(), 0, 0, [], []

        def row(payload: np.ndarray, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block], pa.int64()), pa.array([payload.astype("<u2").tobytes()], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "payload", "doc_ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                pending.append(np.array([*encoding.encode_ordinary(text.as_py() or ""), eod], np.uint16))
                kept += len(pending[-1])
                names.append((kept, doc_id))
                if kept >= block_tokens:
                    flat = np.concatenate(pending)
                    cut = kept // block_tokens * block_tokens
                    for start in range(0, cut, block_tokens):
                        stop = start + block_tokens
                        yield row(flat[start:stop], [d for end, d in names if start < end <= stop])
                        block += 1
                    pending, kept = [flat[cut:]], kept - cut
                    names = [(end - cut, d) for end, d in names if end > cut]
        if kept:
            yield row(np.concatenate(pending), [d for _, d in names])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(write, "file long, block long, payload binary, doc_ids array<long>")


def read_token_files(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """(file string, block long, payload binary) of flat files of 16-bit ids, read by Spark.

    A file of more than WHOLE_BYTES is read in records whose length is the greatest even divisor of its size that is at most `block_bytes`.
    Smaller ones, and those whose size has no divisor of LEAST_RECORD bytes, are read as a whole, each in one task, and cut into blocks there.
    An odd byte at the end of a file is half an id and is left out. Sizes come from the file listing, so nothing is read twice.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    records = {}
    for name, length in files.select("path", "length").where(F.col("length") > WHOLE_BYTES).collect():
        record = next((r for r in range(min(block_bytes, length) // 2 * 2, LEAST_RECORD - 1, -2) if length % r == 0), None)
        if record:
            records[name] = record
    fields = "file string, block long, payload binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(2, block_bytes // 2 * 2)
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content"), strict=True):
                raw = content.as_buffer()
                for k, start in enumerate(range(0, len(raw) - 1, size)):
                    payload = raw[start : min(start + size, len(raw) // 2 * 2)].to_pybytes()
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()]), pa.array([k], pa.int64()), pa.array([payload], pa.binary())], ["file", "block", "payload"])

    whole = files.where((F.col("length") > 1) & ~F.col("path").isin(list(records))).select("path", "content").mapInArrow(cut, fields)
    if not records:
        return whole

    def read(name: str, record: int):
        conf = {"org.apache.spark.input.FixedLengthBinaryInputFormat.recordLength": str(record)}
        rows = spark.sparkContext.newAPIHadoopFile(name, "org.apache.spark.input.FixedLengthBinaryInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.BytesWritable", conf=conf)
        return rows.map(lambda kv: (name, int(kv[0]), bytes(kv[1])))

    large = spark.sparkContext.union([read(name, record) for name, record in sorted(records.items())])
    return whole.unionByName(spark.createDataFrame(large, fields))


def summaries(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, block, n, ends array<int>): ids in each block, and one past the place of each separator."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.schema.fields if f.name != "payload")
    names = [f.name for f in blocks.schema.fields if f.name != "payload"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ends = [], []
            for payload in batch.column("payload"):
                ids = np.frombuffer(payload.as_buffer(), "<u2")
                n.append(len(ids))
                ends.append((np.flatnonzero(ids == eod) + 1).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], [*names, "n", "ends"])

    return blocks.mapInArrow(scan, f"{fields}, n long, ends array<int>")


def stitched(summary: DataFrame) -> DataFrame:
    """Adds inherited (ids of the open document before the block), ordinal (separators before it) and last (whether it ends the file)."""
    s = summary.withColumn("g", F.floor(F.col("block") / GROUP)).withColumn("n_ends", F.size("ends"))
    before = Window.partitionBy("file", "g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    s = s.withColumn("start", F.coalesce(F.sum("n").over(before), zero)).withColumn("ends_before", F.coalesce(F.sum("n_ends").over(before), zero))
    s = s.withColumn("closed", F.when(F.col("n_ends") > 0, F.col("start") + F.element_at("ends", -1)))
    s = s.withColumn("closed_before", F.max("closed").over(before))
    groups = s.groupBy("file", "g").agg(F.sum("n").alias("gn"), F.sum("n_ends").alias("ge"), F.max("closed").alias("gc"))
    above = Window.partitionBy("file").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("gs", F.coalesce(F.sum("gn").over(above), zero)).withColumn("g_ends", F.coalesce(F.sum("ge").over(above), zero))
    groups = groups.withColumn("g_closed", F.coalesce(F.max(F.col("gs") + F.col("gc")).over(above), zero))
    groups = groups.withColumn("g_last", F.max("g").over(Window.partitionBy("file")) == F.col("g"))
    in_group = Window.partitionBy("file", "g")
    return (
        s.withColumn("b_last", F.max("block").over(in_group) == F.col("block"))
        .join(groups.select("file", "g", "gs", "g_ends", "g_closed", "g_last"), ["file", "g"])
        .withColumn("inherited", F.col("gs") + F.col("start") - F.coalesce(F.col("gs") + F.col("closed_before"), F.col("g_closed")))
        .withColumn("ordinal", F.col("g_ends") + F.col("ends_before"))
        .withColumn("last", F.col("g_last") & F.col("b_last"))
    )


def count_tokens(blocks: DataFrame, eod: int = EOD) -> DataFrame:
    """(file, ordinal, n_tokens, terminated[, doc_id]): one row for each document of each file, separators not counted."""
    s = stitched(summaries(blocks, eod))
    named = "doc_ids" in blocks.columns
    lengths = F.transform("ends", lambda e, i: F.when(i == 0, F.col("inherited") + e - 1).otherwise((e - F.get("ends", i - 1) - 1).cast("long")))
    tail = F.col("n") - F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)) + F.when(F.col("n_ends") == 0, F.col("inherited")).otherwise(0)
    doc = [F.get("doc_ids", F.col("i")).alias("doc_id")] if named else []
    whole = s.select("file", "ordinal", *(["doc_ids"] if named else []), F.posexplode(lengths).alias("i", "n_tokens"))
    whole = whole.select("file", (F.col("ordinal") + F.col("i")).alias("ordinal"), F.col("n_tokens").cast("long"), F.lit(True).alias("terminated"), *doc)
    rest = s.where(F.col("last") & (tail > 0)).select("file", (F.col("ordinal") + F.col("n_ends")).alias("ordinal"), tail.cast("long").alias("n_tokens"), F.lit(False).alias("terminated"), *([F.lit(None).cast("long").alias("doc_id")] if named else []))
    return whole.unionByName(rest)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(RANK_FILE))
    blocks = common.written(token_blocks(common.table(spark, sf_dir, "documents"), ranks), "tokens")
    return count_tokens(blocks).select("doc_id", "n_tokens")
