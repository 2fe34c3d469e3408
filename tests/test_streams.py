"""Streams give what their batch twins give."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from lodestone.streaming import buffers, sync


SECONDS = 90


def run(stream, name, spark, mode="append", rows=None):
    """The stream's output. A state with a processing-time limit never falls idle, so its test says how many rows to wait for."""
    writer = stream.writeStream.outputMode(mode).format("memory").queryName(name)
    q = writer.start() if rows else writer.trigger(availableNow=True).start()
    try:
        if rows:
            end = time.monotonic() + SECONDS
            while spark.table(name).count() < rows and time.monotonic() < end and q.isActive:
                time.sleep(0.5)
        else:
            assert q.awaitTermination(SECONDS)
    finally:
        q.stop()
    return spark.table(name)


def test_answer_buffers(spark, tmp_path):
    rows = [("a", 0, "he", False), ("a", 1, "llo", False), ("a", 2, "llo", False), ("a", 3, "😀", True), ("b", 0, "x", False)]
    chunks = spark.createDataFrame(rows, "guid string, seq int, chunk string, done boolean")
    chunks.coalesce(1).write.parquet(str(tmp_path / "chunks"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks"))
    got = run(buffers.streamed(stream), "buffers_out", spark, "update", rows=2).collect()
    want = buffers.assembled(chunks).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("a", "hello😀", 7, True), ("b", "x", 1, False)]


def test_sessions(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    got = run(buffers.session_totals(stream), "sessions_out", spark)
    want = buffers.session_totals(events)
    assert got.count() > 0 and got.select("user_id", "start", "events").exceptAll(want.select("user_id", "start", "events")).count() == 0


def test_once(spark):
    events = spark.createDataFrame([(1, "2024-01-01"), (1, "2024-01-01"), (2, "2024-01-02")], "event_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert events.isStreaming is False and buffers.once(events).count() == 2


def shown(spark, path, schema, **options):
    return sorted(tuple(r)[:-1] for r in sync.snapshot(spark, path, schema, **options).collect())


def test_periodic_sync(spark, tmp_path):
    schema = "k int, v string, ts int"
    batches = [[(1, "a", 1), (1, "new", 9), (2, "x", 1), (None, "no key", 1)], [(1, "late", 2), (2, "y", 3), (3, "z", None)], [(2, "older", 2), (3, "dated", 1), (4, "w", 4), (4, "w2", 4)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        q = sync.synced(stream, str(tmp_path / "out"), "k", "ts").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(SECONDS), n
        finally:
            q.stop()
    kind = spark.createDataFrame([], schema).schema
    assert shown(spark, str(tmp_path / "out"), kind) == [(1, "new", 9), (2, "y", 3), (3, "dated", 1), (4, "w2", 4)]
    assert shown(spark, str(tmp_path / "out"), kind, before=1) == [(1, "new", 9), (2, "x", 1)]


def test_versions_write_what_changed(spark, tmp_path):
    path = str(tmp_path / "s")
    first = spark.range(200).select(F.col("id").alias("k"), F.lit("a").alias("v"), F.lit(1).alias("ts"))
    sync.merge(first, path, "k", "ts", 0, buckets=8)
    for _ in range(2):  # a version that is written again is the same
        sync.merge(first.where("k = 7").withColumns({"v": F.lit("b"), "ts": F.lit(2)}), path, "k", "ts", 1, buckets=8)
    sync.merge(first.where("k = 9").withColumns({"v": F.lit("late"), "ts": F.lit(0)}), path, "k", "ts", 2, buckets=8)
    held = {v: {r.held for r in sync.manifests(spark, path).where(F.col("version_") == v).collect()} for v in range(3)}
    assert held == {0: {0}, 1: {0, 1}, 2: {0, 1}}
    assert len(list((tmp_path / "s/data/version_=1").glob("bucket_=*"))) == 1 and not (tmp_path / "s/data/version_=2").exists()
    assert shown(spark, path, first.schema) == sorted((k, "b" if k == 7 else "a", 2 if k == 7 else 1) for k in range(200))
    assert sync.trimmed(spark, path, keep=1) == [0] and len(shown(spark, path, first.schema)) == 200
    assert shown(spark, str(tmp_path / "none"), first.schema) == []
