"""Suffix-array dedup: bytes covered by a LENGTH-byte string that also starts anywhere else are removed.

Suffixes are sampled: of every LENGTH-byte window, the suffix at its least K-byte gram (by hash, leftmost on a tie) is
kept, so equal windows keep equal suffixes at equal places. Consecutive windows with one suffix are a segment: the
suffix's first K bytes, the signature of the whole segment, its place and its number of windows. About one byte in 90 starts a segment.

The index is a logarithmic family of levels. A level is a suffix array in shards: a suffix's shard follows from its first K bytes, and
within a shard suffixes stand in the order of their bytes (K bytes as longs that sort as the bytes do, then the signature). Shards are
buckets of a table, so levels are scanned and merged side by side without a shuffle. A new batch gets its array (counts are
combined before the shuffle), is merge-scanned against every level for suffixes that agree in their first K bytes, and becomes
a level; levels of equal size merge before the next batch. What the scans find are candidates for long matches:
- suffixes with one signature twice: all windows of their segments are repeated;
- suffixes with several signatures: the segments' bytes are read once, and a suffix array over their windows,
  cut at LENGTH bytes, is sorted; equal neighbours are repeated. Where more than HEAVY signatures agree in K bytes, windows are not sorted
  in one task: they are dealt by their own hashes and counted.
Every occurrence of a repeated window is then marked in its text, those of earlier batches too.

The levels are tables of the session's catalogue, so the warehouse must be shared by the driver and the executors, as on any cluster.

Defined cases: a null text is empty; texts under LENGTH bytes have no windows; very long texts are scanned whole; rows that repeat an id and its
text are documents of their own, so they repeat each other; null ids are ids; an empty table gives no rows; other columns are ignored. Signatures are
64-bit hashes that must agree along with equal leading bytes; windows of differing signatures are compared byte by byte (heavy ones: by 128 bits).
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, hashing

LENGTH = 200
K = 24
BATCHES = 4
HEAVY = 32768
GROUP_ROWS = 1024
SORTED_WINDOWS = 1 << 17
SECOND_BASE = 0xC2B2AE3D27D4EB4F | 1
KEY = ["k1", "k2", "k3"]
KEYS = "k1 long, k2 long, k3 long"
ENTRY = f"{KEYS}, sig long, doc long, h long, start int, n int, copies long"


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of every run of `width` values, by doubling."""
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def leading(data: np.ndarray, at: np.ndarray, k: int = K) -> np.ndarray:
    """The first k bytes of the suffixes at `at`, as k / 8 rows of longs in the order of the bytes."""
    words = np.ascontiguousarray(data[at[:, None] + np.arange(k)]).view(">u8").astype(np.uint64)
    return (words ^ np.uint64(1 << 63)).view(np.int64).T


def segments(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(k1, k2, k3, sig, start, n) of the segments of a chunk of texts; starts are places in the chunk."""
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(k // 8 + 3))
    sums = hashing.prefix_sums(data)
    grams = hashing.mix((sums[k:] - sums[:-k]) * hashing.powers(hashing.INVERSE, len(sums))[: len(sums) - k])
    high = np.uint64(0xFFFFFFFF00000000)
    least = sliding_min((grams & high) | np.arange(len(grams), dtype=np.uint64), length - k + 1)
    anchor = (least & ~high).astype(np.int64)
    text_end = np.repeat(offsets[1:], np.diff(offsets))[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= text_end
    cut = np.ones(len(anchor), bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]) | (text_end[1:] != text_end[:-1])
    cuts = np.flatnonzero(cut)
    kept = whole[cuts]
    starts, ends = cuts[kept], np.append(cuts[1:], len(anchor))[kept]
    return *leading(data, anchor[starts], k), hashing.span_hashes(sums, starts, ends + length - 1).view(np.int64), starts, ends - starts


def _rows(batches: Iterator[pa.RecordBatch], combined: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = common.text_buffer(batch.column("text"))
        doc, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "h"))
        found = []
        for first, _, part, at in common.chunks(data, offsets):
            *key, sig, start, n = segments(part, at)
            text = hashing.text_of(start, at)
            found.append((*key, sig, doc[first + text], h[first + text], (start - at[text]).astype(np.int32), n.astype(np.int32)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)]
        copies = np.ones(len(columns[0]), np.int64)
        if combined and len(copies):
            order = np.lexsort(columns[3::-1])
            new = np.any([c[order[1:]] != c[order[:-1]] for c in columns[:4]], axis=0)
            heads = np.flatnonzero(np.append(True, new))
            copies = np.diff(np.append(heads, len(order)))
            columns = [c[order[heads]] for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*columns, copies)], [*KEY, "sig", "doc", "h", "start", "n", "copies"])


def combined_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(batches, True)


def single_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _rows(batches, False)


def sources(documents: DataFrame) -> DataFrame:
    """(doc, h, text): null ids take the least long; h tells rows that repeat an id apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


class LevelIndex:
    """The logarithmic family: levels of doubling size, each a bucketed table of sorted entries."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.levels = spark, []
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _store(self, entries: DataFrame, size: int) -> tuple[int, str]:
        name = f"lodestone_level_{uuid.uuid4().hex}"
        with common.shuffles_dropped(self.spark):
            entries.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY, "sig").saveAsTable(name)
        return size, name

    def _merge(self) -> None:
        """Equal-sized neighbours become one level: their buckets are written together, without a shuffle."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (n, a), (m, b) = self.levels.pop(), self.levels.pop()
            self.levels.append(self._store(self.spark.table(a).unionByName(self.spark.table(b)), n + m))
            for name in (a, b):
                self.spark.sql(f"DROP TABLE {name}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Indexes a batch (doc, h, text); returns the entries, new and old, whose first K bytes now occur more than once."""
        self._merge()
        entries = (
            batch.mapInArrow(combined_rows, ENTRY)
            .repartition(self.buckets, *KEY)
            .groupBy(*KEY, "sig")
            .agg(F.min(F.struct("doc", "h", "start")).alias("at"), F.first("n").alias("n"), F.sum("copies").alias("copies"))
            .select(*KEY, "sig", "at.doc", "at.h", "at.start", "n", "copies")
        )
        size, name = self._store(entries, 1)
        new = self.spark.table(name)
        repeated = new.groupBy(*KEY).agg(F.sum("copies").alias("c")).where("c > 1").select(*KEY)
        found = new.join(repeated, KEY, "left_semi")
        for _, level in self.levels:
            old = self.spark.table(level)
            found = found.unionByName(new.join(old, KEY, "left_semi")).unionByName(old.join(new, KEY, "left_semi"))
        self.levels.append((size, name))
        return common.written(found, "matches")

    def drop(self) -> None:
        for _, name in self.levels:
            with contextlib.suppress(Exception):
                self.spark.sql(f"DROP TABLE {name}")
        self.levels = []


def runs_of(flags: np.ndarray, segment: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive flagged windows of a segment: (segment, first window, windows)."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    head = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (segment[at[1:]] != segment[at[:-1]])])
    first = np.flatnonzero(head)
    return segment[at[first]], offset[at[first]], np.diff(np.append(first, len(at)))


def _windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    segment = np.repeat(np.arange(len(n)), n)
    return segment, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def repeated_windows(t: pa.Table) -> pa.Table:
    """Suffix arrays over those windows of a group's segments whose hash repeats, cut at LENGTH bytes; equal neighbours are repeated."""
    data, begin = common.text_buffer(t.column("bytes"))
    data = data + np.uint8(1)  # UTF-8 has no byte 255: no zero bytes, which numpy's strings would drop
    n = t.column("n").to_numpy().astype(np.int64)
    segment, offset = _windows(n)
    starts = begin[segment] + offset
    hashes = hashing.span_hashes(hashing.prefix_sums(data), starts, starts + LENGTH)
    order = np.argsort(hashes, kind="stable")
    twice = np.flatnonzero(hashes[order[1:]] == hashes[order[:-1]])
    maybe = np.unique(np.concatenate([order[twice], order[twice + 1]]))
    passes = max(1, -(-len(maybe) // SORTED_WINDOWS))
    view = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    flags = np.zeros(len(starts), bool)
    for k in range(passes):  # equal windows meet in one pass
        part = maybe[hashes[maybe] % np.uint64(passes) == k]
        suffix = np.ascontiguousarray(view[starts[part]]).view(f"S{LENGTH}").ravel()
        order = np.argsort(suffix, kind="stable")
        same = suffix[order[1:]] == suffix[order[:-1]]
        flags[part[order[1:][same]]] = flags[part[order[:-1][same]]] = True
    s, first, count = runs_of(flags, segment, offset)
    return pa.table({**{k: t.column(k).to_numpy()[s] for k in KEY}, "sig": t.column("sig").to_numpy()[s], "first": first.astype(np.int32), "count": count.astype(np.int32)})


def window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, begin = common.text_buffer(batch.column("bytes"))
        for first, end, part, at in common.chunks(data, begin, 1 << 18):
            n = np.diff(at) - LENGTH + 1
            segment, offset = _windows(n)
            starts = at[segment] + offset
            a, b = (hashing.span_hashes(hashing.prefix_sums(part, base), starts, starts + LENGTH, base) for base in (hashing.BASE, SECOND_BASE))
            names = (batch.column(c).to_numpy()[first:end][segment] for c in (*KEY, "sig"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), b.view(np.int64), *names, offset.astype(np.int32))], ["a", "b", *KEY, "sig", "off"])


def partial_runs(segs: DataFrame) -> DataFrame:
    """(k1, k2, k3, sig, first, count): runs of repeated windows in segments (k1, k2, k3, sig, n, sigs, bytes) that agree in K bytes."""
    groups = F.pmod(F.xxhash64(*KEY), F.lit(max(64, segs.count() // GROUP_ROWS))).alias("g")
    light = segs.where(F.col("sigs") <= HEAVY).select(groups, *KEY, "sig", "n", "bytes")
    found = light.groupBy("g").applyInArrow(repeated_windows, f"{KEYS}, sig long, first int, count int")
    windows = segs.where(F.col("sigs") > HEAVY).select(*KEY, "sig", "bytes").repartition(*KEY, "sig").mapInArrow(window_hashes, f"a long, b long, {KEYS}, sig long, off int")
    # A window of a segment is seen once in it, so two rows of one hash are two places.
    twice = windows.groupBy("a", "b").agg(F.min(F.struct("sig", "off")).alias("x"), F.max(F.struct("sig", "off")).alias("y")).where("x != y").select("a", "b")
    heavy = windows.join(twice, ["a", "b"], "left_semi").select(*KEY, "sig", F.col("off").alias("first"), F.lit(1).alias("count"))
    return found.unionByName(heavy)


def repeats(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc, h, spans array<struct<a int, b int>>): byte spans of every text's repeated windows, unmerged."""
    spark, source = documents.sparkSession, sources(documents)
    index, logs = LevelIndex(spark), []
    try:
        for b in range(batches):
            logs.append(index.add(source.where(F.pmod(F.xxhash64("doc", "h"), F.lit(batches)) == b)))
    finally:
        index.drop()
    log = logs[0]
    for other in logs[1:]:
        log = log.unionByName(other)
    at = F.struct("doc", "h", "start")
    entries = common.written(
        log.groupBy(*KEY, "sig")
        .agg(F.min(at).alias("at"), F.max(at).alias("other"), F.first("n").alias("n"), F.max("copies").alias("copies"))
        .select(*KEY, "sig", "at.doc", "at.h", "at.start", "n", ((F.col("copies") > 1) | (F.col("at") != F.col("other"))).alias("whole")),
        "entries",
    )
    common.discard(*logs)
    shared = entries.groupBy(*KEY).agg(F.count(F.lit(1)).alias("sigs")).where("sigs > 1")
    several = entries.join(shared, KEY).select(*KEY, "sig", "doc", "h", "start", "n", "sigs")
    cut = F.substring(F.col("text").cast("binary"), F.col("start") + 1, F.col("n") + LENGTH - 1).alias("bytes")
    segs = several.join(source, ["doc", "h"]).select(*KEY, "sig", "n", "sigs", cut).dropDuplicates([*KEY, "sig"])
    segs = common.written(segs, "segments")
    partial = partial_runs(segs)
    runs = partial.unionByName(entries.where("whole").select(*KEY, "sig", F.lit(0).alias("first"), F.col("n").alias("count")))
    key = F.xxhash64(*KEY).alias("key")  # with the signature 128 bits; the shuffle of all occurrences carries no more
    found = source.mapInArrow(single_rows, ENTRY).select(key, "sig", "doc", "h", "start").join(runs.select(key, "sig", "first", "count"), ["key", "sig"])
    begin = F.col("start") + F.col("first")
    return found.groupBy("doc", "h").agg(F.collect_set(F.struct(begin.alias("a"), (begin + F.col("count") + LENGTH - 1).alias("b"))).alias("spans"))


def removals(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, removed array<struct<a, b>>) for every row of `documents`."""
    spans = repeats(documents, batches)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                pairs = sorted((s["a"], s["b"]) for s in found.as_py() or ())
                merged: list[list[int]] = []
                for a, b in pairs:
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                kept, last = [], 0
                for a, b in merged:
                    kept.append(raw[last:a])
                    last = b
                kept.append(raw[last:])
                for column, value in zip(out, (len(raw), sum(b - a for a, b in merged), len(merged), b"".join(kept), merged), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.binary()), pa.array([[{"a": a, "b": b} for a, b in m] for m in out[4]], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
                ["doc", "n_bytes", "n_removed", "n_spans", "kept", "removed"],
            )

    joined = sources(documents).join(spans, ["doc", "h"], "left").select("doc", "text", "spans")
    out = joined.mapInArrow(cut, "doc long, n_bytes long, n_removed long, n_spans long, kept binary, removed array<struct<a:int,b:int>>")
    return out.withColumn("doc_id", F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc"))).drop("doc")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = removals(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int, str]]:
    """The contract's answer for a small list of texts, by counting every window; for tests."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p : p + length]] = seen.get(t[p : p + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(t, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(t), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out
