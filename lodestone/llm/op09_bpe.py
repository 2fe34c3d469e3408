"""Byte-level BPE encoding and decoding.

1. Texts are split into pieces by the vocabulary's pattern. A block is a row of about BLOCK_BYTES of texts: its distinct pieces
   once, and every text as places among them. Blocks are written to the shared folder.
2. Pieces are dealt by their hash, so equal ones of all blocks meet and are folded once: Spark's higher-order functions fold the
   ranked merges over the byte array of each piece. The rank map is a literal: an array of 2**16 small maps, addressed by the crc32 of
   the bytes, so a look-up reads a few entries.
3. Ids go back to their blocks, packed by block. Each text's ids are its pieces' ids in order; decoding concatenates the binary
   pieces of the ids.

What a task holds is bounded by a block, or by TASK_PIECES, not by its split or the vocabulary of the corpus: a piece has one row of a
few bytes in each block that holds it, so no piece is hot. Only the public vocabulary, of fixed size, is broadcast. A piece of more than LONG bytes is merged with a
heap instead of a fold (same ranks, same result), as a fold over n bytes takes n * n steps.

Defined cases: null and empty texts have no ids and decode to no bytes; null ids and repeated rows are rows as any other;
a very long text is a block of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 24 << 20
BUCKETS = 1 << 16
LONG = 512
NONE = (1 << 31) - 1
#: Pieces (of all blocks, equal ones counted again) of a task that folds; it reads the literal once.
TASK_PIECES = 1 << 18
BLOCK = "block long, doc_ids array<long>, sizes array<int>, stream binary, pieces array<binary>"


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a public vocabulary, by the bytes of each token. Read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The rank map as array<map<binary, int>>, addressed by crc32 modulo BUCKETS."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for token, rank in ranks.items():
        buckets[zlib.crc32(token) % BUCKETS][token.hex()] = rank
    parsed = F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")
    return F.transform(parsed, lambda m: F.transform_keys(m, lambda k, v: F.unhex(k)))


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def rank_of(table: Column, token: Column) -> Column:
    """The token's rank, null if it has none."""
    return F.try_element_at(table[F.crc32(token).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")], token)


def merged(table: Column, piece: Column) -> Column:
    """Ids of one piece: its own rank, or its parts after merging the pair of least rank again and again.

    The state of the fold is the borders between parts, each as rank of what it divides * 2**16 + place; a merge drops the least
    border, which is the first of equal rank, and ranks its two neighbours anew.
    """
    size, shift = F.octet_length(piece), F.lit(1 << 16).cast("long")

    def divided(low: Column, high: Column) -> Column:
        return F.coalesce(rank_of(table, F.substring(piece, low + 1, high - low)), F.lit(NONE))

    def place(border: Column) -> Column:
        return border.bitwiseAND(F.lit((1 << 16) - 1).cast("long")).cast("int")

    def ranked(borders: Column, at: Column, i: Column) -> Column:
        low, high = F.coalesce(place(F.get(borders, i - 1)), F.lit(0)), F.coalesce(place(F.get(borders, i + 1)), size)
        return divided(low, high) * shift + at

    def without(borders: Column, gone: Column) -> Column:
        k = F.array_position(borders, gone).cast("int")
        left = F.filter(borders, lambda b: b != gone)
        return bound(k, lambda at: bound(left, lambda s: F.transform(s, lambda b, i: F.when((i == at - 1) | (i == at - 2), ranked(s, place(b), i)).otherwise(b))))

    def step(borders: Column, _: Column) -> Column:
        return bound(F.array_min(borders), lambda least: F.when(least < F.lit(NONE << 16), without(borders, least)).otherwise(borders))

    first = F.transform(F.sequence(F.lit(1), size - 1), lambda i: divided(i - 1, i + 1) * shift + i)
    ends = F.aggregate(F.sequence(F.lit(2), size), first, step, lambda b: F.array_append(F.transform(b, place), size))
    parts = bound(ends, lambda e: F.transform(e, lambda end, i: divided(F.coalesce(F.get(e, i - 1), F.lit(0)), end)))
    return bound(rank_of(table, piece), lambda whole: F.when(whole.isNotNull() | (size < 2), F.array(whole)).otherwise(parts))


def merge_long(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The same merges in n log n steps: a heap of (rank, place) over a linked list of parts."""
    n = len(piece)
    ends, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

    def pair(i: int) -> tuple[int, int, int] | None:
        j = ends[i]
        if j >= n:
            return None
        rank = ranks.get(piece[i : ends[j]])
        return None if rank is None else (rank, i, ends[j])

    heap = [x for i in range(n) if (x := pair(i))]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        if not live[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        gone = ends[i]
        live[gone] = False
        ends[i] = end
        if end < n:
            before[end] = i
        for k in (i, before[i]):
            if k >= 0 and (x := pair(k)):
                heapq.heappush(heap, x)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : ends[i]]])
        i = ends[i]
    return out


def split_blocks(pattern: str, block_bytes: int = BLOCK_BYTES):
    """Batches of (doc_id, text) -> blocks of texts: their distinct pieces, the most frequent first, and streams of places among them."""

    def row(block: int, doc_ids: list, sizes: list[int], stream: list[np.ndarray], place: dict[str, int]) -> pa.RecordBatch:
        places = np.concatenate(stream)
        often = np.argsort(-np.bincount(places, minlength=len(place)), kind="stable")
        rank = np.empty(len(often), np.int32)
        rank[often] = np.arange(len(often))
        pieces = [p.encode() for p in place]
        columns = [
            pa.array([block], pa.int64()),
            pa.array([doc_ids], pa.list_(pa.int64())),
            pa.array([sizes], pa.list_(pa.int32())),
            pa.array([shrunk(rank[places])], pa.binary()),
            pa.array([[pieces[k] for k in often]], pa.list_(pa.binary())),
        ]
        return pa.RecordBatch.from_arrays(columns, ["block", "doc_ids", "sizes", "stream", "pieces"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find, block = regex.compile(pattern).findall, TaskContext.get().partitionId() << 32
        doc_ids, sizes, stream, place, held = [], [], [], _places(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                pieces = find(text.as_py() or "")
                doc_ids.append(doc_id)
                sizes.append(len(pieces))
                stream.append(np.fromiter(map(place.__getitem__, pieces), np.int32, len(pieces)))
                held += len(text.as_buffer()) if text.is_valid else 0
                if held >= block_bytes:
                    yield row(block, doc_ids, sizes, stream, place)
                    doc_ids, sizes, stream, place, held = [], [], [], _places(), 0
                    block += 1
        if doc_ids:
            yield row(block, doc_ids, sizes, stream, place)

    return split


def _places() -> dict[str, int]:
    place: dict[str, int] = defaultdict()
    place.default_factory = place.__len__
    return place


def shrunk(places: np.ndarray) -> bytes:
    """Places as four planes of bytes, low ones first, compressed; `grown` reverses it."""
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(places.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), asbytes=True)


def grown(packed_places: pa.Buffer, count: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(packed_places, 4 * count, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


CODEC = "zstd"


def shut(values: np.ndarray) -> bytes:
    return pa.Codec(CODEC, 1).compress(np.ascontiguousarray(values).tobytes(), asbytes=True)


def opened(packed_values: pa.Buffer, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.Codec(CODEC, 1).decompress(packed_values, count * np.dtype(kind).itemsize, asbytes=True), kind)


def gathered(ranks: dict[bytes, int]):
    """Rows (block, place, piece) of a task -> one row: its distinct pieces, the ids of those too long for a fold, and where each stands."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, at = _places(), [[], [], []]
        for batch in batches:
            pieces = batch.column("piece").to_pylist()
            at[0].append(np.fromiter(map(number.__getitem__, pieces), np.int32, len(pieces)))
            at[1].append(batch.column("block").to_numpy())
            at[2].append(batch.column("place").to_numpy())
        if number:
            ready = [merge_long(ranks, p) if len(p) > LONG else None for p in number]
            where = [pa.array([np.concatenate(a).tobytes()], pa.binary()) for a in at]
            yield pa.RecordBatch.from_arrays([pa.array([list(number)], pa.list_(pa.binary())), pa.array([ready], pa.list_(pa.list_(pa.int32()))), *where], ["pieces", "ready", "number", "blocks", "places"])

    return gather


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The ids of a task's pieces, packed for each block that holds any of them: places, numbers of ids, ids."""
    for batch in batches:
        for k in range(batch.num_rows):
            codes = batch.column("ids")[k].values
            ends = codes.offsets.to_numpy() - codes.offsets[0].as_py()
            flat = codes.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            number, block, place = (np.frombuffer(batch.column(c)[k].as_buffer(), t) for c, t in (("number", "<i4"), ("blocks", "<i8"), ("places", "<i4")))
            order = np.lexsort((place, block))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(block[order]) != 0, [True]]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = order[a:b]
                n = np.diff(ends)[number[rows]].astype("<i4")
                ids = flat[_gather(ends[:-1][number[rows]].astype(np.int64), n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block[rows[0]])], pa.int64()), pa.array([b - a], pa.int64()), pa.array([len(ids)], pa.int64()), *(pa.array([shut(x)], pa.binary()) for x in (place[rows], n, ids))],
                    ["of", "pieces", "total", "places", "sizes", "ids"],
                )


class Tokens:
    """The binary pieces of the vocabulary, by rank."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.size = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids' binary pieces one after another, and each one's length."""
        n = self.size[ids]
        return self.bytes[_gather(self.at[ids], n)], n


def _gather(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """at[0] .. at[0] + n[0] - 1, at[1] .. and so on."""
    return np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def joined_texts(block: pa.Table, codes: pa.Table, tokens: Tokens, step: int = 256) -> Iterator[pa.RecordBatch]:
    """The texts of one block, each put together from the codes of its pieces, `step` texts at a time."""
    parts = [(int(x["pieces"]), int(x["total"]), x["places"], x["sizes"], x["ids"]) for x in codes.select(["pieces", "total", "places", "sizes", "ids"]).to_pylist()]
    read = lambda which, count, kind: np.concatenate([np.zeros(0, kind), *(opened(pa.py_buffer(x[which]), x[count], kind) for x in parts)])
    place, size, flat = read(2, 0, "<i4"), read(3, 0, "<i4").astype(np.int64), read(4, 1, "<i4")
    order = np.argsort(place)
    at, n = (np.cumsum(size) - size)[order], size[order]
    row = block.slice(0, 1).combine_chunks()
    doc_ids, sizes = row.column("doc_ids").chunk(0).flatten(), row.column("sizes").chunk(0).flatten().to_numpy()
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    stream = grown(row.column("stream")[0].as_buffer(), int(ends[-1]))
    for first in range(0, len(sizes), step):
        cut = ends[first : first + step + 1]
        places = stream[cut[0] : cut[-1]]
        count = n[places]
        ids = flat[_gather(at[places], count)].astype(np.int32)
        data, size = tokens.decode(ids)
        id_ends = np.concatenate([[0], np.cumsum(count)])[cut - cut[0]]
        byte_ends = np.concatenate([[0], np.cumsum(size)])[id_ends]
        decoded = pa.Array.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(byte_ends.astype(np.int32)), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays([doc_ids.slice(first, len(cut) - 1), pa.ListArray.from_arrays(pa.array(id_ends.astype(np.int32)), pa.array(ids)), decoded], ["doc_id", "ids", "decoded"])


def encode(documents: DataFrame, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary): the ids of every whole text, and the bytes they decode to."""
    context = documents.sparkSession.sparkContext
    texts = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    blocks = common.written(texts.mapInArrow(split_blocks(pattern, block_bytes), BLOCK), "pieces", CODEC)
    each = blocks.select("block", F.posexplode("pieces").alias("place", "piece"))
    most = blocks.agg(F.sum(F.size("pieces"))).first()[0] or 0
    tasks = max(1, min(2 * context.defaultParallelism, most // (TASK_PIECES // 32)), most // TASK_PIECES)
    rows = each.repartition(tasks, "piece").mapInArrow(gathered(ranks), "pieces array<binary>, ready array<array<int>>, number binary, blocks binary, places binary")
    ids = bound(rank_literal(ranks), lambda t: F.zip_with("pieces", "ready", lambda p, r: F.coalesce(r, merged(t, p))))
    # Written before it goes on, so that no stage needs two Python workers for a task.
    codes = common.written(rows.select(ids.alias("ids"), "number", "blocks", "places"), "codes", CODEC)
    found = codes.mapInArrow(by_block, "of long, pieces long, total long, places binary, sizes binary, ids binary")
    streams = common.written(blocks.select("block", "doc_ids", "sizes", "stream"), "streams")
    common.discard(blocks)
    held = context.broadcast(ranks)  # one vocabulary, fixed in size

    def gather(block: pa.Table, codes: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(joined_texts(block, codes, tokens_of(held))))

    return streams.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(gather, "doc_id long, ids array<int>, decoded binary")


_tokens: list[tuple[dict, Tokens]] = []


def tokens_of(held) -> Tokens:
    """The vocabulary of a worker, laid out once for all its blocks."""
    if not _tokens or _tokens[0][0] is not held.value:
        _tokens[:] = [(held.value, Tokens(held.value))]
    return _tokens[0][1]


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = read_ranks(public_tokenizers.path(RANK_FILE))
    return encode(common.table(spark, sf_dir, "documents"), ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
