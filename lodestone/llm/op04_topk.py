"""Exact top-k search with vector-approximation files.

Every component is floor(64 * x). Candidates and queries are dealt into blocks by a hash of the id; each pair of a
query block and a candidate block is one group of one task. There the candidates are reduced to BITS bits a
dimension; the cells give a lower and an upper bound of every inner product, the k-th largest lower bound of distinct ids drops
what cannot reach the top, and exact vectors are read in the order of their bounds until the k-th result is certain.
The blocks' results are merged by rank. Nothing is approximate; queries are all rows whose id fits the query rule.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an
id; rows that repeat an id and its vector count once; an id with several vectors is several candidates and its
query asks for the best over its vectors' pairs, none with its own id; vectors are compared with vectors of the same length;
ties go to the smaller vec_id. Bounds are sums of whole numbers and exact; components too large for that are compared with Python's
integers; scores beyond 64 bits are cut at their limits. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 20
BITS = 4
SCALE = 64
QUERY_BLOCK, CANDIDATE_BLOCK, TILE = 2048, 8192, 256


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return (
        embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine)
        .select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"))
        .distinct()
    )


class VaFile:
    """Vectors with their cells: mid is twice the middle of each vector's cell, half the width of the cell, in each dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, bits: int = BITS) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids, vectors = ids[order], vectors[order]
        self.first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # where each distinct id begins
        self.most = max(abs(int(vectors.min())), abs(int(vectors.max())))
        least, most = vectors.min(0), vectors.max(0)
        width = np.maximum(1, (most - least) // (1 << bits) + 1)
        low = least + (vectors - least) // width * width
        high = np.minimum(low + width - 1, most)
        self.mid, self.half = low + high, high - low

    def top(self, qid: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query id, ids, scores) of the k best of each query, none of them of the query's own id."""
        # Twice a bound is a sum of integers below `reach`: exact in 32 bits below 2**24, in 64 below 2**53. Beyond, all is compared with whole numbers.
        reach = 4 * (self.most + 1) * (max(abs(int(queries.min())), abs(int(queries.max()))) + 1) * queries.shape[1]
        if reach >= 1 << 53:
            for i, q in enumerate(queries):
                yield qid[i], *self._whole(int(qid[i]), q, k)
            return
        kind = np.float32 if reach < 1 << 24 else np.float64
        mid, half = self.mid.astype(kind), self.half.astype(kind)
        for at in range(0, len(queries), TILE):
            q = queries[at : at + TILE].astype(kind)
            middle, spread = q @ mid.T, np.abs(q) @ half.T
            upper, lower = (middle + spread) / 2, (middle - spread) / 2
            own = qid[at : at + TILE, None] == self.ids[None, :]
            upper[own] = lower[own] = -np.inf
            if len(self.first) < len(self.ids):
                lower = np.maximum.reduceat(lower, self.first, axis=1)
            n = len(self.first) - min(k, len(self.first))
            floor = np.partition(lower, n, axis=1)[:, n]
            for i in range(len(q)):
                yield qid[at + i], *self._certain(queries[at + i], upper[i], floor[i], k)

    def _whole(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for components whose sums floating point can't hold. Scores beyond 64 bits are cut at their limits."""
        best: dict[int, int] = {}
        for i, s in zip(self.ids.tolist(), (self.vectors.astype(object) @ q.astype(object)).tolist(), strict=True):
            if i != own:
                best[i] = max(s, best.get(i, s))
        top = sorted((-max(-(1 << 63), min((1 << 63) - 1, s)), i) for i, s in best.items())[:k]
        return np.array([i for _, i in top], np.int64), np.array([-s for s, _ in top], np.int64)

    def _certain(self, q: np.ndarray, upper: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        left = np.flatnonzero((upper >= floor) & (upper > -np.inf))
        left = left[np.argsort(-upper[left], kind="stable")]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        step = max(64, 2 * k)
        for s in range(0, len(left), step):
            if len(ids) >= k and upper[left[s]] < scores[k - 1]:
                break
            rows = left[s : s + step]
            ids, scores = np.concatenate([ids, self.ids[rows]]), np.concatenate([scores, self.vectors[rows] @ q])
            order = np.lexsort((ids, -scores))
            if len(self.first) < len(self.ids):  # an id counts once, by its best vector
                order = order[np.sort(np.unique(ids[order], return_index=True)[1])]
            order = order[:k]
            ids, scores = ids[order], scores[order]
        return ids, scores


def _vectors(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = t.column("v").combine_chunks()
    n = t.num_rows
    return t.column("vec_id").to_numpy(), v.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of every query. Both frames are (vec_id, v)."""
    n, m = candidates.count(), queries.count()
    c_blocks, q_blocks = max(1, -(-n // CANDIDATE_BLOCK)), max(1, -(-m // QUERY_BLOCK))

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", "v"), F.lit(count))

    def everywhere(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    dims = F.size("v").alias("dims")
    q = queries.select("vec_id", "v", dims, block(q_blocks).alias("qb"), everywhere(c_blocks).alias("cb"))
    c = candidates.select("vec_id", "v", dims, everywhere(q_blocks).alias("qb"), block(c_blocks).alias("cb"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            for query, ids, scores in VaFile(*_vectors(right)).top(*_vectors(left), k):
                out["query_id"] += [query] * len(ids)
                out["vec_id"] += ids.tolist()
                out["score"] += scores.tolist()
        return pa.table({n: pa.array(v, pa.int64()) for n, v in out.items()})

    parts = q.groupBy("dims", "qb", "cb").cogroup(c.groupBy("dims", "qb", "cb")).applyInArrow(search, "query_id long, vec_id long, score long")
    # An id with several vectors (or asked several times) keeps the best score of each pair.
    best = parts.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op4_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(common.table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (SELECT DISTINCT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(CAST(list_dot_product(q.v, c.v) AS BIGINT)) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v) GROUP BY 1, 2),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
