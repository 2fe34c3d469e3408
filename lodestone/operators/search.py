"""Searches of many queries against many points, in blocks that meet in one shuffle.

Queries and points are dealt into blocks by a hash of their ids. A block of queries and a block of points are one group; it gives the best
`k` of each of its queries, and a second step ranks these. The plan is the same for any number of queries, nothing is broadcast, and no task
holds more than one block of each side. Scores are rounded to `digits` before they are ranked; ties go to the smaller doc_id.

- `dense_topk`: cosine of vectors. `multi_topk`: MaxSim of vectors cut into unit parts.
- `sparse_topk`: cosine of term counts. A point's terms stay with the point, so no term is a join key and common words make no hot key. Points are
  dealt by their weightiest term, in the order of its weight, so that a block's points are alike; a block knows the greatest weight of each term
  (its impact). The first round searches the block that a query itself would lie in, which gives a threshold: its k-th best score there.
  In the second round a query skips every block whose bound, the sum over its terms of its weight times the block's impact, is below that.

`best_by`, a column of the points, asks for the k best of each of its values; `boost` gives points marked in a column a factor and a cap.

Defined cases: vectors that are null or hold nulls take no part, vectors meet those of the same length only; a zero vector's cosine is 0; a text without terms has no
scores; a query's own id is no answer; repeated points are candidates each; an empty side gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.sources.tables import written

QUERY_BLOCK, POINT_BLOCK = 1024, 8192
#: Queries of a block that are scored at once, so that a task holds this many rows of scores, not a whole block's.
SCORED = 64
#: Texts whose terms are weighed at once.
WEIGHED = 256
HIT = "qid long, doc_id long, score double, by string"


def _blocks(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def _everywhere(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _dealt(column: str, n: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _kept(qid: np.ndarray, ids: np.ndarray, by: np.ndarray | None, scores: np.ndarray, k: int) -> dict[str, list]:
    """The k best of each row of `scores` (queries by points), for each value of `by`; NaN is no score."""
    out: dict[str, list] = {"qid": [], "doc_id": [], "score": [], "by": []}
    groups = [(None, np.arange(len(ids)))] if by is None else [(v, np.flatnonzero(by == v)) for v in np.unique(by)]
    for i, q in enumerate(qid.tolist()):
        for value, at in groups:
            s = scores[i, at]
            fit = at[(ids[at] != q) & ~np.isnan(s)]
            s = scores[i, fit]
            if len(fit) > k:
                floor = np.partition(s, len(s) - k)[len(s) - k]
                fit, s = fit[s >= floor], s[s >= floor]
            best = fit[np.lexsort((ids[fit], -s))[:k]]
            out["qid"] += [q] * len(best)
            out["doc_id"] += ids[best].tolist()
            out["score"] += scores[i, best].tolist()
            out["by"] += [value] * len(best)
    return out


def _joined(found: list[dict[str, list]]) -> dict[str, list]:
    return {c: [v for f in found for v in f[c]] for c in ("qid", "doc_id", "score", "by")}


def _table(rows: dict[str, list]) -> pa.Table:
    return pa.table({"qid": pa.array(rows["qid"], pa.int64()), "doc_id": pa.array(rows["doc_id"], pa.int64()), "score": pa.array(rows["score"], pa.float64()), "by": pa.array(rows["by"], pa.string())})


def _ranked(hits: DataFrame, k: int, best_by: str | None) -> DataFrame:
    keys = ["qid", "by"] if best_by else ["qid"]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("qid", *([F.col("by").alias(best_by)] if best_by else []), "doc_id", "score", "rank")


def _matrix(t: pa.Table) -> np.ndarray:
    column = t.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(-1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _by(t: pa.Table) -> np.ndarray | None:
    return None if t.column("by").null_count == t.num_rows else np.array([str(v) for v in t.column("by").to_pylist()], object)


def _boosted(scores: np.ndarray, t: pa.Table, boost: tuple[str, float, float] | None) -> np.ndarray:
    if boost:
        hit = t.column("hit").to_numpy(zero_copy_only=False).astype(bool)
        scores[:, hit] = np.minimum(boost[2], scores[:, hit] * boost[1])
    return scores


def _sides(points: DataFrame, queries: DataFrame, best_by: str | None, boost: tuple[str, float, float] | None) -> tuple[DataFrame, DataFrame]:
    sound = lambda v: F.col(v).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())
    v = lambda c: F.col(c).cast("array<double>").alias("v")
    by = (F.coalesce(F.col(best_by).cast("string"), F.lit("")) if best_by else F.lit(None).cast("string")).alias("by")
    hit = (F.coalesce(F.col(boost[0]), F.lit(False)) if boost else F.lit(False)).alias("hit")
    p = points.where(sound("vec")).select(F.col("doc_id").cast("long"), v("vec"), by, hit, F.size("vec").alias("dims"))
    q = queries.where(sound("qvec")).select(F.col("qid").cast("long"), v("qvec"), F.size("qvec").alias("dims"))
    return p, q


def _vector_topk(points: DataFrame, queries: DataFrame, k: int, units: Callable[[np.ndarray], np.ndarray], score: Callable[[np.ndarray, np.ndarray], np.ndarray], digits: int, best_by: str | None, boost: tuple[str, float, float] | None) -> DataFrame:
    p, q = _sides(points, queries, best_by, boost)
    pn, qn = _blocks(p, POINT_BLOCK), _blocks(q, QUERY_BLOCK)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _table({"qid": [], "doc_id": [], "score": [], "by": []})
        qid, ids, by, q, p = left.column("qid").to_numpy(), right.column("doc_id").to_numpy(), _by(right), units(_matrix(left)), units(_matrix(right))
        found = []
        for i in range(0, len(qid), SCORED):
            scores = _boosted(np.round(score(q[i : i + SCORED], p), digits), right, boost)
            found.append(_kept(qid[i : i + SCORED], ids, by, scores, k))
        return _table(_joined(found))

    left = q.withColumns({"qb": _dealt("qid", qn), "pb": _everywhere(pn)})
    right = p.withColumns({"pb": _dealt("doc_id", pn), "qb": _everywhere(qn)})
    hits = left.groupBy("dims", "qb", "pb").cogroup(right.groupBy("dims", "qb", "pb")).applyInArrow(search, HIT)
    return _ranked(hits, k, best_by)


def dense_topk(points: DataFrame, queries: DataFrame, k: int, digits: int = 9, best_by: str | None = None, boost: tuple[str, float, float] | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): the k points (doc_id, vec) of greatest cosine for each query (qid, qvec)."""
    return _vector_topk(points, queries, k, _units, lambda q, p: q @ p.T, digits, best_by, boost)


def multi_topk(points: DataFrame, queries: DataFrame, k: int, parts: int = 4, digits: int = 9) -> DataFrame:
    """The same by MaxSim: each part of the query's vector with its best part of the point's, summed. A length that `parts` doesn't divide has its last components left out."""

    def cut(m: np.ndarray) -> np.ndarray:
        return _units(m[:, : m.shape[1] // parts * parts].reshape(len(m), parts, -1))

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = 0
        for i in range(parts):
            best = a[:, i] @ b[:, 0].T
            for j in range(1, parts):
                np.maximum(best, a[:, i] @ b[:, j].T, out=best)
            total = total + best
        return total

    return _vector_topk(points, queries, k, cut, score, digits, None, None)


def weighted_terms(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, terms, weights): a text's distinct terms in order, and their counts over the norm of all counts. Texts without terms are left out."""
    each = docs.select(F.col(key).cast("long").alias(key), text.term_counts(F.col(column)).alias("words")).where(F.size("words") > 0)
    schema = f"{key} long, terms array<string>, weights array<double>"

    def weigh(batches):
        for batch in batches:
            for first in range(0, batch.num_rows, WEIGHED):
                part, terms, weights = batch.slice(first, WEIGHED), [], []
                for words in part.column("words"):
                    names, n = np.unique(np.array(words.as_py(), object), return_counts=True)
                    terms.append(pa.array(names, pa.string()))
                    weights.append(n / np.sqrt((n * n).sum()))
                ends = pa.array(np.cumsum([0, *map(len, weights)]), pa.int32())
                columns = [pa.ListArray.from_arrays(ends, pa.concat_arrays(terms)), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(weights)))]
                yield pa.RecordBatch.from_arrays([part.column(key), *columns], [key, "terms", "weights"])

    return each.mapInArrow(weigh, schema)


#: Queries of a block in a sparse search; their terms are the vocabulary that the points of a block are read by.
SPARSE_QUERIES = 256


class _Weights:
    """Rows of (terms, weights) over a vocabulary: row numbers, term numbers and weights of the entries that the vocabulary has."""

    def __init__(self, t: pa.Table, vocabulary: pa.Array) -> None:
        terms, weights = t.column("terms").combine_chunks(), t.column("weights").combine_chunks()
        sizes = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
        at = pc.index_in(terms.flatten(), value_set=vocabulary)
        has = at.is_valid().to_numpy(zero_copy_only=False)
        self.rows = np.repeat(np.arange(t.num_rows), sizes)[has]
        self.terms = at.drop_null().to_numpy()
        self.weights = weights.flatten().to_numpy(zero_copy_only=False)[has]


def _sparse_parts(asked: pa.Table, given: pa.Table, least: np.ndarray, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of queries, and their scores by points; NaN where they share no term. Queries whose bound for the block is below `least` are left out."""
    vocabulary = pc.unique(asked.column("terms").combine_chunks().flatten())
    q, p = _Weights(asked, vocabulary), _Weights(given, vocabulary)
    m, n = asked.num_rows, given.num_rows
    impact = np.zeros(len(vocabulary))
    np.maximum.at(impact, p.terms, p.weights)
    bound = np.bincount(q.rows, q.weights * impact[q.terms], m)
    active = np.flatnonzero(bound + 10.0**-digits >= least)
    starts, ends = np.searchsorted(q.rows, np.arange(m + 1)), np.searchsorted(p.rows, np.arange(n + 1))
    points = np.flatnonzero(np.diff(ends)).tolist()
    for i in range(0, len(active), SCORED):
        rows = active[i : i + SCORED]
        own, found = np.zeros((len(vocabulary), len(rows))), np.zeros((n, len(rows)))
        for j, row in enumerate(rows.tolist()):
            entries = slice(starts[row], starts[row + 1])
            own[q.terms[entries], j] = q.weights[entries]
        for j in points:
            entries = slice(ends[j], ends[j + 1])
            found[j] = p.weights[entries] @ own[p.terms[entries]]
        yield rows, np.where(found > 0, np.round(found, digits), np.nan).T


def _sparse_scores(asked: pa.Table, given: pa.Table, least: np.ndarray, digits: int) -> np.ndarray:
    """Scores of queries by points, of all parts in one; NaN for queries that are left out."""
    scores = np.full((asked.num_rows, given.num_rows), np.nan)
    for rows, part in _sparse_parts(asked, given, least, digits):
        scores[rows] = part
    return scores


def _sparse_best(asked: pa.Table, given: pa.Table, least: np.ndarray, digits: int, k: int) -> dict[str, list]:
    """The k best points of each query, of those that reach its `least`."""
    qid, ids, best = asked.column("id").to_numpy(), given.column("id").to_numpy(), []
    for rows, scores in _sparse_parts(asked, given, least, digits):
        scores[scores < least[rows, None]] = np.nan
        best.append(_kept(qid[rows], ids, None, scores, k))
    return _joined(best)


def sparse_topk(points: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(qid, doc_id, score, rank): the k points (doc_id, text) of greatest cosine of term counts for each query (qid, qtext)."""
    p = weighted_terms(points, "doc_id").select(F.col("doc_id").alias("id"), F.lit(False).alias("asks"), "terms", "weights")
    q = weighted_terms(queries, "qid", "qtext").select(F.col("qid").alias("id"), F.lit(True).alias("asks"), "terms", "weights")
    top = F.array_max(F.zip_with("weights", F.sequence(F.lit(1), F.size("weights")), lambda w, i: F.struct(w.alias("w"), (-i).alias("i"))))
    both = p.unionByName(q).select("*", F.get("terms", -1 - top["i"]).alias("lead"), top["w"].alias("lead_weight"))
    # Queries lie among the points that are like them, so the block that a query falls into gives its first threshold.
    blocks = _blocks(points, POINT_BLOCK)
    placed = both.repartitionByRange(blocks, "lead", F.desc("lead_weight"), "id").withColumn("block", F.spark_partition_id())
    placed = written(placed.select("id", "asks", "terms", "weights", "block"), "sparse")
    asked, given = placed.where("asks"), placed.where("NOT asks")

    def home(t: pa.Table) -> pa.Table:
        asks = t.column("asks")
        left, right = t.filter(asks), t.filter(pc.invert(asks))
        parts = [left.slice(i, SPARSE_QUERIES) for i in range(0, left.num_rows, SPARSE_QUERIES)] if right.num_rows else []
        return _table(_joined([_sparse_best(x, right, np.full(x.num_rows, -np.inf), digits, k) for x in parts]))

    first = written(placed.groupBy("block").applyInArrow(home, HIT), "first")
    if blocks == 1:
        return _ranked(first, k, None)
    least = first.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("least"))
    qn = _blocks(asked, SPARSE_QUERIES)
    left = asked.join(least, F.col("id") == F.col("qid"), "left").select("id", "terms", "weights", F.col("block").alias("home"), "least", _dealt("id", qn).alias("qb"), _everywhere(blocks).alias("pb")).where("pb <> home")
    # Both sides come from one table; new names tell their columns apart.
    right = given.select(*(F.col(c).alias(c) for c in ("id", "terms", "weights")), F.col("block").alias("pb"), _everywhere(qn).alias("qb"))

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return _table({"qid": [], "doc_id": [], "score": [], "by": []})
        return _table(_sparse_best(a, b, a.column("least").fill_null(-np.inf).to_numpy(), digits, k))

    rest = left.groupBy("qb", "pb").cogroup(right.groupBy("qb", "pb")).applyInArrow(search, HIT)
    return _ranked(first.unionByName(rest), k, None)
