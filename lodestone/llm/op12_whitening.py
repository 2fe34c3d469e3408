r"""Embedding whitening by a one-sided Jacobi SVD of a tall and skinny QR.

Every component c becomes the whole number floor(SCALE * c). The fit list holds each distinct vector once; its count and
sums are exact. Blocks of centred rows are reduced to an upper triangle R each (Householder QR), triangles are stacked
and reduced again, FAN at a time, until one is left: R'R = n * V with V the covariance. Plane rotations make R's columns
orthogonal (one-sided Jacobi); the accumulated rotations are the components, the columns' norms are sqrt(n * e). The product
R'R is never formed, so small eigenvalues keep their digits. Only sums and one triangle, d and d * d numbers for vectors of d
components, reach the driver. Rows are scored where they lie.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; a row without an id stays, with a
null id; rows that repeat an id or a vector each get their rows, and a vector counts once in the fit; of vectors of several lengths the
commonest length takes part (of equally common ones the longest); components without variance (eigenvalues below d * n * 2**-52
of the greatest, as for a single distinct vector) can't be whitened and are left out; each component's sign makes its entry of
greatest size positive; components beyond 62 bits after scaling take no part, a deviation beyond 64 bits is null. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SCALE = 256
TOP = 4
#: Rows of a block, and triangles that one task reduces.
BLOCK, FAN = 4096, 16
SWEEPS = 60


class Whitening(NamedTuple):
    """A fitted model: n distinct vectors, their sums, the components (k, d), eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def whole(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    e = F.col("embedding")
    fine = F.forall(e, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < float(1 << 62)))
    rows = embeddings.where(e.isNotNull() & (F.size(e) > 0) & fine).select(F.col("vec_id"), F.transform(e, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("x"))
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (sizes.d if sizes else 0))


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            x = _matrix(batch)
            if not len(x):
                continue
            small = int(max(abs(int(x.min())), abs(int(x.max())))) * len(x) < 1 << 62
            part = x.sum(0).tolist() if small else [sum(c) for c in x.T.tolist()]
            n, sums = n + len(x), part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
        if n:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(sums)), pa.int32()), "n": pa.array([n] * len(sums), pa.int64()), "s": [str(s) for s in sums]})

    parts = fit.mapInArrow(partial, "dim int, n long, s string")
    rows = parts.groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("dim").collect()
    return (rows[0].n if rows else 0), [int(r.s) for r in rows]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n, from whole numbers where these fit."""
    whole_mean = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    return (x - whole_mean).astype(np.float64) - rest


def _triangle(blocks: Iterator[np.ndarray]) -> np.ndarray | None:
    """The R of all rows of the blocks, stacked one after another."""
    r = None
    for b in blocks:
        if len(b):
            r = np.linalg.qr(b if r is None else np.concatenate([r, b]), mode="r")
    return r


def tall_qr(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R (d columns, at most d rows) of the centred rows: one triangle a partition, then FAN triangles at a time."""
    d = len(sums)

    def packed(r: np.ndarray | None, at: int) -> dict:
        return {"at": pa.array([] if r is None else [at], pa.int64()), "r": pa.array([] if r is None else [r.astype("<f8").tobytes()], pa.binary())}

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cut = (centred(x[i : i + BLOCK], n, sums) for x in map(_matrix, batches) for i in range(0, len(x), BLOCK))
        yield pa.RecordBatch.from_pydict(packed(_triangle(cut), TaskContext.get().partitionId()))

    def merge(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        return pa.table(packed(_triangle(np.frombuffer(b.as_py(), "<f8").reshape(-1, d) for b in t.column("r")), t.column("at")[0].as_py() // FAN))

    level = common.written(fit.mapInArrow(local, "at long, r binary"), "triangles")
    while level.count() > 1:  # `at` shrinks by FAN each time, so all triangles meet in the end
        above = common.written(level.groupBy(F.floor(F.col("at") / FAN).alias("g")).applyInArrow(merge, "at long, r binary"), "triangles")
        common.discard(level)
        level = above
    row = level.first()
    common.discard(level)
    return np.frombuffer(row.r, "<f8").reshape(-1, d).copy() if row else np.zeros((0, d))


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Every pair of columns once, in rounds of disjoint pairs (one column stays, the others turn)."""
    m = d + d % 2
    ring, out = list(range(1, m)), []
    for _ in range(m - 1):
        order = [0, *ring]
        pairs = [(min(a, b), max(a, b)) for a, b in zip(order[: m // 2], reversed(order[m // 2 :]), strict=True) if max(a, b) < d]
        out.append((np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])))
        ring = ring[-1:] + ring[:-1]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of `r`, falling, and its right singular vectors as columns, by rotating pairs of columns until all are orthogonal."""
    d = r.shape[1]
    a, v = r.astype(np.float64).copy(), np.eye(d)
    rounds = _rounds(d)
    floor = np.finfo(float).eps * max(1e-300, float((a * a).sum()))
    for _ in range(SWEEPS):
        turned = False
        for p, q in rounds:
            if not len(p):
                continue
            ap, aq = a[:, p], a[:, q]
            alpha, beta, gamma = (ap * ap).sum(0), (aq * aq).sum(0), (ap * aq).sum(0)
            on = (np.abs(gamma) > 4 * np.finfo(float).eps * np.sqrt(alpha * beta)) & (np.abs(gamma) > floor * np.finfo(float).eps)
            if not on.any():
                continue
            turned = True
            i, j, g = p[on], q[on], gamma[on]
            zeta = (beta[on] - alpha[on]) / (2 * g)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (a, v):
                mi, mj = m[:, i].copy(), m[:, j].copy()
                m[:, i], m[:, j] = c * mi - s * mj, s * mi + c * mj
        if not turned:
            break
    sigma = np.sqrt((a * a).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def fitted(fit: DataFrame, top: int = TOP) -> Whitening | None:
    """The model of the distinct vectors `fit` (column x); None for an empty table."""
    n, sums = totals(fit)
    if not n:
        return None
    sigma, v = jacobi(tall_qr(fit, n, sums))
    e = sigma**2 / n
    kept = min(top, int((e > len(sums) * n * 2.0**-52 * e.max(initial=0.0)).sum()) if e.max(initial=0.0) > 0 else 0)
    w = v[:, :kept].T
    signs = np.array([np.sign(row[np.argmax(np.abs(row))]) for row in w])
    return Whitening(n, sums, w * signs[:, None] if kept else w, e[:kept], float(e.sum()))


def _projected(x: np.ndarray, model: Whitening) -> np.ndarray:
    return centred(x, model.n, model.sums) @ model.components.T / np.sqrt(model.eigenvalues)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - S)**2, exact; None beyond 64 bits."""
    s = max(abs(v) for v in sums)
    if (n * int(max(abs(int(x.min())), abs(int(x.max())))) + s) ** 2 * x.shape[1] < 1 << 63:
        return (((n * x - np.array(sums, np.int64)) ** 2).sum(1)).tolist()
    out = [sum((n * a - b) ** 2 for a, b in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(model.eigenvalues)
    held = fit.sparkSession.sparkContext.broadcast(model)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, m = 0, np.zeros(k), np.zeros((k, k))
        for x in map(_matrix, batches):
            if len(x):
                w = _projected(x, held.value)
                here, mid = len(w), w.mean(0)
                step = mid - mean
                m += (w - mid).T @ (w - mid) + np.outer(step, step) * (n * here / (n + here))
                mean, n = mean + step * (here / (n + here)), n + here
        if n:
            flat = [*(n * mean).tolist(), *(m + n * np.outer(mean, mean)).ravel().tolist()]
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(flat)), pa.int32()), "v": flat})

    sums = {r.i: r.v for r in fit.mapInArrow(moments, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    flat = np.array([sums[i] for i in range(k + k * k)]) / model.n
    mean = flat[:k]
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, component, deviation, whitened): one row for each row of (vec_id, x) and component."""
    k = len(model.eigenvalues)
    held = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, each = _matrix(batch), np.repeat(np.arange(batch.num_rows), k)
            if batch.num_rows and k:
                far = deviations(x, held.value.n, held.value.sums)
                columns = [batch.column("vec_id").take(pa.array(each)), np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows), pa.array(far, pa.int64()).take(pa.array(each)), _projected(x, held.value).ravel()]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["vec_id", "component", "deviation", "whitened"])

    return rows.mapInArrow(score, f"vec_id {kind}, component int, deviation long, whitened double")


def _shares(model: Whitening) -> Column:
    return F.get(F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]), F.col("component") - 1)


def whitening(embeddings: DataFrame, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row that takes part."""
    rows = whole(embeddings, scale)
    fit = common.written(rows.select("x").distinct(), "vectors")
    model = fitted(fit, top)
    columns = "vec_id {}, component int, n long, deviation long, whitened double, explained double, identity_error double".format(rows.schema["vec_id"].dataType.simpleString())
    if model is None or not len(model.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], columns)
    error = identity_error(fit, model)
    common.discard(fit)
    out = whitened(rows, model)
    return out.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", _shares(model).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(common.table(spark, sf_dir, "embeddings"))
