"""Relations between named concepts, kept up to date locally or made anew.

Two concepts are related by the likeness of their names, by tiers: 1.0 for equal names (of either language), 0.9 where an alias of the first is the name of
the second, 0.8 for a common alias, 0.7 where one name holds the other, else the sequence matcher's ratio if it is above 0.5. The concept of the smaller
id is the first. Concepts are dealt into blocks, and two blocks meet in one task; there the counts of common characters bound the ratio, and only pairs
that it can lift above 0.5 are matched.

After a change the affected concepts are counted: below LOCAL of all, they alone are compared with all, and relations between others stay; above that all are
compared with all. Both ways give the same relations.

Defined cases: null and blank names are like no other by containment or ratio; concepts without an id are left out; of rows that repeat an id the
first in the order of names counts; relations of concepts that are not there any more go; no concepts give no relations.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCAL, LEAST = 0.1, 0.3
LEFT_BLOCK, RIGHT_BLOCK = 256, 2048
RELATION = "source long, target long, score double"
_COLUMNS = ("id", "name", "name_ko", "aliases")


def _normal(x: str | None) -> str:
    return (x or "").lower()


def tier(a: dict, b: dict, ratio: float) -> float:
    """The likeness of two concepts whose names have a matcher's ratio of `ratio`."""
    x, y, xk, yk = _normal(a["name"]), _normal(b["name"]), _normal(a["name_ko"]), _normal(b["name_ko"])
    if (x and x == y) or (xk and xk == yk):
        return 1.0
    others = {_normal(v) for v in b["aliases"] or []}
    for alias in map(_normal, a["aliases"] or []):
        if alias and alias in (y, yk):
            return 0.9
        if alias and alias in others:
            return 0.8
    if x.strip() and y.strip():
        return 0.7 if x in y or y in x else ratio if ratio > 0.5 else 0.0
    return 0.0


def bounds(left: list[str], right: list[str]) -> np.ndarray:
    """The greatest ratio that each pair of names can have: twice the common characters over all characters."""
    alphabet = {c: i for i, c in enumerate(sorted(set("".join(left + right))))}
    counts = [np.zeros((len(names), len(alphabet)), np.int32) for names in (left, right)]
    for m, names in zip(counts, (left, right), strict=True):
        for i, name in enumerate(names):
            for c, n in Counter(name).items():
                m[i, alphabet[c]] = n
    common = np.array([np.minimum(row, counts[1]).sum(1) for row in counts[0]]).reshape(len(left), len(right))
    total = counts[0].sum(1)[:, None] + counts[1].sum(1)[None, :]
    return np.divide(2 * common, total, out=np.zeros(common.shape), where=total > 0)


def compared(left: DataFrame, right: DataFrame, least: float = LEAST) -> DataFrame:
    """(source, target, score): pairs of a concept of `left` and another one of `right` (id, name, name_ko, aliases) with a likeness above `least`, source before target."""

    def concepts(df: DataFrame) -> DataFrame:
        return df.where(F.col("id").isNotNull()).groupBy(F.col("id").cast("long").alias("id")).agg(F.min(F.struct("name", "name_ko", "aliases")).alias("c")).select("id", "c.*")

    a, b = concepts(left), concepts(right)
    an, bn = (max(1, -(-df.count() // size)) for df, size in ((a, LEFT_BLOCK), (b, RIGHT_BLOCK)))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def search(x: pa.Table, y: pa.Table) -> pa.Table:
        rows, others = x.select(_COLUMNS).to_pylist(), y.select(_COLUMNS).to_pylist()
        out: dict[tuple[int, int], float] = {}
        most = bounds([_normal(r["name"]) for r in rows], [_normal(r["name"]) for r in others]) if rows and others else None
        for i, r in enumerate(rows):
            for j, o in enumerate(others):
                if r["id"] == o["id"]:
                    continue
                p, q = (r, o) if r["id"] < o["id"] else (o, r)
                if (p["id"], q["id"]) not in out:
                    ratio = SequenceMatcher(None, _normal(p["name"]), _normal(q["name"])).ratio() if most[i, j] > 0.5 else 0.0
                    out[p["id"], q["id"]] = tier(p, q, ratio)
        found = [(s, t, v) for (s, t), v in out.items() if v > least]
        return pa.table({"source": pa.array([f[0] for f in found], pa.int64()), "target": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    sides = a.withColumns({"l": block(an), "r": every(bn)}), b.select(*(F.col(c).alias(c) for c in b.columns)).withColumns({"r": block(bn), "l": every(an)})
    return sides[0].groupBy("l", "r").cogroup(sides[1].groupBy("l", "r")).applyInArrow(search, RELATION).distinct()


def updated(nodes: DataFrame, relations: DataFrame, affected: DataFrame, least: float = LEAST, local: float = LOCAL) -> DataFrame:
    """The relations after the concepts `affected` (id) have changed. relations: (source, target, score) before that, of the same `least`."""
    ids = nodes.select(F.col("id").cast("long").alias("id")).where("id IS NOT NULL").distinct()
    hit = affected.select(F.col("id").cast("long").alias("id")).distinct()
    changed = nodes.join(hit, "id", "left_semi")
    if changed.select("id").distinct().count() >= local * ids.count():
        return compared(nodes, nodes, least)
    stays = relations.select("source", "target", "score")
    for side in ("source", "target"):
        stays = stays.join(hit.withColumnRenamed("id", side), side, "left_anti").join(ids.withColumnRenamed("id", side), side, "left_semi")
    return stays.select("source", "target", "score").unionByName(compared(changed, nodes, least))
