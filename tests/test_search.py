"""Searches in blocks give what brute force gives, however the blocks are cut."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import search


def best(scores: dict[int, dict[int, float]], k: int) -> dict[int, list]:
    return {q: sorted(((-round(s, 9), d) for d, s in of.items() if d != q))[:k] for q, of in scores.items()}


def got(hits) -> dict[int, list]:
    out: dict[int, list] = {}
    for x in sorted(hits.collect(), key=lambda x: (x.qid, x["rank"])):
        out.setdefault(x.qid, []).append((-x.score, x.doc_id))
    return out


@pytest.fixture(params=[(1 << 20, 1 << 20, 1 << 20), (4, 7, 3)])
def blocks(request, monkeypatch):
    for name, n in zip(("QUERY_BLOCK", "POINT_BLOCK", "SPARSE_QUERIES"), request.param, strict=True):
        monkeypatch.setattr(search, name, n)


def test_vectors(spark, blocks):
    r = np.random.default_rng(2)
    rows = [(i, v.tolist(), "ab"[i % 2], i % 3 == 0) for i, v in enumerate(np.round(r.normal(size=(40, 8)), 1))] + [(50, [0.0] * 8, "a", False), (51, None, "a", True), (52, [1.0] * 3, "a", None), (53, [None] * 8, "b", False)]
    points = spark.createDataFrame(rows, "doc_id int, vec array<double>, s string, match boolean")
    queries = points.where("doc_id < 9 OR doc_id >= 50").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"))
    of = {i: np.array(v) for i, v, *_ in rows if v and None not in v and len(v) == 8}
    unit = lambda v: v / n if (n := np.sqrt((v * v).sum())) else v
    asked = [q for q in of if q < 9 or q >= 50]
    cosine = {q: {d: float(unit(of[q]) @ unit(v)) for d, v in of.items()} for q in asked}
    assert got(search.dense_topk(points, queries, 5)) == best(cosine, 5)
    cut = lambda v: [unit(x) for x in v.reshape(4, 2)]
    multi = {q: {d: float(sum(max(a @ b for b in cut(v)) for a in cut(of[q]))) for d, v in of.items()} for q in asked}
    found = got(search.multi_topk(points, queries, 6))
    assert {q: [d for _, d in v] for q, v in found.items()} == {q: [d for _, d in v] for q, v in best(multi, 6).items()}
    marked = {i for i, _, _, m in rows if m}
    boosted = {q: {d: min(0.9, round(s, 9) * 2) if d in marked else s for d, s in row.items()} for q, row in cosine.items()}
    hits = search.dense_topk(points, queries, 5, boost=("match", 2.0, 0.9))
    assert {q: [d for _, d in v] for q, v in got(hits).items()} == {q: [d for _, d in v] for q, v in best(boosted, 5).items()}
    by = search.dense_topk(points, queries, 1, best_by="s").where("qid = 3").collect()
    sides = {i: s for i, _, s, _ in rows}
    assert {x.s: x.doc_id for x in by} == {s: best({3: {d: c for d, c in cosine[3].items() if sides[d] == s}}, 1)[3][0][1] for s in "ab"}
    assert search.dense_topk(points, queries.limit(0), 5).count() == search.dense_topk(points.limit(0), queries, 5).count() == 0


def test_terms(spark, blocks):
    r = random.Random(8)
    words = [["der", "und", "die", "haus", "baum", "weg"], ["the", "and", "house", "tree", "road", "way"]]
    texts = [" ".join(["the"] * r.randint(0, 4) + r.choices(words[i % 2], k=r.randint(1, 14))) for i in range(60)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "a b 1"), (103, "onlyhere"), (104, "the " * 3000), (105, texts[4]), (106, texts[4])]
    points = spark.createDataFrame(rows, "doc_id long, text string")
    queries = points.where("doc_id % 5 = 0 OR doc_id > 99").select(F.col("doc_id").alias("qid"), F.col("text").alias("qtext"))
    counts = {i: c for i, t in rows if (c := Counter(re.findall("[a-z]{3,}", t or "")))}
    norm = {i: sum(n * n for n in c.values()) ** 0.5 for i, c in counts.items()}
    scores = {q: {d: s for d, c in counts.items() if (s := sum(n * c[t] for t, n in counts[q].items()) / (norm[q] * norm[d])) > 0} for q in counts if q % 5 == 0 or q > 99}
    want = {q: v for q, v in best(scores, 4).items() if v}
    assert {q: [d for _, d in v] for q, v in got(search.sparse_topk(points, queries, 4)).items()} == {q: [d for _, d in v] for q, v in want.items()}
    assert search.sparse_topk(points, queries.limit(0), 4).count() == search.sparse_topk(points.limit(0), queries, 4).count() == 0


def test_blocks_are_skipped():
    import pyarrow as pa

    side = lambda rows: pa.table({"terms": [list(t) for t, _ in rows], "weights": [list(w) for _, w in rows]})
    asked, given = side([("ab", (0.6, 0.8)), ("ac", (0.8, 0.6))]), side([("a", (1.0,)), ("ad", (0.6, 0.8))])
    scores = search._sparse_scores(asked, given, np.array([0.7, 0.8]), 9)
    assert np.isnan(scores[0]).all() and scores[1].tolist() == [0.8, 0.48]


def test_few_rows_of_scores_at_once(monkeypatch):
    """F2, F3, F4, F6, F8 of round 3: a task's memory does not follow the size of a block of queries."""
    import tracemalloc

    import pyarrow as pa

    def measured(rows, work):
        tracemalloc.start()
        work(rows)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    r = np.random.default_rng(3)
    words = [f"w{i}" for i in range(20_000)]
    table = lambda first, n: pa.table({"id": np.arange(first, first + n), "terms": [sorted(r.choice(words, 40, replace=False).tolist()) for _ in range(n)], "weights": [[0.1] * 40] * n})
    given = table(10_000, 2000)
    sparse = lambda n: search._sparse_best(table(0, n), given, np.full(n, -np.inf), 9, 5)
    assert measured(256, sparse) < 80e6

    taken = {}

    class Frame:
        def __getattr__(self, name):
            return lambda *a, **k: self

        def applyInArrow(self, f, schema):  # noqa: N802
            taken["search"] = f
            return self

    monkeypatch.setattr(search, "_sides", lambda *a: (Frame(), Frame()))
    monkeypatch.setattr(search, "_blocks", lambda *a: 1)
    monkeypatch.setattr(search, "_dealt", lambda *a: None)
    monkeypatch.setattr(search, "_everywhere", lambda *a: None)
    monkeypatch.setattr(search, "_ranked", lambda *a: None)
    search.multi_topk(None, None, 5)
    side = lambda name, n: pa.table({name: np.arange(n), "v": pa.array(r.normal(size=(n, 64)).tolist()), "by": pa.nulls(n, pa.string()), "hit": pa.array([False] * n)})
    left, right = side("qid", 1024), side("doc_id", 4096)
    assert measured(None, lambda _: taken["search"](left, right)) < 60e6
