"""Dense numbers are the same whatever the ranges."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ids
from lodestone.sources import tables


@pytest.mark.parametrize("rows", [3, 1000])
def test_numbers(spark, monkeypatch, rows):
    monkeypatch.setattr(ids, "RANGE_ROWS", rows)
    df = spark.createDataFrame([(None if i == 5 else i % 7, str(i), 1) for i in range(40)], "k int, s string, number_range_ int")
    got = sorted((x.number, x.k, x.s) for x in ids.numbered(df, ["k", "s"], first=10).collect())
    want = sorted(((None if i == 5 else i % 7, str(i)) for i in range(40)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert got == [(10 + n, k, s) for n, (k, s) in enumerate(want)]
    assert ids.numbered(df.limit(0), ["k"]).count() == 0


def test_clone(spark):
    index = spark.createDataFrame([(1, 1, "a"), (5, 1, "b"), (7, 2, "c")], "id long, tenant int, body string")
    parts = spark.createDataFrame([(5, 0), (5, 1), (7, 0)], "id long, part int")
    edges = spark.createDataFrame([(1, 5), (5, 7), (5, 1)], "source long, target long")
    new = ids.cloned_tenant(index, {"parts": (parts, ["id"]), "edges": (edges, ["source", "target"])}, "id", "tenant", 1, 3)
    assert {k: sorted(map(tuple, v.collect())) for k, v in new.items()} == {"index": [(8, 3, "a"), (9, 3, "b")], "parts": [(9, 0), (9, 1)], "edges": [(8, 9), (9, 8)]}
    assert ids.cloned_tenant(index, {}, "id", "tenant", 99, 3)["index"].agg(F.count(F.lit(1))).first()[0] == 0


def test_written_tables_go(spark):
    df = tables.written(spark.range(3).toDF("n"), "some")
    assert sorted(r.n for r in df.collect()) == [0, 1, 2]
    path = tables._own(spark).removeprefix("file:")
    assert os.path.isdir(path)
    tables.clear(spark)
    assert not os.path.exists(path)
    tables.clear(spark)


def test_copies_are_dealt_by_their_rows(spark, monkeypatch):
    """F10 of round 3: the tasks that move a tenant's rows hold a range of rows each."""
    monkeypatch.setattr(ids, "RANGE_ROWS", 7)
    index = spark.range(100).selectExpr("id AS k", "id % 2 AS tenant")
    new = ids.cloned_tenant(index, {"edges": (spark.range(90).selectExpr("id AS s", "id + 2 AS g"), ["s", "g"])}, "k", "tenant", 1, 5)
    plan = new["edges"]._jdf.queryExecution().executedPlan().toString()
    assert ids.deals(spark.range(90)) == 13 and plan.count(", 13), REPARTITION_BY_NUM") == 4
    assert new["edges"].count() == 45
