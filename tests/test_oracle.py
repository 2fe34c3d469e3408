"""Every query with a SQL twin gives the twin's rows; every other one runs."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lodestone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(columns, rows):
    plain = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(plain(v) for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows_of(columns, [tuple(r) for r in df.select(*columns).collect()])
    if name in registry.ORACLE_SQL:
        want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert got == rows_of(columns, want)
    assert got or name in ("pii_findings",)


def test_entry_functions(spark):
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "ch", "rk"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
