"""Dense numbers for rows of any count, and copies of tenants whose tables refer to each other.

Rows are dealt into ranges of their order, each range is numbered by itself, and the ranges' counts, a few numbers, give where each begins. No task
holds more than a range. Defined cases: nulls come first in the order; rows that are equal in it are numbered one after another, in no defined order; an
empty table stays empty.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import written

#: Rows of a range.
RANGE_ROWS = 500_000
MAX_RANGES = 4096


def numbered(df: DataFrame, order: list[str], name: str = "number", first: int = 1) -> DataFrame:
    """`df` with a column `name`: first, first + 1, ... in the order of `order`."""
    at = f"{name}_range"
    ranges = deals(df)
    placed = written(df.repartitionByRange(ranges, *order).withColumn(at, F.spark_partition_id()), "numbered")
    counts = {r[at]: r["count"] for r in placed.groupBy(at).count().collect()}
    starts = list(accumulate((counts.get(i, 0) for i in range(ranges)), initial=first - 1))
    rank = F.row_number().over(Window.partitionBy(at).orderBy(*order))
    return placed.withColumn(name, rank + F.get(F.array(*(F.lit(s).cast("long") for s in starts)), F.col(at))).drop(at)


def deals(df: DataFrame, rows: int = RANGE_ROWS) -> int:
    """Into how many parts rows are dealt so that one holds about `rows` (RANGE_ROWS), however many there are."""
    return min(MAX_RANGES, max(1, -(-df.count() // rows)))


def cloned_tenant(index: DataFrame, parts: dict[str, tuple[DataFrame, list[str]]], key: str, tenant: str, source: int, target: int) -> dict[str, DataFrame]:
    """A tenant's rows under a new tenant, with new keys: the index and every table that refers to it.

    index: one row for each `key`. parts: name -> (table, columns that hold keys of the index). New keys follow the greatest one there is, in the order
    of the old ones. A row of a part is copied if all its keys are of the tenant. Gives {"index": ..., name: ...}, the new rows only.
    """
    own = index.where(F.col(tenant) == source)
    greatest = index.agg(F.max(key)).first()[0] or 0
    ids = written(numbered(own.select(F.col(key).alias("old_key")).distinct(), ["old_key"], "new_key", greatest + 1), "keys")

    def moved(rows: DataFrame, columns: list[str]) -> DataFrame:
        n = deals(rows)
        for c in columns:
            new = ids.select(F.col("old_key").alias(c), F.col("new_key").alias(f"{c}_new")).repartition(n, c)
            rows = rows.repartition(n, c).join(new, c).drop(c).withColumnRenamed(f"{c}_new", c)
        return rows

    out = {"index": moved(own, [key]).withColumn(tenant, F.lit(target)).select(*index.columns)}
    return out | {name: moved(rows, columns).select(*rows.columns) for name, (rows, columns) in parts.items()}
