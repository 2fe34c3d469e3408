"""Filtered hybrid retrieval for sets of queries: filters, budgets, fusion of ranked channels, packing. The channels are in `search`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def visible(tenant: Column, target: int, shared: int = 1) -> Column:
    """Rows of the target tenant and of the shared one."""
    return tenant.isin(*sorted({shared, target}))


def any_of(values: Column, wanted: list) -> Column:
    """Whether an array column holds any of the wanted values."""
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def budgets(k: int, three_way: bool = True) -> dict[str, int]:
    """How many candidates each channel may bring for a top-k."""
    if three_way:
        b = min(max(10 * k, 80), 150)
        return {"dense": b * 45 // 100, "sparse": b * 45 // 100, "multi": b * 10 // 100}
    b = min(max(30 * k, 200), 400)
    dense = b * 45 // 100
    return {"dense": dense, "sparse": b - dense}


def ranked(scored: DataFrame, limit: int, by: str = "score") -> DataFrame:
    """(qid, doc_id, by, rank) with rank <= limit: score descending, then doc_id."""
    w = Window.partitionBy("qid").orderBy(F.desc(by), "doc_id")
    return scored.select("qid", "doc_id", by, F.row_number().over(w).alias("rank")).where(F.col("rank") <= limit)


def rrf(channels: list[DataFrame], k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Reciprocal rank fusion of ranked channels: one union and one aggregation, however many channels there are."""
    all_ranks = channels[0].select("qid", "doc_id", "rank")
    for c in channels[1:]:
        all_ranks = all_ranks.unionByName(c.select("qid", "doc_id", "rank"))
    one = F.lit(1.0) / (F.lit(k) + F.col("rank"))
    return all_ranks.groupBy("qid", "doc_id").agg(F.round(F.sum(one), digits).alias("score"), F.count(F.lit(1)).alias("ch"))


def top(fused: DataFrame, k: int) -> DataFrame:
    """The k best of each query with their place rk; ties go to the smaller doc_id."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")
    return fused.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)


def boosted(score: Column, hit: Column, factor: float = 2.5, most: float = 0.95) -> Column:
    return F.when(hit, F.least(F.lit(most), score * factor)).otherwise(score)


def type_boosted(score: Column, same_type: Column) -> Column:
    return F.when(same_type, F.least(F.lit(0.99), score * 1.2)).otherwise(score * 0.5)


def packed(ranked_docs: DataFrame, budget: int, order: str = "rk", size: str = "tokens") -> DataFrame:
    """Documents of each query, in order, up to the first that would overflow the budget."""
    w = Window.partitionBy("qid").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return ranked_docs.withColumn("used", F.sum(size).over(w)).where(F.col("used") <= budget)


def widened(k: int, by_id: Column, several: Column) -> Column:
    """How many rows a search for the best k asks for: twice k, ten times for questions by id, two more for several intents."""
    return F.when(by_id, F.lit(10 * k)).otherwise(F.lit(2 * k)) + F.when(several, F.lit(2)).otherwise(F.lit(0))
