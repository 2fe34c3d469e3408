"""Connected components by star contraction: every node learns the least node it is linked with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every greater neighbour of u with the least node among u and its neighbours."""
    near = _neighbours(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links u and its smaller neighbours with the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v): v is the least node of u's component, for every node that is not itself the least. edges: (u, v).

    The minimum of each node's neighbours is an aggregate, so a node with very many links is combined before it is
    shuffled; each round is written, and the rounds grow with the logarithm of the longest chain.
    """
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).alias("mark")
    now = common.written(edges.select("u", "v").where("u != v").distinct(), "links")
    seen = now.agg(mark).first()
    while True:
        after = common.written(_small_star(_large_star(now)), "links")
        found = after.agg(mark).first()
        common.discard(now)
        now = after
        if found == seen:
            return now
        seen = found
