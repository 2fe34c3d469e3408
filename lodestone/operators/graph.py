"""Knowledge graph pieces: co-occurrence, referential filters, merges of nodes, fuzzy matches in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.tables import written


def cooccurrences(concepts: DataFrame, column: str = "concepts") -> DataFrame:
    """(a, b, docs): pairs a < b of the concepts of one row, with the number of rows. Pairs are made within the row, counts are combined before the shuffle.

    The array holds a text's distinct concepts, of which the extraction gives ten at most; null and empty ones have no pairs.
    """
    c = F.array_sort(column)
    pairs = F.flatten(F.transform(c, lambda a, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return concepts.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("docs"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist; of repeats of (source, target, type) the first stays."""
    ids = nodes.select("id").distinct()
    kept = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    w = Window.partitionBy("source", "target", "type").orderBy("ord")
    return kept.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes by id: the first non-null name_ko stays, aliases are united, the last properties win."""
    return nodes.groupBy("id").agg(
        F.min_by("name_ko", F.when(F.col("name_ko").isNotNull(), F.col("ord"))).alias("name_ko"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
        F.max_by("properties", "ord").alias("properties"),
    )


def without_file(nodes: DataFrame, edges: DataFrame, created: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes the nodes in `created` (id) and every edge that touches one."""
    gone = created.select("id").distinct()
    left = nodes.join(gone, "id", "left_anti")
    return left, edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")


def position_weight(index: Column) -> Column:
    return 1.0 + 0.1 * index


def name_candidates(group: DataFrame, least: float) -> DataFrame:
    """(id, id2), id < id2: pairs of (id, name, size) of distinct names that can have a sequence-matcher ratio of `least`; no such pair is missing.

    Of names of x and y characters at least m = least (x + y) / 2 are matched, in order. Between neighbouring matches at most (1 - least)(x + y) characters
    are skipped in both names together, so at least m - 1 - (1 - least)(x + y) / 2 neighbours have at most one skipped: they are the same pair
    of characters, next to each other or one apart, in both. Names are joined on such pairs, numbered if they repeat, the rarest first,
    and on the band of their length; names too short for that number to be positive, and their partners, on single characters. Lengths
    and common characters are compared before a name is read. Up to a ratio of 0.5 all names are joined on single characters.
    """
    share = least / (2 - least)
    chars = F.filter(F.split("name", ""), lambda c: c != "")
    named = group.select("id", "size", chars.alias("chars"))
    numbered = lambda xs: F.transform(xs, lambda c, i: F.concat(c, F.lit("#"), F.size(F.filter(F.slice(xs, 1, i + 1), lambda d: d == c)).cast("string")))
    apart = lambda n: F.filter(F.zip_with("chars", F.slice("chars", n + 1, F.size("chars")), lambda a, b: F.when(b.isNotNull(), F.concat(a, b))), lambda p: p.isNotNull())
    named = named.withColumn("pairs", F.concat(apart(1), apart(2)))
    size = F.col("size").cast("double")
    # A name of x characters and its partner have x (1 + share) or more; from `long` on they share a pair at least.
    long = int(1 / ((least - 0.5) * (1 + share)) + 1e-9) + 1 if least > 0.5 else None
    kinds = {"chars": (F.lit(True) if long is None else F.col("size") <= int((long - 1) / share + 1e-9), F.ceil(size * share - 1e-9))}
    if long is not None:
        kinds["pairs"] = (F.col("size") >= long, F.ceil((least - 0.5) * (1 + share) * size - 1 - 1e-9))
    found = None
    for kind, (fits, common) in kinds.items():
        rows = named.where(fits).select("id", "size", numbered(F.col("chars")).alias("bag"), numbered(F.col(kind)).alias("tokens"), F.greatest(F.lit(1), common).alias("common"))
        often = rows.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("often"))
        rare = rows.select("id", F.explode("tokens").alias("t")).join(often, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "t"))).alias("rare"))
        first = F.slice("rare", 1, F.greatest(F.lit(0), F.size("rare") - F.col("common") + 1).cast("int"))
        band = F.floor(F.log(size) / F.log(F.lit(1.001 / share))).cast("int")
        keyed = rows.join(rare, "id").select("id", "size", "bag", band.alias("band"), F.explode(F.transform(first, lambda x: x["t"])).alias("t"))
        other = keyed.select(*(F.col(c).alias(f"{c}2") for c in ("id", "size", "bag")), "t", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"))
        total = F.col("size") + F.col("size2")
        near = keyed.join(other, ["t", "band"]).where((F.col("id") < F.col("id2")) & (2 * F.least("size", "size2") >= least * total - 1e-9))
        near = near.where(2 * F.size(F.array_intersect("bag", "bag2")) >= least * total - 1e-9).select("id", "id2")
        found = near if found is None else found.unionByName(near)
    return found.distinct()


def similar_names(names: DataFrame, least: float = 0.7) -> DataFrame:
    """(a, b, score): pairs of (id, name) whose sequence-matcher ratio is at least `least`, a before b.

    Names are compared in lower case without punctuation. Names without characters have no pairs; names that are equal are one row of
    the search (see `group`), and come back as pairs of their ids with the first of them. Names are written, and their groups too: else the
    conditions on a name's pairs of characters go below the grouping, to every row that it came from, once for each part of the search.
    """
    clean = F.regexp_replace(F.lower("name"), r"[^\w\s]", "")
    rows = written(names.select("id", clean.alias("name")).where(F.length("name") > 0), "names")
    group = written(rows.groupBy("name").agg(F.min("id").alias("id"), F.length("name").alias("size")), "groups")
    pairs = name_candidates(group, least)
    text = group.select("id", "name")
    pairs = pairs.join(text, "id").join(text.select(F.col("id").alias("id2"), F.col("name").alias("name2")), "id2")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from difflib import SequenceMatcher

        for b in batches:
            scores = [SequenceMatcher(None, x, y).ratio() for x, y in zip(b["name"], b["name2"], strict=True)]
            yield pd.DataFrame({"a": b["id"], "b": b["id2"], "score": scores})

    found = pairs.mapInPandas(compare, "a long, b long, score double").where(F.col("score") >= least)
    same = rows.join(group.select("name", F.col("id").alias("a")), "name").where("id != a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("score"))
    return found.unionByName(same)


def both_ways(terms: DataFrame) -> DataFrame:
    """(term, other) of (ko, en) in both directions, with and without blanks; blank terms are left out."""
    t = terms.select(F.lower(F.trim("ko")).alias("a"), F.lower(F.trim("en")).alias("b")).where((F.col("a") != "") & (F.col("b") != ""))
    t = t.unionByName(t.select(F.col("b").alias("a"), F.col("a").alias("b")))
    bare = F.replace("a", F.lit(" "), F.lit(""))
    return t.select(F.explode(F.array_distinct(F.array("a", bare))).alias("term"), F.col("b").alias("other")).distinct()


def rebuilt(edges: DataFrame, affected: DataFrame, fresh: DataFrame) -> DataFrame:
    """Edges (source, target, ...) without those that touch an affected id, and the fresh ones."""
    gone = affected.select("id").distinct()
    kept = edges.join(gone.withColumnRenamed("id", "source"), "source", "left_anti").join(gone.withColumnRenamed("id", "target"), "target", "left_anti")
    return kept.unionByName(fresh)


def related(affected: DataFrame, nodes: DataFrame, edges: DataFrame, score, least: float, limit: int = 10_000) -> DataFrame:
    """(source, target, score): affected nodes (id, name) with every node whose score is above `least`, without edges there are already, either way.

    The affected side is counted: up to `limit` nodes it is broadcast, a larger one goes in parts of that size, each by its own join.
    """
    parts = max(1, -(-affected.count() // limit))
    out = None
    for k in range(parts):
        a = affected.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k).select(F.col("id").alias("source"), F.col("name").alias("x"))
        found = nodes.select(F.col("id").alias("target"), F.col("name").alias("y")).join(F.broadcast(a), F.col("source") != F.col("target"))
        found = found.select("source", "target", score(F.col("x"), F.col("y")).alias("score")).where(F.col("score") > least)
        out = found if out is None else out.unionByName(found)
    known = edges.select("source", "target").unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"))).distinct()
    return out.join(known, ["source", "target"], "left_anti")


def dangling(edges: DataFrame, tasks: DataFrame) -> DataFrame:
    """Edges of a workflow (source, target) that name a task that is not there."""
    ids = tasks.select("id").distinct()
    bad = lambda side: edges.join(ids.withColumnRenamed("id", side), side, "left_anti").select("source", "target", F.lit(side).alias("problem"))
    return bad("source").unionByName(bad("target"))
