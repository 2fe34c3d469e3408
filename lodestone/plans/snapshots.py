"""Diffs and merges of two snapshots of the documents.

The old snapshot lacks ids divisible by 10 and differs in texts of ids divisible by 7; the new one lacks ids divisible by 11.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import ids
from lodestone.operators import relational as rel
from lodestone.sources.tables import table, written

from .base import query

SNAPSHOTS = """old AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || 'x' ELSE text END) AS h, doc_id % 5 <> 0 AS enabled FROM documents WHERE doc_id % 10 <> 0),
new AS (SELECT doc_id, md5(text) AS h, doc_id % 3 <> 0 AS enabled FROM documents WHERE doc_id % 11 <> 0)"""
CHANGE = """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'created' WHEN n.doc_id IS NULL THEN 'deleted' WHEN o.h IS DISTINCT FROM n.h THEN 'updated'
WHEN o.enabled IS DISTINCT FROM n.enabled THEN 'toggled' ELSE 'same' END AS change FROM old o FULL JOIN new n ON o.doc_id = n.doc_id"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d, i = table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("doc_id")
    old = d.where(i % 10 != 0).select("doc_id", F.md5(F.when(i % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("h"), (i % 5 != 0).alias("enabled"))
    return old, d.where(i % 11 != 0).select("doc_id", F.md5("text").alias("h"), (i % 3 != 0).alias("enabled"))


@query(f"WITH {SNAPSHOTS} {CHANGE}")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happened to every key."""
    return rel.diff(*snapshots(spark, sf_dir), "doc_id", "h", "enabled")


@query(f"WITH {SNAPSHOTS} SELECT change, count(*) AS n FROM ({CHANGE}) GROUP BY change")
def diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by kind."""
    return snapshot_diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SNAPSHOTS} SELECT doc_id, h, enabled FROM new UNION ALL SELECT doc_id, h, enabled FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)")
def merged_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2, K3: upsert; rows that the new snapshot lacks stay."""
    old, new = snapshots(spark, sf_dir)
    return rel.upsert(old, new, "doc_id")


@query(f"WITH {SNAPSHOTS} SELECT o.doc_id, coalesce(n.h, o.h) AS h, o.enabled, CASE WHEN n.h IS NOT NULL AND n.h <> o.h THEN 2 ELSE 1 END AS rev FROM old o LEFT JOIN new n ON o.doc_id = n.doc_id")
def revised_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K7: a changed row gets the next revision and keeps its switch."""
    old, new = snapshots(spark, sf_dir)
    return rel.revised(old.withColumn("rev", F.lit(1)), new.select("doc_id", F.col("h").alias("new_value")), "doc_id", "h")


@query("SELECT doc_id, enabled FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN FALSE ELSE doc_id % 5 <> 0 END AS enabled FROM documents WHERE doc_id % 13 <> 0)")
def deletes_and_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An anti-join drops keys, a switch is set for others."""
    d, i = table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id")
    kept = d.join(d.where(i % 13 == 0), "doc_id", "left_anti")
    return kept.select("doc_id", F.when(i % 9 == 0, False).otherwise(i % 5 != 0).alias("enabled"))


@query("SELECT doc_id % 3 + 1 AS tenant, doc_id FROM documents UNION ALL SELECT 4, doc_id FROM documents WHERE doc_id % 3 + 1 = 1")
def cloned_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tenant's rows under a new id."""
    d = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3 + 1).alias("tenant"), "doc_id")
    return rel.clone_tenant(d, "tenant", 1, 4)


@query("SELECT vec_id FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose parent was deleted go with it."""
    kept = table(spark, sf_dir, "documents").where("n_chars > 500")
    return rel.without_orphans(table(spark, sf_dir, "embeddings").select("vec_id"), kept, "vec_id", "doc_id")


@query("SELECT doc_id, md5(text) AS text_md5, sha256(text) AS text_sha256, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15)) AS BIGINT) AS point_id FROM documents")
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and ids derived from them."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"), F.sha2("text", 256).alias("text_sha256"), text.point_id(F.col("doc_id").cast("string")).alias("point_id"))


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 4 AS tenant FROM orders), m AS (SELECT o_orderkey AS old, (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY o_orderkey) AS new FROM t WHERE tenant = 1),
e AS (SELECT o_orderkey AS s, o_orderkey + 4 AS g FROM orders)
SELECT 'index' AS kind, m.new AS a, CAST(9 AS BIGINT) AS b, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'parts', m.new, l_linenumber, count(*) FROM lineitem JOIN m ON l_orderkey = old GROUP BY ALL
UNION ALL SELECT 'graph', x.new, y.new, count(*) FROM e JOIN m x ON s = x.old JOIN m y ON g = y.old GROUP BY ALL""")
def cloned_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenant's index, parts and graph under a new tenant, with new keys that still refer to each other."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("tenant"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    edges = orders.select(F.col("o_orderkey").alias("s"), (F.col("o_orderkey") + 4).alias("g"))
    new = ids.cloned_tenant(orders, {"parts": (lines, ["l_orderkey"]), "graph": (edges, ["s", "g"])}, "o_orderkey", "tenant", 1, 9)
    shape = {"index": ("o_orderkey", "tenant"), "parts": ("l_orderkey", "l_linenumber"), "graph": ("s", "g")}
    rows = [new[k].select(F.lit(k).alias("kind"), F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")) for k, (a, b) in shape.items()]
    copied = written(rows[0].unionByName(rows[1]).unionByName(rows[2]), "copied")
    return copied.repartition(ids.deals(copied), "kind", "a", "b").groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, ts, event_id) AS number FROM events")
def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows numbered over the whole table, range by range."""
    return ids.numbered(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id", "ts", "event_id"]).select("event_id", "number")
