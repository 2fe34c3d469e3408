"""Relational queries: joins, aggregates, filters, pages and rule look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import relational as rel
from lodestone.sources.tables import table

from .base import query


@query("SELECT c_custkey, c_name, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey = 1")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer join to a small dimension."""
    n = table(spark, sf_dir, "nation").where("n_regionkey = 1").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice > 400000)")
def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without large orders, as an anti-join."""
    o = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(o, "c_custkey", "left_anti")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderstatus")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2."""
    return table(spark, sf_dir, "orders").where("o_totalprice > 100000").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT lang, count(*) AS n, round(avg(strlen(text)), 4) AS mean_bytes, CAST(max(strlen(text)) AS BIGINT) AS max_bytes, CAST(min(strlen(text)) AS BIGINT) AS min_bytes FROM documents GROUP BY lang")
def byte_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: lengths are bytes, not characters."""
    b = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(b), 4).alias("mean_bytes"), F.max(b).alias("max_bytes"), F.min(b).alias("min_bytes"))


@query("SELECT label, count(*) AS n, count(DISTINCT vec_id) AS ids, round(avg(len(embedding)), 4) AS mean_dims, CAST(max(len(embedding)) AS INTEGER) AS max_dims FROM embeddings GROUP BY label")
def embedding_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    d = F.size("embedding")
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), F.round(F.avg(d), 4).alias("mean_dims"), F.max(d).alias("max_dims"))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS embeddings, (SELECT CAST(sum(strlen(text)) AS BIGINT) FROM documents) AS text_bytes, (SELECT coalesce(avg(len(embedding)), 0) FROM embeddings) AS mean_dims")
def store_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of scalar aggregates; each side is one row."""
    d = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.octet_length("text").cast("long")).alias("text_bytes"))
    e = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("embeddings"), F.coalesce(F.avg(F.size("embedding")), F.lit(0.0)).alias("mean_dims"))
    return d.crossJoin(e).select("documents", "embeddings", "text_bytes", "mean_dims")


@query("SELECT doc_id % 3 + 1 AS tenant, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((doc_id % 3 + 1, source), ())")
def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detail rows and one grand total."""
    d = table(spark, sf_dir, "documents").withColumn("tenant", F.col("doc_id") % 3 + 1)
    return d.groupingSets([["tenant", "source"], []], "tenant", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars")).select("tenant", "source", "n", "chars")


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%re%' AND (lower(p_brand) LIKE '%1%' OR p_type = 'x')")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every keyword must be in one of the columns, case aside."""
    return table(spark, sf_dir, "part").where(F.lower("p_name").contains("re") & (F.lower("p_brand").contains("1") | (F.col("p_type") == "x"))).select("p_partkey", "p_name")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-07' AND CAST(json_extract_string(props, '$.k') AS INTEGER) < 20")
def date_and_json_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F11."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").where(F.col("ts").between(F.expr("timestamp_ntz'2024-01-05'"), F.expr("timestamp_ntz'2024-01-07'"))).select("event_id", k.alias("k")).where("k < 20")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: sorted top."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def page_of_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3: a page in a fixed order."""
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey").offset(100).limit(50)


@query("""SELECT e.user_id, e.event_id, round(e.value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1""")
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each key."""
    best = rel.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value"), "user_id", ["ts", "event_id"])
    return best.select("user_id", "event_id", F.round("value", 6).alias("value"))


@query("""SELECT doc_id, ip, n <= 4 AND bool_and(p <= 255) AS valid, CASE WHEN bool_and(p <= 255) THEN CAST(sum(p * pow(256, 3 - i)) AS BIGINT) END AS number FROM
(SELECT doc_id, ip, len(string_split(ip, '.')) AS n, unnest(string_split(ip, '.'))::BIGINT AS p, unnest(range(4)) AS i FROM
 (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}')) AS ip FROM documents)) GROUP BY doc_id, ip, n""")
def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 addresses as numbers."""
    ip = F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), F.lit(0)))
    found = table(spark, sf_dir, "documents").select("doc_id", ip.alias("ip")).distinct()
    number = rel.ip_number(F.col("ip"))
    return found.select("doc_id", "ip", number.isNotNull().alias("valid"), number.alias("number"))


@query("""WITH p AS (SELECT * FROM (VALUES (1, 'P', 0.5), (2, 'PR', 0.9), (3, '', 0.1)) t(ord, prefix, price))
SELECT o_orderkey, price FROM (SELECT o_orderkey, price, row_number() OVER (PARTITION BY o_orderkey ORDER BY ord) AS rn FROM orders JOIN p ON starts_with(o_orderpriority, prefix)) WHERE rn = 1""")
def prefix_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first matching prefix of an ordered price list of fixed size."""
    p = spark.createDataFrame([(1, "P", 0.5), (2, "PR", 0.9), (3, "", 0.1)], "ord int, prefix string, price double")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(F.broadcast(p), F.col("o_orderpriority").startswith(F.col("prefix")))
    return o.groupBy("o_orderkey").agg(F.min_by("price", "ord").cast("decimal(2,1)").alias("price"))


@query("""WITH p AS (SELECT * FROM (VALUES (1, 'small', 5, 905.0), (2, 'medium', 20, 910.0), (3, 'large', 40, 915.0)) t(ord, tier, min_size, min_price))
SELECT p_partkey, tier FROM (SELECT p_partkey, tier, row_number() OVER (PARTITION BY p_partkey ORDER BY ord DESC) AS rn FROM part JOIN p ON p_size >= min_size AND p_retailprice >= min_price) WHERE rn = 1""")
def preset_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """both limits of a preset must hold; the highest preset counts."""
    p = spark.createDataFrame([(1, "small", 5, 905.0), (2, "medium", 20, 910.0), (3, "large", 40, 915.0)], "ord int, tier string, min_size int, min_price double")
    hit = table(spark, sf_dir, "part").join(F.broadcast(p), (F.col("p_size") >= F.col("min_size")) & (F.col("p_retailprice") >= F.col("min_price")))
    return hit.groupBy("p_partkey").agg(F.max_by("tier", "ord").alias("tier"))


@query("""SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""")
def region_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 with A1: a star join, aggregated before the dimensions are joined, and rolled up."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("k"), F.sum("c_acctbal").alias("b"))
    j = c.join(table(spark, sf_dir, "nation"), "n_nationkey").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.rollup("r_name", "n_name").agg(F.sum("k").alias("customers"), F.round(F.sum("b"), 2).alias("balance"))


@query("""SELECT event_type, user_id, event_id, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 3""")
def top_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of each group."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("event_type", "user_id", "event_id", "rn")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def price_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1-A4 over the largest relational table."""
    l = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'"))
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"),
        F.round(F.avg("l_discount"), 6).alias("discount"), F.count(F.lit(1)).alias("n"),
    )
