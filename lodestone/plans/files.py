"""Scans of files. The inputs are written from tables into the session's shared folder, as the tables are Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import files
from lodestone.sources.tables import shared, table

from .base import query
from .parsing import made


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, 'said \"hi\", then' || chr(10) || c_custkey AS note, c_custkey || ' ' || c_name || ' said \"hi\", then' || chr(10) || c_custkey AS text FROM customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files of a folder and its subfolders; rows without questions and answers become text."""
    path = shared(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", made('said "hi", then\n', F.col("c_custkey")).alias("note"))
    files.append_csv(rows.where("c_custkey % 2 = 0"), f"{path}/a")
    files.append_csv(rows.where("c_custkey % 2 = 1"), f"{path}/b/c")
    return files.csv_rows(spark, path).select("c_custkey", "c_name", "note", "text")


@query("""SELECT 'item' AS kind, count(*) AS n, count(DISTINCT p_partkey) AS distinct_values FROM part WHERE p_partkey % 50 <> 3 UNION ALL SELECT 'rejected', count(DISTINCT p_partkey % 8), NULL FROM part WHERE p_partkey % 50 = 3""")
def json_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON files with an array of objects each; files that don't parse are set apart with the reason."""
    path = shared(spark, "json")
    p = table(spark, sf_dir, "part").select("p_partkey")
    good = p.where("p_partkey % 50 <> 3").groupBy(F.floor(F.col("p_partkey") / 100).alias("g")).agg(F.to_json(F.collect_list(F.struct("p_partkey"))).alias("value"))
    bad = p.where("p_partkey % 50 = 3").groupBy((-1 - F.col("p_partkey") % 8).alias("g")).agg(made("{broken ", F.min("p_partkey")).alias("value"))
    both = good.unionByName(bad)
    # One file for each group: the writer's files are named by the partition, and hold one line each.
    both.repartitionByRange(64, "g").write.partitionBy("g").text(path)
    items, rejected = files.json_rows(spark, path, "*.txt")
    key = F.get_json_object("item", "$.p_partkey").cast("long")
    return items.agg(F.lit("item").alias("kind"), F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("distinct_values")).unionByName(
        rejected.agg(F.lit("rejected").alias("kind"), F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("distinct_values"))
    )


@query("SELECT p_partkey, p_name || chr(10) || 'size <' || p_size || '> & more' || chr(10) || 'raw <x>' AS text FROM part")
def xml_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text nodes of XML documents."""
    xml = made('<?xml version="1.0"?><!-- c --><a k="v"> <b>', F.col("p_name"), "</b>\n<c>size &lt;", F.col("p_size"), "&gt; &amp; more</c> <d><![CDATA[raw &lt;x&gt;]]></d></a>")
    return table(spark, sf_dir, "part").select("p_partkey", files.xml_text(xml).alias("text"))


@query("SELECT c_custkey, 'web' AS tag, c_name AS name, CAST(8000 + c_custkey % 100 AS VARCHAR) AS port, 'a=b' AS note FROM customer WHERE c_custkey % 3 <> 0")
def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated lines with pairs; comments and blank lines are skipped."""
    line = F.when(F.col("c_custkey") % 3 == 0, "# comment").otherwise(made("web\t", F.col("c_name"), "\tport=", 8000 + F.col("c_custkey") % 100, "\tnote=a=b"))
    r = table(spark, sf_dir, "customer").select("c_custkey", files.registry_line(line).alias("r")).where("r IS NOT NULL")
    return r.select("c_custkey", "r.tag", "r.name", F.try_element_at("r.pairs", F.lit("port")).alias("port"), F.try_element_at("r.pairs", F.lit("note")).alias("note"))


@query("""SELECT c_custkey AS path, unnest(['', 'main', 'main', 'other']) AS section, unnest(['top', 'port', 'host', 'port']) AS key, unnest([c_mktsegment, CAST(8000 + c_nationkey AS VARCHAR), c_name || ' x', CAST(c_custkey AS VARCHAR)]) AS value FROM customer""")
def settings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings of INI files, each with the section above it."""
    text = made("top = ", F.col("c_mktsegment"), "\n; comment\n[main]\nport=", 8000 + F.col("c_nationkey"), "\nhost : ", F.col("c_name"), " x\n\n[other]\n# no = yes\nport = ", F.col("c_custkey"))
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path"), F.posexplode(F.split(text, "\n")).alias("n", "line"))
    return files.settings(lines)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS date, CASE WHEN user_id % 4 = 0 THEN 'REST_API' ELSE 'u' || user_id END AS user, count(*) AS n FROM events GROUP BY ALL""")
def logged_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in folders by day, in the order of users, read back."""
    path = shared(spark, "log")
    user = F.when(F.col("user_id") % 4 != 0, made("u", F.col("user_id")))
    files.chat_log(table(spark, sf_dir, "events").select("ts", user.alias("user"), "event_type"), path)
    log = spark.read.schema("ts string, user string, event_type string, date string").csv(path, header=True)
    return log.groupBy("date", "user").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'nodes' AS entity, count(DISTINCT p_name) AS n FROM part UNION ALL SELECT 'relations', count(*) FROM (SELECT DISTINCT p_name, p_brand FROM part)""")
def saved_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph's entities saved as one snapshot, a table each, and loaded again."""
    p = table(spark, sf_dir, "part")
    graph = {"nodes": p.select(F.col("p_name").alias("id")).distinct(), "relations": p.select("p_name", "p_brand").distinct()}
    path = shared(spark, "graph")
    files.save_snapshot(graph, path)
    back = files.load_snapshot(spark, path, list(graph))
    counts = [df.agg(F.lit(name).alias("entity"), F.count(F.lit(1)).alias("n")) for name, df in back.items()]
    return counts[0].unionByName(counts[1])
