"""Scalar text functions over documents, pages and benchmark items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.sources.tables import table

from .base import query


@query("""SELECT item_id, CASE WHEN s = '' THEN 'item' ELSE s END AS slug, n AS node FROM (SELECT item_id, trim(substr(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), 1, 40), '-') AS s,
substr(regexp_replace(regexp_replace(lower(text), '[^a-z0-9가-힣]', '_', 'g'), '_+', '_', 'g'), 1, 50) AS n FROM benchmark)""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-8, T-9."""
    return table(spark, sf_dir, "benchmark").select("item_id", t.slug(F.col("text")).alias("slug"), t.node_id(F.col("text")).alias("node"))


@query("""SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview, '****' || right(CAST(doc_id + 1000000 AS VARCHAR), 4) AS masked,
CAST(floor(length(text) / 4) AS BIGINT) AS tokens, len(regexp_split_to_array(trim(text), '\\s+')) AS words FROM documents WHERE length(trim(text)) > 0""")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-18, T-19, T-23."""
    d = table(spark, sf_dir, "documents").where(F.length(F.trim("text")) > 0)
    return d.select("doc_id", t.cut(F.col("text"), 100).alias("preview"), t.masked_key((F.col("doc_id") + 1000000).cast("string")).alias("masked"), t.token_estimate(F.col("text")).alias("tokens"), t.word_count(F.col("text")).cast("long").alias("words"))


@query("""SELECT doc_id, coalesce(array_to_string(list_slice(w, 1, 5), ' '), '') AS head, coalesce(md5(array_to_string([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))], '|')), '') AS pairs
FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents)""")
def word_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five words, and all neighbouring ones as a digest."""
    d = table(spark, sf_dir, "documents").select("doc_id", t.term_counts(F.coalesce("text", F.lit(""))).alias("w"))
    return d.select("doc_id", F.array_join(F.slice("w", 1, 5), " ").alias("head"), F.md5(F.array_join(t.bigrams(F.col("w")), "|")).alias("pairs"))


@query("""SELECT item_id, 'id: ' || CAST(item_id AS VARCHAR) || CASE WHEN length(trim(text)) > 0 THEN ' text: ' || trim(text) ELSE '' END AS joined FROM benchmark""")
def embedding_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled parts joined for embedding."""
    return table(spark, sf_dir, "benchmark").select("item_id", t.labelled_text([("id", F.col("item_id").cast("string")), ("text", F.col("text")), ("note", F.lit(""))]).alias("joined"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, len(string_split(regexp_replace(url, '^[a-z]+://', ''), '/')) AS depth FROM pages""")
def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a path."""
    rest = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.size(F.split(rest, "/")).cast("long").alias("depth"))


@query(None)
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S5, T-4: text of pages without their tags."""
    return table(spark, sf_dir, "pages").select("page_id", t.without_tags(F.col("html")).alias("text"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp, strftime(date_trunc('day', ts) - INTERVAL 7 DAY, '%Y%m%d%H%M%S') AS week_before,
CAST(CAST(ts AS DATE) + CASE WHEN event_type = 'view' THEN 30 ELSE 365 END AS DATE) AS renewed FROM events""")
def time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D1, D2, D5, D6."""
    ts = F.col("ts")
    unit = F.when(F.col("event_type") == "view", "month").otherwise("year")
    return table(spark, sf_dir, "events").select("event_id", t.stamp(ts).alias("stamp"), t.day_start(ts, 7).alias("week_before"), t.renewed(ts.cast("date"), F.lit(1), unit).alias("renewed"))


@query("""SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]')) AS latin, CASE WHEN regexp_matches(text, '[가-힣]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[가-힣]') THEN 'ko' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END AS script FROM documents""")
def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-11."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.regexp_count("text", F.lit("[A-Za-z]")).cast("long").alias("latin"), t.script_of(F.col("text")).alias("script"))


@query("""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}'))) AS emails, len(regexp_extract_all(text, '[0-9]{16}')) AS cards FROM documents""")
def pattern_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incidence of plain patterns."""
    d = table(spark, sf_dir, "documents")
    emails = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}"), F.lit(0))))
    return d.select("doc_id", emails.cast("long").alias("emails"), F.size(F.regexp_extract_all("text", F.lit("[0-9]{16}"), F.lit(0))).cast("long").alias("cards"))


@query("""SELECT lang, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, count(*) FILTER (length(text) <= 28 AND len(regexp_split_to_array(trim(text), '\\s+')) <= 3) AS short_texts FROM documents GROUP BY lang""")
def shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F18, F19."""
    short = (F.length("text") <= 28) & (F.size(F.split(F.trim("text"), r"\s+")) <= 3)
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.size(F.split("text", "\n")).cast("long")).alias("lines"), F.count_if(short).alias("short_texts"))
