"""Evaluation queries over events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import evaluation as e
from lodestone.sources.tables import table

from .base import query


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(avg(CASE WHEN value > 0 THEN value END), 2) AS mean_positive FROM events GROUP BY event_type")
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9, A10."""
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("mean"), e.mean_positive(v).alias("mean_positive"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) WHERE rn <= 2")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W3."""
    return e.sampled(table(spark, sf_dir, "events"), "event_type", "event_id", 2).select("event_type", "event_id")


@query("SELECT event_id, round(1.0 * (event_id % 50) / 100 + 5.0 * (100 - event_id % 50) / 100, 2)::DOUBLE AS weighted FROM events")
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    p = F.col("event_id") % 50
    return table(spark, sf_dir, "events").select("event_id", e.weighted_score(F.create_map(F.lit("1"), p.cast("double"), F.lit("5"), (100 - p).cast("double"))).alias("weighted"))


@query("""SELECT conv_id, count(*) AS steps, count(*) FILTER (role = 'assistant') AS done, printf('%.1f', 100.0 * count(*) FILTER (role = 'assistant') / count(*)) AS progress FROM conversations GROUP BY conv_id""")
def workflow_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A23, A19."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("role") == "assistant").alias("done"))
    return g.withColumn("progress", F.format_string("%.1f", F.try_divide(F.col("done") * 100.0, F.col("steps"))))


@query("""SELECT problem, count(*) AS n FROM (SELECT unnest([CASE WHEN length(text) < 500 THEN 'short' END, CASE WHEN contains(text, '!!') THEN 'noisy' END, CASE WHEN lang <> 'en' THEN 'foreign' END]) AS problem FROM documents) WHERE problem IS NOT NULL GROUP BY problem""")
def validation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems by kind."""
    found = F.array_compact(F.array(F.when(F.length("text") < 500, "short"), F.when(F.contains("text", F.lit("!!")), "noisy"), F.when(F.col("lang") != "en", "foreign")))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(None)
def answer_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1, V6: verdicts of assistant turns; their rules need patterns over fenced blocks."""
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    broken = e.verdict(F.col("text"), F.lit("QNA"))
    return turns.select("conv_id", "turn", F.array_join(broken, ",").alias("broken"), e.code_check(F.col("text"), F.size(broken)).alias("code"))
