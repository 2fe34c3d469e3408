"""Intent scores of events, made from their values so that every branch occurs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import intent as i
from lodestone.sources.tables import table

from .base import query

RAW = """r AS (SELECT event_id, (event_id % 7) / 5.0 AS q, (event_id % 5) / 5.0 AS p, (event_id % 3) / 5.0 AS a FROM events),
c AS (SELECT event_id, greatest(0, least(1, q)) AS q, greatest(0, least(1, p)) AS p, greatest(0, least(1, a)) AS a FROM r),
v AS (SELECT event_id, CASE WHEN q + p + a <= 0 THEN 0.33 WHEN abs(q + p + a - 1) > 0.01 THEN q / (q + p + a) ELSE q END AS q,
CASE WHEN q + p + a <= 0 THEN 0.33 WHEN abs(q + p + a - 1) > 0.01 THEN p / (q + p + a) ELSE p END AS p,
CASE WHEN q + p + a <= 0 THEN 0.34 WHEN abs(q + p + a - 1) > 0.01 THEN a / (q + p + a) ELSE a END AS a FROM c)"""
BEST = "CASE WHEN q >= greatest(p, a) THEN 'qna' WHEN p >= a THEN 'plan' ELSE 'action' END"


def raw(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, i.Scores]:
    e = F.col("event_id")
    return table(spark, sf_dir, "events"), ((e % 7) / 5.0, (e % 5) / 5.0, (e % 3) / 5.0)


@query(f"WITH {RAW} SELECT event_id, round(q, 6) AS qna, round(p, 6) AS plan, round(a, 6) AS action, {BEST} AS best FROM v")
def validated_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M13 and the choice of the best."""
    e, s = raw(spark, sf_dir)
    v = i.validated(s)
    return e.select("event_id", *(F.round(x, 6).alias(n) for x, n in zip(v, ("qna", "plan", "action"), strict=True)), i.best(v).alias("best"))


@query(f"""WITH {RAW}, o AS (SELECT *, list_reverse_sort([round(q, 9), round(p, 9), round(a, 9)]) AS o, {BEST} AS best FROM v)
SELECT event_id, best, o[1] - o[2] >= 0.4 AND o[1] >= 0.6 AS clear, o[2] >= 0.30 AND round(o[1] - o[2], 12) <= 0.3 AS multi,
CASE WHEN o[1] - o[2] >= 0.4 AND o[1] >= 0.6 THEN CASE WHEN best = 'qna' THEN 0.85 ELSE 0.075 END ELSE round(q, 9) END::DOUBLE AS qna FROM o""")
def sharpened_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M14, M16."""
    e, s = raw(spark, sf_dir)
    v = tuple(F.round(x, 9) for x in i.validated(s))
    o = F.reverse(F.array_sort(F.array(*v)))
    return e.select("event_id", i.best(v).alias("best"), ((o[0] - o[1] >= 0.4) & (o[0] >= 0.6)).alias("clear"), i.multi(v).alias("multi"), i.sharpened(v)[0].alias("qna"))


@query(f"""WITH {RAW}, m AS (SELECT event_id, q, p, a, (event_id % 4) / 4.0 AS x, (event_id % 6) / 6.0 AS y, 0.25 AS z FROM v),
f AS (SELECT event_id, {BEST} AS m, CASE WHEN x >= greatest(y, z) THEN 'qna' WHEN y >= z THEN 'plan' ELSE 'action' END AS r, q, .4 * q + .6 * x AS fq, .4 * q + .6 * x + .4 * p + .6 * y + .4 * a + .6 * z AS t FROM m)
SELECT event_id, round(CASE WHEN m = r THEN q WHEN t > 0 THEN fq / t ELSE fq END, 6) AS qna FROM f""")
def fused_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M11."""
    e, s = raw(spark, sf_dir)
    n = F.col("event_id")
    return e.select("event_id", F.round(i.fused(i.validated(s), ((n % 4) / 4.0, (n % 6) / 6.0, F.lit(0.25)))[0], 6).alias("qna"))


@query("SELECT doc_id, (contains(lower(text), 'the'))::INT + (contains(lower(text), 'and'))::INT + (contains(lower(text), 'der'))::INT AS hits FROM documents")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M12, F17."""
    return table(spark, sf_dir, "documents").select("doc_id", i.keyword_hits(F.col("text"), ["the", "and", "der"]).alias("hits"))
