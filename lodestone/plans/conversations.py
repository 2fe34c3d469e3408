"""Queries over conversations and event sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import conversation as c
from lodestone.sources.tables import table

from .base import query


@query("""WITH k AS (SELECT conv_id, turn, role, CASE WHEN length(trim(text)) > 300 THEN substr(trim(text), 1, 300) || '... (cut)' ELSE trim(text) END AS text FROM conversations WHERE length(trim(text)) > 0),
l AS (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS p FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, role, md5(text) AS digest FROM l WHERE NOT (r IS NOT DISTINCT FROM role AND p IS NOT DISTINCT FROM text)""")
def cleaned_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W6, T-5, T-18."""
    return c.cleaned(table(spark, sf_dir, "conversations"), 300).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("""SELECT conv_id, turn, tokens, used FROM (SELECT conv_id, turn, CAST(floor(length(text) / 4) AS BIGINT) AS tokens,
CAST(sum(floor(length(text) / 4)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS used FROM conversations) WHERE used <= 200""")
def budgeted_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W4, T-23."""
    return c.within_budget(table(spark, sf_dir, "conversations"), 200).select("conv_id", "turn", "tokens", "used")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W5."""
    return c.last_turns(table(spark, sf_dir, "conversations"), 3).select("conv_id", "turn", "role")


@query("SELECT conv_id, max(turn) AS turn, md5(arg_max(text, turn)) AS digest FROM conversations WHERE role = 'user' GROUP BY conv_id")
def last_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8."""
    return c.last_by_role(table(spark, sf_dir, "conversations"), "user").select("conv_id", "turn", F.md5("text").alias("digest"))


@query("""WITH g AS (SELECT conv_id, turn, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS group_no FROM conversations)
SELECT conv_id, turn, role, group_no, CAST(row_number() OVER (PARTITION BY conv_id, group_no ORDER BY turn) AS INTEGER) AS step_no FROM g""")
def plan_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn starts a group; rows after it are its steps."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return c.islands(turns, "conv_id", "turn", F.col("role") == "user").select("conv_id", "turn", "role", F.col("group_no").cast("long"), "step_no")


@query("""WITH m AS (SELECT conv_id, turn, role = 'assistant' AS bot, CASE WHEN role = 'assistant' AND turn % 4 = 1 THEN '*질문[' || turn || '/4]*: ' || text WHEN role <> 'assistant' AND turn % 4 = 2 THEN '<@U0AB' || turn || '> ' WHEN role <> 'assistant' THEN ' <@U0AB' || turn || '>' || text || '<@lower>' ELSE text END AS t FROM conversations),
c AS (SELECT conv_id, turn, bot, CASE WHEN bot THEN t ELSE trim(regexp_replace(t, '<@[A-Z0-9]+>', '', 'g'), ' ' || chr(9) || chr(10) || chr(13)) END AS content FROM m WHERE NOT (bot AND contains(t, '*질문[') AND contains(t, ']*:'))),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM c WHERE bot OR content <> '')
SELECT conv_id, turn, CASE WHEN bot THEN 'assistant' ELSE 'user' END AS speaker, md5(content) AS content FROM k WHERE NOT (rn = 1 AND NOT bot)""")
def thread_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status lines of the bot and mentions go, blank questions go, and a trailing question is not history."""
    bot, turn = F.col("role") == "assistant", F.col("turn").cast("string")
    status = F.concat(F.lit("*질문["), turn, F.lit("/4]*: "), F.col("text"))
    only, around = F.concat(F.lit("<@U0AB"), turn, F.lit("> ")), F.concat(F.lit(" <@U0AB"), turn, F.lit(">"), F.col("text"), F.lit("<@lower>"))
    text = F.when(bot & (F.col("turn") % 4 == 1), status).when(~bot & (F.col("turn") % 4 == 2), only).when(~bot, around).otherwise(F.col("text"))
    return c.thread_history(table(spark, sf_dir, "conversations").select("conv_id", "turn", bot.alias("bot"), text.alias("text"))).select("conv_id", "turn", "speaker", F.md5("content").alias("content"))


@query("""SELECT role, count(*) AS calls, CAST(sum(floor(length(text) / 4)) AS BIGINT) AS tokens, CAST(sum(len(regexp_split_to_array(trim(text), '\\s+'))) AS BIGINT) AS words FROM conversations GROUP BY role""")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16, A24, T-23."""
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("role").agg(F.count(F.lit(1)).alias("calls"), F.sum(t.token_estimate(F.col("text"))).alias("tokens"), F.sum(t.word_count(F.col("text")).cast("long")).alias("words"))


@query("""WITH s AS (SELECT *, coalesce(epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER w >= 3600, TRUE) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, CAST(sum(n::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM s)
SELECT user_id, session, count(*) AS events, round(sum(value), 6) AS total FROM g GROUP BY 1, 2""")
def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions end after an hour of silence."""
    s = c.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)
    return s.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total"))
