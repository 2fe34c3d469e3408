"""Windows over conversations: cleaning, budgets, islands.

Turns are ordered by `turn` within a conversation; of turns with one number any may come first. Null texts are blank: they are cleaned
away, cost no tokens, and can be a role's last message. Empty tables give no rows; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t


def cleaned(turns: DataFrame, size: int = 2000) -> DataFrame:
    """Blank messages go, long ones are cut and blobs masked, then repeats of the message just before go."""
    body = t.cut(t.without_blobs(F.trim("text")), size, "... (cut)")
    kept = turns.where(F.length(F.trim("text")) > 0).withColumn("text", body)
    w = Window.partitionBy("conv_id").orderBy("turn")
    same = F.lag("role").over(w).eqNullSafe(F.col("role")) & F.lag("text").over(w).eqNullSafe(F.col("text"))
    return kept.withColumn("_same", same & F.lag("turn").over(w).isNotNull()).where(~F.col("_same")).drop("_same")


def last_turns(turns: DataFrame, n: int = 10) -> DataFrame:
    """The newest n turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def within_budget(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns whose tokens fit: stops at the first that overflows, as sums only grow."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("tokens", t.token_estimate(F.col("text"))).withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def last_by_role(turns: DataFrame, role: str) -> DataFrame:
    """(conv_id, text, turn) of the newest turn of a role; conversations without one have no row."""
    return turns.where(F.col("role") == role).groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"), F.max("turn").alias("turn"))


def islands(rows: DataFrame, key: str, order: str, boundary) -> DataFrame:
    """group_no and step_no of runs: a row where `boundary` holds starts a run."""
    w = Window.partitionBy(key).orderBy(order)
    out = rows.withColumn("group_no", F.sum(F.when(boundary, 1).otherwise(0)).over(w))
    return out.withColumn("step_no", F.row_number().over(Window.partitionBy(key, "group_no").orderBy(order)))


def sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Sessions that end after `gap_seconds` of silence or more, numbered for each key. Times count as whole seconds, rounded, halves to the even one."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    second = F.rint(F.unix_micros(F.col(ts).cast("timestamp")) / 1e6)
    new = F.coalesce((second - F.lag(second).over(w)) >= gap_seconds, F.lit(True))
    return events.withColumn("_new", new).withColumn("session", F.sum(F.col("_new").cast("int")).over(w)).drop("_new")


# A mention in a message, and what a status line of the bot holds.
MENTION, STATUS = "<@[A-Z0-9]+>", ("*질문[", "]*:")


def thread_history(messages: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, speaker, content) of messages (conv, turn, bot, text): status lines and mentions go, blank questions too, and so does a question at the end.

    A null text is a blank one; a bot's blank message stays.
    """
    text = F.coalesce("text", F.lit(""))
    content = F.when(F.col("bot"), text).otherwise(F.regexp_replace(F.regexp_replace(text, MENTION, ""), r"^\s+|\s+$", ""))
    status = F.col("bot") & F.contains(text, F.lit(STATUS[0])) & F.contains(text, F.lit(STATUS[1]))
    rows = messages.where(~status).select(conv, turn, "bot", content.alias("content")).where(F.col("bot") | (F.col("content") != ""))
    last = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(turn)))
    kept = rows.withColumn("last_", last).where((F.col("last_") > 1) | F.col("bot"))
    return kept.select(conv, turn, F.when(F.col("bot"), "assistant").otherwise("user").alias("speaker"), "content")
