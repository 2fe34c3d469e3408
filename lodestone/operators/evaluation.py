"""Evaluation aggregates and verdict rules. Nulls are left out of means and break no rule; empty tables give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t

#: The rules of an answer's verdict, with the pattern that breaks each.
RULES = {
    "token_leak": r"<\|[a-z_]+\|>|</?(?:start|end)_of_turn>",
    "where_in_query": r"(?i)\|\s*where\b",
    "uppercase_boolean": r"\b(?:AND|OR|NOT)\b",
    "forbidden_command": r"(?i)\|\s*(?:head|order)\b",
    "string_ip_compare": r"(?i)ip\s*==?\s*\"[0-9.]+\"",
}


def sampled(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def mean_positive(score: Column, digits: int = 2) -> Column:
    """Mean of the scores above 0, null if there are none."""
    return F.round(F.avg(F.when(score > 0, score)), digits)


def weighted_score(probabilities: Column) -> Column:
    """Sum of score * percent / 100 over a map of score -> percent, to two digits."""
    return F.round(F.aggregate(F.map_entries(probabilities), F.lit(0.0), lambda s, e: s + e["key"].cast("double") * e["value"] / 100), 2)


def verdict(answer: Column, intent: Column) -> Column:
    """Names of the broken rules; query rules look at fenced blocks alone."""
    blocks = t.code_blocks(F.coalesce(answer, F.lit("")))
    in_block = lambda p: F.exists(blocks, lambda b: b.rlike(p))
    hits = [F.when(answer.rlike(RULES["token_leak"]), "token_leak"), F.when((intent == "QNA") & answer.rlike(r'(?s)\[\s*\{\s*"'), "action_json_in_qna")]
    hits += [F.when(in_block(p), name) for name, p in RULES.items() if name != "token_leak"]
    return F.array_compact(F.array(*hits))


def code_check(answer: Column, errors: Column) -> Column:
    blocks = t.code_blocks(answer)
    return F.when(answer.isNull(), "ERROR").when(F.size(blocks) == 0, "NO_QUERY").when(errors > 0, "FAIL").otherwise("PASS")


def knowledge_checks(docs: DataFrame) -> DataFrame:
    """(name, problem): what is wrong with each enabled knowledge document (name, enabled, question, answer, spec)."""
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    problems = F.array_compact(F.array(F.when(blank("name"), "no name"), F.when(blank("question"), "no question"), F.when(blank("answer") & blank("spec"), "no answer")))
    return docs.where(F.coalesce("enabled", F.lit(True))).select("name", F.explode(problems).alias("problem"))
