"""Texts of the tables with placeholders, marks and blocks put in between their words, and rewritten."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rewrite as r
from lodestone.sources.tables import table

from .base import query

#: The moment that the queries take for now.
NOW = datetime.datetime(2024, 3, 5, 7, 8, 9)


def with_every(text: Column, step: int, at: int, new) -> Column:
    """The text with each word whose number is `at` modulo `step` replaced by `new` of it and its number."""
    return F.array_join(F.transform(F.split(text, " "), lambda w, i: F.when(i % step == at, new(w, i)).otherwise(w)), " ")


@query("""SELECT doc_id, array_to_string([CASE (i - 1) % 40 WHEN 7 THEN strftime(DATE '2024-03-05' - CAST(i - 1 AS INTEGER), '%Y%m%d') || '000000' WHEN 11 THEN '20240305070809' WHEN 13 THEN 'from=' || '20240305070809' || ',to=' || strftime(DATE '2024-03-05' - 3, '%Y%m%d') || '000000' WHEN 17 THEN '20260113' || '000000' ELSE w END FOR w, i IN string_split(regexp_replace(text, '\\bnow\\b|\\$', '', 'g'), ' ')], ' ') AS text FROM documents""")
def dated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of the current time and of days before it, anywhere in a text."""

    def put(w: Column, i: Column) -> Column:
        days = F.concat(F.lit("$CUR_DATE_MINUS_"), i.cast("string"), F.lit("D$"))
        return F.when(i % 40 == 7, days).when(i % 40 == 11, "$CUR_DATE$ $CUR_TIME$").when(i % 40 == 13, "from=now(),to=$CUR_DATE_MINUS_3D$").when(i % 40 == 17, "20260113T000000").otherwise(w)

    plain = F.regexp_replace("text", r"\bnow\b|\$", "")
    text = with_every(plain, 1, 0, put)
    return table(spark, sf_dir, "documents").select("doc_id", r.with_times(text, F.lit(NOW)).alias("text"))


@query("""SELECT conv_id, turn, array_to_string([CASE WHEN (i - 1) % 9 = 4 AND length(w) % 2 = 1 THEN '<KR\\_NAME\\_x' || (i - 1) || '>' ELSE w END FOR w, i IN string_split(text, ' ')], ' ') AS text,
len([1 FOR w, i IN string_split(text, ' ') IF (i - 1) % 9 = 4 AND length(w) % 2 = 0]) AS marks FROM conversations""")
def repaired_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hidden behind marks that a model has escaped or spaced come back; marks that nobody gave stay."""

    def put(w: Column, i: Column) -> Column:
        n = i.cast("string")
        unknown = F.concat(F.lit(r"<KR\_NAME\_x"), n, F.lit(">"))
        known = F.when(i % 3 == 0, F.concat(F.lit("<KR_NAME_"), n, F.lit(">"))).when(i % 3 == 1, F.concat(F.lit(r"<KR\_NAME\_"), n, F.lit(">"))).otherwise(F.concat(F.lit("< KR_NAME _"), n, F.lit(" >")))
        return F.when(F.length(w) % 2 == 1, unknown).otherwise(known)

    numbered = F.filter(F.transform(F.split("text", " "), lambda w, i: F.struct(F.concat(F.lit("<KR_NAME_"), i.cast("string"), F.lit(">")).alias("key"), w.alias("value"), i.alias("i"))), lambda e: (e["i"] % 9 == 4) & (F.length(e["value"]) % 2 == 0))
    marks = F.map_from_entries(F.transform(numbered, lambda e: F.struct(e["key"], e["value"])))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", marks.alias("marks"), with_every(F.col("text"), 9, 4, put).alias("altered"))
    return rows.select("conv_id", "turn", r.unmasked(F.col("altered"), F.col("marks")).alias("text"), F.size("marks").cast("long").alias("marks"))


@query("""WITH d AS (SELECT doc_id, replace(text, '`', '') AS t, string_split(replace(text, '`', ''), chr(10))[1] AS head FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '```' || chr(10) || head || chr(10) || '```' || chr(10) || '```query' || chr(10) || 'best \\1 $2 ' || doc_id || chr(10) || '``` and ```query' || chr(10) || 'x' || chr(10) || '```' || t
  WHEN 1 THEN head || '```query' || chr(10) || 'best \\1 $2 ' || doc_id || chr(10) || '```' || t WHEN 2 THEN head || '````query' || chr(10) || 'best \\1 $2 ' || doc_id || chr(10) || '````' ELSE t END AS text FROM d""")
def corrected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first query block of an answer gets the corrected query; other blocks and texts without one stay."""
    t = F.replace("text", F.lit("`"), F.lit(""))
    head = F.get(F.split(t, "\n"), F.lit(0))
    k = F.col("doc_id") % 4
    answer = (
        F.when(k == 0, F.concat(F.lit("```\n"), head, F.lit("\n```\n```query\n"), t, F.lit("\n``` and ```query\nx\n```"), t))
        .when(k == 1, F.concat(head, F.lit("```query\n"), F.replace(t, F.lit("\n"), F.lit(" ")), F.lit("```"), t))
        .when(k == 2, F.concat(head, F.lit("````query \n"), t, F.lit("\n````"))).otherwise(t)
    )
    body = F.concat(F.lit(r"best \1 $2 "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", r.with_corrected_block(answer, body).alias("text"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, lang, source, text FROM documents), f AS (SELECT doc_id, text, l[1] AS q, coalesce(l[2], '') AS cot, coalesce(l[3], '') AS spec, coalesce(array_to_string(l[4:], ' '), '') AS a, lang, source FROM d),
p AS (SELECT *, trim(q, chr(9) || chr(10) || chr(13) || ' ') AS tq, trim(cot, chr(9) || chr(10) || chr(13) || ' ') AS tc, trim(spec, chr(9) || chr(10) || chr(13) || ' ') AS ts, trim(a, chr(9) || chr(10) || chr(13) || ' ') AS ta FROM f),
j AS (SELECT doc_id, text, concat_ws(' ', CASE WHEN q <> '' THEN '질문: ' || tq END, CASE WHEN cot <> '' THEN '추론과정: ' || tc END, CASE WHEN spec <> '' THEN '명세: ' || ts END, CASE WHEN a <> '' THEN '답변: ' || ta END, '앱코드: ' || source, CASE WHEN doc_id % 3 = 0 THEN '필수파라미터: ' || lang || '(str)[선택사항][기본값:' || source || ']: of 예시:x ' || source || '(int): ' || lang END, CASE WHEN doc_id % 2 = 0 THEN 'keywords: ' || lang || ' ' || source END) AS store,
  concat_ws(' ', CASE WHEN q <> '' THEN '질문: ' || tq END, CASE WHEN cot <> '' THEN '추론과정: ' || tc END, CASE WHEN a <> '' THEN '답변: ' || ta END, CASE WHEN doc_id % 2 = 1 THEN '관련키워드: ' || source END, CASE WHEN doc_id % 2 = 0 THEN 'keywords: ' || lang || ' ' || source END) AS trial,
  concat_ws(' ', CASE WHEN q <> '' THEN '질문: ' || tq END, CASE WHEN cot <> '' THEN '추론과정: ' || tc END, CASE WHEN spec <> '' THEN '명세: ' || ts END, CASE WHEN a <> '' THEN '답변: ' || ta END) AS prompt,
  trim('Question:' || chr(10) || q || chr(10) || chr(10) || 'Chain of Thought:' || chr(10) || cot || chr(10) || chr(10) || 'Answer:' || chr(10) || a, chr(9) || chr(10) || chr(13) || ' ') AS sections FROM p)
SELECT doc_id, left(CASE WHEN store = '' THEN text ELSE store END, 6000) AS store, left(CASE WHEN trial = '' THEN text ELSE trial END, 6000) AS trial, CASE WHEN prompt = '' THEN text ELSE prompt END AS prompt, sections FROM j""")
def texts_to_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways in which a document's fields make the text that is embedded. The lines of a text are its fields."""
    lines = F.split("text", "\n")
    line = lambda i: F.coalesce(F.get(lines, F.lit(i)), F.lit(""))
    param = lambda name, kind, text, optional, default, example: F.struct(name.alias("name"), F.lit(kind).alias("type"), text.alias("description"), F.lit(optional).alias("optional"), default.alias("default"), example.alias("example"))
    none = F.lit(None).cast("string")
    require = F.array(param(F.col("lang"), "str", F.lit("of"), True, F.col("source"), F.lit("x")), param(F.col("source"), "int", F.col("lang"), False, none, none))
    k = F.col("doc_id")
    fields = {
        "question": line(0), "cot": line(1), "spec": line(2), "answer": F.array_join(F.slice(lines, 4, F.greatest(F.lit(1), F.size(lines))), " "), "app_code": F.col("source"),
        "require": F.when(k % 3 == 0, r.requirements(require)), "aliases": F.when(k % 2 == 1, F.col("source")), "keywords": F.when(k % 2 == 0, F.concat_ws(" ", "lang", "source")),
    }
    return table(spark, sf_dir, "documents").select("doc_id", *(r.text_to_embed(fields, kind, F.col("text")).alias(kind) for kind in ("store", "trial", "prompt", "sections")))
