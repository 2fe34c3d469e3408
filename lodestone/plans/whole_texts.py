"""Parsers over whole texts of the tables: what is parsed stands between texts of documents, benchmark items and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parsing as p
from lodestone.functions import text as t
from lodestone.operators import knowledge, pii
from lodestone.sources.tables import table

from .base import query
from .parsing import made
from .pii import EXAMPLES

BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(f"""WITH d AS (SELECT doc_id, lang, translate(text, '[]{{}}`"\\', '') AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(t || ' ') END AS before, CASE WHEN doc_id % 3 = 0 THEN md5(chr(10) || t) END AS after, CASE WHEN doc_id % 3 = 0 THEN 'action' ELSE 'qna' END AS kind,
CASE WHEN doc_id % 3 = 0 THEN '[{{"query":"search a=' || doc_id || '","note":"' || lang || '"}}]' END AS cleaned,
md5(CASE doc_id % 3 WHEN 0 THEN trim(t || ' [{{"query": "| search a=' || doc_id || '", "note": "' || lang || '"}}]' || chr(10) || t, {BLANK}) WHEN 1 THEN '{{"a": "' || lang || '", "n": ' || doc_id || '}}' ELSE trim(t, {BLANK}) END) AS body,
CASE doc_id % 3 WHEN 0 THEN '{{"query": "| search a=' || doc_id || '", "note": "' || lang || '"}}' WHEN 1 THEN '{{"a": "' || lang || '", "n": ' || doc_id || '}}' END AS object FROM d""")
def json_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON array and object within an answer, what kind that makes it, its queries cleaned, the body of its fence."""
    k, plain = F.col("doc_id") % 3, F.translate("text", '[]{}`"\\', "")
    listed = made(plain, ' [{"query": "| search a=', F.col("doc_id"), '", "note": "', F.col("lang"), '"}]\n', plain)
    fenced = made(plain, '\n```json\n{"a": "', F.col("lang"), '", "n": ', F.col("doc_id"), "}\n```\n", plain)
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 0, listed).when(k == 1, fenced).otherwise(plain).alias("answer"))
    parts = p.json_array_parts(F.col("answer"))
    d = d.select("doc_id", "answer", parts.alias("parts"))
    return d.select(
        "doc_id", F.md5("parts.before").alias("before"), F.md5("parts.after").alias("after"), p.answer_kind(F.col("answer")).alias("kind"), p.cleaned_queries(F.col("parts.items")).alias("cleaned"),
        F.md5(t.fenced_json(F.col("answer"))).alias("body"), t.json_object(F.col("answer")).alias("object"),
    )


@query("""WITH b AS (SELECT item_id, string_split(text, chr(10))[1] AS q, text AS a, array_to_string([x FOR x IN [trim(regexp_replace(l, '^[-*# ]+', '')) FOR l IN string_split(text, chr(10))] IF x <> ''], chr(10)) AS lines FROM benchmark WHERE length(trim(text)) > 0)
SELECT item_id, i AS item, CASE i WHEN 1 THEN CASE WHEN item_id % 3 = 2 THEN trim(regexp_replace(q, '^[-*# ]+', '')) ELSE q END ELSE 'and ' || item_id END AS question, md5(CASE WHEN i = 2 THEN 'three' WHEN item_id % 3 = 2 THEN lines ELSE a END) AS answer, CASE WHEN i = 1 THEN 'x/y' ELSE '' END AS aliases FROM b, (VALUES (1), (2)) v(i)""")
def items_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and answers from a JSON array, from objects one on a line, or from tagged lines; an item's whole text is an answer."""
    k, q, lines = F.col("item_id") % 3, F.get(F.split("text", "\n"), F.lit(0)), F.split("text", "\n")
    one = F.to_json(F.struct(q.alias("question"), F.col("text").alias("answer"), F.array(F.lit("x"), F.lit("y")).alias("aliases")))
    two = made('{"question": "and ', F.col("item_id"), '", "answer": "three"}')
    tagged = made("Sure:\n- Q: ", q, "\nA: ", F.array_join(lines, "\n\n"), "\nAL: x | y\n**Question: and ", F.col("item_id"), "\nanswer: three\nQ: never answered")
    text = F.when(k == 0, made("Sure:\n[", one, ", ", two, "]\n")).when(k == 1, made("Sure:\n", one, ",\nbroken {\n", two)).otherwise(tagged)
    b = table(spark, sf_dir, "benchmark").where("length(trim(text)) > 0").select("item_id", F.posexplode(knowledge.qna_items(text)).alias("i", "x"))
    return b.select("item_id", (F.col("i") + 1).alias("item"), "x.question", F.md5("x.answer").alias("answer"), F.coalesce(F.array_join("x.aliases", "/"), F.lit("")).alias("aliases"))


@query(f"""WITH b AS (SELECT item_id, translate(text, '|"[]\\', '') AS t FROM benchmark)
SELECT item_id, md5('table a=' || item_id || '~search "' || t || '|y"~' || trim(t, ' ') || '~join [ search ' || t || '|c ]') AS parts, md5('table a=' || item_id || ' "' || array_to_string([trim(x, {BLANK}) FOR x IN string_split(t, chr(10)) IF trim(x, {BLANK}) <> ''], ' ') || '" x' || chr(10) || 'search [ b c ]') AS joined FROM b WHERE trim(t, {BLANK}) <> ''""")
def queries_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-15, T-16, T-17: pipes part a query outside of quotes and brackets, which hold whole texts; lines are joined while one is open."""
    plain = F.translate("text", '|"[]\\', "")
    q = made("table a=", F.col("item_id"), ' | search "', plain, '|y" || ', plain, " | join [ search ", plain, "|c ]")
    lines = made("| a | b |\n|---|---|\ntable a=", F.col("item_id"), ' "', plain, '" x\n\nsearch [ b\nc ]\n...')
    b = table(spark, sf_dir, "benchmark").where(F.regexp_replace(plain, r"\s", "") != "")
    return b.select("item_id", F.md5(F.array_join(p.pipe_parts(q), "~")).alias("parts"), F.md5(p.joined_lines(lines)).alias("joined"))


EXAMPLE_ROWS = ", ".join(f"({k}, '{e}', '{x}', {s})" for k, (e, x, s) in enumerate(EXAMPLES))


@query(f"""WITH v AS (SELECT * FROM (VALUES {EXAMPLE_ROWS}) v(k, entity, example, score)), b AS (SELECT item_id, translate(text, '0123456789@:=-', '') AS t FROM benchmark)
SELECT item_id, k, entity, CAST(length(t) + 13 + CASE WHEN contains(example, '법인 ') THEN 3 WHEN contains(example, '계좌 ') THEN 3 WHEN contains(example, '건강보험 ') THEN 5 ELSE 0 END AS INTEGER) AS first, round(score, 6)::DOUBLE AS score,
md5(t || ' of of of of ' || CASE WHEN contains(example, '법인') THEN '법인 ' WHEN contains(example, '계좌') THEN '계좌 ' WHEN contains(example, '건강보험') THEN '건강보험 ' ELSE '' END || '<' || entity || '> x ' || t) AS masked FROM b, v""")
def values_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity between whole texts, with its place and score, and the irreversible mask."""
    plain = F.translate("text", "0123456789@:=-", "")
    every = F.posexplode(F.array(*(F.lit(x) for _, x, _ in EXAMPLES))).alias("k", "example")
    b = table(spark, sf_dir, "benchmark").select("item_id", plain.alias("t"), every)
    b = b.select("item_id", "k", made(F.col("t"), " of of of of ", F.col("example"), " ", F.col("t")).alias("text"))
    f = b.select("item_id", "k", pii.irreversible(F.col("text")).alias("masked"), F.explode(pii.findings("text")).alias("f"))
    return f.select("item_id", "k", "f.entity", "f.first", F.round("f.score", 6).alias("score"), F.md5("masked").alias("masked"))


@query("""WITH c AS (SELECT conv_id, turn, regexp_replace(lower(text), '[0-9]|\\b(now|today|yesterday|tomorrow|recently|last|past|previous|this|next|from|until|since|between)\\b', '', 'g') AS t FROM conversations)
SELECT conv_id, turn, md5(trim(regexp_replace('logs of ' || t || ' please', '\\s+', ' ', 'g'))) AS asked, md5(t || ' [data] ' || t) AS masked FROM c""")
def questions_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, T-6: spans of time go from whole texts, and long runs of base64 are masked in them."""
    plain = F.regexp_replace(F.lower("text"), r"[0-9]|\b(now|today|yesterday|tomorrow|recently|last|past|previous|this|next|from|until|since|between)\b", "")
    asked = t.without_times(made("logs of today ", plain, " in the last 3 days 2024-01-02T03:04 2 weeks ago please"))
    masked = t.without_blobs(made(plain, " ", F.repeat(F.lit("Zm9v"), 200), " ", plain))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(asked).alias("asked"), F.md5(masked).alias("masked"))
