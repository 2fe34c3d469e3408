"""Korean and English side by side. Every second text is written in Hangul, letter by letter, in the query and in its twin."""

from __future__ import annotations

from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import concepts as c
from lodestone.functions import text as t
from lodestone.operators import knowledge_graph, terms
from lodestone.sources.tables import table

from .base import query

#: A syllable for every letter, particles among them.
SYLLABLES = "가나다라이마은바는사를아에자의차로카으타과파와하을거"


def in_hangul(text: Column) -> Column:
    return F.translate(F.lower(text), ascii_lowercase, SYLLABLES)


def _listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


MIXED = f"SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN translate(lower(text), '{ascii_lowercase}', '{SYLLABLES}') ELSE text END AS t FROM documents"
LONG, ONE = tuple(p for p in c.PARTICLES if len(p) == 2), tuple(p for p in c.PARTICLES if len(p) == 1)


CONCEPTS = f"""w AS (SELECT doc_id, t, regexp_matches(t, '[가-힣]') AS ko, [x FOR x IN regexp_split_to_array(coalesce(t, ''), '\\s+') IF length(x) > 1] AS w FROM d),
s AS (SELECT doc_id, t, ko, CASE WHEN ko THEN [CASE WHEN right(x, 2) IN ({_listed(LONG)}) THEN left(x, length(x) - 2) WHEN right(x, 1) IN ({_listed(ONE)}) THEN left(x, length(x) - 1) ELSE x END FOR x IN w IF x NOT IN ({_listed(c.KOREAN_STOP)})]
  ELSE [lower(x) FOR x IN w IF length(x) > 2 AND lower(x) NOT IN ({_listed(c.ENGLISH_STOP)})] END AS s FROM w),
b AS (SELECT doc_id, t, ko, [x FOR x IN s IF length(x) > 1] AS s FROM s),
e AS (SELECT doc_id, list_concat(list_concat(CASE WHEN ko THEN [] ELSE regexp_extract_all(t, '{c.PHRASE}') END, [p FOR p IN [s[i] || ' ' || s[i + 1] FOR i IN range(1, len(s))] IF length(p) > CASE WHEN ko THEN 3 ELSE 4 END]), s) AS e FROM b),
u AS (SELECT doc_id, unnest(e) AS name, unnest(range(len(e))) AS i FROM e), k AS (SELECT doc_id, lower(name) AS key, min(i) AS i, arg_min(name, i) AS name FROM u WHERE length(name) > 2 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM k)"""


@query(f"""WITH d AS ({MIXED}), {CONCEPTS}
SELECT doc_id, string_agg(name, '|' ORDER BY i) AS concepts FROM r WHERE rn <= 10 GROUP BY doc_id""")
def mixed_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21, T-22: concepts of texts in either script; particles and stop words go, forms of one term count once."""
    text = F.when(F.col("doc_id") % 2 == 1, in_hangul(F.col("text"))).otherwise(F.col("text"))
    named = F.array(F.array_join(c.concepts(text), "|"))
    # A condition on a selected column is worked out again below the selection; one on exploded rows is not.
    return table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(named).alias("concepts")).where("concepts <> ''")


@query(f"""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN translate(lower(text), 'aeiou', '가이는의과') ELSE text END AS t FROM documents)
SELECT doc_id, len(regexp_extract_all(t, '[가-힣]')) AS hangul, len(regexp_extract_all(t, '[A-Za-z]')) AS latin, CASE WHEN regexp_matches(t, '[가-힣]') AND regexp_matches(t, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(t, '[가-힣]') THEN 'ko' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' END AS script
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN regexp_replace(t, '[A-Za-z]', '', 'g') ELSE t END AS t FROM d)""")
def scripts_of_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-11: ko, en or mixed; vowels of every second text are Hangul, and every third has no Latin letters."""
    vowels = F.when(F.col("doc_id") % 2 == 1, F.translate(F.lower("text"), "aeiou", "가이는의과")).otherwise(F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 1, F.regexp_replace(vowels, "[A-Za-z]", "")).otherwise(vowels).alias("t"))
    return d.select("doc_id", F.regexp_count("t", F.lit("[가-힣]")).cast("long").alias("hangul"), F.regexp_count("t", F.lit("[A-Za-z]")).cast("long").alias("latin"), t.script_of(F.col("t")).alias("script"))


DEFAULTS = ", ".join(f"('{k}', '{e}', 0, {i}, 0)" for i, (k, e) in enumerate(terms.DEFAULT_TERMS))


@query(f"""WITH p AS (SELECT p_partkey AS ord, p_name AS en, translate(lower(p_name), '{ascii_lowercase}', '{SYLLABLES}') AS ko, p_type FROM part),
f AS (SELECT ord, CASE ord % 3 WHEN 0 THEN en ELSE ko END AS name, CASE ord % 3 WHEN 0 THEN [en || ' 1', ko, ko || '가'] WHEN 1 THEN ['#' || ord, upper(en)] ELSE [ko] END AS aliases, CASE WHEN ord % 2 = 0 THEN [ko, p_type, '사용자', 'user' || ord] ELSE [p_type, ko || '나'] END AS parts FROM p),
n AS (SELECT *, regexp_matches(name, '[가-힣]') AS ko FROM f),
a AS (SELECT ord, name, ko, [x FOR x IN aliases IF CASE WHEN ko THEN regexp_full_match(x, '[a-zA-Z\\s]+') ELSE regexp_matches(x, '[가-힣]') AND regexp_full_match(name, '[a-zA-Z\\s]+') END][1] AS x FROM n),
s AS (SELECT ord, i, parts[i] AS l, parts[i + 1] AS r FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM f)),
c AS (SELECT lower(CASE WHEN ko THEN name ELSE x END) AS term, lower(CASE WHEN ko THEN x ELSE name END) AS other, 1 AS kind, ord, 0 AS i FROM a WHERE x IS NOT NULL
  UNION ALL SELECT lower(CASE WHEN regexp_matches(l, '[가-힣]') THEN l ELSE r END), lower(CASE WHEN regexp_matches(l, '[가-힣]') THEN r ELSE l END), 2, ord, i - 1 FROM s WHERE (regexp_matches(l, '[가-힣]') AND regexp_full_match(r, '[a-zA-Z\\s]+')) OR (regexp_matches(r, '[가-힣]') AND regexp_full_match(l, '[a-zA-Z\\s]+'))
  UNION ALL SELECT * FROM (VALUES {DEFAULTS}) v),
b AS (SELECT term, arg_max(other, (kind, ord, i)) AS other, min((kind, ord, i)) AS first FROM c GROUP BY term),
e AS (SELECT term, other, 0 AS level, first, 0 AS k FROM b UNION ALL SELECT replace(term, ' ', ''), other, 1, first, 0 FROM b WHERE contains(term, ' ') UNION ALL SELECT term, replace(other, ' ', ''), 1, first, 1 FROM b WHERE contains(other, ' ')),
m AS (SELECT term, arg_max(other, (level, first, k)) AS other FROM e GROUP BY term), w AS (SELECT term, other FROM m UNION SELECT other, term FROM m)
SELECT term, string_agg(other, ',' ORDER BY other) AS others FROM w GROUP BY term""")
def shared_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two languages from names, aliases and file names, later ones first, with forms without blanks, in both directions."""
    ko, k = in_hangul(F.col("p_name")), F.col("p_partkey")
    aliases = F.when(k % 3 == 0, F.array(F.concat("p_name", F.lit(" 1")), ko, F.concat(ko, F.lit("가")))).when(k % 3 == 1, F.array(F.concat(F.lit("#"), k.cast("string")), F.upper("p_name"))).otherwise(F.array(ko))
    stem = F.when(k % 2 == 0, F.concat_ws("-", ko, "p_type", F.lit("사용자"), F.concat(F.lit("user"), k.cast("string")))).otherwise(F.concat_ws("-", "p_type", F.concat(ko, F.lit("나"))))
    files = table(spark, sf_dir, "part").select(k.alias("ord"), stem.alias("stem"), F.when(k % 3 == 0, F.col("p_name")).otherwise(ko).alias("name"), aliases.alias("aliases"))
    return terms.in_both_directions(terms.term_map(files)).select("term", F.array_join("others", ",").alias("others"))


@query(f"""WITH base AS (SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN translate(lower(text), '{ascii_lowercase}', '{SYLLABLES}') ELSE text END AS q, CASE WHEN doc_id % 7 = 0 THEN '' ELSE source END || '-' || lang || '-' || lpad(CAST(doc_id % 50 AS VARCHAR), 2, '0') AS stem FROM documents),
d AS (SELECT doc_id, q AS t FROM base WHERE doc_id % 5 <> 0), {CONCEPTS},
cc AS (SELECT doc_id, 'concept_' || left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9가-힣]', '_', 'g'), '_+', '_', 'g'), 50) AS id FROM r WHERE rn <= 10 AND length(name) >= 3),
ff AS (SELECT doc_id, q, regexp_replace(regexp_replace(lower(stem), '[^a-z0-9가-힣]', '_', 'g'), '_+', '_', 'g') AS stem, string_split(stem, '-') AS p FROM base),
nn AS (SELECT 'document' AS type, 'document_' || stem AS id FROM ff UNION SELECT 'question', 'question_' || stem FROM ff WHERE doc_id % 5 <> 0 AND q <> '' UNION SELECT 'concept', id FROM cc UNION SELECT 'header', 'header_' || p[1] FROM ff WHERE p[1] <> '' UNION SELECT 'component', 'component_' || unnest(p[2:]) FROM ff),
ee AS (SELECT 'has_question' AS type, 'document_' || stem AS s, 'question_' || stem AS g, 1.0 AS w, doc_id FROM ff WHERE doc_id % 5 <> 0 AND q <> '' UNION ALL SELECT 'mentions_concept', 'question_' || stem, id, 1.0, doc_id FROM ff JOIN cc USING (doc_id) UNION ALL SELECT 'contains_concept', 'document_' || stem, id, 1.0, doc_id FROM ff JOIN cc USING (doc_id)
  UNION ALL SELECT 'has_header', 'document_' || stem, 'header_' || p[1], 1.2, doc_id FROM ff WHERE p[1] <> '' UNION ALL SELECT 'has_component', 'document_' || stem, 'component_' || p[i + 2], 1.0 + 0.1 * i, doc_id FROM ff, (VALUES (0), (1)) v(i) UNION ALL SELECT 'contains_component', 'header_' || p[1], 'component_' || p[i + 2], 1.0, doc_id FROM ff, (VALUES (0), (1)) v(i) WHERE p[1] <> ''),
uu AS (SELECT type, s, g, arg_min(w, (doc_id, w)) AS w FROM ee GROUP BY ALL)
SELECT 'node' AS kind, type, count(*) AS n, NULL::DOUBLE AS weight, bit_xor(CAST('0x' || left(md5(id), 15) AS BIGINT)) AS digest FROM nn GROUP BY type UNION ALL SELECT 'edge', type, count(*), round(sum(w), 3)::DOUBLE, bit_xor(CAST('0x' || left(md5(s || '>' || g), 15) AS BIGINT)) FROM uu GROUP BY type""")
def typed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as typed nodes and six kinds of weighted edges, made in one expansion; counts, weights and digests by kind."""
    k = F.col("doc_id")
    stem = F.concat_ws("-", F.when(k % 7 == 0, "").otherwise(F.col("source")), "lang", F.lpad((k % 50).cast("string"), 2, "0"))
    asked = F.when(k % 2 == 1, in_hangul(F.col("text"))).otherwise(F.col("text"))
    files = table(spark, sf_dir, "documents").select(k.alias("ord"), stem.alias("stem"), stem.alias("name"), F.when(k % 5 != 0, asked).alias("question"), F.array("lang").alias("aliases"))
    nodes, edges = knowledge_graph.built(files)
    digest = lambda c: F.bit_xor(F.conv(F.left(F.md5(c), F.lit(15)), 16, 10).cast("long")).alias("digest")
    n = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("weight"), digest(F.col("id"))).select(F.lit("node").alias("kind"), "*")
    e = edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 3).alias("weight"), digest(F.concat("source", F.lit(">"), "target"))).select(F.lit("edge").alias("kind"), "*")
    return n.unionByName(e)
