"""Parsers and rewriters. Their inputs are made from the tables' keys, so the twin can say what each must give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parsing as p
from lodestone.functions import text as t
from lodestone.operators import ids, technical
from lodestone.sources.tables import table

from .base import query


def made(*parts: Column | str) -> Column:
    """Text of strings and columns, one after another."""
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN NULL ELSE '[{"query":"| search a=' || p_size || '"}]' END AS items, CASE WHEN p_partkey % 3 = 2 THEN 'qna' ELSE 'action' END AS kind,
CASE WHEN p_partkey % 3 < 2 THEN '[{"query":"search a=' || p_size || '"}]' END AS cleaned FROM part""")
def json_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON array in an answer, what kind of answer that makes it, and its queries cleaned."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 2, made("no array [here")).otherwise(made("Answer: ", '[{"query":"| search a=', F.col("p_size"), '"}]', " as asked"))
    parts = p.json_array_parts(text)
    return table(spark, sf_dir, "part").select("p_partkey", parts["items"].alias("items"), p.answer_kind(text).alias("kind"), p.cleaned_queries(parts["items"]).alias("cleaned"))


@query("""SELECT p_partkey, 'stats count by ' || p_size || '|sort b' AS blocks, 'see ```query' || chr(10) || 'fixed ' || p_size || chr(10) || '``` and ```' || chr(10) || 'sort b``` end' AS replaced FROM part""")
def query_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of fenced blocks, and a text with the first one replaced."""
    text = made("see ```query stats count by ", F.col("p_size"), "``` and ```\nsort b``` end")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(t.code_blocks(text), "|").alias("blocks"), p.with_first_block(text, made("fixed ", F.col("p_size"))).alias("replaced"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '{"a": ' || p_size || '}' WHEN 1 THEN '{"a": ' || p_size || '}' ELSE 'plain ' || p_size END AS body, CASE WHEN p_partkey % 3 < 2 THEN '{"a": ' || p_size || '}' END AS object FROM part""")
def json_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The body of a fenced or plain answer, and the object in it."""
    k, body = F.col("p_partkey") % 3, made('{"a": ', F.col("p_size"), "}")
    text = F.when(k == 0, made("x ```json\n", body, "\n``` y")).when(k == 1, made("```", body, "```")).otherwise(made(" plain ", F.col("p_size"), " "))
    return table(spark, sf_dir, "part").select("p_partkey", t.fenced_json(text).alias("body"), t.json_object(text).alias("object"))


@query("""SELECT c_custkey, array_to_string(list_filter([trim(x) FOR x IN regexp_split_to_array(lower(c_mktsegment) || ' | ' || c_nationkey || '; ;x,y', '[|;,]')], lambda a: a <> ''), '/') AS aliases,
CASE WHEN length(trim(' ' || c_nationkey || ' is ')) >= 5 THEN trim(' ' || c_nationkey || ' is ') END AS question FROM customer""")
def alias_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X15, X17."""
    text = made(F.lower("c_mktsegment"), " | ", F.col("c_nationkey"), "; ;x,y")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(t.aliases(text), "/").alias("aliases"), p.question(made(" ", F.col("c_nationkey"), " is ")).alias("question"))


@query("""SELECT item_id, array_to_string(list_slice(list_sort(list_distinct(list_concat(['alpha', 'beta'], list_slice(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), 1, 5)))), 1, 10), '|') AS words FROM benchmark""")
def keyword_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given keywords and the first words of a text; the cut to ten is the function's own."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(p.keywords(F.lit("alpha, beta,,"), F.col("text")), "|").alias("words"))


@query("""SELECT p_partkey, 'syntax-error' AS kind, p_size AS position, 'near ' || p_name AS note, 'query' AS header, replace(p_name, ' ', '/') AS components FROM part""")
def error_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of error messages and of file names."""
    e = p.error_parts(made(" syntax-error: bad token at offset ", F.col("p_size"), ", note: near ", F.col("p_name")))
    f = p.file_parts(made("query-", F.replace("p_name", F.lit(" "), F.lit("-")), ".yaml"))
    return table(spark, sf_dir, "part").select("p_partkey", e["kind"].alias("kind"), e["position"].alias("position"), e["note"].alias("note"), f["header"].alias("header"), F.array_join(f["components"], "/").alias("components"))


@query("""WITH e AS (SELECT event_id, event_id % 7 + 1 AS a, event_id % 5 AS b FROM events) SELECT event_id, round(a / (a + b + 2.0), 6)::DOUBLE AS qna, round(b / (a + b + 2.0), 6)::DOUBLE AS plan, round(2 / (a + b + 2.0), 6)::DOUBLE AS action, a / 10.0::DOUBLE AS json_qna FROM e""")
def named_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores in free text (in percent, too) and in JSON of either case."""
    a, b = F.col("event_id") % 7 + 1, F.col("event_id") % 5
    s = p.free_scores(made("I say QnA: ", a, ", plan = ", b, " and action: 2."))
    j = p.intent_json(made('sure {"QNA": ', a / 10, ', "plan": "x"} done'))
    return table(spark, sf_dir, "events").select("event_id", s["qna"].alias("qna"), s["plan"].alias("plan"), s["action"].alias("action"), j["qna"].alias("json_qna"))


_STEM = "CASE WHEN ends_with(w, '{0}') AND length(w) - {1} >= 3 THEN left(w, length(w) - {1}) || '{2}' END"
_LONGER = ", ".join(_STEM.format(gone, len(gone), new) for gone, new in p.ENDINGS)
_SHORTER = ", ".join(_STEM.format(new, len(new), gone) for gone, new in p.ENDINGS)


@query(f"""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), f AS (SELECT w, list_concat(list_concat([w], [x FOR x IN [{_LONGER}] IF length(x) <= 15]), [x FOR x IN [{_SHORTER}] IF x IS NOT NULL]) AS f FROM t),
u AS (SELECT w, unnest(f) AS v, unnest(range(len(f))) AS i FROM f), d AS (SELECT w, v, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT w, v, row_number() OVER (PARTITION BY w ORDER BY length(v), i) AS rn FROM d)
SELECT w AS word, string_agg(v, ',' ORDER BY rn) AS variants FROM r WHERE rn <= 5 GROUP BY w""")
def variant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of the words of the benchmark by rules of endings, shorter ones first, at most five."""
    w = table(spark, sf_dir, "benchmark").select(F.explode(t.found(F.lower("text"), "[a-z]+")).alias("word")).distinct()
    return w.select("word", F.array_join(p.word_variants(F.col("word")), ",").alias("variants"))


@query("""WITH w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'that')) AS w, [lower(x) FOR x IN regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')] AS ph FROM benchmark),
l AS (SELECT item_id, list_concat(list_concat(ph, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), w) AS c FROM w), u AS (SELECT item_id, unnest(c) AS c, unnest(range(len(c))) AS i FROM l), f AS (SELECT item_id, c, min(i) AS i FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS rn FROM f)
SELECT item_id, string_agg(c, '|' ORDER BY i) AS concepts FROM r WHERE rn <= 10 GROUP BY item_id""")
def text_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X21, T-22, W10: capitalised phrases, neighbours, words; the first ten are the concepts."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(p.english_concepts(F.col("text")), "|").alias("concepts"))


@query("""SELECT p_partkey, 'Title' || chr(10) || 'bold text and ' || p_name || chr(10) || 'item' || chr(10) || '```a **b**```' || chr(10) || 'x y' AS plain, 'ok  fine' AS no_emoji FROM part""")
def plain_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-4: markdown goes, fenced blocks stay; emoji go."""
    text = made("## Title\n**bold** text and [", F.col("p_name"), "](http://x)\n- item\n```a **b**```\n| x | y |")
    return table(spark, sf_dir, "part").select("p_partkey", p.without_markdown(text).alias("plain"), p.without_emoji(F.lit("ok 😀 fine☀")).alias("no_emoji"))


@query("""SELECT p_partkey, 'Do ' || p_name || '.' || chr(10) || 'Then stop.' AS prompt, CASE p_partkey % 3 WHEN 0 THEN 'widget' WHEN 1 THEN 'ring' ELSE 'else' END AS term FROM part""")
def cleaned_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-7, T-10: the date section and tags go; terms take the dictionary's form."""
    text = made("<b>Do ", F.col("p_name"), ".</b>\nCurrent date: today\nyear 2024\n\nThen stop.")
    k = F.col("p_partkey") % 3
    term = F.when(k == 0, " Wid Get ").when(k == 1, "RING").otherwise("Else")
    return table(spark, sf_dir, "part").select("p_partkey", p.without_dates(text).alias("prompt"), p.normal_term(term, {"widget": "widget", "ring": "ring"}).alias("term"))


@query("""SELECT p_partkey, 'Alpha zulu beta ' || p_size AS repaired, '__0__ 가 __1__ ' || p_size AS marked, 'report 가 zulu ' || p_size AS back FROM part""")
def protected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-12, T-13: words lost in a translation come back; words are marked before it and restored after."""
    x = p.protected(made("report 가 zulu ", F.col("p_size")))
    d = table(spark, sf_dir, "part").select("p_partkey", "p_size", x.alias("x"))
    return d.select("p_partkey", p.repaired_keywords(made("beta ", F.col("p_size")), F.lit("Alpha zulu beta")).alias("repaired"), F.col("x.text").alias("marked"), p.restored(F.col("x.text"), F.col("x.words")).alias("back"))


@query("""SELECT item_id, '[' || (item_id + 1) || ']' || chr(10) || 'Question: ' || trim(text) || CASE WHEN item_id % 2 = 0 THEN chr(10) || 'Note: even' ELSE '' END AS line FROM benchmark""")
def context_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-14, W9, M19."""
    line = p.context_line(F.col("item_id") + 1, [("Question", F.col("text")), ("Note", F.when(F.col("item_id") % 2 == 0, "even").otherwise(" "))])
    return table(spark, sf_dir, "benchmark").select("item_id", line.alias("line"))


@query("""SELECT p_partkey, 'table a=' || p_size || '~search "x|y"~join [ search b|c ]' AS parts, 'table a=' || p_size || ' "two lines" x' || chr(10) || 'search [ b c ]' AS joined FROM part""")
def split_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-15, T-16, T-17: pipes outside of quotes and brackets part a query; lines are joined while one is open; table lines go."""
    q = made("table a=", F.col("p_size"), ' | search "x|y" || join [ search b|c ]')
    lines = made("| a | b |\n|---|---|\ntable a=", F.col("p_size"), ' "two\nlines" x\n\nsearch [ b\nc ]\n...')
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    # A file may hold a million short rows in one group, which one task reads: they are dealt out before the work on them.
    dealt = parts.repartition(ids.deals(parts, 50_000))
    return dealt.select("p_partkey", F.array_join(p.pipe_parts(q), "~").alias("parts"), p.joined_lines(lines).alias("joined"))


@query("""SELECT p_partkey, '---' || chr(10) || 'a: ' || p_size || chr(10) || 'b' AS yaml, 'yes ' || p_size AS final, CASE WHEN p_partkey % 2 = 0 THEN 'table x=' || p_size || ' | stats count' ELSE 'stats count' END AS based, 'größe ' || p_size AS msg FROM part""")
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-20, T-24, T-25, T-26: line ends restored, the final channel kept, fragments based on the query before, Latin-1 read again as UTF-8."""
    even = F.col("p_partkey") % 2 == 0
    final = p.final_channel(made("think <|channel|>final <|x|>yes ", F.col("p_size"), "� <end_of_turn> rest"))
    based = p.based(F.when(even, "| stats count").otherwise("stats count"), made("table x=", F.col("p_size"), " | search y"))
    return table(spark, sf_dir, "part").select("p_partkey", p.yaml_text(made("a: ", F.col("p_size"), "¶b")).alias("yaml"), final.alias("final"), based.alias("based"), p.demojibaked(made("grÃ¶Ã\u009fe ", F.col("p_size"))).alias("msg"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'l1' || chr(10) || 'l2' ELSE '(no data)' END || chr(10) || '---' || chr(10) || '[1] ' || p_name || chr(10) || '[2] b' AS ticket, CASE WHEN p_partkey % 2 = 0 THEN 'bad' ELSE 'free text' END AS analysis, CASE WHEN p_partkey % 2 = 0 THEN 'attack' ELSE 'unknown' END AS kind, p_partkey % 2 = 0 AS brief FROM part""")
def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-27, T-28, T-29."""
    even = F.col("p_partkey") % 2 == 0
    lines = F.when(even, F.array(F.lit("l1"), F.lit("l2"))).otherwise(F.array().cast("array<string>"))
    a = p.analysis(F.when(even, F.lit('x {"analysis": "bad", "kind": "attack"} y')).otherwise(F.lit("free text")))
    m = p.mode_flag(F.when(even, "go --brief now").otherwise("go now"))
    return table(spark, sf_dir, "part").select("p_partkey", p.ticket(lines, F.array(F.col("p_name"), F.lit("b"))).alias("ticket"), a["analysis"].alias("analysis"), a["kind"].alias("kind"), m["brief"].alias("brief"))


@query("""SELECT p_partkey, i AS ordinal, CASE i WHEN 1 THEN 'find ' || p_name ELSE '' END AS msg, CASE i WHEN 1 THEN 'qna' ELSE 'action' END AS category, 'pending' AS status FROM part, (VALUES (1), (2)) v(i) WHERE p_partkey % 4 <> 3""")
def planned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-30, G7: steps of a plan with defaults; plans that do not parse have none."""
    text = F.when(F.col("p_partkey") % 4 == 3, F.lit("no plan")).otherwise(made('plan: [{"msg": "find ', F.col("p_name"), '", "category": "qna"}, {}]'))
    s = table(spark, sf_dir, "part").select("p_partkey", F.explode(p.plan_items(text)).alias("s"))
    return s.select("p_partkey", "s.ordinal", "s.msg", "s.category", "s.status")


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS k, year(o_orderdate) AS y FROM orders) SELECT o_orderkey, CASE k WHEN 0 THEN '' WHEN 1 THEN '2023' WHEN 2 THEN '2022,2024' ELSE '1999,2022' END AS years,
'table from=' || CASE k WHEN 0 THEN '2024' WHEN 1 THEN '2023' WHEN 2 THEN '2022' ELSE '1999' END || '0101000000 to=' || CASE k WHEN 0 THEN '2024' WHEN 1 THEN '2023' WHEN 2 THEN '2024' ELSE '2022' END || '1231235959' AS query FROM o""")
def patched_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years that a question names, and the times of a query moved to them; a day ends at 23:59:59."""
    k = F.col("o_orderkey") % 4
    asked = F.when(k == 0, "show all").when(k == 1, "last year please").when(k == 2, "this year and the year before last").otherwise("from 1999 to 2022")
    years = p.years_named(asked, 2024)
    q = p.with_years(F.lit("table from=20200101000000 to=20201231235959"), years, 2024)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(years, lambda y: y.cast("string")), ",").alias("years"), q.alias("query"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN conv_id % 2 = 1 THEN translate(text, 'aeiou', '😀😁😂😃😄') ELSE text END AS t FROM conversations),
u AS (SELECT conv_id, turn, t, [struct_pack(c := c, at := i - 1 + len(regexp_extract_all(left(t, i - 1), '[\\x{10000}-\\x{10FFFF}]')), w := CASE WHEN regexp_matches(c, '[\\x{10000}-\\x{10FFFF}]') THEN 2 ELSE 1 END) FOR c, i IN string_split(left(t, 25), '')] AS l FROM c)
SELECT conv_id, turn, CAST(length(t) + len(regexp_extract_all(t, '[\\x{10000}-\\x{10FFFF}]')) AS INTEGER) AS units, array_to_string([x.c FOR x IN l IF x.at >= 5 AND x.at + x.w <= 25], '') AS slice FROM u""")
def utf16_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-21, Z1: lengths and slices in UTF-16 units; vowels of every second conversation take two units each."""
    text = F.when(F.col("conv_id") % 2 == 1, F.translate("text", "aeiou", "😀😁😂😃😄")).otherwise(F.col("text"))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return c.select("conv_id", "turn", t.utf16_units(F.col("text")).alias("units"), t.utf16_slice(F.col("text"), 5, 25).alias("slice"))


@query("""SELECT p_partkey, 'show logs of ' || p_name AS asked, 'a [data] b' AS masked, CASE WHEN p_partkey % 2 = 0 THEN 'own' WHEN p_partkey % 3 = 0 THEN 'sub' ELSE 'default' END AS setting, CASE WHEN p_partkey % 2 = 0 THEN 'no_where' ELSE '' END AS broken FROM part""")
def stripped_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X4, T-6, M20, V4: spans of time go from a question, long runs of base64 are masked, the first setting counts, rules of a plug-in."""
    k = F.col("p_partkey")
    asked = t.without_times(made("show logs of ", F.col("p_name"), " in the last 3 days yesterday"))
    blob = t.without_blobs(F.concat(F.lit("a "), F.repeat(F.lit("Zm9v"), 200), F.lit(" b")))
    value = p.setting(F.when(k % 2 == 0, "own"), F.when(k % 3 == 0, "sub"), F.lit("default"))
    broken = p.validated(F.when(k % 2 == 0, "table x | where y").otherwise("table x"), {"no_where": r"\|\s*where\b", "no_head": r"\|\s*head\b"})
    return table(spark, sf_dir, "part").select("p_partkey", asked.alias("asked"), blob.alias("masked"), value.alias("setting"), F.array_join(broken, ",").alias("broken"))


@query(None)
def technical_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most telling pieces of documents' technical content."""
    return table(spark, sf_dir, "documents").select("doc_id", technical.technical_parts(F.col("text")).alias("parts")).where("parts IS NOT NULL")
