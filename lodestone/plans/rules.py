"""Rules over questions, manifests, requests and names, on inputs made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import rules
from lodestone.functions import text as t
from lodestone.functions import vectors
from lodestone.operators import manifest
from lodestone.sources import yaml
from lodestone.sources.tables import table, written

from .base import query
from .parsing import made

#: Question, is it casual, complete, only parameters.
QUESTIONS = [
    ("hello there", True, False, True), ("hi", True, False, True), ("weather of 10.0.0.1", False, False, True), ("show me the firewall log of last week", False, True, True),
    ("what is a port scan?", False, True, True), ("보여줘", True, False, True), ("2024-01-05", False, False, True), ("어제 로그를 조회해줘", False, True, True), ("123", True, False, True),
    ("please write a long poem about rivers and hills and query nothing", False, True, False), ("여행 계획 세워줄래요", True, True, True), ("list all of the many different kinds of data", False, False, False),
]
QUESTION_SQL = ", ".join(f"({k}, '{q}', {c}, {f}, {p})" for k, (q, c, f, p) in enumerate(QUESTIONS))


@query(f"WITH q AS (SELECT * FROM (VALUES {QUESTION_SQL}) v(k, question, casual, complete, parameters)) SELECT c_custkey, question, casual, complete, parameters FROM customer JOIN q ON k = c_custkey % {len(QUESTIONS)}")
def question_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small talk, questions that stand on their own, answers that only give values. What each must be is stated by hand."""
    text = F.element_at(F.array(*(F.lit(q) for q, *_ in QUESTIONS)), (F.col("c_custkey") % len(QUESTIONS) + 1).cast("int"))
    c = table(spark, sf_dir, "customer").select("c_custkey", text.alias("question"))
    return c.select("c_custkey", "question", rules.casual(F.col("question"), ["firewall", "port", "log"]).alias("casual"), rules.complete(F.col("question")).alias("complete"), rules.parameters_only(F.col("question")).alias("parameters"))


def _any(text: str, words: list[str]) -> str:
    return f"len([x FOR x IN {words!r} IF contains({text}, x)]) > 0"


@query(f"""WITH a AS (SELECT conv_id, arg_max(text, turn) AS a FROM conversations WHERE role = 'assistant' GROUP BY conv_id), u AS (SELECT conv_id, arg_max(text, turn) AS u FROM conversations WHERE role = 'user' GROUP BY conv_id),
t AS (SELECT conv_id, lower(CASE WHEN conv_id % 2 = 0 THEN a || ' {{"action": "clarify"}}' ELSE a END) AS a, CASE conv_id % 3 WHEN 0 THEN left(u, 40) || ' 10.0.0.' || conv_id WHEN 1 THEN regexp_extract(u, '^\\S+ \\S+') ELSE u END AS u FROM a JOIN u USING (conv_id))
SELECT conv_id, u AS question, (contains(replace(a, '": "', '":"'), '"action":"clarify"') OR {_any("a", rules.CLARIFY)} OR regexp_matches(a, 'from.*to|기간.*알려') OR (contains(a, '?') AND {_any("a", rules.ASKING)}))
AND u <> '' AND length(u) <= 200 AND (regexp_matches(u, '{rules.FOUR_NUMBERS}') OR regexp_matches(u, '{rules.DATES}') OR {_any("lower(trim(u))", rules.TIMES)} OR lower(trim(u)) IN ('yes', 'no', '네', '아니오', '예') OR regexp_full_match(lower(trim(u)), '[0-9]+')
  OR (len([x FOR x IN regexp_split_to_array(lower(trim(u)), '\\s+') IF x <> '']) <= 5 AND NOT {_any("lower(trim(u))", ["조회", "search", "query", "show", "list"])})) AS followup FROM t""")
def clarify_followups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last answer asks back, and the last question only gives values. Every second answer carries the mark of asking back."""
    turns, k = table(spark, sf_dir, "conversations"), F.col("conv_id")
    last = turns.groupBy("conv_id").agg(F.max_by(F.when(F.col("role") == "assistant", F.col("text")), F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"), F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))).alias("u"))
    answer = F.when(k % 2 == 0, F.concat("a", F.lit(' {"action": "clarify"}'))).otherwise(F.col("a"))
    asked = F.when(k % 3 == 0, F.concat(F.left("u", F.lit(40)), F.lit(" 10.0.0."), k.cast("string"))).when(k % 3 == 1, F.regexp_extract("u", r"^\S+ \S+", 0)).otherwise(F.col("u"))
    both = last.where("a IS NOT NULL AND u IS NOT NULL").select("conv_id", answer.alias("answer"), asked.alias("question"))
    return both.select("conv_id", "question", (rules.clarifies(F.col("answer")) & rules.parameters_only(F.col("question"))).alias("followup"))


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'installation' WHEN 1 THEN 'configuration' WHEN 2 THEN 'faq' WHEN 3 THEN 'action' WHEN 4 THEN 'other' WHEN 5 THEN 'troubleshooting' WHEN 6 THEN 'playbook' ELSE 'faq' END AS doc_type FROM part""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type from the path's words, its folder, or the document's head."""
    paths = ["x/install-guide.yaml", "x/setup.yaml", "qna/x.yaml", "action/x.yaml", "x/y.yaml", "x/z.yaml", "playbook/x.yaml", "x/w.yaml"]
    bodies = ["", "", "", "", "error without a head", "---\nanswer: fix this error", "", "---\nquestion: how to\nanswer: install"]
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", rules.path_type(pick(paths), pick(bodies)).alias("doc_type"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.8 WHEN 2 THEN 0.2 ELSE 0.6 END::DOUBLE AS qna, CASE p_partkey % 4 WHEN 0 THEN 0.5 WHEN 1 THEN 0.1 WHEN 2 THEN 0.6 ELSE 0.2 END::DOUBLE AS plan, CASE p_partkey % 4 WHEN 3 THEN 0.2 WHEN 2 THEN 0.2 WHEN 1 THEN 0.1 ELSE 0 END::DOUBLE AS action,
CASE p_partkey % 4 WHEN 0 THEN 'plan' WHEN 1 THEN 'plan' WHEN 2 THEN 'plan' ELSE 'action' END AS emergency, CASE p_partkey % 4 WHEN 0 THEN 'qna' WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE 'action' END AS clear FROM part""")
def shaped_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of keywords with defaults by shape, scores without a model, clear patterns."""
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("p_partkey") % 4 + 1).cast("int"))
    longer = "a very long sentence of nothing at all, quite so"
    k = rules.keyword_intent(pick("explain the plan", "is it so?", longer, "만든다"))
    e = rules.emergency_intent(pick("explain the plan", "is it so?", longer, "보여"))
    clear = rules.clear_pattern(pick("explain the plan", "is it so?", longer, "show logs"), {"qna": [r"^explain\b", r"^what\b"], "action": [r"^show\b"]})
    return table(spark, sf_dir, "part").select("p_partkey", *(x.alias(n) for x, n in zip(k, ("qna", "plan", "action"), strict=True)), F.when(e[0] > 0.5, "qna").when(e[1] > 0.5, "plan").otherwise("action").alias("emergency"), clear.alias("clear"))


@query("""WITH c AS (SELECT c_custkey AS k, lower(replace(c_name, '#', '-')) AS n, c_mktsegment FROM customer)
SELECT CAST(k AS VARCHAR) AS cartridge, 'name' AS "check", 'error' AS level FROM c WHERE k % 2 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'version', 'error' FROM c WHERE k % 3 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'prompts', 'error' FROM c WHERE k % 5 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'prompts.odd', 'warning' FROM c WHERE k % 5 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'prompts.qna', 'error' FROM c WHERE k % 5 > 0 AND k % 7 = 1 UNION ALL SELECT CAST(k AS VARCHAR), 'knowledge.dir', 'error' FROM c WHERE k % 11 = 0
UNION ALL SELECT CAST(k AS VARCHAR), 'plugins[0].name', 'error' FROM c WHERE k % 13 = 0 UNION ALL SELECT CAST(k AS VARCHAR), 'plugins[1].path', 'warning' FROM c WHERE k % 4 = 1""")
def manifest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2: manifests in YAML, one for each customer, held against the files of their cartridges."""
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.col("c_name")).otherwise(F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))))
    body = made(
        'name: "', name, '"\nversion: ', F.when(k % 3 == 0, "1.0").otherwise("'1.0'"), "\nprompts:\n  ", F.when(k % 5 == 0, "odd").otherwise("qna"), ": ", F.when(k % 7 == 1, "gone").otherwise("p"), "/", F.col("c_mktsegment"), ".txt\nknowledge:\n  ",
        F.when(k % 11 == 0, "folder: docs").otherwise("dir: docs"), "\n  breakdown: {a: 1}\nplugins:\n- ", F.when(k % 13 == 0, "title: x").otherwise("name: x"), "\n  path: x.py\n- {name: y, path: ", F.when(k % 4 == 1, "y.py").otherwise("docs"), "}",
    )
    c = table(spark, sf_dir, "customer").select(k.cast("string").alias("cartridge"), "c_mktsegment", yaml.yaml_entries(F.encode(body, "UTF-8"))["entries"].alias("entries"))
    c = written(c, "manifests")
    files = c.select("cartridge", F.explode(F.array(F.concat(F.lit("p/"), F.col("c_mktsegment"), F.lit(".txt")), F.lit("docs/a.yaml"), F.lit("x.py"))).alias("file"))
    return manifest.problems(c.select("cartridge", "entries"), files)


@query("""WITH q AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN regexp_extract(text, '^[^\\n]*') WHEN 2 THEN regexp_extract(text, '^[^\\n]*') || repeat('|', CAST(doc_id % 9 AS INTEGER)) ELSE regexp_extract(text, '^[^\\n]*') || ' dst=10.0.0.1' END AS q FROM documents)
SELECT doc_id, contains(q, chr(10)) OR length(q) - length(replace(q, '|', '')) >= 6 OR regexp_matches(q, '(?i)\\b(CEF:|LEEF:|DETECT\\||SyslogAlertForwarder:|%ASA-|PulseSecure:|tlog:\\s*\\{|src=|dst=|spt=|dpt=|dvc=|dvchost=|deviceExternalId=|rt=|proto=|act=|msg=)\\b') AS payload FROM q""")
def log_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions that carry raw log lines."""
    k, line = F.col("doc_id") % 4, F.regexp_extract("text", r"^[^\n]*", 0)
    q = F.when(k == 0, F.col("text")).when(k == 1, line).when(k == 2, F.concat(line, F.repeat(F.lit("|"), (F.col("doc_id") % 9).cast("int")))).otherwise(F.concat(line, F.lit(" dst=10.0.0.1")))
    return table(spark, sf_dir, "documents").select("doc_id", rules.log_payload(q).alias("payload"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'name' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'role' END, CASE WHEN c_custkey % 3 = 0 THEN 'ranges' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer""")
def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7."""
    k = F.col("c_custkey")
    name = F.when(k % 2 == 0, F.lit("x")).otherwise(F.col("c_name"))
    ranges = F.when(k % 3 == 0, F.array(F.lit("10.0.0.0/8"), F.lit("10.0.0.256/8"))).otherwise(F.array(F.lit("192.168.0.0/16")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(rules.request_problems(name, F.col("c_mktsegment"), ranges, ["BUILDING", "MACHINERY"]), ",").alias("problems"))


@query("""WITH t AS (SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents) SELECT source, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) > 131072 AS rejected FROM t JOIN documents USING (doc_id) GROUP BY source""")
def prompt_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: prompts over the limit of tokens are rejected."""
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(t.token_estimate(F.col("text"))).alias("tokens"))
    return d.select("source", "tokens", (F.col("tokens") > 131072).alias("rejected"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents), g AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^[A-Z].*\\.$') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM l)
SELECT doc_id, CAST(part AS BIGINT) AS part, CAST(sum(floor(length(line) / 4)) AS BIGINT) AS tokens FROM g GROUP BY doc_id, part""")
def header_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V8: tokens of each part of a text; a header line begins a part. Runs are found within the row, without a shuffle."""
    lines = F.split("text", "\n")
    start = F.from_json(F.lit("[]"), "array<struct<part:bigint,tokens:bigint>>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.struct(F.lit(None).cast("long").alias("part"), F.lit(0).cast("long").alias("tokens")))

    def step(a, x):
        head, n = x.rlike(r"^[A-Z].*\.$"), F.floor(F.length(x) / 4).cast("long")
        part = F.coalesce(last(a)["part"], F.lit(0).cast("long")) + head.cast("long")
        whole = F.array_append(a, F.struct(part.alias("part"), n.alias("tokens")))
        more = F.array_append(F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)), F.struct(part.alias("part"), (last(a)["tokens"] + n).alias("tokens")))
        return F.when(head | (F.size(a) == 0), whole).otherwise(more)

    d = table(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select("doc_id", F.explode(F.aggregate(lines, start, step)).alias("x"))
    return d.select("doc_id", "x.part", "x.tokens")


@query("""WITH t AS (SELECT doc_id, term, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS term FROM documents) GROUP BY 1, 2), m AS (SELECT doc_id, max(n) AS m FROM t GROUP BY 1) SELECT doc_id, count(*) AS terms, round(sum(n / m), 6) AS total FROM t JOIN m USING (doc_id) GROUP BY doc_id""")
def sparse_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: weights of a sparse vector scaled to a greatest one of 1. The words of a document meet in one row and are counted there."""
    words = F.array_join(t.term_counts(F.coalesce("text", F.lit("")), 5), " ")
    whole = table(spark, sf_dir, "documents").select("doc_id", words.alias("words")).groupBy("doc_id").agg(F.array_join(F.collect_list("words"), " ").alias("words"))
    scaled = F.map_values(vectors.max_normalised(t.term_weights(t.term_counts(F.col("words"), 5))))
    row = t.held(scaled, lambda w: F.struct(F.size(w).cast("long").alias("terms"), F.round(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), 6).alias("total")))
    return whole.where("words rlike '[a-z]'").select("doc_id", row.alias("r")).select("doc_id", "r.terms", "r.total")


@query("""WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS s FROM nation), p AS (SELECT a.k AS a, b.k AS b, list_distinct(string_split(a.s, '')) AS x, list_distinct(string_split(b.s, '')) AS y FROM n a JOIN n b ON a.k < b.k) SELECT a, b, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))), 6)::DOUBLE AS score FROM p""")
def character_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8: Jaccard similarity of names' characters, over the pairs of a small dimension."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("a"), F.lower("n_name").alias("x"))
    m = n.select(F.col("a").alias("b"), F.col("x").alias("y"))
    return n.join(F.broadcast(m), F.col("a") < F.col("b")).select("a", "b", F.round(rules.characters_shared(F.col("x"), F.col("y")), 6).alias("score"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.8 WHEN 3 THEN 0.7 ELSE CASE WHEN p_partkey % 2 = 0 THEN 0.6 ELSE 0 END END::DOUBLE AS score, printf('%.2f', p_partkey / 7) AS shown, round(p_partkey / 7, 4)::DOUBLE AS rounded FROM part""")
def tiered_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of likeness by names and aliases, with the matcher's ratio last; display with two and four digits."""
    k = F.col("p_partkey")
    other = F.when(k % 5 == 0, F.col("p_name")).when(k % 5 == 3, made(F.col("p_name"), " x")).otherwise(F.lit("zzz"))
    mine = F.when(k % 5 == 1, F.array(F.lit("zzz"))).when(k % 5 == 2, F.array(F.lit("common"))).otherwise(F.array(F.lit("m")))
    theirs = F.when(k % 5 == 2, F.array(F.lit("common"), F.lit("q"))).otherwise(F.array(F.lit("t")))
    ratio = F.when(k % 2 == 0, 0.6).otherwise(0.4)
    return table(spark, sf_dir, "part").select("p_partkey", rules.name_similarity(F.col("p_name"), other, mine, theirs, ratio).alias("score"), F.format_string("%.2f", k / 7).alias("shown"), F.round(k / 7, 4).alias("rounded"))
