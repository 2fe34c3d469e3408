"""Knowledge files, binary parts and text pieces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import knowledge as k
from lodestone.sources import yaml
from lodestone.sources.tables import table

from .base import query
from .parsing import made


@query("""WITH n AS (SELECT c_nationkey, c_custkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS number FROM customer) SELECT c_nationkey, CAST(number AS INTEGER) AS number, lpad(CAST(number AS VARCHAR), 3, '0') || '-' || trim(substr(regexp_replace(lower(c_name), '[^a-z0-9]+', '-', 'g'), 1, 40), '-') || '.yaml' AS file,
'---' || chr(10) || 'question: "who is \\"' || c_custkey || '\\"?"' AS shown, 'who is "' || c_custkey || '"?' AS question FROM n""")
def knowledge_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One numbered YAML file for each item, and its question read back."""
    c = k.numbered_files(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "c_name")
    body = k.yaml_of([("question", made('who is "', F.col("c_custkey"), '"?')), ("answer", F.lit(None).cast("string"))])
    return c.select("c_nationkey", "number", "file", body.alias("shown")).select("*", k.yaml_value(F.col("shown"), "question").alias("question"))


@query("""WITH d AS (SELECT doc_id, strlen(text) AS n, sha256(text) AS sha FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(greatest(1, ceil(n / 1000.0)) AS BIGINT) AS parts, sha AS content_sha, TRUE AS ok FROM d""")
def binary_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents cut into parts with digests, and put together again."""
    parts = k.chunked(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 1000)
    whole = k.reassembled(parts, "doc_id")
    return whole.join(parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts")), "doc_id").select("doc_id", "parts", F.sha2("content", 256).alias("content_sha"), "ok")


@query("SELECT doc_id, strlen(text) >= 2000 AS packed, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K9: texts above a size are compressed, and read back."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", k.packed(F.col("text"), 2000).alias("p"))
    return d.select("doc_id", F.col("p").startswith(k.PACKED).alias("packed"), F.md5(k.unpacked(F.col("p"))).alias("digest"))


@query("""SELECT c_custkey, i AS item, CASE i WHEN 1 THEN 'what is ' || c_custkey ELSE 'and b' END AS question, CASE WHEN i = 1 AND c_custkey % 3 = 2 THEN 'one' || chr(10) || 'two' WHEN i = 1 THEN 'one' ELSE 'three' END AS answer, CASE WHEN i = 1 THEN 'x/y' ELSE '' END AS aliases FROM customer, (VALUES (1), (2)) v(i)""")
def qna_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from a JSON array, from objects one on a line, or from tagged lines."""
    q = F.col("c_custkey")
    one, two = made('{"question": "what is ', q, '", "answer": "one", "aliases": ["x", "y"]}'), made('{"question": "and b", "answer": "three"}')
    text = F.when(q % 3 == 0, made("Sure:\n[", one, ", ", two, "]\n")).when(q % 3 == 1, made("Sure:\n", one, ",\nbroken {\n", two))
    text = text.otherwise(made("Sure:\n- Q: what is ", q, "\nA: one\n\ntwo\nAL: x | y\n**Question: and b\nanswer: three\nQ: never answered"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(k.qna_items(text)).alias("i", "x"))
    return c.select("c_custkey", (F.col("i") + 1).alias("item"), "x.question", "x.answer", F.coalesce(F.array_join("x.aliases", "/"), F.lit("")).alias("aliases"))


@query("""WITH r AS (SELECT c_nationkey, c_custkey % 400 <> 7 AS fit FROM customer), f AS (SELECT c_nationkey, bool_and(fit) AS structured, count(*) AS n FROM r GROUP BY 1) SELECT c_nationkey, structured, n FROM f""")
def structured_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's rows are items only if all of them have a question and an answer."""
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 400 == 7, " ").otherwise(F.col("c_name")).alias(" Question"), F.col("c_mktsegment").alias("A"), F.lit("x|y").alias("alias"))
    p = k.picked(rows, "c_nationkey")
    return p.groupBy("c_nationkey").agg(F.first("structured").alias("structured"), F.count(F.lit(1)).alias("n"))


@query("""SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS content, TRUE AS bounded FROM documents WHERE length(trim(text)) > 0 AND regexp_matches(text, '\\S')""")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-1: pieces at paragraphs; the twin holds that none is too long and that no letter is lost."""
    return _pieces(spark, sf_dir, k.chunk_text, 700)


@query("""SELECT doc_id, md5(regexp_replace(text, '\\s+', '', 'g')) AS content, TRUE AS bounded FROM documents WHERE length(trim(text)) > 0 AND regexp_matches(text, '\\S')""")
def message_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T-2: parts that don't cut fenced blocks; the same twin."""
    return _pieces(spark, sf_dir, k.safe_split, 500)


def _pieces(spark: SparkSession, sf_dir: str, split, size: int) -> DataFrame:
    pieces = k.pieces_of(table(spark, sf_dir, "documents"), "doc_id", "text", size, split)
    whole = pieces.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece"))).alias("p"), F.bool_and(F.length("piece") <= size).alias("bounded"))
    joined = F.array_join(F.transform("p", lambda x: x["piece"]), "")
    return whole.select("doc_id", F.md5(F.regexp_replace(joined, r"\s+", "")).alias("content"), "bounded")


@query("""WITH d AS (SELECT doc_id, lang, source, [trim(x) FOR x IN string_split(replace(text, chr(13), ''), chr(10)) IF trim(x) <> ''] AS l FROM documents),
e AS (SELECT doc_id, lang, source, array_to_string(l, chr(10)) AS body, array_to_string(l[:3], ' ') AS head FROM d)
SELECT doc_id, unnest(['question', 'lang', 'app.name', 'app.ids[0]', 'app.ids[1].key', 'app.ids[1].on', 'app.more[0][0]', 'app.more[0][1]', 'tags[0]', 'tags[1].src', 'tags[2]', 'empty', 'answer', 'head', CASE WHEN doc_id % 2 = 0 THEN '가' ELSE '가나' END]) AS path,
unnest([source || ' said "hi"' || chr(10) || 'then', lang, source || '''s', CAST(doc_id AS VARCHAR), 'k' || doc_id % 7, 'true', lang, source, lang, source, 'x, y', NULL, CASE WHEN body = '' THEN '' ELSE body || chr(10) END, head, CAST(doc_id % 5 AS VARCHAR)]) AS value FROM e""")
def yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML with lists, nesting and block scalars, read into paths and values. Whole texts are block scalars."""
    lines = F.filter(F.transform(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    put = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat(F.lit("  "), x)), "\n")
    body = made(
        "# made of ", F.col("doc_id"), '\n---\nquestion: "', F.col("source"), ' said \\"hi\\"\\nthen"\nlang: ', F.col("lang"), "   # note\napp:\n  name: '", F.col("source"), "''s'\n  ids:\n  - ", F.col("doc_id"), "\n  - key: k", F.col("doc_id") % 7,
        "\n    on: true\n  more:\n    - - ", F.col("lang"), "\n      - ", F.col("source"), "\ntags: [", F.col("lang"), ", {src: ", F.col("source"), '}, "x, y"]\nempty: ~\nanswer: |\n', put(lines), "\n\nhead: >-\n", put(F.slice(lines, 1, 3)), "\n",
    )
    name = F.when(F.col("doc_id") % 2 == 0, "가").otherwise("가나")
    d = table(spark, sf_dir, "documents").select("doc_id", yaml.yaml_entries(F.encode(made(body, name, ": ", F.col("doc_id") % 5), "UTF-8")).alias("y"))
    return d.select("doc_id", F.inline("y.entries")).drop("plain")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'no entry: just words' END AS error, CASE WHEN c_custkey % 4 < 3 THEN '가' END AS path, CASE WHEN c_custkey % 4 < 3 THEN c_name || CASE WHEN c_custkey % 4 = 1 THEN ' 나' ELSE '' END END AS value FROM customer""")
def yaml_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in CP949 are read after UTF-8 has failed; a file that is no YAML gives its reason."""
    kind = F.col("c_custkey") % 4
    text = lambda *parts: F.encode(made(*parts), "UTF-8")
    content = (
        F.when(kind == 0, F.concat(F.unhex(F.lit("EAB080")), text(": ", F.col("c_name"))))
        .when(kind == 1, F.concat(F.unhex(F.lit("B0A1")), text(": ", F.col("c_name"), " "), F.unhex(F.lit("B3AA"))))
        .when(kind == 2, F.concat(F.unhex(F.lit("B0A1")), text(": '", F.col("c_name"), "'"))).otherwise(text("just words"))
    )
    c = table(spark, sf_dir, "customer").select("c_custkey", yaml.yaml_entries(content).alias("y"))
    return c.select("c_custkey", "y.error", F.explode_outer("y.entries").alias("e")).select("c_custkey", "error", "e.path", "e.value")
