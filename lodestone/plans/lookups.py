"""Point look-ups, admission rules, mappings and set operations over the relational tables.

Fields that the tables lack (paths, apps, expiry, permissions) are derived from keys, in the query and in its twin alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.operators import relational as rel
from lodestone.operators import retrieval as r
from lodestone.sources.tables import table

from .base import query

#: The path of a part: a folder by its key, its name with dashes.
PATH = "concat(element_at(array('action', 'plan', 'qna', 'cve', 'misc'), cast(p_partkey % 5 as int) + 1), '/', replace(p_name, ' ', '-'), '-', p_partkey, '.yaml')"
PATH_SQL = "['action', 'plan', 'qna', 'cve', 'misc'][p_partkey % 5 + 1] || '/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.yaml'"


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey = 17 OR p_name = 'red widget'")
def name_or_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key or by name."""
    return table(spark, sf_dir, "part").where((F.col("p_partkey") == 17) | (F.col("p_name") == "red widget")).select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8, 13, 21, 34, 55, 89)")
def key_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a list of keys."""
    return table(spark, sf_dir, "customer").where(F.col("c_custkey").isin(3, 5, 8, 13, 21, 34, 55, 89)).select("c_custkey", "c_name")


@query("SELECT k AS wanted, coalesce(d.text, 'not found') AS text FROM (VALUES ('7'), ('src1/11'), ('none')) w(k) LEFT JOIN (SELECT doc_id, text, source FROM documents WHERE doc_id IN (7, 11)) d ON CAST(d.doc_id AS VARCHAR) = k OR 'src1/' || d.doc_id = k")
def document_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document for each wanted key or path, or a fixed text for none. The wanted keys are few, the documents are pruned by id first."""
    wanted = spark.createDataFrame([("7",), ("src1/11",), ("none",)], "wanted string")
    ids = wanted.select("wanted", F.try_to_number(F.regexp_extract("wanted", "([0-9]+)$", 1), F.lit("999999999")).cast("long").alias("doc_id"))
    return ids.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "left").select("wanted", F.coalesce("text", F.lit("not found")).alias("text"))


@query("SELECT vec_id, label, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings WHERE label IN (1, 3)")
def scrolled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filtered scan of points with the payload and without the vectors; pages and cursors are the scan's own."""
    return table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3)).select("vec_id", "label", F.size("embedding").alias("dims"))


@query("SELECT vec_id, coalesce(CAST(label AS VARCHAR), 'none') AS label, 4 * len(embedding) AS bytes FROM embeddings")
def embedding_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of vectors with defaults for what is missing."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("label"), (4 * F.size("embedding")).cast("long").alias("bytes"))


@query("SELECT c_custkey, c_mktsegment, '****' || right(md5(c_name), 4) AS api_key, count(*) OVER () AS total FROM customer WHERE c_mktsegment = 'MACHINERY'")
def subscription_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21, T-19: a filtered listing with masked keys and the number of rows, joined on as one row."""
    rows = table(spark, sf_dir, "customer").where("c_mktsegment = 'MACHINERY'")
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.select("c_custkey", "c_mktsegment", t.masked_key(F.md5(F.col("c_name").cast("binary"))).alias("api_key")).join(F.broadcast(total))


@query("WITH c AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE c_mktsegment END AS app FROM customer) SELECT c_custkey, app FROM c WHERE app IS NULL OR trim(app) = '' OR app IN ('BUILDING', 'MACHINERY')")
def compatible_apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a row passes without an app, or if its app is installed."""
    k = F.col("c_custkey") % 4
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k == 0, F.lit(None)).when(k == 1, "  ").otherwise(F.col("c_mktsegment")).alias("app"))
    return c.where(rel.app_fits(F.col("app"), ["BUILDING", "MACHINERY"]))


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 30 DAY AS DATE) AS expires FROM orders WHERE o_orderdate + INTERVAL 30 DAY > TIMESTAMP '1998-08-01'")
def active_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows that have not expired at a given time."""
    expires = F.col("o_orderdate") + F.expr("interval 30 days")
    return table(spark, sf_dir, "orders").where(expires > F.expr("timestamp_ntz'1998-08-01'")).select("o_orderkey", expires.cast("date").alias("expires"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN TRUE WHEN c_custkey % 11 = 0 THEN FALSE ELSE c_custkey % 4 = 2 OR (c_custkey % 4 = 3 AND c_custkey % 256 BETWEEN 64 AND 127) END AS allowed FROM customer""")
def address_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """an empty list lets all in, a bad address is denied, bad ranges are skipped."""
    k = F.col("c_custkey")
    client = F.when(k % 11 == 0, F.lit("10.0.300.1")).otherwise(F.concat_ws(".", F.lit("10"), (k % 4).cast("string"), F.lit("0"), (k % 256).cast("string")))
    acl = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("10.2.0.0/16"), F.lit("bad/99"), F.lit("10.3.0.64/26")))
    return table(spark, sf_dir, "customer").select("c_custkey", rel.allowed(client, acl).alias("allowed"))


@query("SELECT event_id, event_type FROM events WHERE list_contains(CASE WHEN user_id % 2 = 0 THEN ['view', 'click'] ELSE ['error'] END, event_type)")
def permitted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a row's kind must be among its owner's permissions."""
    permissions = F.when(F.col("user_id") % 2 == 0, F.array(F.lit("view"), F.lit("click"))).otherwise(F.array(F.lit("error")))
    return table(spark, sf_dir, "events").where(F.array_contains(permissions, F.col("event_type"))).select("event_id", "event_type")


@query(f"""WITH p AS (SELECT p_partkey, {PATH_SQL} AS path FROM part) SELECT p_partkey, path, CASE WHEN split_part(path, '/', 1) IN ('action', 'plan', 'qna', 'cve') THEN split_part(path, '/', 1) ELSE 'qna' END AS doc_type FROM p WHERE starts_with(regexp_replace('gpt/' || path, '^(gpt-oss|gpt|llama)/', ''), 'action/') OR contains(path, 'ring')""")
def typed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's folder goes, the first folder is the type, an unknown one is qna."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.expr(PATH).alias("path"))
    under = rel.without_model(F.concat(F.lit("gpt/"), F.col("path"))).startswith("action/")
    return p.where(under | F.contains("path", F.lit("ring"))).select("p_partkey", "path", rel.type_of_path(F.col("path")).alias("doc_type"))


@query("""WITH p AS (SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS name, p_partkey % 3 AS k FROM part), f AS (SELECT p_partkey, 'query-' || name || '-' || CASE k WHEN 0 THEN 'command' WHEN 1 THEN 'function' ELSE 'table' END || '.yaml' AS file, name, k FROM p)
SELECT p_partkey, file, CASE WHEN k < 2 THEN name END AS brand FROM f WHERE k < 2 AND name IN ('small_ring', 'red_widget', 'large_bolt')""")
def command_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of files hold a command or a function; both are matched with the query's tokens."""
    k = F.col("p_partkey") % 3
    kind = F.when(k == 0, "command").when(k == 1, "function").otherwise("table")
    file = F.concat(F.lit("query-"), F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("-"), kind, F.lit(".yaml"))
    f = table(spark, sf_dir, "part").select("p_partkey", file.alias("file")).withColumn("b", t.brand_of_file(F.col("file")))
    tokens = ["small_ring", "red_widget", "large_bolt"]
    return f.where(F.col("b.command_name").isin(tokens) | F.col("b.func_name").isin(tokens)).select("p_partkey", "file", "b.brand")


@query("""WITH s AS (SELECT p_partkey, p_size AS s, p_partkey AS k FROM part), i AS (SELECT p_partkey, ['CAPEC-' || (k % 9), 'CWE-' || s, 'CVE-2024-' || lpad(CAST(k % 10000 AS VARCHAR), 4, '0'), 'T10' || lpad(CAST(s AS VARCHAR), 2, '0'), 'T10' || lpad(CAST(s AS VARCHAR), 2, '0') || '.00' || (k % 5), 'G00' || lpad(CAST(s AS VARCHAR), 2, '0')] AS ids FROM s)
SELECT p_partkey, array_to_string(ids, ',') AS ids FROM i WHERE list_has_any(ids, ['CWE-7', 'CAPEC-3', 'T1011'])""")
def security_id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public identifiers of a text, normalised, and rows that share any of the wanted ones."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey")
    two = F.lpad(s, 2, "0")
    text = F.concat(F.lit("see cwe-0"), s, F.lit(", CAPEC "), (k % 9).cast("string"), F.lit(" and cve 2024_"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("; T10"), two, F.lit(".00"), (k % 5).cast("string"), F.lit(" by G00"), two)
    p = table(spark, sf_dir, "part").select("p_partkey", t.security_ids(text)["all_ids"].alias("ids"))
    return p.where(r.any_of(F.col("ids"), ["CWE-7", "CAPEC-3", "T1011"])).select("p_partkey", F.array_join("ids", ",").alias("ids"))


@query("""WITH w AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS w FROM benchmark), d AS (SELECT * FROM (VALUES ('the', 'command'), ('and', 'command'), ('of', 'function'), ('that', 'function')) v(w, kind)),
h AS (SELECT item_id, w, kind FROM w JOIN d USING (w)) SELECT item_id, w AS word, kind FROM h WHERE kind = 'command' OR item_id NOT IN (SELECT item_id FROM h WHERE kind = 'command')""")
def dictionary_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a query that are commands, or functions where none is a command. The dictionary is of fixed size."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(t.term_counts(F.col("text"), 2))).alias("word"))
    d = spark.createDataFrame([("the", "command"), ("and", "command"), ("of", "function"), ("that", "function")], "word string, kind string")
    return rel.first_kind(words.join(F.broadcast(d), "word"), "item_id", "kind", "command").select("item_id", "word", "kind")


@query("""WITH m AS (SELECT * FROM (VALUES ('view', 'qna', 1.2), ('click', 'action', 1.5), ('error', 'plan', 0.5)) v(event_type, doc_type, weight)) SELECT event_id, coalesce(doc_type, 'qna') AS doc_type, round(value * coalesce(weight, 1.0), 6)::DOUBLE AS weighted FROM events LEFT JOIN m USING (event_type)""")
def intent_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds are mapped to document types, whose weights multiply the score."""
    m = spark.createDataFrame([("view", "qna", 1.2), ("click", "action", 1.5), ("error", "plan", 0.5)], "event_type string, doc_type string, weight double")
    e = table(spark, sf_dir, "events").join(F.broadcast(m), "event_type", "left")
    return e.select("event_id", F.coalesce("doc_type", F.lit("qna")).alias("doc_type"), F.round(F.col("value") * F.coalesce("weight", F.lit(1.0)), 6).alias("weighted"))


@query(f"""WITH p AS (SELECT p_partkey, {PATH_SQL} AS path FROM part), f AS (SELECT *, split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS base FROM p), w AS (SELECT * FROM (VALUES ('ring'), ('Widget'), ('nothing')) v(wanted)),
h AS (SELECT wanted, path, row_number() OVER (PARTITION BY wanted ORDER BY CASE folder WHEN 'action' THEN 0 WHEN 'plan' THEN 1 ELSE 2 END, path) AS rn FROM w JOIN f ON (lower(base) = lower(wanted) OR contains(lower(base), lower(wanted))) AND folder IN ('action', 'plan', 'qna')) SELECT wanted, path FROM h WHERE rn = 1""")
def reference_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first file, by folder, whose name is or holds each wanted name. The wanted list is of fixed size."""
    p = table(spark, sf_dir, "part").select(F.expr(PATH).alias("path"))
    p = p.select("path", F.split_part("path", F.lit("/"), F.lit(1)).alias("folder"), F.lower(F.split_part("path", F.lit("/"), F.lit(2))).alias("base")).where(F.col("folder").isin("action", "plan", "qna"))
    wanted = spark.createDataFrame([("ring",), ("Widget",), ("nothing",)], "wanted string")
    order = F.when(F.col("folder") == "action", 0).when(F.col("folder") == "plan", 1).otherwise(2)
    hits = p.join(F.broadcast(wanted), F.contains("base", F.lower("wanted")))
    return hits.groupBy("wanted").agg(F.min(F.struct(order.alias("o"), F.col("path"))).alias("first")).select("wanted", "first.path")


@query("""WITH u AS (SELECT page_id, url FROM pages), x AS (SELECT * FROM (VALUES ('/fr/', 'rose'), ('/en/', 'then'), ('example.com', 'the')) v(fragment, word)) SELECT fragment, count(*) AS used, count(*) FILTER (contains(lower(html), word)) AS answered FROM pages JOIN x ON contains(url, fragment) GROUP BY fragment""")
def overlay_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which temporary documents were used as a source (by fragments of its path), and whose words stand in the answer."""
    x = spark.createDataFrame([("/fr/", "rose"), ("/en/", "then"), ("example.com", "the")], "fragment string, word string")
    hits = table(spark, sf_dir, "pages").join(F.broadcast(x), F.contains("url", F.col("fragment")))
    return hits.groupBy("fragment").agg(F.count(F.lit(1)).alias("used"), F.count_if(F.contains(F.lower("html"), F.col("word"))).alias("answered"))


@query("""WITH m AS (SELECT * FROM (VALUES ('HOUSEHOLD', 'home_key'), ('MACHINERY', 'machine_key')) v(slot, config_key)) SELECT c_mktsegment AS slot, coalesce(config_key, '') AS config_key, config_key IS NULL AS dropped, count(*) AS n FROM customer LEFT JOIN m ON slot = c_mktsegment GROUP BY ALL""")
def slot_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots become configuration keys; those without one are reported as dropped."""
    m = spark.createDataFrame([("HOUSEHOLD", "home_key"), ("MACHINERY", "machine_key")], "slot string, config_key string")
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return c.join(F.broadcast(m), "slot", "left").select("slot", F.coalesce("config_key", F.lit("")).alias("config_key"), F.col("config_key").isNull().alias("dropped"), "n")


@query("SELECT l_orderkey, count(*) AS steps, round(any_value(o_totalprice) + sum(l_quantity), 2) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '5-LOW' GROUP BY l_orderkey")
def plan_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan's own time and the times of its steps; steps are combined before the join."""
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("steps"), F.sum("l_quantity").alias("q"))
    plans = table(spark, sf_dir, "orders").where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return steps.join(plans, "l_orderkey").select("l_orderkey", "steps", F.round(F.col("o_totalprice") + F.col("q"), 2).alias("total"))


@query("""WITH c AS (SELECT CASE WHEN length(text) < 300 THEN 'short' WHEN contains(text, '!!') THEN 'noisy' ELSE 'fine' END AS category, doc_id FROM documents) SELECT category, count(*) AS n, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 3), ',') AS examples FROM c GROUP BY category""")
def validation_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each category and its three least examples; only three a task go into the shuffle."""
    category = F.when(F.length("text") < 300, "short").when(F.contains("text", F.lit("!!")), "noisy").otherwise("fine")
    c = table(spark, sf_dir, "documents").select(category.alias("category"), "doc_id")
    first = c.withColumn("rn", F.row_number().over(Window.partitionBy("category").orderBy("doc_id"))).where("rn <= 3")
    examples = first.groupBy("category").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("examples"))
    return c.groupBy("category").agg(F.count(F.lit(1)).alias("n")).join(examples, "category")


@query("SELECT source, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE length(text) > 0 GROUP BY source HAVING count(*) > 0")
def stores_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One store for each type; types without documents have none."""
    return table(spark, sf_dir, "documents").where(F.length("text") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM documents), g AS (SELECT doc_id, w, count(*) AS score FROM w GROUP BY 1, 2) SELECT doc_id, array_to_string(list_slice(list(w ORDER BY score DESC, length(w) DESC, w), 1, 5), ' ') AS top FROM g GROUP BY doc_id""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: several sort keys within a row, then the first five; counted and ordered in the row, without a shuffle."""
    words = t.term_counts(F.col("text"), 6)
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_sort(words).alias("w")).where(F.size("w") > 0)
    # Runs of equal words in a sorted array: a word's count is the distance to the next border.
    border = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    counted = F.transform(F.col("b"), lambda i, k: F.struct((i - F.coalesce(F.get("b", k + 1), F.size("w"))).alias("s"), (-F.length(F.get("w", i))).alias("l"), F.get("w", i).alias("x")))
    return d.withColumn("b", border).select("doc_id", F.array_join(F.transform(F.slice(F.array_sort(counted), 1, 5), lambda x: x["x"]), " ").alias("top"))


@query("SELECT item_id, CASE WHEN regexp_matches(lower(text), 'the [a-z]+ed') THEN 100 ELSE 20 END + CASE WHEN contains(text, ',') THEN 2 ELSE 0 END AS widened FROM benchmark")
def search_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a search asks for: twice k, ten times for id-like questions, two more for two intents."""
    text = F.lower("text")
    return table(spark, sf_dir, "benchmark").select("item_id", r.widened(10, text.rlike("the [a-z]+ed"), F.contains("text", F.lit(","))).cast("int").alias("widened"))


@query("""WITH a AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) SELECT event_id, event_type, value FROM a WHERE rn <= 20 ORDER BY value DESC, event_id LIMIT 30""")
def merged_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each type, then the best of all of them."""
    w = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    best = table(spark, sf_dir, "events").select("event_id", "event_type", "value").withColumn("rn", F.row_number().over(w)).where("rn <= 20").drop("rn")
    return best.orderBy(F.desc("value"), "event_id").limit(30)


@query("""WITH temp AS (SELECT item_id + 1000000000 AS doc_id, text, 'temp' AS source FROM benchmark), b AS (SELECT doc_id, text, source FROM documents UNION ALL SELECT * FROM temp) SELECT source, count(*) AS n, count(*) FILTER (contains(lower(text), 'the')) AS hits FROM b GROUP BY source""")
def overlay_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and temporary rows are searched together; the overlay is a view, so there is nothing to clean up."""
    temp = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000000).alias("doc_id"), "text", F.lit("temp").alias("source"))
    both = table(spark, sf_dir, "documents").select("doc_id", "text", "source").unionByName(temp)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.contains(F.lower("text"), F.lit("the"))).alias("hits"))


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]{3,}') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM w), f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY 1, 2) SELECT doc_id, md5(string_agg(x, ' ' ORDER BY i)) AS digest FROM f GROUP BY doc_id""")
def ordered_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: repeats go, the first stays in its place."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(t.term_counts(F.coalesce("text", F.lit("")))).alias("w")).where(F.size("w") > 0)
    return d.select("doc_id", F.md5(F.array_join("w", " ")).alias("digest"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'override' ELSE 'base' END AS mode, c_mktsegment AS segment, CASE WHEN c_custkey % 3 = 0 THEN 'extra' END AS note FROM customer")
def merged_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two maps become one, the right one wins."""
    base = F.create_map(F.lit("mode"), F.lit("base"), F.lit("segment"), F.col("c_mktsegment"))
    over = F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("mode"), F.lit("override"), F.lit("note"), F.lit("extra"))).otherwise(F.create_map().cast("map<string,string>"))
    m = rel.merged_maps(base, over)
    return table(spark, sf_dir, "customer").select("c_custkey", m).select("c_custkey", *(F.try_element_at("m", F.lit(k)).alias(k) for k in ("mode", "segment", "note")))


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5('doc' || doc_id) ELSE 'g' || doc_id END AS guid FROM documents")
def backfilled_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without an id get one that follows from the row, so a repeated run gives the same."""
    guid = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("g"), F.col("doc_id").cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(guid, F.md5(F.concat(F.lit("doc"), F.col("doc_id").cast("string")))).alias("guid"))


@query("""SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN -embedding[1]::DOUBLE ELSE embedding[1]::DOUBLE END AS head, CASE WHEN vec_id % 2 = 0 THEN 'edited' ELSE 'old' END AS payload FROM embeddings""")
def edited_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K19, K20, S-level merge: edits with a new vector replace both, edits without one only the payload."""
    base = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), F.lit("old").alias("payload"))
    edits = base.where("vec_id % 2 = 0").select("vec_id", F.transform("vec", lambda x: -x).alias("vec"), F.lit("edited").alias("payload"), (F.col("vec_id") % 3 == 0).alias("reembed"))
    return rel.edited(base, edits, "vec_id", "vec", "payload").select("vec_id", F.col("vec")[0].alias("head"), "payload")


@query("""WITH o AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'), kept AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)) SELECT (SELECT count(*) FROM o) AS documents, (SELECT count(*) FROM kept) AS embeddings""")
def aged_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows older than a limit go, then those that have lost their parent."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.expr("timestamp_ntz'1997-01-01'")).select("o_orderkey")
    kept = rel.without_orphans(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), o, "l_orderkey", "o_orderkey")
    return o.agg(F.count(F.lit(1)).alias("documents")).join(kept.agg(F.count(F.lit(1)).alias("embeddings")))


@query("""WITH r AS (SELECT * FROM (VALUES ('web', 8000), ('db', 8002)) v(role, base)), p AS (SELECT role, unnest(range(base, base + 200)) AS port FROM r), used AS (SELECT 8000 + s_suppkey % 7 AS port FROM supplier) SELECT role, CAST(min(port) AS INTEGER) AS port FROM p WHERE port NOT IN (SELECT port FROM used) GROUP BY role""")
def free_ports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least free port of each role within 200 of its base, as an anti-join."""
    roles = spark.createDataFrame([("web", 8000), ("db", 8002)], "role string, base int")
    ports = roles.select("role", F.explode(F.sequence(F.col("base"), F.col("base") + 199)).alias("port"))
    used = table(spark, sf_dir, "supplier").select((8000 + F.col("s_suppkey") % 7).cast("int").alias("port")).distinct()
    return ports.join(used, "port", "left_anti").groupBy("role").agg(F.min("port").alias("port"))


@query("SELECT c_custkey, c_custkey % 10 = 4 AND c_custkey <> 14 AS allowed FROM customer")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """keys that are registered for files, but for the admin's."""
    keys = table(spark, sf_dir, "customer").where("c_custkey % 10 = 4").select("c_custkey", F.lit(True).alias("known"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(keys, "c_custkey", "left").select("c_custkey", (F.coalesce("known", F.lit(False)) & (F.col("c_custkey") != 14)).alias("allowed"))
