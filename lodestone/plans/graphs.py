"""Concept graphs of documents. A document's concepts are those of the extraction, which by definition gives the first ten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parsing as p
from lodestone.functions import rules
from lodestone.operators import graph as g
from lodestone.operators import relations
from lodestone.sources.tables import table

from .base import query

CONCEPTS = """wd AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda x: x NOT IN ('the', 'and', 'for', 'with', 'that')) AS w, [lower(x) FOR x IN regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+)+')] AS ph FROM documents),
ls AS (SELECT doc_id, list_concat(list_concat(ph, [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]), w) AS c FROM wd), un AS (SELECT doc_id, unnest(c) AS concept, unnest(range(len(c))) AS i FROM ls),
fi AS (SELECT doc_id, concept, min(i) AS i FROM un GROUP BY 1, 2), m AS (SELECT * FROM (SELECT doc_id, concept, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS rn FROM fi) WHERE rn <= 10)"""


def concept_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, concepts)."""
    return table(spark, sf_dir, "documents").select("doc_id", p.english_concepts(F.coalesce("text", F.lit(""))).alias("concepts"))


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, concept)."""
    return concept_lists(spark, sf_dir).select("doc_id", F.posexplode("concepts").alias("pos", "concept"))


@query(f"WITH {CONCEPTS} SELECT doc_id, concept, CAST(rn - 1 AS INTEGER) AS pos, round(1.0 + 0.1 * (rn - 1), 3)::DOUBLE AS weight FROM m")
def concept_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document to concept, weighted by place."""
    return concepts(spark, sf_dir).select("doc_id", "concept", "pos", F.round(g.position_weight(F.col("pos")), 3).alias("weight"))


@query(f"WITH {CONCEPTS} SELECT x.concept AS a, y.concept AS b, count(*) AS docs FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.concept < y.concept GROUP BY 1, 2")
def concept_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J11, A13."""
    return g.cooccurrences(concept_lists(spark, sf_dir))


@query(f"""WITH {CONCEPTS}, ids AS (SELECT DISTINCT concept AS id FROM m WHERE length(concept) > 12), e AS (SELECT x.concept AS source, y.concept AS target, x.doc_id FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.rn = 1 AND y.rn = 2)
SELECT source, target, min(doc_id) AS first_doc FROM e WHERE source IN (SELECT id FROM ids) AND target IN (SELECT id FROM ids) GROUP BY 1, 2""")
def referential_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends must exist, the first of repeats stays."""
    c = concepts(spark, sf_dir)
    nodes = c.where(F.length("concept") > 12).select(F.col("concept").alias("id")).distinct()
    first, second = (c.where(F.col("pos") == k).select("doc_id", F.col("concept").alias(n)) for k, n in enumerate(("source", "target")))
    edges = first.join(second, "doc_id").select("source", "target", F.lit("next").alias("type"), F.col("doc_id").alias("ord"))
    return g.valid_edges(edges, nodes).select("source", "target", F.col("ord").alias("first_doc"))


@query(f"""WITH {CONCEPTS}, e AS (SELECT concept, count(*) AS n FROM m GROUP BY concept), q AS (SELECT * FROM (VALUES (0, 'the'), (1, 'eration'), (2, 'zzzz')) t(qid, term)),
x AS (SELECT qid, concept, n FROM q JOIN e ON concept = term), s AS (SELECT qid, concept, n FROM q JOIN e ON contains(concept, term) WHERE qid NOT IN (SELECT qid FROM x))
SELECT qid, concept FROM (SELECT qid, concept, row_number() OVER (PARTITION BY qid ORDER BY n DESC, concept) AS rn FROM (SELECT * FROM x UNION ALL SELECT * FROM s)) WHERE rn <= 5""")
def concept_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact matches, or else containing names, at most five."""
    from pyspark.sql import Window

    names = concepts(spark, sf_dir).groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    q = F.broadcast(spark.createDataFrame([(0, "the"), (1, "eration"), (2, "zzzz")], "qid int, term string"))
    exact = names.join(q, F.col("concept") == F.col("term")).select("qid", "concept", "n")
    rest = F.broadcast(q.join(exact.select("qid").distinct(), "qid", "left_anti"))
    loose = names.join(rest, F.col("concept").contains(F.col("term"))).select("qid", "concept", "n")
    w = Window.partitionBy("qid").orderBy(F.desc("n"), "concept")
    return exact.unionByName(loose).withColumn("rn", F.row_number().over(w)).where("rn <= 5").select("qid", "concept")


@query(None)
def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and nations that resemble each other, by sequence matching behind a lossless filter."""
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id")).select("id", "name")
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("id"), F.col("n_name").alias("name"))
    return g.similar_names(parts.unionByName(nations)).select("a", "b", F.round("score", 6).alias("score"))


@query("""SELECT p_name AS id, min(p_brand) FILTER (p_partkey % 3 = 0 AND p_partkey = f) AS name_ko, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS aliases, arg_max(p_type, p_partkey) AS properties FROM (SELECT *, min(CASE WHEN p_partkey % 3 = 0 THEN p_partkey END) OVER (PARTITION BY p_name) AS f FROM part) GROUP BY p_name""")
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of nodes with one id the first name stays, aliases are united, the last properties win."""
    ko = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand"))
    nodes = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), ko.alias("name_ko"), F.array("p_brand").alias("aliases"), F.col("p_type").alias("properties"), F.col("p_partkey").alias("ord"))
    return g.merged_nodes(nodes).select("id", "name_ko", F.array_join("aliases", ",").alias("aliases"), "properties")


GRAPH = "e AS (SELECT l_orderkey AS source, l_partkey AS target FROM lineitem)"


def order_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"))


@query(f"""WITH {GRAPH}, gone AS (SELECT p_partkey FROM part WHERE p_brand = 'Brand#2') SELECT 'nodes' AS kind, count(*) AS n FROM part WHERE p_partkey NOT IN (SELECT * FROM gone) UNION ALL SELECT 'edges', count(*) FROM e WHERE source NOT IN (SELECT * FROM gone) AND target NOT IN (SELECT * FROM gone)""")
def removed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's nodes go, and every edge that touches one."""
    parts = table(spark, sf_dir, "part")
    nodes, edges = g.without_file(parts.select(F.col("p_partkey").alias("id")), order_edges(spark, sf_dir), parts.where("p_brand = 'Brand#2'").select(F.col("p_partkey").alias("id")))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("n"))
    return count(nodes, "nodes").unionByName(count(edges, "edges"))


@query(f"""WITH {GRAPH}, hit AS (SELECT p_partkey FROM part WHERE p_size = 7), r AS (SELECT source, target FROM e WHERE source NOT IN (SELECT * FROM hit) AND target NOT IN (SELECT * FROM hit) UNION ALL SELECT p_partkey, 0 FROM hit) SELECT target, count(*) AS n FROM r GROUP BY target""")
def rebuilt_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of affected nodes are made anew, all others stay."""
    hit = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("id"))
    fresh = hit.select(F.col("id").alias("source"), F.lit(0).cast("long").alias("target"))
    return g.rebuilt(order_edges(spark, sf_dir), hit, fresh).groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH n AS (SELECT n_nationkey AS k, lower(n_name) AS s, n_regionkey AS r FROM nation), p AS (SELECT a.k AS source, b.k AS target, list_distinct(string_split(a.s, '')) AS x, list_distinct(string_split(b.s, '')) AS y FROM n a JOIN n b ON a.k <> b.k WHERE a.k % 5 = 0 AND NOT (a.r = b.r)),
s AS (SELECT source, target, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) AS score FROM p) SELECT source, target, round(score, 6)::DOUBLE AS score FROM s WHERE score > 0.3""")
def new_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed concepts against all concepts, without pairs that are related already (here: of one region)."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.lower("n_name").alias("name"), "n_regionkey")
    m = n.select(F.col("id").alias("target"), "n_regionkey")
    known = n.select(F.col("id").alias("source"), "n_regionkey").join(m, "n_regionkey").where("source < target").select("source", "target")
    return g.related(n.where("id % 5 = 0"), n, known, rules.characters_shared, 0.3).select("source", "target", F.round("score", 6).alias("score"))


@query("""WITH t AS (SELECT lower(trim(n_name)) AS a, 'n ' || n_nationkey AS b FROM nation), u AS (SELECT a, b FROM t UNION SELECT b, a FROM t), v AS (SELECT a AS term, b AS other FROM u UNION SELECT replace(a, ' ', ''), b FROM u) SELECT DISTINCT term, other FROM v""")
def term_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in two languages, in both directions, with and without blanks."""
    return g.both_ways(table(spark, sf_dir, "nation").select(F.col("n_name").alias("ko"), F.concat(F.lit("N "), F.col("n_nationkey").cast("string")).alias("en")))


@query("""WITH t AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 10 <> 3), e AS (SELECT p_partkey AS source, p_partkey + 1 AS target FROM part) SELECT source, target, 'source' AS problem FROM e WHERE source NOT IN (SELECT id FROM t) UNION ALL SELECT source, target, 'target' FROM e WHERE target NOT IN (SELECT id FROM t)""")
def dangling_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a workflow that name a task that is not there."""
    parts = table(spark, sf_dir, "part")
    edges = parts.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") + 1).alias("target"))
    return g.dangling(edges, parts.where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("id")))


@query(None)
def updated_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts and of nations, of which those of one brand have changed; compared locally if they are few, else all anew."""
    brand = F.array_sort(F.collect_set("p_brand"))
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("id"), F.slice(brand, 1, 2).alias("aliases"))
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1_000_000_000).cast("long").alias("id"), F.col("n_name").alias("name"), F.array(F.lit("nation")).alias("aliases"))
    after = parts.unionByName(nations).withColumn("name_ko", F.lit(None).cast("string"))
    before = after.withColumn("name", F.when(F.col("id") % 16 == 3, F.reverse("name")).otherwise(F.col("name")))
    return relations.updated(after, relations.compared(before, before), after.where("id % 16 = 3")).select("source", "target", F.round("score", 6).alias("score"))
