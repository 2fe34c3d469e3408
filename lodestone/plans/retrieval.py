"""Retrieval over documents, embeddings and labels.

Tenant, switch and type of a point are derived, as the tables have none: tenant = doc_id % 3 + 1, enabled = not labelled toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vectors
from lodestone.operators import retrieval as r
from lodestone.operators import search
from lodestone.sources.tables import table, written

from .base import query


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, source, vec) of the points that tenant 2 may see, written once for all channels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source").where(r.visible(F.col("doc_id") % 3 + 1, 2))
    off = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    points = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), vectors.doubles(F.col("embedding")).alias("vec"))
    return written(docs.join(off, "doc_id", "left_anti").join(points, "doc_id"), "corpus")


def batch(points: DataFrame) -> DataFrame:
    """The queries: every point whose id is divisible by 100."""
    return points.where("doc_id % 100 = 0").select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec"), F.col("text").alias("qtext"))


CORPUS = """
corpus AS (SELECT d.doc_id, d.text, d.source, CAST(e.embedding AS DOUBLE[]) AS vec FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id
           WHERE d.doc_id % 3 + 1 IN (1, 2) AND d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
q AS (SELECT doc_id AS qid, vec AS qvec, text AS qtext FROM corpus WHERE doc_id % 100 = 0)"""
DENSE = """
dense AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM
          (SELECT qid, doc_id, round(list_cosine_similarity(qvec, vec), 9) AS score FROM q JOIN corpus ON doc_id <> qid))"""
SPARSE = """
tc AS (SELECT doc_id, term, CAST(count(*) AS DOUBLE) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM corpus) GROUP BY 1, 2),
tn AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM tc GROUP BY 1),
sparse AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM
           (SELECT a.doc_id AS qid, b.doc_id, round(sum(a.w * b.w) / (any_value(na.norm) * any_value(nb.norm)), 9) AS score
            FROM tc a JOIN tc b ON a.term = b.term AND a.doc_id <> b.doc_id JOIN tn na ON na.doc_id = a.doc_id JOIN tn nb ON nb.doc_id = b.doc_id
            WHERE a.doc_id IN (SELECT qid FROM q) GROUP BY 1, 2))"""
MULTI = """
parts AS (SELECT doc_id, i, list_slice(vec, 1 + 16 * i, 16 + 16 * i) AS p FROM corpus, range(4) t(i)),
multi AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM
          (SELECT qid, doc_id, round(sum(best), 9) AS score FROM
           (SELECT a.doc_id AS qid, b.doc_id, a.i, max(list_cosine_similarity(a.p, b.p)) AS best
            FROM parts a JOIN parts b ON a.doc_id <> b.doc_id WHERE a.doc_id IN (SELECT qid FROM q) GROUP BY 1, 2, 3) GROUP BY 1, 2))"""


def fusion_sql(channels: str) -> str:
    return f"""SELECT qid, doc_id, score, ch, CAST(rk AS INTEGER) AS rk FROM
    (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM
     (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS ch FROM ({channels}) GROUP BY 1, 2)) WHERE rk <= 10"""


@query(f"WITH {CORPUS}, {DENSE}, {SPARSE} " + fusion_sql("SELECT * FROM dense WHERE rank <= 45 UNION ALL SELECT * FROM sparse WHERE rank <= 45"))
def hybrid_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, two channels, fusion, top 10."""
    points = corpus(spark, sf_dir)
    q, n = batch(points), r.budgets(10)
    fused = r.rrf([search.dense_topk(points, q, n["dense"]), search.sparse_topk(points, q, n["sparse"])])
    return r.top(fused, 10).select("qid", "doc_id", "score", "ch", "rk")


@query(f"WITH {CORPUS}, {DENSE}, {SPARSE}, {MULTI} " + fusion_sql("SELECT * FROM dense WHERE rank <= 45 UNION ALL SELECT * FROM sparse WHERE rank <= 45 UNION ALL SELECT * FROM multi WHERE rank <= 10"))
def three_way_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third channel is MaxSim over slices of the vector."""
    points = corpus(spark, sf_dir)
    q, n = batch(points), r.budgets(10)
    channels = [search.dense_topk(points, q, n["dense"]), search.sparse_topk(points, q, n["sparse"]), search.multi_topk(points, q, n["multi"])]
    return r.top(r.rrf(channels), 10).select("qid", "doc_id", "score", "ch", "rk")


@query(f"WITH {CORPUS}, {DENSE} SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM dense WHERE rank <= 10")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J6, M2, W1, L1."""
    points = corpus(spark, sf_dir)
    return search.dense_topk(points, batch(points), 10)


@query(f"WITH {CORPUS}, {SPARSE} SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 10")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J5, W1, L1."""
    points = corpus(spark, sf_dir)
    return search.sparse_topk(points, batch(points), 10)


@query(f"WITH {CORPUS}, {MULTI} SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank FROM multi WHERE rank <= 10")
def maxsim_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, W1."""
    points = corpus(spark, sf_dir)
    return search.multi_topk(points, batch(points), 10)


@query(f"""WITH {CORPUS}, {DENSE}, {MULTI},
c AS (SELECT coalesce(d.qid, m.qid) AS qid, coalesce(d.doc_id, m.doc_id) AS doc_id, coalesce(d.score, 0) AS dense, coalesce(m.score, 0) AS multi
      FROM (SELECT * FROM dense WHERE rank <= 20) d FULL JOIN (SELECT * FROM multi WHERE rank <= 20) m ON d.qid = m.qid AND d.doc_id = m.doc_id),
s AS (SELECT qid, doc_id, dense, multi, round(dense * (0.4 / 0.7) + multi / 4 * (0.3 / 0.7), 9) AS score FROM c)
SELECT qid, doc_id, dense, multi, score, CAST(rk AS INTEGER) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM s) WHERE rk <= 10""")
def weighted_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of two channels, missing scores 0, weights scaled to sum to 1."""
    points = corpus(spark, sf_dir)
    q = batch(points)
    d = search.dense_topk(points, q, 20).select("qid", "doc_id", F.col("score").alias("dense"))
    m = search.multi_topk(points, q, 20).select("qid", "doc_id", F.col("score").alias("multi"))
    zero = F.lit(0.0)
    both = d.join(m, ["qid", "doc_id"], "full_outer").select("qid", "doc_id", F.coalesce("dense", zero).alias("dense"), F.coalesce("multi", zero).alias("multi"))
    score = F.round(F.col("dense") * (0.4 / 0.7) + F.col("multi") / 4 * (0.3 / 0.7), 9)
    return r.top(both.withColumn("score", score), 10).select("qid", "doc_id", "dense", "multi", "score", "rk")


@query(f"""WITH {CORPUS}, {DENSE}, {SPARSE},
d AS (SELECT qid, doc_id FROM dense WHERE rank <= 45), s AS (SELECT qid, doc_id FROM sparse WHERE rank <= 45)
SELECT qid, count(*) FILTER (x AND y) AS both_channels, count(*) FILTER (x AND NOT y) AS dense_only, count(*) FILTER (y AND NOT x) AS sparse_only FROM
(SELECT coalesce(d.qid, s.qid) AS qid, d.doc_id IS NOT NULL AS x, s.doc_id IS NOT NULL AS y FROM d FULL JOIN s ON d.qid = s.qid AND d.doc_id = s.doc_id) GROUP BY qid""")
def channel_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the channels agree."""
    points = corpus(spark, sf_dir)
    q = batch(points)
    marked = lambda df, name: df.select("qid", "doc_id", F.lit(True).alias(name))
    both = marked(search.dense_topk(points, q, 45), "x").join(marked(search.sparse_topk(points, q, 45), "y"), ["qid", "doc_id"], "full_outer")
    x, y = F.coalesce("x", F.lit(False)), F.coalesce("y", F.lit(False))
    return both.groupBy("qid").agg(F.count_if(x & y).alias("both_channels"), F.count_if(x & ~y).alias("dense_only"), F.count_if(y & ~x).alias("sparse_only"))


@query(f"""WITH {CORPUS}, {DENSE} SELECT qid, c.source, max(score) AS score, arg_max(dense.doc_id, score) AS doc_id FROM dense JOIN corpus c USING (doc_id)
GROUP BY qid, c.source""")
def best_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hit of each source of a query."""
    points = corpus(spark, sf_dir)
    return search.dense_topk(points, batch(points), 1, best_by="source").select("qid", "source", "score", "doc_id")


@query(f"""WITH {CORPUS}, {DENSE}, b AS (SELECT qid, dense.doc_id, CASE WHEN c.source = 'src1' THEN least(0.95, score * 2.5) ELSE score END AS score
FROM dense JOIN corpus c USING (doc_id)) SELECT qid, doc_id, round(score, 6) AS score, CAST(rk AS INTEGER) AS rk FROM
(SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rk FROM b) WHERE rk <= 10 AND score >= 0.05""")
def boosted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boost on a match, rank, threshold."""
    points = corpus(spark, sf_dir)
    hits = search.dense_topk(points.withColumn("match", F.col("source") == "src1"), batch(points), 10, boost=("match", 2.5, 0.95))
    return hits.where("score >= 0.05").select("qid", "doc_id", F.round("score", 6).alias("score"), F.col("rank").alias("rk"))


@query(f"""WITH {CORPUS}, {DENSE}, k AS (SELECT qid, doc_id, rank, CAST(floor(length(c.text) / 4) AS BIGINT) AS tokens FROM dense JOIN corpus c USING (doc_id) WHERE rank <= 20),
u AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS used FROM k)
SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, tokens, used FROM u WHERE used <= 4000""")
def packed_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each query up to its token budget."""
    points = corpus(spark, sf_dir)
    hits = search.dense_topk(points, batch(points), 20).join(points.select("doc_id", F.floor(F.length("text") / 4).cast("long").alias("tokens")), "doc_id")
    return r.packed(hits, 4000, "rank").select("qid", "rank", "doc_id", "tokens", "used")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
SELECT vec_id, round(sqrt(list_sum([x * x FOR x IN v])), 6) AS norm, round(list_sum([x * x FOR x IN list_slice(v, 1, 16)]), 6) AS head,
round((v[1] + v[17] + v[33] + v[49]) / 4, 6) AS pooled_first FROM e""")
def vector_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms and mean pooling."""
    v = vectors.doubles(F.col("embedding"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    head = F.slice("v", 1, 16)
    return e.select("vec_id", F.round(vectors.norm(F.col("v")), 6).alias("norm"), F.round(vectors.dot(head, head), 6).alias("head"), F.round(vectors.mean_pool(vectors.slices(F.col("v"), 16, 4), 16)[0], 6).alias("pooled_first"))


@query("""WITH t AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS term FROM documents) GROUP BY 1, 2),
m AS (SELECT doc_id, count(*) AS terms, max(n) AS top, round(avg(n / m), 6) AS mean_weight FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS m FROM t) GROUP BY doc_id)
SELECT source, count(*) AS docs, count(*) FILTER (m.doc_id IS NULL) AS empty_docs, CAST(sum(coalesce(terms, 0)) AS BIGINT) AS total_terms, CAST(max(coalesce(terms, 0)) AS BIGINT) AS max_terms
FROM documents LEFT JOIN m USING (doc_id) GROUP BY source""")
def sparse_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of the sparse vectors by source."""
    from lodestone.functions import text

    terms = F.size(F.array_distinct(text.term_counts(F.coalesce("text", F.lit(""))))).cast("long")
    d = table(spark, sf_dir, "documents").select("source", terms.alias("terms"))
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("terms") == 0).alias("empty_docs"), F.sum("terms").alias("total_terms"), F.max("terms").alias("max_terms"))


@query(f"""WITH {CORPUS}, p AS (SELECT doc_id, vec FROM corpus WHERE doc_id % 7 <> 3 UNION ALL SELECT -1 - doc_id, list_reverse(vec) FROM corpus WHERE doc_id % 7 = 3),
s AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (SELECT qid, doc_id, round(list_cosine_similarity(qvec, vec), 9) AS score FROM q JOIN p ON doc_id <> qid))
SELECT qid, doc_id, score, CAST(rank AS INTEGER) AS rank, doc_id < 0 AS temporary FROM s WHERE rank <= 5""")
def overlay_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over the store and rows that are only there for it. A union is a view, so nothing has to be removed afterwards."""
    points = corpus(spark, sf_dir)
    base = points.where("doc_id % 7 <> 3").select("doc_id", "vec")
    temporary = points.where("doc_id % 7 = 3").select((-1 - F.col("doc_id")).alias("doc_id"), F.reverse("vec").alias("vec"))
    return search.dense_topk(base.unionByName(temporary), batch(points), 5).select("qid", "doc_id", "score", "rank", (F.col("doc_id") < 0).alias("temporary"))
