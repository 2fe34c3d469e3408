"""From documents to training tokens: five stages, each one operator of lodestone.llm over all that the stage before kept.

1. toxicity: documents that the factorisation machine rejects go.
2. jaccard_join: of every class of near copies the row with the least doc_id stays.
3. decontamination: documents that hold a benchmark window go.
4. secret_scan: confirmed secrets are replaced by a mark; n_chars follows the text.
5. byte_bpe: the last stage; ids of every text, with the digest of what they decode to.

All stages but the last return the columns of `documents`; further columns pass through. Defined cases: null and empty
texts are neither toxic (unless the model's bias says so), near copies, contaminated nor secret, so they stay; rows that
repeat an id and its text are near copies of each other, one stays; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import common, op06_decontaminate, op07_jaccard, op08_toxicity, op09_bpe, op10_secrets

TOXIC = 0.5
#: The near-copy stage: texts that share 80 of 100 of their 5-word shingles are one class.
SHINGLE, NUM, DEN = 5, 80, 100
SCORE = "__toxicity"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op08_toxicity.train_toxicity(docs, common.table(spark, sf_dir, "labels"))
    score = common.fresh(docs, "toxicity")
    return op08_toxicity.score_toxicity(docs, model, score).where(F.col(score) < TOXIC).select(*common.quoted(docs.columns))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    classes = op07_jaccard.jaccard_classes(docs, size=SHINGLE, num=NUM, den=DEN)
    key = common.fresh(docs, "key")
    stays = classes.where("doc = first_doc AND h = first_h").select(F.struct("doc", "h").alias(key)).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mine = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(op07_jaccard.NO_ID)).alias("doc"), F.xxhash64(text).alias("h"))
    return docs.withColumn(key, mine).join(stays, key, "left_semi").dropDuplicates([key]).select(*common.quoted(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    key = common.fresh(docs, "key")
    hits = op06_decontaminate.contamination(docs, common.table(spark, sf_dir, "benchmark")).where("n_hit > 0").select(F.struct("doc_id", "h").alias(key))
    mine = F.struct("doc_id", F.xxhash64("text").alias("h"))
    return docs.join(hits, mine.eqNullSafe(F.col(key)), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = op10_secrets.train_forest(op10_secrets.labelled_findings(spark))
    cleaned, found = op10_secrets.redact(docs, model), F.col("n_secrets")
    if "n_secrets" in docs.columns:  # the column of the documents stays as it is
        count, key = common.fresh(docs, "secrets"), common.fresh(docs, "given")
        given = docs.withColumn(key, F.col("n_secrets"))
        cleaned = op10_secrets.redact(given, model).withColumnsRenamed({"n_secrets": count}).withColumnsRenamed({key: "n_secrets"})
        found = F.col(count)
    chars = {"n_chars": F.when(found > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {}
    return cleaned.withColumns(chars).select(*common.quoted(docs.columns))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks = op09_bpe.read_ranks(public_tokenizers.path(op09_bpe.RANK_FILE))
    encoded = op09_bpe.encode(docs, ranks)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("byte_bpe", byte_bpe),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
