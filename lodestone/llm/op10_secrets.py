r"""Secret scans: a random forest over candidate strings, trained from labelled findings to remove false positives.

A candidate is a run of [A-Za-z0-9_+/-] that holds a digit and at least MIN_LENGTH characters, that begins with one of PREFIXES, or that is assigned (= or :) to one of
SECRET_WORDS, whatever its length and characters. Candidates may be joined by '.', ':' or '@'. Its features are its length,
the shares of its kinds of characters, the transitions between kinds, how much of it a small dictionary covers, whether it looks like
part of a path, address or name, and the words next to it. Everything runs in DataFrame functions and in pyspark.ml's forest.

The forest is trained on labelled findings (before, candidate, after, label). `labelled_findings` makes a bounded, fixed set of
them: keys, tokens and passwords as they occur in the wild against commit ids, checksums, identifiers, dates, paths and names.

Defined cases: null and empty texts have no candidates; a text with one secret many times has one candidate for each place, and
all places are redacted, those of less than MIN_LENGTH characters where they are runs of their own; rows that repeat a doc_id are scanned each by its own text; other columns pass through `redact`.
"""

from __future__ import annotations

import re

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_LENGTH = 16
CUTOFF = 0.5
FINDINGS = 4800
TREES, DEPTH, SEED = 24, 8, 11
# Words next to secrets, words next to harmless strings, and a dictionary of common names in identifiers.
SECRET_WORDS = "token secret password passwd pwd key apikey api_key auth authorization bearer credential credentials access private client_secret signature"
HARMLESS_WORDS = "commit sha sha1 sha256 md5 checksum hash digest revision uuid guid id version build page phone card isbn file path url image release order invoice ref"
DICTIONARY = "the and for with data test user name file path image page index table value item list type time date version build release order report model train batch number count total index config default example sample main base node group class method error http https www com org html json"
PREFIXES = "AKIA ghp_ gho_ sk_live_ sk- xoxb- glpat- npm_ AIza hf_"
PLAIN_WORDS = "required optional string none null true false value enabled disabled hidden changed invalid missing expired here below management rotation policy manager field input reset length generator please unknown public important"
_RUN = "[A-Za-z0-9_+/-]"
_ASSIGNED = rf"""(?<=[=:]\s{{0,3}}["']?)(?<=(?i:(?<![A-Za-z])(?:{'|'.join(SECRET_WORDS.split())})["']?\s{{0,3}}[=:]\s{{0,3}}["']?))"""
CANDIDATE = rf"(?<!{_RUN})(?:(?=[A-Za-z_+/-]*[0-9]){_RUN}{{16,}}|(?:{'|'.join(PREFIXES.split())}){_RUN}{{12,}}|{_ASSIGNED}{_RUN}+)"
#: Groups: before, candidate, after. What stands next to a candidate is looked at, not consumed, so it can be a candidate itself.
IN_CONTEXT = rf"(?={CANDIDATE})(?:(?<=((?<![A-Za-z])[A-Za-z][A-Za-z_-]{{1,19}}[^A-Za-z0-9_+/\n-]{{1,5}}))|)({CANDIDATE})(?=([.@:][A-Za-z0-9]{{1,8}})?)"
FEATURES = ["length", "digits", "upper", "lower", "marks", "hexes", "distinct", "runs", "longest_letters", "longest_digits", "covered", "vowels", "consonants", "path", "tail", "dashes", "secret_word", "harmless_word", "assigned", "prefixed"]


def findings_in(text: Column) -> Column:
    """Candidates with what stands next to them, as array<struct<before, candidate, after>>."""
    names = ("before", "candidate", "after")
    groups = [F.regexp_extract_all(text, F.lit(IN_CONTEXT), F.lit(k)) for k in (1, 2, 3)]
    return F.when(text.rlike(CANDIDATE), F.transform(F.arrays_zip(*(g.alias(n) for g, n in zip(groups, names, strict=True))), lambda x: F.struct(*(x[n].alias(n) for n in names))))


def with_features(found: DataFrame) -> DataFrame:
    """Adds FEATURES to rows with before, candidate and after."""
    c, before = F.col("candidate"), F.lower("before")
    n = F.length(c).cast("double")

    def share(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)) / n

    def longest(pattern: str) -> Column:
        return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda r: F.length(r))), F.lit(0)).cast("double")

    def has_word(words: str) -> Column:
        return before.rlike(rf"(?<![a-z])(?:{'|'.join(sorted(words.split(), key=lambda w: (-len(w), w)))})[^a-z0-9]*$").cast("double")

    dictionary = "|".join(sorted({*DICTIONARY.split(), *PLAIN_WORDS.split()}, key=lambda w: (-len(w), w)))
    return found.withColumns(
        {
            "length": F.least(n, F.lit(128.0)),
            "digits": share("[0-9]"),
            "upper": share("[A-Z]"),
            "lower": share("[a-z]"),
            "marks": share("[_+/-]"),
            "hexes": share("[0-9a-fA-F]"),
            "distinct": F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(40.0)),
            "runs": share("[a-z]+|[A-Z]+|[0-9]+|[_+/-]+"),
            "longest_letters": longest("[A-Za-z]+"),
            "longest_digits": longest("[0-9]+"),
            "covered": 1 - F.length(F.regexp_replace(F.lower(c), dictionary, "")) / n,
            "vowels": share("[aeiouAEIOU]"),
            "consonants": longest("[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]+"),
            "path": (c.contains("/") | before.rlike("[/:@.]$")).cast("double"),
            "tail": (F.length("after") > 0).cast("double"),
            "dashes": F.regexp_count(c, F.lit("-")).cast("double"),
            "secret_word": has_word(SECRET_WORDS),
            "harmless_word": has_word(HARMLESS_WORDS),
            "prefixed": c.rlike(rf"^(?:{'|'.join(PREFIXES.split())})").cast("double"),
            "assigned": before.rlike("[=:]\\s*[\"']?$").cast("double"),
        }
    )


def labelled_findings(spark: SparkSession, rows: int = FINDINGS) -> DataFrame:
    """(before, candidate, after, label): `rows` findings made from hashes of their number; the same in every run."""
    i = F.col("id")
    digest = lambda salt: F.sha2(F.concat(i.cast("string"), F.lit(salt)), 256)
    b64 = F.regexp_replace(F.base64(F.unhex(digest("b"))), "=", "")
    alnum = F.regexp_replace(b64, "[+/]", "k")
    pick = lambda words, salt: F.element_at(F.split(F.lit(words), " "), (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(len(words.split()))) + 1).cast("int"))
    size = lambda low, high, salt: (low + F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(high - low + 1))).cast("int")
    cut = lambda text, low, high: F.substring(text, F.lit(1), size(low, high, "n"))
    sep = F.element_at(F.array(*map(F.lit, ("=", " = \"", ": ", "=\"", ": '", " "))), size(1, 6, "s"))
    secret_context, harmless_context = F.concat(pick(SECRET_WORDS, "w"), sep), F.concat(pick(HARMLESS_WORDS, "w"), sep)
    prose = F.concat(pick("and the of le la der und con para with then", "p"), F.lit(" "))
    names = F.concat_ws("_", pick(DICTIONARY, "1"), pick(DICTIONARY, "2"), pick(DICTIONARY, "3"), size(1, 9999, "4").cast("string"))
    uuid = F.concat_ws("-", F.substring(digest("u"), 1, 8), F.substring(digest("u"), 9, 4), F.substring(digest("u"), 13, 4), F.substring(digest("u"), 17, 4), F.substring(digest("u"), 21, 12))
    dated = F.concat_ws("-", pick(DICTIONARY, "1"), size(1990, 2030, "y").cast("string"), F.lpad(size(1, 12, "m").cast("string"), 2, "0"), F.lpad(size(1, 28, "d").cast("string"), 2, "0"))
    hexes, number = digest("h"), F.translate(digest("d"), "abcdef", "123456")
    letters = F.translate(F.when(i % 3 == 0, alnum).otherwise(F.lower(alnum)), "0123456789", "qwrtzpsdfg")
    joined = F.concat(cut(letters, 2, 8), F.element_at(F.array(*map(F.lit, (":", ".", "@"))), size(1, 3, "j")))
    assigned = F.concat(pick(SECRET_WORDS, "w"), F.element_at(F.array(*map(F.lit, ("=", " = \"", ": ", "=\"", ": '", " = "))), size(1, 6, "s")))
    kinds = [
        (secret_context, cut(hexes, 16, 64), 1), (secret_context, cut(alnum, 16, 43), 1), (secret_context, cut(b64, 16, 43), 1),
        (prose, F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), 1),
        (F.when(i % 2 == 0, prose).otherwise(secret_context), F.concat(pick(PREFIXES.removeprefix("AKIA "), "x"), cut(alnum, 20, 40)), 1),
        (prose, cut(alnum, 32, 43), 1),
        (harmless_context, cut(hexes, 32, 64), 0), (prose, cut(hexes, 40, 40), 0), (F.when(i % 2 == 0, harmless_context).otherwise(secret_context), names, 0),
        (F.when(i % 2 == 0, harmless_context).otherwise(prose), uuid, 0), (prose, dated, 0), (F.when(i % 2 == 0, prose).otherwise(harmless_context), cut(number, 16, 19), 0),
        (F.lit("https:/"), F.concat(F.lit("/"), F.concat_ws("/", pick(DICTIONARY, "1"), pick(DICTIONARY, "2"), cut(number, 4, 10))), 0),
        (F.concat(pick(DICTIONARY, "9"), F.lit(".")), F.concat(pick(DICTIONARY, "1"), pick(DICTIONARY, "2"), cut(number, 6, 12)), 0),
        # Joined by a mark: a key and its secret, the parts of a signed token.
        (F.when(i % 2 == 0, prose).otherwise(secret_context), F.concat(F.lit("AKIA"), F.upper(F.substring(alnum, 1, 16))), 1), (joined, cut(b64, 20, 43), 1),
        (F.when(i % 2 == 0, joined).otherwise(F.lit("bearer ")), F.concat(F.lit("eyJ"), cut(alnum, 13, 40)), 1),
        # Assigned, short or without a digit.
        (assigned, F.concat(F.when(i % 2 == 0, pick(PLAIN_WORDS, "k")).otherwise(cut(letters, 2, 6)), size(1, 9999, "4").cast("string"), F.when(i % 3 != 0, cut(letters, 1, 6)).otherwise(F.lit(""))), 1),
        (assigned, F.substring(letters, F.lit(1), size(8, 15, "n")), 1), (assigned, F.substring(letters, F.lit(1), size(16, 32, "n")), 1),
        *[(assigned, pick(PLAIN_WORDS, f"k{j}"), 0) for j in range(2)], (assigned, pick(DICTIONARY, "k"), 0), (assigned, F.when(i % 2 == 0, cut(number, 1, 4)).otherwise(cut(letters, 1, 4)), 0),
    ]
    kind = F.pmod(i, F.lit(len(kinds)))
    chosen = F.coalesce(*(F.when(kind == k, F.struct(b.alias("before"), c.alias("candidate"), F.lit(y).cast("double").alias("label"))) for k, (b, c, y) in enumerate(kinds)))
    follows = F.concat(F.element_at(F.array(*map(F.lit, (":", ".", "@"))), size(1, 3, "f")), cut(alnum, 4, 8))
    after = F.when(kind.isin(12, 13) & (i % 3 == 0), F.lit(".html")).when(kind.isin(14, 16) | (kind.isin(0, 1, 2, 8, 11, 15) & (i % 5 == 0)), follows).otherwise(F.lit(""))
    made = spark.range(0, rows, 1, 2).select(chosen.alias("f"), after.alias("after"))
    # Written, so that the features and the forest's passes don't carry the expressions above in their plans.
    out = common.written(made.select("f.before", "f.candidate", "after", "f.label"), "labelled")
    return out.where(F.col("candidate").rlike(CANDIDATE) | F.concat("before", "candidate").rlike(f"{CANDIDATE}$"))


def train_forest(findings: DataFrame) -> PipelineModel:
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt")
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="features"), forest]
    return Pipeline(stages=stages).fit(with_features(findings))


def findings(documents: DataFrame, model: PipelineModel) -> DataFrame:
    """(doc_id, h, candidate, before, after, score) of every candidate of every whole text."""
    text = F.col("text").cast("string")
    each = documents.select("doc_id", F.xxhash64("text").alias("h"), F.explode(findings_in(text)).alias("found"))
    each = each.select("doc_id", "h", "found.before", "found.candidate", "found.after")
    scored = model.transform(with_features(each))
    return scored.select("doc_id", "h", "candidate", "before", "after", vector_to_array("probability")[1].alias("score"))


def per_text(documents: DataFrame, model: PipelineModel, cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, h, n_candidates, n_secrets, top, secrets) of texts with candidates; secrets: distinct, longest first."""
    found = findings(documents, model).withColumn("secret", F.when(F.col("score") >= cutoff, F.col("candidate")))
    # The same row twice has the same candidates twice; they are counted once for each row.
    rows = documents.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("copies"))
    out = found.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("nc"), F.count("secret").alias("ns"), F.max("score").alias("top"), F.collect_set("secret").alias("s"))
    key = [out["doc_id"].eqNullSafe(rows["doc_id"]), out["h"] == rows["h"]]
    longest_first = F.array_sort("s", lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return out.join(rows, key).select(out["doc_id"], out["h"], (F.col("nc") / F.col("copies")).cast("long").alias("n_candidates"), (F.col("ns") / F.col("copies")).cast("long").alias("n_secrets"), "top", longest_first.alias("secrets"))


def redact(documents: DataFrame, model: PipelineModel, mark: str = "[SECRET]") -> DataFrame:
    """`documents` with the secrets of every text replaced by `mark`, and n_secrets (which replaces a column of that name); all others pass through."""
    key = common.fresh(documents, "found")
    found = per_text(documents, model).where("n_secrets > 0").select(F.struct("doc_id", "h", "n_secrets", "secrets").alias(key))
    mine = F.col(key)
    place = lambda s: F.when(F.length(s) >= MIN_LENGTH, s).otherwise(F.concat(F.lit(f"(?<!{_RUN})"), s, F.lit(f"(?!{_RUN})")))
    pattern = F.array_join(F.transform(mine["secrets"], lambda s: place(F.replace(s, F.lit("+"), F.lit("[+]")))), "|")
    text = F.coalesce(F.regexp_replace(F.col("text"), pattern, F.lit(re.sub(r"([\\$])", r"\\\1", mark))), F.col("text"))
    joined = documents.join(found, F.col("doc_id").eqNullSafe(mine["doc_id"]) & (F.xxhash64("text") == mine["h"]), "left")
    kept = [text.alias("text") if c == "text" else x for c, x in zip(documents.columns, common.quoted(documents.columns), strict=True) if c != "n_secrets"]
    return joined.select(*kept, F.coalesce(mine["n_secrets"], F.lit(0).cast("long")).alias("n_secrets"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = common.table(spark, sf_dir, "documents")
    found = per_text(documents, train_forest(labelled_findings(spark))).select(F.col("doc_id").alias("id"), F.col("h").alias("g"), "n_candidates", "n_secrets", "top", "secrets")
    rows = documents.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"))
    zero = F.lit(0).cast("long")
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left").select(
        "doc_id",
        F.coalesce("n_candidates", zero).alias("n_candidates"),
        F.coalesce("n_secrets", zero).alias("n_secrets"),
        F.round(F.coalesce("top", F.lit(0.0)), 6).alias("top_score"),
        F.sha2(F.coalesce(F.array_join(F.array_sort("secrets"), ","), F.lit("")).cast("binary"), 256).alias("secrets_sha256"),
    )
