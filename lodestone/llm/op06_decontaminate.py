r"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, verified exactly.

A window is WINDOW consecutive words of an item (a shorter item is one window). Words are ordered by rarity, counted
over all documents. A document that holds a window holds its rarest word, so that word is the window's necessary
prefix: documents' words are joined with the prefixes alone. The prefix's place in the window and the window's length
bound where it can start (positional and length bounds), and the words there are compared one by one. Everything runs
in built-in functions; the verification is part of the join's stage, so candidates are never materialised. Documents are cut into words
once; the words are written to the shared folder, joined by blanks, and later passes cut them at these.

Windows travel to the documents, in blocks of at most BLOCK_BYTES, so what is broadcast is bounded whatever the size of
the benchmark; each block is one pass over the documents. One block serves about 100,000 windows.

Defined cases: null and empty texts have no words and no hits; items without words have no windows; rows without an
item_id are left out, rows that repeat one are one item with all their windows; rows that repeat a doc_id are judged
each by its own text; very long texts are searched whole; empty tables give no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLOCK_BYTES = 24 << 20


def words(text: Column) -> Column:
    """Words of a text after lower-casing A-Z; none for a null."""
    return F.coalesce(F.regexp_extract_all(F.translate(text, ascii_uppercase, ascii_lowercase), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def item_windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window): distinct windows of every item."""
    w = benchmark.select("item_id", words(F.col("text").cast("string")).alias("words")).where(F.col("item_id").isNotNull() & (F.size("words") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - size + 1))
    return w.select("item_id", "words", F.explode(starts).alias("start")).select("item_id", F.slice("words", F.col("start"), size).alias("window")).distinct()


def tokenised(documents: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, joined): the words of every document, cut once and written."""
    w = documents.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text").cast("string")).alias("w"))
    return common.written(w.select("doc_id", "h", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("joined")), "words")


def cut(tokens: DataFrame) -> DataFrame:
    """`tokens` with `words` in place of `joined`; documents without words are left out."""
    return tokens.where("n_words > 0").select("doc_id", "h", F.split("joined", " ").alias("words"))


def word_counts(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n) for the words of `vocabulary`, over all documents; absent words have no row."""
    each = cut(tokens).select(F.explode("words").alias("word"))
    return each.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def with_prefix(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds the rarest word of each window (ties to the smaller word) and its first place in it."""
    each = windows.select("window", F.posexplode("window").alias("at", "word")).distinct()
    rarest = each.join(counts, "word", "left").groupBy("window").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("p"))
    return windows.join(rarest, "window").select("item_id", "window", F.col("p.word").alias("word"), F.col("p.at").alias("at"))


def occurrences(tokens: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, h, item_id, start, stop): word spans where a window occurs. `windows` must be small enough to broadcast."""
    each = cut(tokens).select("doc_id", "h", "words", F.posexplode("words").alias("pos", "word"))
    start = F.col("pos") - F.col("at")
    return (
        each.join(F.broadcast(windows), "word")
        .where((start >= 0) & (start + F.size("window") <= F.size("words")))
        .where(F.slice("words", start + 1, F.size("window")) == F.col("window"))
        .select("doc_id", "h", "item_id", start.cast("long").alias("start"), (start + F.size("window")).cast("long").alias("stop"))
    )


def covered(spans: Column) -> Column:
    """Number of places in the union of (start, stop) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    step = lambda a, s: F.struct((a.n + F.greatest(F.lit(0).cast("long"), s.stop - F.greatest(s.start, a.end))).alias("n"), F.greatest(a.end, s.stop).alias("end"))
    return F.aggregate(F.array_sort(spans), zero, step, lambda a: a.n)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, h, n_hit, items, spans) of documents with a hit; h = xxhash64(text) tells rows that repeat an id apart.

    items: sorted ids as strings; spans: sorted distinct word spans (start, stop) of the windows found.
    """
    return hits_in(tokenised(documents), benchmark, window, block_bytes)


def hits_in(tokens: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """`contamination` of documents that are cut into words already."""
    windows = item_windows(benchmark, window)
    total = windows.agg(F.sum(F.aggregate("window", F.lit(64).cast("long"), lambda a, w: a + F.octet_length(w) + 16))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = []
    for k in range(blocks):
        part = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        vocabulary = part.select(F.explode("window").alias("word")).distinct()
        # A table of at most block_bytes; kept, so that the count over the documents runs once.
        prefixed = common.written(with_prefix(part, word_counts(tokens, vocabulary)).coalesce(1), "windows")
        found.append(occurrences(tokens, prefixed))
    hits = reduce(DataFrame.unionByName, found)
    return (
        hits.groupBy("doc_id", "h")
        .agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select("doc_id", "h", covered(F.col("spans")).alias("n_hit"), "items", "spans")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokenised(common.table(spark, sf_dir, "documents"))
    hits = hits_in(tokens, common.table(spark, sf_dir, "benchmark"))
    sized = tokens.select(F.col("doc_id").cast("long"), "h", "n_words")
    hits = hits.select(F.col("doc_id").alias("id"), F.col("h").alias("g"), "n_hit", "items")
    zero = F.lit(0).cast("long")
    return sized.join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")), "left").select(
        "doc_id", "n_words",
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("items").cast("long"), zero).alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", zero) > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, s, s + 9), ' ') AS k, least(len(w), 10) AS n
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, dw.n AS n FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
