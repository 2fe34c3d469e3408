r"""Document fingerprints: homomorphic multiset hashes of paragraphs.

A paragraph is a piece of a text between line feeds. It hashes to a vector of two parts:

- EXACT lanes modulo 2**32, cut from SHA-512 digests of the paragraph. They decide equality.
- LIKE lanes modulo 2**24: every word of the paragraph, joined with the word after it, adds 1 or -1 to one lane that its
  hash names (a signed count sketch). A paragraph of less than SHORT characters adds its pairs of characters in the same way,
  as so few words say little. These lanes estimate how much two texts share.

A text's fingerprint is the sum of its paragraphs' vectors, lane by lane. So it does not depend on the order of
paragraphs, fingerprints of parts add up to that of the whole, and a paragraph is inserted or deleted by adding or
subtracting its vector (`plus`, `minus`, `updated`) without the rest of the text. The likeness of two fingerprints is
2 * a.b / (a.a + b.b) over the LIKE lanes, not below 0, where a lane counts as the logarithm of its size, so that a line
repeated a hundred times doesn't outweigh all others; its error for texts without common words is about 1 / sqrt(LIKE) = 0.06. Everything is built-in functions and the hashing transformer of pyspark.ml; no Python runs on executors.

The next document is found in one shuffle: ranges of (doc_id, hash of the text) of about RANGE_BYTES are counted first,
each text goes to its range, and the first text of each range is dealt to the range before it as well.

Defined cases: a null text is an empty one, with one empty paragraph; rows without an id come first; rows that repeat an id
follow in the order of their texts' hashes, and rows that repeat both follow each other; the last row's next is the first, a single row's
is itself; very long texts are read whole; an empty table gives no rows. Lanes wrap at their powers: equality is not
touched, a likeness is wrong only where one lane counts more than 2**23. Other columns are ignored by the query and kept by `fingerprinted`.
"""

from __future__ import annotations

import json

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

EXACT, EXACT_BITS = 32, 32
LIKE, LIKE_BITS = 256, 24
SHORT = 40
RANGE_BYTES = 4 << 20
#: Bounds that travel with the plan: 16 bytes each.
MAX_RANGES = 1 << 16


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _digest(paragraph: Column) -> Column:
    """8 hex digits for each of the EXACT lanes."""
    return F.concat(*[F.sha2(F.concat(F.lit(f"{k}:"), paragraph), 512) for k in range(EXACT // 16)])


def exact_lanes(parts: Column) -> Column:
    """Sums of the paragraphs' digests, lane by lane. parts: array of paragraphs."""
    zeros = F.array_repeat(F.lit(0).cast("long"), EXACT)
    add = lambda acc, d: F.transform(acc, lambda a, i: a + F.conv(F.substring(d, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))
    return F.aggregate(F.transform(parts, _digest), zeros, add, lambda acc: F.transform(acc, lambda a: F.pmod(a, F.lit(1 << EXACT_BITS))))


def word_hashes(parts: Column) -> Column:
    """A hash for every word with the word after it in the same paragraph, and for pairs of characters of short paragraphs."""
    words = F.transform(parts, lambda p: F.filter(F.split(p, " "), lambda w: w != ""))
    pairs = F.transform(words, lambda w: F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1))))
    letters = lambda p: F.transform(F.sequence(F.lit(1), F.length(p)), lambda i: F.xxhash64(F.lit(SHORT), F.substring(p, i, F.lit(2))))
    short = F.transform(F.filter(parts, lambda p: F.length(p).between(1, SHORT - 1)), letters)
    return F.flatten(F.concat(pairs, short))


def with_lanes(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with a column `name`, the EXACT + LIKE lanes of column `text`."""
    terms, counts = common.fresh(df, f"{name}_terms"), common.fresh(df, f"{name}_counts")
    df = df.withColumn(terms, word_hashes(paragraphs(F.col(text))))
    df = HashingTF(numFeatures=2 * LIKE, inputCol=terms, outputCol=counts).transform(df)
    df = df.withColumn(counts, vector_to_array(counts))
    plus, minus = F.filter(counts, lambda x, i: i % 2 == 0), F.filter(counts, lambda x, i: i % 2 == 1)
    like = F.zip_with(plus, minus, lambda p, m: F.pmod((p - m).cast("long"), F.lit(1 << LIKE_BITS)))
    return df.withColumn(name, F.concat(exact_lanes(paragraphs(F.col(text))), like)).drop(terms, counts)


def printed(lanes: Column) -> Column:
    """The fingerprint as hex digits: 8 for each exact lane, 6 for each of the others."""
    width = lambda i: F.when(i < EXACT, EXACT_BITS // 4).otherwise(LIKE_BITS // 4)
    return F.array_join(F.transform(lanes, lambda x, i: F.lpad(F.lower(F.hex(x)), width(i), F.lit("0"))), "")


def lanes_of(fingerprint: Column) -> Column:
    """The lanes of a printed fingerprint."""
    wide, narrow = EXACT_BITS // 4, LIKE_BITS // 4
    number = lambda at, n: F.conv(F.substring(fingerprint, at, F.lit(n)), 16, 10).cast("long")
    exact = F.transform(F.sequence(F.lit(0), F.lit(EXACT - 1)), lambda i: number(i * wide + 1, wide))
    like = F.transform(F.sequence(F.lit(0), F.lit(LIKE - 1)), lambda i: number(i * narrow + EXACT * wide + 1, narrow))
    return F.concat(exact, like)


def _wrapped(x: Column, i: Column) -> Column:
    return F.when(i < EXACT, F.pmod(x, F.lit(1 << EXACT_BITS))).otherwise(F.pmod(x, F.lit(1 << LIKE_BITS)))


def plus(a: Column, b: Column) -> Column:
    """Lanes of two parts taken together."""
    return F.transform(F.zip_with(a, b, lambda x, y: x + y), _wrapped)


def minus(a: Column, b: Column) -> Column:
    """Lanes of `a` without the part `b`."""
    return F.transform(F.zip_with(a, b, lambda x, y: x - y), _wrapped)


def spread(lanes: Column) -> Column:
    """The LIKE lanes as numbers around 0, each by the logarithm of its size."""
    half = 1 << (LIKE_BITS - 1)
    signed = F.transform(F.slice(lanes, EXACT + 1, LIKE), lambda x: F.pmod(x + half, F.lit(1 << LIKE_BITS)) - half)
    return F.transform(signed, lambda x: F.signum(x) * F.log2(F.abs(x) + 1.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def alike(a: Column, b: Column, spread_a: Column, spread_b: Column) -> Column:
    """`likeness` of lanes whose spread is known."""
    both = _dot(spread_a, spread_a) + _dot(spread_b, spread_b)
    return F.when(a == b, 1.0).when(both == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 2 * _dot(spread_a, spread_b) / both))


def likeness(a: Column, b: Column) -> Column:
    """How much two texts share, from their lanes: 1 for equal fingerprints, about 0 for texts without common words."""
    return alike(a, b, spread(a), spread(b))


def fingerprinted(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` with the printed fingerprint of column `text`."""
    lanes = common.fresh(docs, "lanes")
    return with_lanes(docs, text, lanes).withColumn(name, printed(F.col(lanes))).drop(lanes)


def updated(prints: DataFrame, edits: DataFrame) -> DataFrame:
    """Fingerprints after paragraphs were put in or taken out, without their texts.

    prints: (doc_id, fingerprint), one row an id; edits: (doc_id, paragraph, copies), copies below 0 for what goes. Edits are
    summed by lane before they meet a fingerprint; ids that have edits only start from the empty sum.
    """
    lane = with_lanes(edits.select("doc_id", "paragraph", F.col("copies").cast("long").alias("copies")).where("copies != 0"), "paragraph", "v")
    each = lane.select("doc_id", "copies", F.posexplode("v").alias("lane", "x")).groupBy("doc_id", "lane").agg(_wrapped(F.sum(F.col("x") * F.col("copies")), F.col("lane")).alias("x"))
    change = each.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("lane", "x"))), lambda s: s.x).alias("change"))
    none = F.array_repeat(F.lit(0).cast("long"), EXACT + LIKE)
    both = prints.select("doc_id", "fingerprint").join(change, "doc_id", "full")
    now = plus(F.when(F.col("fingerprint").isNull(), none).otherwise(lanes_of(F.col("fingerprint"))), F.coalesce("change", none))
    return both.select("doc_id", F.when(F.col("change").isNull(), F.col("fingerprint")).otherwise(printed(now)).alias("fingerprint"))


def _bounds(docs: DataFrame) -> list[tuple[int, int]]:
    """The first (k, h) of every range; the ranges hold about RANGE_BYTES each, and none is empty."""
    keys = common.written(docs.select("k", "h", F.octet_length("text").alias("size")), "keys")
    ranges = min(MAX_RANGES, max(1, (keys.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES))
    least = keys.select("k", "h").repartitionByRange(ranges, "k", "h").groupBy(F.spark_partition_id()).agg(F.min(F.struct("k", "h")).alias("first"))
    out = sorted((r.first.k, r.first.h) for r in least.collect())
    common.discard(keys)
    return out


def _range(bounds: list[tuple[int, int]], ids: Column, hashes: Column) -> Column:
    """The number of the range that (k, h) lies in, by binary search."""
    steps = [1 << s for s in range(len(bounds).bit_length() - 1, -1, -1)]
    below = lambda at: (F.get(ids, at) < F.col("k")) | ((F.get(ids, at) == F.col("k")) & (F.get(hashes, at) <= F.col("h")))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(below(at + s), at + s).otherwise(at))


def with_next(docs: DataFrame) -> tuple[DataFrame, Window]:
    """(doc_id, text, k, h, range, guest, next_text) with the text of the document that follows in the order of ids, and the window in which it does.

    Rows with `guest` are copies of the next range's first row; they are there to be read and have to go in the end.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), F.xxhash64("text").alias("h"))
    bounds = _bounds(docs)
    ids, hashes = (F.from_json(F.lit(json.dumps([b[i] for b in bounds] or [0])), "array<bigint>") for i in (0, 1))
    dealt = docs.withColumn("at", _range(bounds, ids, hashes))
    own = F.struct(F.col("at").alias("range"), F.lit(False).alias("guest"))
    before = F.struct(F.pmod(F.col("at") - 1, F.lit(max(1, len(bounds)))).alias("range"), F.lit(True).alias("guest"))
    first = (F.get(ids, F.col("at")) == F.col("k")) & (F.get(hashes, F.col("at")) == F.col("h"))
    rows = dealt.select("doc_id", "text", "k", "h", F.inline(F.when(first, F.array(own, before)).otherwise(F.array(own))))
    window = Window.partitionBy("range").orderBy("guest", "k", "h")
    return rows.withColumn("next_text", F.lead("text").over(window)), window


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, window = with_next(common.table(spark, sf_dir, "documents"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "text", "k", "h", "range", "guest", n.cast("long").alias("n_chars"), F.when(~F.col("guest"), edited).alias("edited"))
    rows = with_lanes(with_lanes(rows, "text", "own"), "edited", "after").select("doc_id", "k", "h", "range", "guest", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "after")
    rows = rows.withColumns({"own_spread": spread(F.col("own")), "after_spread": spread(F.col("after"))})
    following = {"following": F.lead("own").over(window), "following_spread": F.lead("own_spread").over(window)}
    near = lambda other: alike(F.col("own"), F.col(other), F.col("own_spread"), F.col(f"{other}_spread"))
    return rows.withColumns(following).where(~F.col("guest")).select(
        "doc_id", "n_chars", "edited_sha256", printed(F.col("own")).alias("fingerprint"), printed(F.col("after")).alias("edited_fingerprint"),
        near("after").alias("near_edited"), near("following").alias("near_next"),
    )
