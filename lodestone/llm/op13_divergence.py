r"""Source divergence audit: how far the sources of a language differ in their terms, exactly, by integer-dictionary encoding.

Terms are counted in each task and summed. A language keeps the terms of at least KEPT of its documents. Kept terms are
dealt into chunks by hash, so that sources times terms of a chunk is at most about CELLS. A chunk's dictionary is its sorted array of
kept terms; searchsorted gives the ids, which keep the order of UTF-8, so that ties between terms are ties between ids. A chunk of a
language is one dense matrix of counts, a row for each source; probabilities are whole numbers and all arithmetic is exact.
Chunks give partial sums of divergences and their best terms, which are summed and ranked by group. Nothing is broadcast: a
language's sources and totals come to its chunks by a join.

With count c of a term in a group, N the group's kept occurrences and V the language's kept terms: p = 1 + floor(1e9 * (c + 1) / (N + V)),
and p diverges from q by floor((p - q) * (p - q) / q).

Defined cases: null texts, languages and sources are empty ones; a group without terms counts 0 of each; a language without kept
terms has pairs of value 0 and no terms; repeated rows count as often as they stand; ties go to the smaller item in the order of
UTF-8; very long texts are counted whole; an empty table gives no rows; other columns are ignored. Sums are within 64 bits below 2**30 kept terms
of a language and 2**53 occurrences of a term.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

TERM = rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
KEPT, TOP = 3, 200
#: Counts of a chunk's matrix, and terms that a counting task holds.
CELLS, HELD = 1 << 18, 400_000

_LOWER = bytes.maketrans(ascii_uppercase.encode(), ascii_lowercase.encode())


def grouped(documents: DataFrame) -> DataFrame:
    """(lang, source, text) without nulls."""
    return documents.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and documents that hold it."""
    term = re.compile(TERM)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, held) in groups.items():
                terms = list(n)
                texts = pa.array(terms, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), texts, pa.array([n[t] for t in terms], pa.int64()), pa.array([held[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
            groups.clear()

        for batch in batches:
            data, offsets = common.text_buffer(batch.column("text"))
            whole, ends = data.tobytes().translate(_LOWER), offsets.tolist()
            for i, key in enumerate(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)):
                found = term.findall(whole, ends[i], ends[i + 1])
                if found:
                    n, held = groups.setdefault(key, (Counter(), Counter()))
                    n.update(found)
                    held.update(set(found))
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from rows()
        yield from rows()

    pieces = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return pieces.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_counts(counts: DataFrame, least: int = KEPT) -> DataFrame:
    """(lang, source, term, n) of the terms that at least `least` documents of the language hold."""
    held = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("held", held).where(F.col("held") >= least).select("lang", "source", "term", "n")


def probabilities(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(1e9 * (counts + 1) / total), three digits at a time, as the product may not fit 64 bits."""
    rest, out = counts + 1, 0
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def divergences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _chunk(groups: pa.Table, kept: pa.Table, top: int) -> pa.Table:
    """Partial sums of all pairs of sources, and the best terms of each source, in one chunk of a language."""
    groups = groups.sort_by("source")
    sources, lang = groups.column("source").to_pylist(), groups.column("lang")[0].as_py()
    names = np.array([s.encode() for s in sources], object)
    out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}

    def put(source: str, part: str, items: list[str], values: np.ndarray) -> None:
        out["source"] += [source] * len(items)
        out["part"] += [part] * len(items)
        out["item"] += items
        out["value"] += values.tolist()

    if not kept.num_rows:
        for s in sources:
            others = [o for o in sources if o != s]
            put(s, "pair", others, np.zeros(len(others), np.int64))
    else:
        terms = np.array(kept.column("term").cast(pa.binary()).to_pylist(), object)
        dictionary = np.unique(terms)
        ids = np.searchsorted(dictionary, terms)
        rows = np.searchsorted(names, np.array(kept.column("source").cast(pa.binary()).to_pylist(), object))
        counts = np.zeros((len(sources), len(dictionary)), np.int64)
        counts[rows, ids] = kept.column("n").to_numpy()  # each source has a term once
        v = groups.column("v")[0].as_py()
        n = groups.column("n").to_numpy()
        p = probabilities(counts, (n + v)[:, None])
        q = probabilities(counts.sum(0), groups.column("all_n")[0].as_py() + v)
        for s, source in enumerate(sources):
            sums = np.array([int(divergences(p[s], p[o]).sum()) for o in range(len(sources)) if o != s], np.int64)
            put(source, "pair", [o for o in sources if o != source], sums)
            above = np.flatnonzero((counts[s] > 0) & (p[s] > q))
            value = divergences(p[s, above], q[above])
            best = np.lexsort((above, -value))[:top]
            put(source, "term", [dictionary[i].decode() for i in above[best]], value[best])
    return pa.table({"lang": pa.array([lang] * len(out["item"]), pa.string()), "source": pa.array(out["source"], pa.string()), "part": pa.array(out["part"], pa.string()), "item": pa.array(out["item"], pa.string()), "value": pa.array(out["value"], pa.int64())})


def divergence_audit(documents: DataFrame, least: int = KEPT, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources of a language, and the `top` terms that set a source apart from its language."""
    docs = grouped(documents)
    kept = common.written(kept_counts(term_counts(docs), least), "kept")
    found = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = docs.select("lang", "source").distinct().join(found, ["lang", "source"], "left").fillna(0, "n")
    vocabulary = kept.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = groups.groupBy("lang").agg(F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("sources")).join(vocabulary, "lang", "left").fillna(0, "v")
    groups = common.written(groups.join(totals, "lang"), "groups")
    chunks = max(1, groups.agg(F.max(F.ceil(F.col("v") * F.col("sources") / CELLS))).first()[0] or 0)
    dealt = kept.withColumn("chunk", F.pmod(F.xxhash64("term"), F.lit(chunks)))
    everywhere = groups.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    pieces = everywhere.groupBy("lang", "chunk").cogroup(dealt.groupBy("lang", "chunk")).applyInArrow(lambda g, k: _chunk(g, k, top), "lang string, source string, part string, item string, value long")
    sums = pieces.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return sums.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_audit(common.table(spark, sf_dir, "documents"))


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{TERM.decode()}') AS terms FROM documents),
w AS (SELECT lang, source, k, term, count(*) AS n FROM (SELECT lang, source, k, unnest(terms) AS term FROM d) GROUP BY ALL),
t AS (SELECT lang, term, sum(n) AS n FROM w GROUP BY ALL HAVING count(*) >= {KEPT}),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM t GROUP BY ALL),
c AS (SELECT lang, source, term, sum(w.n) AS n FROM w SEMI JOIN t USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(c.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (t.n + 1)::HUGEINT) // (v.n + v.v)::HUGEINT AS q FROM t JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, t.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)::HUGEINT) // (g.n + v.v)::HUGEINT AS p
      FROM g JOIN t ON g.lang = t.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = t.term),
f AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
s AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT p.lang, p.source, 'term', p.term, CAST(((p.p - q.q) * (p.p - q.q)) // q.q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM s)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP}
"""
