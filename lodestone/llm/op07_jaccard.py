"""N-gram Jaccard join: exact links of texts whose shingle sets have a Jaccard distance of at most EPS, and their classes.

Shingle size and threshold are parameters; EPS is 1 - num / den. The defaults, 3 words and 90/100, are the figures of the op7 query.

The Jaccard distance is a metric, so pivots can part the texts. But nearly all pairs of texts are at distance 1 from each other, and
a text at distance 1 from all pivots lies in no cell more than in another: its window holds every cell. Two exact steps
therefore come before the metric join:
- isolation: a text of n shingles linked with another has at most n - ceil(n num / den) shingles of its own. Shingles are counted
  by a fixed share of their hashes (see `sample`; over all texts); a text with more shingles of its own than that has no
  link and is done. What the share can't tell stays in the join, so nothing is lost.
- ground: the texts left are ordered by their rarest shingles; linked texts share one of the first n - ceil(n num / den) + 1.
  Texts with such a shingle in common form a first region, named by the least of them.
The metric join then works on regions. One of more than LEAF texts gets pivots, and every text its exact distances from them. Each
pivot has a Voronoi cell: the texts that have no nearer pivot. If x lies in the cell of p and y is linked with x, the triangle
inequality gives d(y, p) <= d(y, q) + 2 EPS for every pivot q, so a text is replicated to every cell whose pivot is at most 2 EPS
farther than its nearest one, and no link is lost between cells. Cells are regions again, until they have at most LEAF texts and are
joined in one task, where distances from further pivots spare most comparisons. Texts within EPS of a pivot are linked with it, and so
with each other; a cell without any other text is done, so large groups of near copies cost a comparison with their pivot each.
A region does not part if its cells hold more than GROW times its texts together (texts that resemble no pivot), or one holds
nearly all of them. It is dealt into blocks of LEAF texts, and pairs of blocks are joined in tasks of their own, but for pairs of blocks
that are known to be one class. So every round ends a region or makes it smaller.

Texts with equal sets are one set from the first step on. Links are reduced to classes by star contraction.

Defined cases: null, empty and blank texts have no shingles, no links and their own doc_id as class; texts of fewer words
have one shingle; rows that repeat a doc_id are texts of their own; a null doc_id is the largest id; an empty table gives no rows;
other columns are ignored. Sets and shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common, hashing
from .components import components

SIZE = 3
NUM, DEN = 90, 100
LEAF = 2048
PIVOTS = 8
CELLS = 16
GROW, SHRINK = 2, 0.9
BUCKET = 2048
NO_ID = (1 << 63) - 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a chunk."""
    data = hashing.LOWER[data]
    s, e = hashing.spans(hashing.NON_SPACE[data], offsets)
    h, text = hashing.span_hashes(hashing.prefix_sums(data), s, e), hashing.text_of(s, offsets)
    grams = hashing.ngrams(h, size)
    inside = text[: len(grams)] == text[size - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[inside], text[: len(inside)][inside]
    cuts = np.searchsorted(owner, np.arange(len(offsets)))
    words = np.searchsorted(text, np.arange(len(offsets)))
    out = []
    for k in range(len(offsets) - 1):
        g = grams[cuts[k] : cuts[k + 1]]
        if not len(g) and words[k] < words[k + 1]:  # fewer words: the whole sequence is one shingle
            w = h[words[k] : words[k + 1]]
            g = hashing.mix(hashing.ngrams(w, len(w)) + np.uint64(len(w)))
        out.append(np.unique(g))
    return out


def set_id(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(hashing.mix((hashing.mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))).reshape(1)).view(np.int64)[0])


def _each(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
    for batch in batches:
        data, offsets = common.text_buffer(batch.column("text"))
        for first, _, part, at in common.chunks(data, offsets):
            yield batch, first, shingle_sets(part, at, size)


def id_rows(batches: Iterator[pa.RecordBatch], size: int = SIZE) -> Iterator[pa.RecordBatch]:
    for batch, first, sets in _each(batches, size):
        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, len(sets)) for c in ("doc", "h")), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc", "h", "sid", "n"])


def sample(num: int = NUM, den: int = DEN) -> int:
    """One in how many shingles tells isolation: about twice as many of them as a linked text may have to itself."""
    return max(3, 5 * den // (10 * max(1, den - num)))


def sampled_rows(batches: Iterator[pa.RecordBatch], size: int = SIZE, share: int = 3) -> Iterator[pa.RecordBatch]:
    for _, _, sets in _each(batches, size):
        kept = [s[s % np.uint64(share) == 0] for s in sets]
        owner = np.repeat(np.array([set_id(s) for s in sets], np.int64), [len(k) for k in kept])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64)), pa.array(owner)], ["shingle", "sid"])


def set_rows(batches: Iterator[pa.RecordBatch], size: int = SIZE) -> Iterator[pa.RecordBatch]:
    for _, _, sets in _each(batches, size):
        cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(sets).view(np.int64)))], ["sid", "shingles"])


def sources(documents: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("h"), text.alias("text"))


def prefix(n: Column, num: int = NUM, den: int = DEN) -> Column:
    """One more than the shingles that a linked text of n may have to itself."""
    return n - F.ceil(n * num / den) + 1


def crowded(source: DataFrame, sets: DataFrame, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """The rows of `sets` (sid, n, doc, h) that isolation can't tell to be without links."""
    share = sample(num, den)
    seen = source.mapInArrow(lambda batches: sampled_rows(batches, size, share), "shingle long, sid long").groupBy("shingle").agg(F.min("sid").alias("sid"), F.max("sid").alias("other"))
    own = seen.where("sid = other").groupBy("sid").agg(F.count(F.lit(1)).alias("own"))
    return sets.join(own, "sid", "left").where(F.coalesce("own", F.lit(0)) < prefix(F.col("n"), num, den)).drop("own")


def region_members(sets: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(rid, sid, label): sets (sid, n, shingles) by the regions of their rarest shared shingles; no label is known yet."""
    each = sets.select("sid", "n", F.explode("shingles").alias("s"))
    kept = each.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("s"))).where("df > 1")
    by_set = Window.partitionBy("sid")
    rank = F.row_number().over(by_set.orderBy("df", "s")) + F.col("n") - F.count(F.lit(1)).over(by_set)
    keys = common.written(kept.withColumn("rank", rank).where(F.col("rank") <= prefix(F.col("n"), num, den)).select("s", "sid"), "keys")
    named = keys.groupBy("s").agg(F.min("sid").alias("rid"), F.max("sid").alias("most")).where("rid != most").select("s", "rid")
    return keys.join(named, "s").select("rid", "sid").distinct().withColumn("label", F.lit(None).cast("long"))


def _sets_of(t: pa.Table, column: str = "shingles") -> tuple[list[np.ndarray], np.ndarray]:
    raw = t.column(column).combine_chunks()
    values, cuts = raw.flatten().to_numpy(), raw.offsets.to_numpy() - raw.offsets[0].as_py()
    return [values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.diff(cuts).astype(np.int64)


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def from_pivots(members: pa.Table, pivots: pa.Table, num: int = NUM, den: int = DEN) -> pa.Table:
    """(rid, sid, ds, pivots, near): exact distances of some members of a region from its pivots, and the pivots that each is linked with."""
    sets, size = _sets_of(members)
    marks, width = _sets_of(pivots, "mark")
    pid = pivots.column("pid").to_numpy()
    order = np.argsort(pid, kind="stable")
    ds, near = np.zeros((len(sets), len(marks))), []
    for k, s in enumerate(sets):
        both = np.array([_shared(s, marks[p]) for p in order])
        union = size[k] + width[order] - both
        ds[k] = 1 - both / union
        near.append(pid[order][den * both >= num * union].tolist())
    return pa.table({"rid": members.column("rid"), "sid": members.column("sid"), "ds": pa.array(list(ds), pa.list_(pa.float64())), "pivots": pa.array([pid[order].tolist()] * len(sets), pa.list_(pa.int64())), "near": pa.array(near, pa.list_(pa.int64()))})


def measured(large: DataFrame, sets: DataFrame, leaf: int, num: int, den: int) -> DataFrame:
    """(rid, sid, ds, pivots, near, members, label): members of large regions with their distances from the region's pivots.

    A region has at most CELLS pivots, texts without a label first, chosen by hash. They go to every block of LEAF members, so no task holds a region.
    """
    by_region = Window.partitionBy("rid").orderBy(F.col("label").isNotNull(), F.xxhash64("rid", "sid"), "sid")
    wanted = F.least(F.lit(CELLS), 2 + F.floor(F.col("members") / leaf))
    chosen = large.withColumn("k", F.row_number().over(by_region)).where((F.col("k") <= CELLS) & (F.col("k") <= wanted))
    blocks = F.floor((F.col("members") - 1) / leaf)
    chosen = chosen.select(F.col("rid").alias("of"), F.col("sid").alias("pid"), F.explode(F.sequence(F.lit(0).cast("long"), blocks)).alias("part"))
    dealt = large.select("rid", "sid", "members", F.pmod(F.xxhash64("sid"), blocks + 1).alias("block"))
    left = dealt.join(sets.select("sid", "shingles"), "sid").select("rid", "block", "sid", "shingles")
    right = chosen.join(sets.select(F.col("sid").alias("pid"), F.col("shingles").alias("mark")), "pid")
    found = left.groupBy("rid", "block").cogroup(right.groupBy("of", "part")).applyInArrow(lambda m, p: from_pivots(m, p, num, den), "rid long, sid long, ds array<double>, pivots array<long>, near array<long>")
    return found.join(large.select(F.col("rid").alias("of"), F.col("sid").alias("pid"), "members", "label"), (F.col("rid") == F.col("of")) & (F.col("sid") == F.col("pid"))).drop("of", "pid")


def cells(found: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(rid, cell, sid, label): the Voronoi cells of each region, with the texts in the windows of their boundaries.

    Pivots have been compared with their whole region and go. Members of one label are known to be in one class.
    """
    reach = F.array_min("ds") + 2 * (1 - num / den) + 1e-9
    each = found.where(~F.array_contains("pivots", F.col("sid"))).select("rid", "sid", "near", "label", "pivots", reach.alias("reach"), F.posexplode("ds").alias("k", "d"))
    pivot = F.get("pivots", F.col("k"))
    label = F.when(F.array_contains("near", pivot), pivot).otherwise(F.coalesce(F.array_min("near"), "label"))
    return each.where(F.col("d") <= F.col("reach")).select("rid", F.xxhash64("rid", "k").alias("cell"), "sid", label.alias("label"))


def joined_in_task(t: pa.Table, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """Links between classes of one region: enough of them to hold its classes together.

    Members of one label are known to be linked. If the members come from two blocks, only pairs of both are compared.
    """
    out: list[tuple[int, int]] = []
    sets, size = _sets_of(t)
    n, sid = len(sets), t.column("sid").to_numpy()
    label = t.column("label").fill_null(-1).to_numpy()
    known = ~t.column("label").is_null().to_numpy(zero_copy_only=False)
    block = t.column("block").to_numpy()
    two = len(block) > 0 and (block != block[0]).any()
    root = np.arange(n)
    if known.any():
        _, first, back = np.unique(label, return_index=True, return_inverse=True)
        root = np.where(known, first[back], root)
    table = []
    for p in range(0, n, max(1, n // PIVOTS)) if n > 4 * PIVOTS else (0,):
        shared = np.array([_shared(sets[p], s) for s in sets])
        table.append(1 - shared / (size[p] + size - shared))
    order = np.argsort(table[0], kind="stable")
    table = np.array(table)[:, order]
    sid, size, root, block = sid[order], size[order], root[order], block[order]
    sets = [sets[k] for k in order]
    eps, d = 1 - num / den + 1e-9, table[0]
    for i in range(n - 1):
        rest = np.arange(i + 1, np.searchsorted(d, d[i] + eps, "right"))
        if two:
            rest = rest[block[rest] != block[i]]
        rest = rest[(root[rest] != root[i]) & (den * np.minimum(size[rest], size[i]) >= num * np.maximum(size[rest], size[i]))]
        rest = rest[(np.abs(table[:, rest] - table[:, [i]]) <= eps).all(0)]
        for j in rest:
            if root[i] == root[j]:
                continue
            shared = _shared(sets[i], sets[j])
            if den * shared >= num * (size[i] + size[j] - shared):
                out.append((int(sid[i]), int(sid[j])))
                root[root == root[j]] = root[i]
    return out


def joined(regions: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v): links within regions (rid, sid, label, block) of bounded size; many small regions share a task."""
    buckets = max(1, regions.count() // BUCKET)  # members of a task, besides a region of up to twice LEAF

    def each(t: pa.Table) -> pa.Table:
        t = t.sort_by("rid")
        rid = t.column("rid").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1], [True]]))
        links = [x for a, b in zip(cuts[:-1], cuts[1:], strict=True) for x in joined_in_task(t.slice(a, b - a), num, den)]
        return pa.table({"u": pa.array([a for a, _ in links], pa.int64()), "v": pa.array([b for _, b in links], pa.int64())})

    held = regions.join(sets.select("sid", "shingles"), "sid").select(F.pmod(F.xxhash64("rid"), F.lit(buckets)).alias("bucket"), "rid", "sid", "label", "block", "shingles")
    return common.written(held.groupBy("bucket").applyInArrow(each, "u long, v long"), "found")


def paired_blocks(stuck: DataFrame, leaf: int) -> DataFrame:
    """(rid, sid, label, block): regions for the pairs of blocks of about `leaf` members of regions (rid, sid, label) that do not part.

    Members of the most frequent label are one class, so their blocks are not paired with each other: what a large group of near copies
    costs grows with the texts that are not known to belong to it.
    """
    sizes = stuck.groupBy("rid").agg(F.mode("label", True).alias("most"), F.count(F.lit(1)).alias("members"))
    part = stuck.join(sizes, "rid").withColumn("known", F.coalesce(F.col("label") == F.col("most"), F.lit(False)))
    counts = part.groupBy("rid").agg(F.count_if("known").alias("n_known"), F.count_if(~F.col("known")).alias("n_odd"))
    blocks = lambda n: F.floor((F.col(n) + leaf - 1) / leaf)
    odd, known = blocks("n_odd"), blocks("n_known")
    deal = lambda n: F.pmod(F.xxhash64("sid", F.lit(1)), n)
    mine = F.when(F.col("known"), odd + deal(known)).otherwise(deal(odd))
    others = F.sequence(F.lit(0).cast("long"), F.when(F.col("known"), odd - 1).otherwise(odd + known - 1))
    each = part.join(counts, "rid").where("n_odd > 0").select("rid", "sid", "label", mine.alias("block"), F.explode(others).alias("other"))
    return each.select(F.xxhash64("rid", F.least("block", "other"), F.greatest("block", "other")).alias("rid"), "sid", "label", "block")


def set_links(sets: DataFrame, leaf: int = LEAF, num: int = NUM, den: int = DEN) -> DataFrame:
    """(u, v): links of sets (sid, n, shingles) that hold every class together."""
    members, links = region_members(sets, num, den), []
    none = F.lit(0).cast("long").alias("block")
    while True:
        unlike = F.bool_or(F.col("label").isNull()) | (F.min("label") != F.max("label"))
        sized = members.groupBy("rid").agg(F.count(F.lit(1)).alias("members"), unlike.alias("open"))
        regions = common.written(members.join(sized.where("open AND members > 1"), "rid"), "regions")
        links.append(joined(regions.where(F.col("members") <= leaf).select("rid", "sid", "label", none), sets, num, den))
        large = regions.where(F.col("members") > leaf).select("rid", "sid", "members", "label")
        if large.isEmpty():
            break
        found = common.written(measured(large, sets, leaf, num, den), "distances")
        links.append(found.select(F.col("sid").alias("u"), F.explode("near").alias("v")).where("u != v"))
        parts = common.written(cells(found, num, den), "cells")
        sizes = parts.groupBy("rid", "cell").agg(F.count(F.lit(1)).alias("n")).groupBy("rid").agg(F.sum("n").alias("after"), F.max("n").alias("largest"))
        stuck = found.select("rid", "members").distinct().join(sizes, "rid").where((F.col("after") > GROW * F.col("members")) | (F.col("largest") > SHRINK * F.col("members"))).select("rid")
        whole = found.join(stuck, "rid", "left_semi").where(~F.array_contains("pivots", F.col("sid"))).select("rid", "sid", F.coalesce(F.array_min("near"), "label").alias("label"))
        links.append(joined(paired_blocks(whole, leaf), sets, num, den))
        members = parts.join(stuck, "rid", "left_anti").select(F.col("cell").alias("rid"), "sid", "label")
    out = links[0]
    for other in links[1:]:
        out = out.unionByName(other)
    return out


def jaccard_classes(documents: DataFrame, leaf: int = LEAF, size: int = SIZE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc, h, n, first_doc, first_h): each row's class, named by its least row; equal sets are one class.

    Texts are linked if at least num / den of the union of their sets of shingles of `size` words is common to both.
    """
    source = sources(documents)
    rows = common.written(source.mapInArrow(lambda batches: id_rows(batches, size), "doc long, h long, sid long, n long"), "sets")
    sets = rows.where("n > 0").groupBy("sid", "n").agg(F.min(F.struct("doc", "h")).alias("at")).select("sid", "n", "at.doc", "at.h")
    left = common.written(crowded(source, sets, size, num, den), "crowded")
    # The texts left grow with the corpus, so they are never broadcast: every size has the plan of a large one.
    full = source.join(left.select("doc", "h").hint("merge"), ["doc", "h"]).mapInArrow(lambda batches: set_rows(batches, size), "sid long, shingles array<long>").dropDuplicates(["sid"])
    full = common.written(full.select("sid", F.size("shingles").cast("long").alias("n"), "shingles"), "shingles")
    node = left.select("sid", F.struct("doc", "h", "sid").alias("node"))
    links = set_links(full, leaf, num, den)
    edges = links.join(node.withColumnsRenamed({"sid": "u", "node": "nu"}), "u").join(node.withColumnsRenamed({"sid": "v", "node": "nv"}), "v")
    classes = components(edges.select(F.col("nu").alias("u"), F.col("nv").alias("v")))
    named = sets.select("sid", "n", F.struct("doc", "h", "sid").alias("u")).join(classes, "u", "left").select("sid", "n", F.coalesce("v", "u").alias("c"))
    out = rows.join(named, ["sid", "n"], "left")
    return out.select("doc", "h", "n", F.coalesce("c.doc", "doc").alias("first_doc"), F.coalesce("c.h", "h").alias("first_h"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_classes(common.table(spark, sf_dir, "documents"), size=SIZE, num=NUM, den=DEN)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(real("doc").alias("doc_id"), F.col("n").alias("n_shingles"), real("first_doc").alias("component_id"))


def brute_force(rows: list[tuple[int, str]], size: int = SIZE, num: int = NUM, den: int = DEN) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id) by comparing all pairs; for tests with distinct ids."""
    import re

    sets = {}
    for doc_id, text in rows:
        w = re.findall("[^ \t-\r]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets[doc_id] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * min(len(x), len(y)) >= num * max(len(x), len(y)) and den * len(x & y) >= num * len(x | y):
                r, s = sorted((find(a), find(b)))
                root[s] = r
    return {d: (len(sets[d]), find(d)) for d in ids}
