"""Fingerprints, whitening and the divergence audit against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import common, op11_fingerprint, op12_whitening, op13_divergence

M32 = (1 << 32) - 1


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def murmur_long(x: int, seed: int = 42) -> int:
    rot = lambda v, r: ((v << r) | (v >> (32 - r))) & M32
    h = seed
    for k in (x & M32, (x >> 32) & M32):
        h = (rot(h ^ (rot(k * 0xCC9E2D51 & M32, 15) * 0x1B873593 & M32), 13) * 5 + 0xE6546B64) & M32
    h ^= 8
    for r, m in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> r)) * m & M32
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def plain_lanes(text: str) -> list[int]:
    exact, like = [0] * 32, [0] * 256
    for p in text.split("\n"):
        digest = "".join(hashlib.sha512(f"{k}:{p}".encode()).hexdigest() for k in range(2))
        exact = [(a + int(digest[8 * i : 8 * i + 8], 16)) % (1 << 32) for i, a in enumerate(exact)]
        words, hashes = [w for w in p.split(" ") if w], []
        for a, b in zip(words, [*words[1:], None], strict=False):
            h = xxhash.xxh64(a.encode(), seed=42).intdigest()
            hashes.append(h if b is None else xxhash.xxh64(b.encode(), seed=h).intdigest())
        if 0 < len(p) < 40:
            first = xxhash.xxh64((40).to_bytes(4, "little"), seed=42).intdigest()
            hashes += [xxhash.xxh64(p[i : i + 2].encode(), seed=first).intdigest() for i in range(len(p))]
        for h in hashes:
            at = murmur_long(signed(h)) % 512
            like[at // 2] += -1 if at % 2 else 1
    return exact + [v % (1 << 24) for v in like]


def plain_print(text: str) -> str:
    return "".join(f"{v:0{8 if i < 32 else 6}x}" for i, v in enumerate(plain_lanes(text)))


def plain_likeness(a: str, b: str) -> float:
    if plain_lanes(a) == plain_lanes(b):
        return 1.0
    x, y = ([math.copysign(math.log2(abs(s) + 1), s) for s in ((v + (1 << 23)) % (1 << 24) - (1 << 23) for v in plain_lanes(t)[32:])] for t in (a, b))
    both = sum(v * v for v in x) + sum(v * v for v in y)
    return max(0.0, 2 * sum(v * w for v, w in zip(x, y, strict=True)) / both) if both else 0.0


def edited(a: str, b: str) -> str:
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


@pytest.mark.parametrize("size", [1, 300, 1 << 30])
def test_fingerprints(spark, monkeypatch, tmp_path, size):
    monkeypatch.setattr(op11_fingerprint, "RANGE_BYTES", size)
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdeéß漢😀 ", k=r.randint(1, 6)))
    texts = ["\n".join(" ".join(word() for _ in range(r.randint(0, 12))) for _ in range(r.randint(0, 5))) for _ in range(50)]
    rows = [(i * 7 - 40, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "x"), (903, "\n"), (904, "long word " * 9000), (905, texts[3]), (906, texts[3])]
    r.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, k string, range int")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op11_fingerprint.op11_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(order)
    for (i, a), (_, b) in zip(order, order[1:] + order[:1], strict=True):
        x, e = got[i], edited(a, b)
        assert (x.n_chars, x.edited_sha256) == (len(a), hashlib.sha256(e.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (plain_print(a), plain_print(e))
        assert x.near_edited == pytest.approx(plain_likeness(a, e)) and x.near_next == pytest.approx(plain_likeness(a, b))
    assert got[905].fingerprint == got[906].fingerprint and got[905].near_next == 1.0


def test_fingerprints_of_odd_tables(spark, tmp_path):
    rows = {"none": [], "one": [(5, "a b c d")], "same": [(None, "abcd"), (None, "abcd"), (1, "wxyz"), (1, "wxyz"), (1, "mnop")]}
    out = {}
    for name, data in rows.items():
        spark.createDataFrame(data, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out[name] = op11_fingerprint.op11_fingerprints(spark, f"{tmp_path}/{name}").collect()
    assert out["none"] == []
    assert [(x.near_next, x.edited_sha256) for x in out["one"]] == [(1.0, hashlib.sha256(edited("a b c d", "a b c d").encode()).hexdigest())]
    assert len(out["same"]) == 5 and len({x.fingerprint for x in out["same"]}) == 3


def test_fingerprints_add_up(spark):
    docs = spark.createDataFrame([(1, "one two\nthree\nfour five six"), (2, "four five six\none two\nthree"), (3, "three\none two"), (4, None)], "doc_id long, text string")
    prints = op11_fingerprint.fingerprinted(docs).select("doc_id", "fingerprint")
    p = {x.doc_id: x.fingerprint for x in prints.collect()}
    assert p[1] == p[2] != p[3]
    edits = spark.createDataFrame([(1, "four five six", -1), (3, "four five six", 2), (3, "four five six", -1), (9, "new", 1), (2, "gone", 1), (2, "gone", -1)], "doc_id long, paragraph string, copies int")
    after = {x.doc_id: x.fingerprint for x in op11_fingerprint.updated(prints, edits).collect()}
    assert after == {1: plain_print("one two\nthree"), 2: p[2], 3: p[1], 4: p[4], 9: plain_print("new")}
    lanes = prints.select("doc_id", op11_fingerprint.lanes_of(F.col("fingerprint")).alias("v"))
    both = lanes.alias("a").join(lanes.alias("b"), F.expr("a.doc_id = 1 AND b.doc_id = 3"))
    rest, again = both.select(op11_fingerprint.minus(F.col("a.v"), F.col("b.v")), op11_fingerprint.plus(F.col("a.v"), F.col("b.v"))).first()
    assert rest == plain_lanes("four five six") and again == plain_lanes("one two\nthree\nfour five six\nthree\none two")


def test_edits_are_nearer_than_the_next_document(spark, sf_dir):
    out = op11_fingerprint.op11_fingerprints(spark, sf_dir)
    near, mid = out.agg(F.avg((F.col("near_edited") > F.col("near_next")).cast("double")), F.avg("near_edited")).first()
    assert near >= 0.97 and 0.35 < mid < 0.65


def plain_whitening(rows, top=4):
    x = {k: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for k, v in rows}
    u = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(u), u.sum(0)
    c = u - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    return {k: ((n * w - s) ** 2).sum() for k, w in x.items()}, {k: (w - s / n) @ v / np.sqrt(e) for k, w in x.items()}, e / np.trace(c.T @ c / n), n


def test_whitening(spark, monkeypatch):
    monkeypatch.setattr(op12_whitening, "BLOCK", 9)
    monkeypatch.setattr(op12_whitening, "FAN", 2)
    r = np.random.default_rng(5)
    base = r.normal(size=(120, 7)) * np.array([5, 3, 2, 1.5, 1, 0.1, 0.01]) + 40
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(500 + i, base[3].tolist()) for i in range(60)]
    bad = [(900, None), (901, []), (902, [None] * 7), (903, [float("nan")] * 7), (904, [float("inf")] * 7), (905, [1.0] * 3)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + bad], "vec_id long, embedding array<float>, n int, component int").repartition(7)
    got = op12_whitening.whitening(frame).collect()
    far, want, explained, n = plain_whitening(rows)
    assert len(got) == 4 * len(rows) and {x.n for x in got} == {n}
    assert len({x.identity_error for x in got}) == 1 and got[0].identity_error < 1e-9
    signs = {}
    for x in got:
        w = want[x.vec_id][x.component - 1]
        if abs(w) > 0.1:
            assert signs.setdefault(x.component, math.copysign(1, w * x.whitened)) == math.copysign(1, w * x.whitened)
        assert abs(x.whitened) == pytest.approx(abs(w), abs=1e-9)
        assert x.deviation == far[x.vec_id] and x.explained == pytest.approx(explained[x.component - 1], rel=1e-9)


def test_whitening_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>"
    assert op12_whitening.whitening(spark.createDataFrame([], kind)).collect() == []
    assert op12_whitening.whitening(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect() == []
    line = op12_whitening.whitening(spark.createDataFrame([(None, [1.0, 1.0]), (1, [2.0, 2.0]), (1, [4.0, 4.0])], kind)).collect()
    assert sorted((x.vec_id is None, x.component, x.explained) for x in line) == [(False, 1, 1.0), (False, 1, 1.0), (True, 1, 1.0)]
    huge = op12_whitening.whitening(spark.createDataFrame([(1, [3e15, 0.0]), (2, [-3e15, 1.0]), (3, [1e30, 0.0])], kind)).collect()
    assert {x.vec_id for x in huge} == {1, 2} and {x.deviation for x in huge} == {None}


@pytest.mark.parametrize("d", [1, 2, 5, 16])
def test_jacobi(d):
    r = np.random.default_rng(d)
    a = r.normal(size=(d, d)) * 10.0 ** -np.arange(d)
    sigma, v = op12_whitening.jacobi(a)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-13)
    assert np.allclose(sigma, np.linalg.svd(a, compute_uv=False), rtol=1e-10)
    pairs = [tuple(p) for ps, qs in op12_whitening._rounds(d) for p in zip(ps.tolist(), qs.tolist(), strict=True)]
    assert sorted(pairs) == [(i, j) for i in range(d) for j in range(i + 1, d)]


def test_divergence_on_the_given_table(spark, sf_dir):
    got = sorted(tuple(x) for x in op13_divergence.op13_source_divergence(spark, sf_dir).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert got == sorted(con.sql(op13_divergence.SQL).fetchall()) and got


def plain_audit(rows):
    docs = [(la or "", so or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")))) for la, so, t in rows]
    out = []
    for la in {d[0] for d in docs}:
        held, groups = Counter(t for d in docs if d[0] == la for t in d[2]), defaultdict(Counter)
        kept = {t for t, n in held.items() if n >= 3}
        for d in docs:
            if d[0] == la:
                groups[d[1]].update({t: n for t, n in d[2].items() if t in kept})
        whole = sum(groups.values(), Counter())
        p = lambda c, t: 1 + (10**9 * (c[t] + 1)) // (sum(c.values()) + len(kept))
        f = lambda a, b: math.floor(Fraction((a - b) ** 2, b))
        for s, c in groups.items():
            pairs = sorted((-sum(f(p(c, t), p(o, t)) for t in kept), name.encode(), name) for name, o in groups.items() if name != s)
            terms = sorted((-f(p(c, t), p(whole, t)), t.encode(), t) for t in kept if c[t] > 0 and p(c, t) > p(whole, t))[:200]
            out += [(la, s, part, item, -v, k) for part, found in (("pair", pairs), ("term", terms)) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize(("cells", "held"), [(1 << 21, 400_000), (40, 5)])
def test_divergence(spark, monkeypatch, cells, held):
    monkeypatch.setattr(op13_divergence, "CELLS", cells)
    monkeypatch.setattr(op13_divergence, "HELD", held)
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abéß漢😀Z", k=r.randint(1, 3))) for _ in range(400)]
    rows = [(r.choice(["en", "de", None, "x"]), r.choice(["a", "b", "ü", None, "z"]), " ".join(r.choices(vocabulary, k=r.randint(0, 60)))) for _ in range(80)]
    rows += [("lone", "s", "only once"), ("lone", "t", None), ("en", "bare", ""), ("en", "long", "ab É-é_X9x " * 5000)] + [("en", "a", "copy copy ab")] * 4
    frame = spark.createDataFrame([(i, *row, 1, "v") for i, row in enumerate(rows)], "doc_id long, lang string, source string, text string, n int, term string")
    assert sorted(tuple(x) for x in op13_divergence.divergence_audit(frame).collect()) == plain_audit(rows)
    assert op13_divergence.divergence_audit(frame.limit(0)).collect() == []


def test_divergence_of_large_counts():
    counts = np.array([10**12, 5 * 10**14, 0])
    total = 10**15
    assert op13_divergence.probabilities(counts, total).tolist() == [1 + 10**9 * (int(c) + 1) // total for c in counts]


def test_new_queries_give_whole_tables(spark, sf_dir):
    n = common.table(spark, sf_dir, "documents").count()
    assert op11_fingerprint.op11_fingerprints(spark, sf_dir).count() == n
    vectors = common.table(spark, sf_dir, "embeddings").count()
    assert op12_whitening.op12_whitening(spark, sf_dir).count() == 4 * vectors
