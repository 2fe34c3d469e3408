"""Classifiers by held-out accuracy, search by brute force, the pipeline by its rules."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import common, op01_quality, op04_topk, op07_jaccard, op08_toxicity
from lodestone.llm.components import components


@pytest.fixture(scope="module")
def big():
    return "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "least"), [(op01_quality.op1_quality_classifier, "quality", 0.95), (op08_toxicity.op8_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, big, query, label, least):
    out = query(spark, big)
    assert out.count() == common.table(spark, big, "documents").count()
    joined = out.join(common.table(spark, big, "labels"), "doc_id").where("held_out")
    right = joined.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0]
    assert right >= least
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_classifier_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "word " * 5000), (3, "word " * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int, text string")
    assert {r.score for r in op01_quality.score_quality(docs, op01_quality.train_quality(docs, labels)).collect()} == {0.5}
    assert {r.toxicity for r in op08_toxicity.score_toxicity(docs, op08_toxicity.train_toxicity(docs, labels)).collect()} == {0.5}
    assert op01_quality.score_quality(docs.limit(0), None).count() == 0


def test_pairs_matter():
    v = np.array([[1.0, 0.0], [2.0, 0.0], [0.0, 3.0]])
    assert op08_toxicity.pairs(v) == pytest.approx(sum(v[i] @ v[j] for i in range(3) for j in range(i + 1, 3)))


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(op04_topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(op04_topk, "CANDIDATE_BLOCK", 11)
    r = random.Random(1)
    rows = [(i, [r.uniform(-1, 1) for _ in range(6)]) for i in range(90)] + [(i, [0.5] * 6) for i in range(90, 130)]
    bad = [(200, None), (201, [None] * 6), (202, [float("nan")] + [0.0] * 5), (203, [float("inf")] * 6), (None, [0.1] * 6), (130, [0.5] * 6), (130, [0.5] * 6), (204, [])]
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, label int, score string")
    vectors = op04_topk.scaled(frame)
    got = {}
    for x in op04_topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    ints = {i: [int(np.floor(64 * float(np.float32(e)))) for e in v] for i, v in rows + [(130, [0.5] * 6)]}
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted(((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in ints.items() if i != q))[:20]
        assert got[q] == {k: (i, -s) for k, (s, i) in enumerate(scores, 1)}
    assert set(got) == {i for i in ints if i % 20 == 0}
    assert op04_topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101)], "u long, v long")
    got = {r.u: r.v for r in components(edges).collect()}
    assert got == {**{k: 1 for k in range(2, 41)}, 101: 100, 102: 100}
    assert components(edges.limit(0)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").withColumn("extra", F.lit("kept"))
    columns, n = docs.columns, docs.count()
    assert [s for s, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "secret_scan", "byte_bpe"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == columns and docs.count() <= n and docs.where("extra = 'kept'").count() == docs.count()
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    digests = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("want"))
    assert out.join(digests, "doc_id").where("want = decoded_sha256").count() == n


def test_pipeline_keeps_edge_rows(spark, sf_dir):
    schema = common.table(spark, sf_dir, "documents").schema
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "plain words here", "en", "s", 16), (3, "plain words here", "en", "s", 16)], schema)
    kept = corpus_pipeline.jaccard_join(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert corpus_pipeline.decontamination(spark, kept, sf_dir).count() == 3
    assert corpus_pipeline.jaccard_join(spark, docs.limit(0), sf_dir).count() == 0


def test_pipeline_drops_near_copies_between_the_settings(spark, sf_dir):
    r, rows = random.Random(4), []
    for k, (n, changed) in enumerate([(200, 4), (100, 2), (500, 10)] * 4):
        words = [f"w{r.randint(0, 10**6)}" for _ in range(n)]
        copy = list(words)
        for at in range(changed):
            copy[(2 * at + 1) * n // (2 * changed)] = f"other{k}_{at}"
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
    missed = op07_jaccard.brute_force(rows)
    want = op07_jaccard.brute_force(rows, corpus_pipeline.SHINGLE, corpus_pipeline.NUM, corpus_pipeline.DEN)
    assert all(c == d for d, (_, c) in missed.items()) and all(c == d - d % 2 for d, (_, c) in want.items())
    schema = common.table(spark, sf_dir, "documents").schema
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    kept = corpus_pipeline.jaccard_join(spark, docs, sf_dir)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({c for _, c in want.values()})


def test_top_k_of_ids_with_many_vectors(spark):
    r = random.Random(2)
    rows = [(1, [r.uniform(0.8, 1) for _ in range(6)]) for _ in range(25)] + [(i, [r.uniform(-1, 0.7) for _ in range(6)]) for i in range(2, 60)] + [(7, [0.75] * 6), (99, [0.5] * 6)]
    vectors = op04_topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = {x.rank: (x.vec_id, x.score) for x in op04_topk.top_k(vectors, vectors.where("vec_id = 99"), 20).collect()}
    ints = [(i, [int(np.floor(64 * float(np.float32(e)))) for e in v]) for i, v in rows]
    best: dict[int, int] = {}
    for i, v in ints:
        best[i] = max(best.get(i, -(10**9)), sum(a * b for a, b in zip(dict(ints)[99], v, strict=True)))
    want = sorted((-s, i) for i, s in best.items() if i != 99)[:20]
    assert got == {k: (i, -s) for k, (s, i) in enumerate(want, 1)}


def test_scores_row_by_row(spark, sf_dir):
    """Scores of op1 and op8 against their formulas, term by term, from the same models."""
    import re

    from lodestone.llm import features, hashing

    rows = [(1, "Some plain words, some words again!!"), (2, "idiot idiot and others"), (3, ""), (4, None), (5, "x" * 30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    quality, toxic = op01_quality.train_quality(docs, labels), op08_toxicity.train_toxicity(docs, labels)
    q = {r.doc_id: r.score for r in op01_quality.score_quality(frame, quality).collect()}
    t = {r.doc_id: r.toxicity for r in op08_toxicity.score_toxicity(frame, toxic).collect()}
    word = lambda w: int(hashing.span_hashes(hashing.prefix_sums(np.frombuffer(w, np.uint8)), np.array([0]), np.array([len(w)]))[0])
    bias, w = op01_quality.dense(quality, op01_quality.BITS)
    for i, text in rows:
        units = [m.encode() for m in re.findall(r"[0-9A-Za-z]+|[^0-9A-Za-z\s]+", text or "")]
        h = [word(u) for u in units]
        ids = [x >> (64 - op01_quality.BITS) for x in h]
        for a, b in zip(h, h[1:]):
            ids.append(int(hashing.ngrams(np.array([a, b], np.uint64), 2)[0]) >> (64 - op01_quality.BITS))
            if a == b:
                ids.append((1 << op01_quality.BITS) - 1)
        total = bias + op01_quality.SCALE * sum(w[k] for k in ids) / max(1, len(ids))
        assert q[i] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-6)
    kept, factors = np.frombuffer(toxic["terms"], "<i4").tolist(), np.frombuffer(toxic["factors"], "<f4").reshape(-1, op08_toxicity.RANK).astype(float)
    at = {k: n for n, k in enumerate(kept)}
    weights = np.frombuffer(toxic["weights"], "<f4")
    for i, text in rows:
        raw = (text or "").encode()
        ids, _ = features.lower_word_terms(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), op08_toxicity.PREFIXES, op08_toxicity.BITS)
        on = sorted({at[int(k)] for k in ids if int(k) in at})
        total = toxic["bias"] + sum(float(weights[k]) for k in on) + sum(float(factors[a] @ factors[b]) for a in on for b in on if a < b)
        assert t[i] == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-5)


@pytest.mark.parametrize("l1", [2.0, 1e6])
def test_pairs_of_neutral_words(monkeypatch, l1):
    """Toxic only if an insult meets its group: no word tells on its own, and with a huge L1 none has a linear weight."""
    import pyarrow as pa

    from lodestone.llm import features

    monkeypatch.setattr(op08_toxicity, "L1", l1)
    r = random.Random(3)

    def make(n):
        out = []
        for _ in range(n):
            a, b = r.randint(0, 1), r.randint(0, 1)
            words = [f"w{r.randint(0, 300)}" for _ in range(30)] + [f"insult{a}", f"group{b}"]
            r.shuffle(words)
            out.append((" ".join(words), float(a == b)))
        return out

    train, test = make(1500), make(200)
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in train]), pa.array([y for _, y in train])], ["text", "y"])
    model = next(op08_toxicity.train(iter([batch]))).to_pylist()[0]
    kept = np.frombuffer(model["terms"], "<i4")
    v, w = np.zeros((1 << op08_toxicity.BITS, op08_toxicity.RANK)), np.zeros(1 << op08_toxicity.BITS)
    v[kept], w[kept] = np.frombuffer(model["factors"], "<f4").reshape(-1, op08_toxicity.RANK), np.frombuffer(model["weights"], "<f4")
    assert l1 < 1e6 or not w.any()

    def right(factors):
        n = 0
        for text, y in test:
            raw = np.frombuffer(text.encode(), np.uint8)
            ids = np.unique(features.lower_word_terms(raw, np.array([0, len(raw)]), op08_toxicity.PREFIXES, op08_toxicity.BITS)[0])
            n += (model["bias"] + w[ids].sum() + op08_toxicity.pairs(factors[ids]) >= 0) == bool(y)
        return n / len(test)

    assert right(v) >= 0.95 and right(0 * v) <= 0.65


def test_queries_on_empty_tables(spark, sf_dir, tmp_path):
    for name in ("documents", "labels", "benchmark", "embeddings"):
        common.table(spark, sf_dir, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    from lodestone.llm import registry

    for name, query in registry.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_top_k_of_large_components(spark):
    r = random.Random(5)
    for size in (2.0**20, 2.0**40):
        rows = [(i, [r.uniform(-1, 1) * size for _ in range(4)]) for i in range(60)]
        vectors = op04_topk.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        ints = {i: [int(np.floor(64 * x)) for x in v] for i, v in rows}
        limit = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
        for q in (0, 20, 40):
            got = [(x.vec_id, x.score) for x in op04_topk.top_k(vectors, vectors.where(f"vec_id = {q}"), 20).orderBy("rank").collect()]
            want = sorted((-limit(sum(a * b for a, b in zip(ints[q], v, strict=True))), i) for i, v in ints.items() if i != q)[:20]
            assert got == [(i, -s) for s, i in want]


def test_pipeline_keeps_columns_of_any_name(spark, sf_dir):
    names = ["__doc", "__h", "__id", "key", "toxicity", "found", "n_secrets", "given"]
    docs = common.table(spark, sf_dir, "documents").limit(60).withColumns({n: F.lit(k) for k, n in enumerate(names)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage")
    assert docs.columns[-len(names) :] == names and docs.select(*names).distinct().collect() == [tuple(range(len(names)))]


def test_pipeline_against_a_plain_version(spark, sf_dir):
    """Each stage's decisions, row by row in Python, on what the stage before kept; the models' scores are tested above."""
    import hashlib
    import re

    import public_tokenizers
    import tiktoken

    from lodestone.llm import op09_bpe, op10_secrets

    docs = common.table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    model = op08_toxicity.train_toxicity(docs, common.table(spark, sf_dir, "labels"))
    scores = {r.doc_id: r.toxicity for r in op08_toxicity.score_toxicity(docs, model).collect()}
    left = {i: t for i, t in texts.items() if scores[i] < corpus_pipeline.TOXIC}
    classes = op07_jaccard.brute_force(sorted(left.items()), corpus_pipeline.SHINGLE, corpus_pipeline.NUM, corpus_pipeline.DEN)
    left = {i: t for i, t in left.items() if classes[i][1] == i}
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t))
    windows: dict[int, set] = {}
    for item in common.table(spark, sf_dir, "benchmark").collect():
        w = word(item.text or "")
        for s in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(len(w[s : s + 10]), set()).add(tuple(w[s : s + 10]))
    held = lambda w: any(tuple(w[s : s + n]) in grams for n, grams in windows.items() for s in range(len(w) - n + 1))
    left = {i: t for i, t in left.items() if not held(word(t))}
    forest = op10_secrets.train_forest(op10_secrets.labelled_findings(spark))
    frame = spark.createDataFrame(sorted(left.items()), "doc_id long, text string")
    secrets: dict[int, set] = {}
    for x in op10_secrets.findings(frame, forest).where(F.col("score") >= op10_secrets.CUTOFF).collect():
        secrets.setdefault(x.doc_id, set()).add(x.candidate)
    for i, found in secrets.items():
        whole = lambda s: re.escape(s) if len(s) >= op10_secrets.MIN_LENGTH else rf"(?<![A-Za-z0-9_+/-]){re.escape(s)}(?![A-Za-z0-9_+/-])"
        left[i] = re.sub("|".join(whole(s) for s in sorted(found, key=lambda s: (-len(s), s))), "[SECRET]", left[i])
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=op09_bpe.read_ranks(public_tokenizers.path(op09_bpe.RANK_FILE)), special_tokens={})
    want = {i: (encoding.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in left.items()}
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want and len(want) < len(texts)
