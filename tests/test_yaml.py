"""YAML files that the library's own writer did not make."""

from __future__ import annotations

import pytest

from lodestone.sources import yaml

TEXT = """# head
---
name: a b   # note
"quoted key": 'it''s'
url: http://x:80/y#z
deep:
  list:
  - one
  - two: 2
    three: "a\\tb\\u00e9"
  -
    - inner
    - [x, "y, z", {k: v}]
  map: {a: 1, 'b': [2, 3], c: {}}
  none: ~
  nothing:
text: |
  first
    more

  last

folded: >-
  a
  b

  c
kept: |+
  x

list:
- - p
  - q
- |
  block
  item
empty: []
"""

WANT = [
    ("name", "a b"), ("quoted key", "it's"), ("url", "http://x:80/y#z"), ("deep.list[0]", "one"), ("deep.list[1].two", "2"), ("deep.list[1].three", "a\tbé"), ("deep.list[2][0]", "inner"),
    ("deep.list[2][1][0]", "x"), ("deep.list[2][1][1]", "y, z"), ("deep.list[2][1][2].k", "v"), ("deep.map.a", "1"), ("deep.map.b[0]", "2"), ("deep.map.b[1]", "3"), ("deep.map.c", None), ("deep.none", None), ("deep.nothing", None),
    ("text", "first\n  more\n\nlast\n"), ("folded", "a b\nc"), ("kept", "x\n\n"), ("list[0][0]", "p"), ("list[0][1]", "q"), ("list[1]", "block\nitem\n"), ("empty", None),
]


def test_entries():
    assert [e[:2] for e in yaml.entries(TEXT)] == WANT and [e[2] for e in yaml.entries("a: 1\nb: '1'\nc: |\n  x")] == [True, False, False]
    assert yaml.entries("") == yaml.entries("# only\n---\n") == [] and yaml.entries("a: 1\n---\nb: 2") == [("a", "1", True)]


@pytest.mark.parametrize("text", ["\ta: 1", 'a: "open', "a: [1, 2", "just words", "a: *x", "a: {b 1}", 'a: "x" y'])
def test_malformed(text):
    with pytest.raises(yaml.Malformed):
        yaml.entries(text)


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, content in {"a.yaml": "질문: 가".encode(), "sub/b.yml": "질문: 가".encode("cp949"), "bad.yaml": b"a: \xff\xff\xff", "open.yaml": b"a: [1", "c.txt": b"a: 1", "empty.yml": b"# none"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[1]: (r.error, [(e.path, e.value) for e in r.entries]) for r in yaml.yaml_files(spark, str(tmp_path)).collect()}
    assert got == {"a.yaml": (None, [("질문", "가")]), "b.yml": (None, [("질문", "가")]), "bad.yaml": ("unknown encoding", []), "open.yaml": ("open bracket", []), "empty.yml": (None, [])}


def test_manifests_are_read_once(spark, sf_dir):
    """F9 of round 3: the checks read written entries, not the files again for each check."""
    from lodestone.plans import registry

    assert "ArrowEvalPython" not in registry.QUERIES["manifest_checks"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
