"""Relations by brute force, and the local way against the full one."""

from __future__ import annotations

import random
from difflib import SequenceMatcher

import pytest

from lodestone.operators import relations

KIND = "id long, name string, name_ko string, aliases array<string>"


def concepts(seed: int) -> list[tuple]:
    r = random.Random(seed)
    words = ["red", "blue", "widget", "ring", "bolt", "log", "login", "port", "Report"]
    return [(i * 3 % 101, " ".join(r.choices(words, k=r.randint(1, 2))) if i % 9 else r.choice([None, "", " "]), r.choice([None, "로그", "설치"]), r.choice([None, [], ["log", "x y"], ["Ring", "p"]])) for i in range(60)]


def plain(rows: list[tuple]) -> dict:
    out, rows = {}, sorted(rows)
    for a in rows:
        for b in rows:
            if a[0] < b[0]:
                x, y = (r[1] or "" for r in (a, b))
                ratio = SequenceMatcher(None, x.lower(), y.lower()).ratio()
                s = relations.tier(*({"name": r[1], "name_ko": r[2], "aliases": r[3]} for r in (a, b)), ratio)
                if s > 0.3:
                    out[a[0], b[0]] = s
    return out


def pairs(df) -> dict:
    rows = df.collect()
    assert len({(r.source, r.target) for r in rows}) == len(rows)
    return {(r.source, r.target): r.score for r in rows}


@pytest.mark.parametrize("size", [4, 1000])
def test_relations(spark, monkeypatch, size):
    monkeypatch.setattr(relations, "LEFT_BLOCK", size)
    monkeypatch.setattr(relations, "RIGHT_BLOCK", size + 3)
    rows = concepts(1)
    nodes = spark.createDataFrame([*rows, (None, "red", None, None)], KIND)
    want = plain(rows)
    assert pairs(relations.compared(nodes, nodes)) == pytest.approx(want) and {1.0, 0.9, 0.8, 0.7} <= set(want.values())


def test_both_ways(spark):
    before, after = concepts(1), concepts(1)
    after[7:10] = [(after[k][0], n, None, ["log"]) for k, n in zip(range(7, 10), ("login", "new bolt", "zzz"), strict=True)]
    after = [r for r in after if r[0] != before[20][0]]
    old = relations.compared(*[spark.createDataFrame(before, KIND)] * 2)
    nodes, hit = spark.createDataFrame(after, KIND), spark.createDataFrame([(r[0],) for r in before[7:10]], "id long")
    ways = [pairs(relations.updated(nodes, old, hit, local=share)) for share in (1.0, 0.0)]
    assert ways[0] == pytest.approx(ways[1]) and ways[1] == pytest.approx(plain(after))
    assert relations.updated(nodes.limit(0), old, hit).count() == 0


def test_tiers():
    c = lambda name, ko=None, aliases=(): {"name": name, "name_ko": ko, "aliases": list(aliases)}
    assert [relations.tier(a, b, 0.6) for a, b in ((c("A"), c("a")), (c("a", "가"), c("b", "가")), (c("a", None, ["B"]), c("b")), (c("a", None, ["z"]), c("b", None, ["Z"])), (c("port"), c("report")), (c("x"), c("y")), (c(None), c("y")))] == [1.0, 1.0, 0.9, 0.8, 0.7, 0.6, 0.0]
    assert relations.bounds(["ab", ""], ["ba", "cc"]).tolist() == [[1.0, 0.0], [0.0, 0.0]]
