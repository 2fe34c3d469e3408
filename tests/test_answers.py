"""Answers in chunks, and workflows: the processor gives what the fold gives, also when it starts again in the middle."""

from __future__ import annotations

import random
import time

import pytest

from lodestone.streaming import answers, workflows

pytest.importorskip("google.protobuf")


def events(seed: int) -> list[tuple]:
    r, out = random.Random(seed), []
    words = ["a", "ab", "xyz", "word", "longer piece ", "😀", "<KR", "_IP_1> ", r"<KR\_IP\_1>", " < 3 ", "BEG", "IN", "BEGIN", "é漢字 "]
    for g in "pqr":
        for seq in range(60):
            if r.random() < 0.4:
                out.append((g, seq, None, None, None, r.randint(-1, 120), r.choice([None, -1, 0, 1, 5, 100])))
            else:
                out.append((g, seq, r.choice([None, "", *words, words[seq % 3]]), seq >= 55 or None, {"<KR_IP_1>": "10.0.0.1"} if g != "r" and seq % 7 == 0 else None, None, None))
    return out


def test_folds(spark):
    rows = [("a", 0, "he", None, None, None, None), ("a", 1, "he", None, None, None, None), ("a", 2, None, None, None, 0, 100), ("a", 3, "llo there", None, None, None, None), ("a", 4, None, None, None, 0, 4), ("a", 5, "<IP", None, {"<IP_1>": "😀"}, None, None),
            ("a", 6, "_1>!", True, None, None, None), ("a", 7, None, None, None, 11, 100), ("a", 8, None, None, None, 12, 100)]
    got = {r.seq: (r.value, r.next, r.finished) for r in answers.replies(spark.createDataFrame(rows, answers.EVENT)).collect()}
    assert got == {2: ("", 0, False), 4: ("hell", 4, False), 7: ("😀!", 14, True), 8: ("!", 14, True)}


@pytest.fixture
def store(spark):
    for k, v in answers.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in answers.STATE_STORE:
        spark.conf.unset(k)


def fed(spark, home: str, pieces: list[list[tuple]], event: str, reply: str, stream_of, answered) -> list[tuple]:
    """The replies to pieces of events, each read by a query that starts where the one before it was stopped.

    State with a time limit never falls idle, so a query is stopped once it has read its piece.
    """
    due = 0
    for n, piece in enumerate(pieces):
        spark.createDataFrame(piece, event).coalesce(1).write.mode("append").parquet(f"{home}/in")
        due += sum(map(answered, piece))
        q = stream_of(spark.readStream.schema(event).parquet(f"{home}/in")).writeStream.format("parquet").option("path", f"{home}/out").option("checkpointLocation", f"{home}/check").trigger(processingTime="500 milliseconds").start()
        end = time.monotonic() + 90
        try:
            while time.monotonic() < end and q.isActive and not any(p["numInputRows"] for p in q.recentProgress):
                time.sleep(0.3)
        finally:
            q.stop()
        assert spark.read.schema(reply).parquet(f"{home}/out").count() == due, n
    return sorted(map(tuple, spark.read.parquet(f"{home}/out").collect()), key=repr)


def replied(spark, home: str, pieces: list[list[tuple]], **options) -> list[tuple]:
    return fed(spark, home, pieces, answers.EVENT, answers.REPLY, lambda s: answers.streamed_replies(s, **options), lambda e: e[5] is not None)


@pytest.mark.parametrize("marker", ["", "BEGIN"])
def test_stream_equals_fold_across_a_restart(spark, store, tmp_path, marker):
    rows = sorted(events(7), key=lambda e: (e[1], e[0]))
    got = replied(spark, str(tmp_path), [rows[:60], rows[60:120], rows[120:]], marker=marker)
    want = answers.replies(spark.createDataFrame(rows, answers.EVENT), marker=marker).select("guid", "seq", "value", "next", "finished")
    assert got == sorted(map(tuple, want.collect()), key=repr) and any(v for _, _, v, _, _ in got)


def test_state_goes_after_its_time(spark, store, tmp_path):
    steps = [[("a", 0, "some text", True, None, None, None), ("b", 0, "other text", None, None, None, None)], [("c", 0, "tick", None, None, None, None)], [("a", 1, None, None, None, 0, 9), ("b", 1, None, None, None, 0, 9)]]
    got = replied(spark, str(tmp_path), steps, done_seconds=0, idle_seconds=3600)
    assert [(g, v) for g, _, v, _, _ in got] == [("a", ""), ("b", "other tex")]


def test_parts():
    text = "a😀b"
    assert [answers.part(text, i, j) for i, j in ((0, 1), (0, 2), (1, 3), (2, 4), (3, 9), (4, 9))] == [("a", 1), ("a", 1), ("😀", 3), ("b", 4), ("b", 4), ("", 4)]


def test_workflows(spark, store, tmp_path):
    none = (None, None, None)
    rows = [("a", 0, ["x", "y"], False, None), ("a", 1, None, True, "fine"), ("b", 0, None, True, "too early"), ("a", 2, None, True, "결과가 없습니다."), ("a", 3, None, True, None), ("a", 4, None, True, "late"), ("b", 1, [], None, None), ("b", 2, ["z"], None, None), ("c", 0, *none)]
    pieces = [rows[:3], rows[3:5], rows[5:]]
    got = fed(spark, str(tmp_path), pieces, workflows.EVENT, workflows.ACTION, workflows.streamed, lambda e: True)
    want = sorted(map(tuple, workflows.folded(spark.createDataFrame(rows, workflows.EVENT)).collect()), key=repr)
    assert got == want == sorted([
        ("a", 0, "continue", 0, "x", 0.0), ("a", 1, "continue", 1, "y", 50.0), ("a", 2, "requires_alternative", 1, "y", 50.0), ("a", 3, "complete", 2, None, 100.0), ("a", 4, "error", 2, None, 100.0),
        ("b", 0, "error", None, None, None), ("b", 1, "complete", 0, None, 100.0), ("b", 2, "continue", 0, "z", 0.0), ("c", 0, "error", None, None, None),
    ], key=repr)
