"""Keyed stream state: answer buffers, session windows, deduplication. Each has a batch twin with the same result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "guid string, answer string, units int, done boolean"
STATE = "answer string, last string, done boolean"


def assembled(chunks: DataFrame) -> DataFrame:
    """Batch: (guid, answer, units, done) of chunks (guid, seq, chunk, done) in order; a chunk equal to the one before it is dropped."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk", "done")))
    fold = F.aggregate(
        "parts",
        F.struct(F.lit("").alias("answer"), F.lit(None).cast("string").alias("last"), F.lit(False).alias("done")),
        lambda a, p: F.struct(F.when(p["chunk"].eqNullSafe(a["last"]) | p["chunk"].isNull(), a["answer"]).otherwise(F.concat(a["answer"], p["chunk"])).alias("answer"), F.coalesce(p["chunk"], a["last"]).alias("last"), (a["done"] | F.coalesce(p["done"], F.lit(False))).alias("done")),
    )
    out = chunks.groupBy("guid").agg(ordered.alias("parts")).select("guid", fold.alias("f")).select("guid", "f.answer", "f.done")
    return out.select("guid", "answer", (F.octet_length(F.encode("answer", "UTF-16LE")) / 2).cast("int").alias("units"), "done")


def _append(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    answer, last, done = state.get if state.exists else ("", None, False)
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(frames)).sort_values("seq")
    for chunk, end in zip(rows["chunk"], rows["done"], strict=True):
        if chunk is not None and chunk != last:
            answer, last = answer + chunk, chunk
        done = bool(done or end)
    state.update((answer, last, done))
    state.setTimeoutDuration(5_000 if done else 600_000)
    yield pd.DataFrame({"guid": [key[0]], "answer": [answer], "units": [len(answer.encode("utf-16-le")) // 2], "done": [done]})


def streamed(chunks: DataFrame) -> DataFrame:
    """Streaming: the same, with idle buffers evicted after 5 s when done and after 600 s otherwise. Emits each update."""
    return chunks.groupBy("guid").applyInPandasWithState(_append, OUTPUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def session_totals(events: DataFrame, gap: str = "3600 seconds", late: str = "10 minutes") -> DataFrame:
    """Totals of event-time sessions of each user; rows later than the watermark are dropped by streams."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("total")).select("user_id", F.col("w.start").alias("start"), "events", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Events without repeats of a key: within the watermark of a stream, or in the whole of a batch."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def _folded(chunks: DataFrame, start: str, kind: str, step) -> DataFrame:
    """(guid, state): chunks (guid, seq, chunk) of each answer folded in order; an answer's chunks are one group, bounded by the answer."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("chunk", F.lit("")).alias("chunk"))))
    return chunks.groupBy("guid").agg(ordered.alias("parts")).select("guid", F.aggregate("parts", F.from_json(F.lit(start), kind), step).alias("state"))


def gated(chunks: DataFrame, marker: str) -> DataFrame:
    """(guid, open, readable): nothing can be read until the marker has come, then what follows its first place; it may be cut between chunks."""
    whole = _folded(chunks, '{"text":""}', "struct<text:string>", lambda a, p: F.struct(F.concat(a["text"], p["chunk"]).alias("text")))
    at = F.instr("state.text", F.lit(marker))
    return whole.select("guid", (at > 0).alias("open"), F.when(at > 0, F.substring(F.col("state.text"), at + len(marker), F.length("state.text"))).otherwise("").alias("readable"))


def coalesced(chunks: DataFrame, short: int = 4, full: int = 32) -> DataFrame:
    """(guid, part, piece): a chunk equal to the one before goes; chunks under `short` characters wait until `full` are held, or a longer one comes."""

    def step(a, p):
        held = F.concat(a["held"], p["chunk"])
        give = (F.length(p["chunk"]) >= short) | (F.length(held) >= full)
        said = F.struct(F.when(give, F.array_append(a["out"], held)).otherwise(a["out"]).alias("out"), F.when(give, "").otherwise(held).alias("held"), p["chunk"].alias("last"))
        return F.when(p["chunk"].eqNullSafe(a["last"]), a).otherwise(said)

    done = _folded(chunks, '{"out":[],"held":"","last":null}', "struct<out:array<string>,held:string,last:string>", step)
    pieces = F.when(F.col("state.held") != "", F.array_append("state.out", F.col("state.held"))).otherwise(F.col("state.out"))
    return done.select("guid", F.posexplode(pieces).alias("part", "piece"))


def evicted(buffers: DataFrame, now, done_seconds: int = 5, idle_seconds: int = 600) -> DataFrame:
    """Adds gone to buffers (last timestamp, done): done and idle for `done_seconds`, or idle for more than `idle_seconds`, at the time `now`."""
    idle = F.unix_timestamp(now) - F.unix_timestamp(F.col("last").cast("timestamp"))
    return buffers.withColumn("gone", (F.coalesce("done", F.lit(False)) & (idle >= done_seconds)) | (idle > idle_seconds))


def audited(requests: DataFrame, failure: str = "error") -> DataFrame:
    """(event_id, ts, user_id, success): the audit log of requests; for a stream and for a table alike, as rows are only appended."""
    return requests.select("event_id", "ts", "user_id", (F.coalesce("event_type", F.lit(failure)) != failure).alias("success"))


def workflow_states(steps: DataFrame, no_result: list[str]) -> DataFrame:
    """(workflow, state, at): steps (workflow, ord, answer) advance a workflow in order until an answer says that there was no result.

    states: completed after all steps, requires_alternative at the first step without a result; a null answer is a step not done: pending there.
    """
    failed = F.exists(F.array(*map(F.lit, no_result)), lambda x: F.contains(F.lower("answer"), x))
    stop = F.when(F.col("answer").isNull(), "pending").when(failed, "requires_alternative")
    first = steps.withColumn("stop", stop).groupBy("workflow").agg(F.min(F.when(F.col("stop").isNotNull(), F.struct("ord", "stop"))).alias("s"), F.max("ord").alias("last"))
    return first.select("workflow", F.coalesce("s.stop", F.lit("completed")).alias("state"), F.coalesce("s.ord", "last").alias("at"))
