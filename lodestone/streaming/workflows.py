"""Plans that are worked off step by step: one keyed processor for streams, one fold for tables.

Events are (workflow, seq, steps, answer). An event with `steps` brings the plan, an array of messages, and starts it anew; one with an answer is the
result of the current step. Each event gives (workflow, seq, action, step, message, progress):

- a plan: `continue` with its first step, or `complete` if it has none;
- an answer with a phrase that says that nothing was found: `requires_alternative`; the step stays the current one;
- any other answer: `continue` with the next step, or `complete` after the last;
- an answer without a plan, or after the last step: `error`.

`step` counts from 0, `progress` is the share of steps done, in percent with one decimal. Defined cases: a null answer says nothing and advances; an
event with neither is an error; events without a workflow are one workflow. A stream forgets a workflow `idle_seconds` after its last event.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "workflow string, seq long, steps array<string>, answered boolean, answer string"
ACTION = "workflow string, seq long, action string, step int, message string, progress double"
# Phrases of an answer that found nothing.
NOTHING = ("조회 결과가 없습니다", "결과가 없습니다", "데이터가 없습니다", "No results found", "Empty result")
IDLE_SECONDS = 3600


class Workflows(StatefulProcessor):
    """Keeps the plan as a list and the place in it as a value."""

    def __init__(self, idle_seconds: int = IDLE_SECONDS) -> None:
        self.idle_ms = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps, self.place = handle.getListState("steps", "message string"), handle.getValueState("place", "done int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        done = self.place.get()[0] if self.place.exists() else None
        steps = [m for (m,) in self.steps.get()] if done is not None else []
        for e in sorted(rows, key=lambda r: r.seq):
            action = "error"
            if e.steps is not None:
                steps, done = list(e.steps), 0
                self.steps.put([(m,) for m in steps]) if steps else self.steps.clear()
                action = "continue" if steps else "complete"
            elif e.answered and done is not None and done < len(steps):
                if any(n in (e.answer or "") for n in NOTHING):
                    action = "requires_alternative"
                else:
                    done += 1
                    action = "continue" if done < len(steps) else "complete"
            at = None if done is None else done
            yield Row(workflow=key[0], seq=e.seq, action=action, step=at, message=steps[done] if done is not None and done < len(steps) else None, progress=None if at is None else round(100.0 * at / len(steps), 1) if steps else 100.0)
        if done is not None:
            self.place.update((done,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.steps.clear()
        self.place.clear()
        return iter(())

    def close(self) -> None:
        pass


def streamed(events: DataFrame, **options) -> DataFrame:
    """The actions of a stream of events. The session needs the settings of answers.STATE_STORE."""
    return events.groupBy("workflow").transformWithState(Workflows(**options), ACTION, "Append", "ProcessingTime")


def folded(events: DataFrame) -> DataFrame:
    """The same for a table, as one fold for each workflow; a workflow's events are a few."""
    each = events.groupBy("workflow").agg(F.array_sort(F.collect_list(F.struct("seq", "steps", "answered", "answer"))).alias("events"))
    action = "struct<seq:bigint,action:string,step:int,message:string,progress:double>"
    start = F.from_json(F.lit('{"out":[]}'), f"struct<steps:array<string>,done:int,out:array<{action}>>")

    def step(a: Column, e: Column) -> Column:
        plan = e["steps"].isNotNull()
        steps = F.when(plan, e["steps"]).otherwise(a["steps"])
        open_ = F.coalesce(~plan & e["answered"] & (a["done"] < F.size(a["steps"])), F.lit(False))
        empty = F.exists(F.array(*map(F.lit, NOTHING)), lambda n: F.contains(F.coalesce(e["answer"], F.lit("")), n))
        done = F.when(plan, 0).when(open_ & ~empty, a["done"] + 1).otherwise(a["done"])
        left = done < F.size(steps)
        name = F.when(open_ & empty, "requires_alternative").when(plan | open_, F.when(left, "continue").otherwise("complete")).otherwise("error")
        progress = F.when(done.isNotNull(), F.when(F.size(steps) > 0, F.round(100.0 * done / F.size(steps), 1)).otherwise(100.0))
        said = F.struct(e["seq"].alias("seq"), name.alias("action"), done.alias("step"), F.when(left, F.get(steps, done)).alias("message"), progress.alias("progress"))
        return F.struct(steps.alias("steps"), done.alias("done"), F.array_append(a["out"], said).alias("out"))

    return each.select("workflow", F.inline(F.aggregate("events", start, step, lambda a: a["out"])))
