"""Answers that arrive in chunks and are read by offset while they grow: one keyed processor for streams, one fold for tables.

Events are (guid, seq, chunk, done, marks, offset, units). An event with an offset is a read of `units` UTF-16 units from there; any other one
brings a chunk. In the order of `seq`, within an answer:

- a chunk equal to the one before it is dropped; chunks under `short` characters are held until `full` characters are, or a longer chunk comes;
- what follows an unclosed '<' is held back, and marks (map mark -> value, from the first event that has one) are replaced by their values;
- with a `marker`, nothing can be read before it has come, and reads start after it at the earliest; it may be cut between chunks;
- `done` gives out all that is held; chunks after it are ignored;
- a read gives (guid, seq, value, next, finished). Half of a surrogate pair at an end of the read is left out; the next read starts at `next`.

In a stream, state goes `done_seconds` after the last event of a done answer, and `idle_seconds` after that of any other; a later event begins
a new answer. Defined cases: null and empty chunks bring nothing; a negative or null number of units reads nothing; events without a guid are one answer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import rewrite
from lodestone.functions.text import utf16_units

EVENT = "guid string, seq long, chunk string, done boolean, marks map<string,string>, offset int, units int"
REPLY = "guid string, seq long, value string, next int, finished boolean"
SHORT, FULL = 4, 32
PIECE = "at int, text string"
HEAD = "last string, held string, tail string, ended boolean, units int, recent string, gate int, marks string"
#: The store that keeps state of this kind.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def size(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def part(text: str, first: int, last: int) -> tuple[str, int]:
    """The units first <= k < last of a text without halves of pairs, and where the part ends."""
    raw = text.encode("utf-16-le")[2 * first : 2 * last]
    if raw[1:2] and 0xDC <= raw[1] <= 0xDF:
        raw, first = raw[2:], first + 1
    if raw and 0xD8 <= raw[-1] <= 0xDB:
        raw = raw[:-2]
    return raw.decode("utf-16-le"), first + len(raw) // 2


def unmasked(text: str, marks: dict[str, str]) -> str:
    """As rewrite.unmasked, for one text."""
    for mark, value in marks.items():
        text = text.replace(mark, value)
    plain = lambda s: re.sub(r"[\\\s]", "", s)
    known = {plain(m): v for m, v in marks.items()}
    return re.sub(rewrite.ALTERED, lambda m: known.get(plain(m[0]), m[0]), text) if "<" in text else text


class Answers(StatefulProcessor):
    """Keeps an answer's pieces as a list, all else as one value, and a timer that lets both go."""

    def __init__(self, marker: str = "", short: int = SHORT, full: int = FULL, done_seconds: int = 5, idle_seconds: int = 600) -> None:
        self.marker, self.short, self.full, self.done_ms, self.idle_ms = marker, short, full, done_seconds * 1000, idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces, self.head = handle.getListState("pieces", PIECE), handle.getValueState("head", HEAD)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        last, held, tail, ended, units, recent, gate, marks = tuple(self.head.get()) if self.head.exists() else (None, "", "", False, 0, "", -1, None)
        known = json.loads(marks) if marks else None
        fresh: list[tuple[int, str]] = []

        def give(piece: str, final: bool = False) -> None:
            nonlocal tail, units, recent, gate
            text, tail = tail + piece, ""
            cut = text.rfind("<")
            if known and not final and cut >= 0 and ">" not in text[cut:]:
                text, tail = text[:cut], text[cut:]
            text = unmasked(text, known) if known else text
            if not text:
                return
            if self.marker and gate < 0:
                near = recent + text
                found = near.find(self.marker)
                gate = units - size(recent) + size(near[: found + len(self.marker)]) if found >= 0 else -1
                recent = near[len(near) - len(self.marker) + 1 :] if len(self.marker) > 1 else ""
            fresh.append((units, text))
            units += size(text)

        for e in sorted(rows, key=lambda r: r.seq):
            known = known or dict(e.marks or ()) or None
            if e.offset is not None:
                yield self._reply(key[0], e, fresh, units, gate, ended)
                continue
            if e.chunk and not ended and e.chunk != last:
                last = e.chunk
                if len(last) < self.short:
                    held += last
                    if len(held) >= self.full:
                        give(held)
                        held = ""
                else:
                    give(held + last)
                    held = ""
            if e.done and not ended:
                give(held, final=True)
                held, ended = "", True
        if fresh:
            self.pieces.appendList(fresh)
        self.head.update((last, held, tail, ended, units, recent, gate, json.dumps(known) if known else None))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + (self.done_ms if ended else self.idle_ms))

    def _reply(self, guid: str, e: Row, fresh: list[tuple[int, str]], units: int, gate: int, ended: bool) -> Row:
        if self.marker and gate < 0:
            return Row(guid=guid, seq=e.seq, value="", next=e.offset, finished=False)
        first = max(e.offset, gate, 0)
        last = first + max(0, e.units or 0)
        touched = [(at, t) for at, t in [*map(tuple, self.pieces.get()), *fresh] if at < last and at + size(t) > first]
        begin = touched[0][0] if touched else first
        value, end = part("".join(t for _, t in touched), first - begin, last - begin)
        return Row(guid=guid, seq=e.seq, value=value, next=begin + end, finished=bool(ended and begin + end >= units))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        self.pieces.clear()
        self.head.clear()
        return iter(())

    def close(self) -> None:
        pass


def streamed_replies(events: DataFrame, **options) -> DataFrame:
    """The replies to the reads in a stream of events. The session needs the settings of STATE_STORE."""
    return events.groupBy("guid").transformWithState(Answers(**options), REPLY, "Append", "ProcessingTime")


def replies(events: DataFrame, marker: str = "", short: int = SHORT, full: int = FULL) -> DataFrame:
    """The same for a table of events, as one fold for each answer; an answer is bounded by the model that writes it."""
    c = events.groupBy("guid").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk", "done", "offset", "units"))).alias("events"), F.min_by("marks", F.when(F.col("marks").isNotNull(), F.col("seq"))).alias("marks"))
    reply = "struct<seq:bigint,value:string,next:int,finished:boolean>"
    start = F.from_json(F.lit('{"text":"","held":"","tail":"","ended":false,"out":[]}'), f"struct<text:string,last:string,held:string,tail:string,ended:boolean,out:array<{reply}>>")

    def state(a: Column, **new: Column) -> Column:
        return F.struct(*((new.get(n) if n in new else a[n]).alias(n) for n in ("text", "last", "held", "tail", "ended", "out")))

    def given(a: Column, piece: Column, final: bool = False) -> tuple[Column, Column]:
        """Text and tail after a piece."""
        whole = F.concat(a["tail"], piece)
        tail = F.when(F.col("marks").isNull() | F.lit(final), "").otherwise(F.regexp_extract(whole, r"(?s)(<[^<>]*)$", 1))
        return F.concat(a["text"], rewrite.unmasked(F.left(whole, F.length(whole) - F.length(tail)), F.col("marks"))), tail

    def put(a: Column, e: Column) -> Column:
        skip = F.coalesce(e["chunk"], F.lit("")).isin("") | a["ended"] | e["chunk"].eqNullSafe(a["last"])
        held = F.concat(a["held"], e["chunk"])
        text, tail = given(a, held)
        wait = (F.length(e["chunk"]) < short) & (F.length(held) < full)
        return F.when(skip, a).when(wait, state(a, last=e["chunk"], held=held)).otherwise(state(a, text=text, last=e["chunk"], held=F.lit(""), tail=tail))

    def end(a: Column, e: Column) -> Column:
        text, tail = given(a, a["held"], final=True)
        return F.when(F.coalesce(e["done"], F.lit(False)) & ~a["ended"], state(a, text=text, held=F.lit(""), tail=tail, ended=F.lit(True))).otherwise(a)

    def read(a: Column, e: Column) -> Column:
        at = F.instr(a["text"], F.lit(marker)) if marker else F.lit(1)
        gate = utf16_units(F.left(a["text"], at - 1 + len(marker))) if marker else F.lit(0)
        first = F.greatest(e["offset"], gate, F.lit(0))
        raw = F.encode(a["text"], "UTF-16BE")
        cut = F.substring(raw, 2 * first + 1, 2 * F.greatest(F.lit(0), F.coalesce(e["units"], F.lit(0))))
        low = F.hex(F.substring(cut, 1, 1)).between("DC", "DF") & (F.octet_length(cut) > 0)
        body = F.when(low, F.substring(cut, F.lit(3), F.octet_length(cut))).otherwise(cut)
        high = F.hex(F.substring(body, F.octet_length(body) - 1, F.lit(1))).between("D8", "DB") & (F.octet_length(body) > 0)
        body = F.when(high, F.substring(body, F.lit(1), F.octet_length(body) - 2)).otherwise(body)
        stop = (first + F.when(low, 1).otherwise(0) + F.octet_length(body) / 2).cast("int")
        open_ = F.struct(e["seq"].alias("seq"), F.decode(body, "UTF-16BE").alias("value"), stop.alias("next"), (a["ended"] & (stop >= utf16_units(a["text"]))).alias("finished"))
        closed = F.struct(e["seq"].alias("seq"), F.lit("").alias("value"), e["offset"].alias("next"), F.lit(False).alias("finished"))
        return state(a, out=F.array_append(a["out"], F.when(at > 0, open_).otherwise(closed)))

    def step(a: Column, e: Column) -> Column:
        after = F.get(F.transform(F.array(put(a, e)), lambda b: end(b, e)), F.lit(0))
        return F.when(e["offset"].isNotNull(), read(a, e)).otherwise(after)

    return c.select("guid", F.inline(F.aggregate("events", start, step, lambda a: a["out"])))
