"""Texts with their matches rewritten by an expression, and what is built on it: dates, altered marks, query blocks, texts for embedding.

A text is worked out and cut into gaps and matches once; each match goes through an expression of its own, and all are put together again. This
is what a pattern replacement can't do when the replacement has to be computed. Null texts stay null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found, held, stamp


def rewritten(text: Column, pattern: str, new: Callable[[Column], Column]) -> Column:
    """The text with `new` of every match in its place; a null result removes the match. The pattern must not match the empty text."""

    def pieces(t: Column) -> Column:
        parts = F.zip_with(F.split(t, pattern, -1), found(t, pattern), lambda gap, match: F.concat(gap, F.when(match.isNotNull(), F.coalesce(new(match), F.lit(""))).otherwise("")))
        return F.array_join(parts, "")

    return held(text, pieces)


# What stands for the current time in a query, for midnight some days before, and a time with a letter inside.
# The characters that a match may begin with are looked for first.
NOW = r"(?=[$<n])(?:\$CUR_DATE\$\s*\$CUR_TIME\$|\$CURDATE\$\s*\$CURTIME\$|\$CUR_DATE\$|\$NOW|\$\{NOW\}|\$\(now\)|<CURRENT_TIME>|now\(\)|\bnow\b)"
DAYS_AGO = r"\$CUR_DATE_MINUS_(\d+)D\$"
PARTED = r"(\d{8})T(\d{6})"


def with_times(text: Column, now: Column) -> Column:
    """Placeholders of times filled in: the current time as 14 digits, midnight n days before; times parted by a T are joined.

    A number of days beyond 9 digits is no placeholder.
    """
    text = rewritten(text, NOW, lambda m: stamp(now))

    def before(m: Column) -> Column:
        days = F.regexp_extract(m, DAYS_AGO, 1)
        date = F.date_sub(now.cast("date"), F.when(F.length(days) <= 9, days.cast("int")))
        return F.coalesce(F.concat(F.date_format(date, "yyyyMMdd"), F.lit("000000")), m)

    return F.regexp_replace(rewritten(text, DAYS_AGO, before), PARTED, "$1$2")


#: What a mark may look like after a model has written it again: escaped, or with blanks inside.
ALTERED = r"<[\\\sA-Za-z0-9_\-]+?>"
_NOISE = r"[\\\s]"


def unmasked(text: Column, marks: Column) -> Column:
    """The text with marks (map mark -> value) replaced by their values: exact ones first, then those with backslashes or blanks inside.

    Marks that the map doesn't have stay; of map keys that differ in such characters only, the last counts.
    """
    entries = F.map_entries(marks)
    exact = F.aggregate(entries, text, lambda t, m: F.replace(t, m["key"], m["value"]))
    plain = F.transform(entries, lambda m: F.struct(F.regexp_replace(m["key"], _NOISE, "").alias("key"), m["value"].alias("value")))
    known = lambda m: F.filter(plain, lambda e: e["key"] == F.regexp_replace(m, _NOISE, ""))
    again = rewritten(exact, ALTERED, lambda m: F.coalesce(F.try_element_at(F.transform(known(m), lambda e: e["value"]), F.lit(-1)), m))
    return F.when(marks.isNull(), text).otherwise(again)


#: How a query block may be fenced, in the order in which they are looked for.
QUERY_BLOCKS = [r"(?s)```query\s*\n.*?\n```", r"(?s)```query\s*\n.*?```", r"(?s)`{3,}query\s*\n.*?\n`{3,}", r"(?s)`{3,}query\s*\n.*?`{3,}"]


def with_corrected_block(text: Column, body: Column) -> Column:
    """The text with its first query block replaced by one that holds `body`; without a query block, or a body, it stays."""
    block = F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in QUERY_BLOCKS))
    at = F.position(block, text)
    whole = F.concat(F.left(text, at - 1), F.lit("```query\n"), body, F.lit("\n```"), F.substring(text, at + F.length(block), F.length(text)))
    return F.when(block.isNotNull() & body.isNotNull(), whole).otherwise(text)


# The labels of the fields that are embedded.
LABELS = {"question": "질문", "cot": "추론과정", "spec": "명세", "answer": "답변", "app_code": "앱코드", "require": "필수파라미터", "aliases": "관련키워드", "description": "설명"}
PLAIN = ("keywords", "category", "tags", "description")
SECTIONS = {"question": "Question", "cot": "Chain of Thought", "answer": "Answer"}
MOST = 6000


def requirements(require: Column) -> Column:
    """Parameters (array of structs name, type, description, optional, default, example) as one text."""

    def one(r: Column) -> Column:
        optional = F.when(F.coalesce(r["optional"], F.lit(False)), "[선택사항]").otherwise("")
        default = F.when(F.length(r["default"]) > 0, F.concat(F.lit("[기본값:"), r["default"], F.lit("]"))).otherwise("")
        example = F.when(F.length(r["example"]) > 0, F.concat(F.lit(" 예시:"), r["example"])).otherwise("")
        text = lambda c: F.coalesce(r[c], F.lit(""))
        return F.concat(text("name"), F.lit("("), text("type"), F.lit(")"), optional, default, F.lit(": "), text("description"), example)

    return F.array_join(F.transform(F.filter(require, lambda r: r.isNotNull()), one), " ")


def _labelled(label: str, value: Column, tidy: bool = True) -> Column:
    value = value.cast("string")
    return F.when(F.length(value) > 0, F.concat(F.lit(f"{label}: "), F.regexp_replace(value, r"^\s+|\s+$", "") if tidy else value))


def text_to_embed(fields: dict[str, Column], kind: str, content: Column) -> Column:
    """What is embedded for a document, from its fields (texts; lists already joined by blanks); `content` where no field has a value.

    kind: 'store' (six labelled fields and four plain ones, cut at MOST), 'trial' (with aliases, cut at MOST), 'prompt' (five fields,
    whole) or 'sections' (three headed sections; null without any).
    """
    if kind == "sections":
        parts = [F.concat(F.lit(f"{head}:\n"), fields[f], F.lit("" if f == "answer" else "\n")) for f, head in SECTIONS.items() if f in fields]
        return F.nullif(F.regexp_replace(F.concat_ws("\n", *parts), r"^\s+|\s+$", ""), F.lit(""))
    names = {"store": ("question", "cot", "spec", "answer", "app_code", "require"), "trial": ("question", "cot", "answer", "aliases"), "prompt": ("question", "cot", "spec", "answer", "description")}[kind]
    parts = [_labelled(LABELS[f], fields[f]) for f in names if f in fields]
    if kind != "prompt":
        parts += [_labelled(f, fields[f], tidy=False) for f in PLAIN if f in fields]
    joined = F.coalesce(F.nullif(F.concat_ws(" ", *parts), F.lit("")), content)
    return joined if kind == "prompt" else F.left(joined, F.lit(MOST))
