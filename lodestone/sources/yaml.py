"""Knowledge files in YAML: nested maps and lists, block scalars, flow lists and maps, quoted and plain scalars, two encodings.

A file becomes entries (path, value, plain): keys joined by dots, places of lists in brackets, as app.ids[1].key. Lines are folded once, with a stack of
the open levels by indentation. Values are texts; null, ~ and nothing are null; an empty list or map is an entry with a null value.

Defined cases: UTF-8 is tried first, then CP949; a file that is neither, has a tab in its indentation, an open quote, bracket or a line that is
no entry is given with the reason and without entries, so that one bad file stops nothing; a file without entries has none, one without bytes is not listed; of several documents in
a file the first is read; anchors, tags and directives are not read and give a reason.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "struct<error:string,entries:array<struct<path:string,value:string,plain:boolean>>>"
ENCODINGS = ("utf-8", "cp949")
_KEY = re.compile(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^\s"'#\[\]{},&*!|>%@`-](?:[^:#]|:(?=\S)|(?<=\S)#)*?|-[^\s:][^:]*?)\s*:(?:\s+(.*))?$""")
_BLOCK = re.compile(r"([|>])([+-]?)\d?([+-]?)\s*(?:#.*)?$")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", '"': '"', "\\": "\\", "/": "/", " ": " "}


class Malformed(ValueError):
    """A line that can't be read."""


def decoded(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            return content.decode(name).removeprefix("﻿")
        except UnicodeDecodeError:
            continue
    raise Malformed("unknown encoding")


def _quoted(raw: str) -> tuple[str, str]:
    """A quoted scalar at the start of `raw`, and what follows it."""
    m = re.match(r'"((?:[^"\\]|\\.)*)"' if raw[0] == '"' else r"'((?:[^']|'')*)'", raw)
    if not m:
        raise Malformed("open quote")
    body = re.sub(r"\\(u[0-9a-fA-F]{4}|.)", lambda e: chr(int(e[1][1:], 16)) if e[1][0] == "u" and len(e[1]) == 5 else _ESCAPES.get(e[1], e[1]), m[1]) if raw[0] == '"' else m[1].replace("''", "'")
    return body, raw[m.end() :].strip()


def _flow(raw: str, path: str, out: list) -> str:
    """Reads a flow value at the start of `raw` into `out`; gives what follows it."""
    raw = raw.strip()
    if raw[:1] in ("[", "{"):
        close, count, start = "]}"["[{".index(raw[0])], 0, len(out)
        listed, raw = raw[0] == "[", raw[1:].strip()
        while not raw.startswith(close):
            here = f"{path}[{count}]"
            if not listed:
                m = re.match(r"""("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^:,{}\[\]]+?)\s*:\s*""", raw)
                if not m:
                    raise Malformed("open bracket")
                name = _quoted(m[1])[0] if m[1][0] in "\"'" else m[1]
                here, raw = f"{path}.{name}" if path else name, raw[m.end() :]
            raw, count = _flow(raw, here, out).strip(), count + 1
            if raw.startswith(","):
                raw = raw[1:].strip()
            elif not raw.startswith(close):
                raise Malformed("open bracket")
        if len(out) == start and not count:
            out.append((path, None, True))
        return raw[1:]
    if raw[:1] in ('"', "'"):
        value, raw = _quoted(raw)
        out.append((path, value, False))
        return raw
    m = re.match(r"[^,\[\]{}]*", raw)
    out.append((path, _plain(m[0]), True))
    return raw[m.end() :]


def _plain(raw: str) -> str | None:
    value = re.sub(r"(^|\s)#.*$", "", raw).strip()
    return None if value in ("", "~", "null", "Null", "NULL") else value


def _value(raw: str, path: str, out: list) -> None:
    if raw[:1] in ("&", "*", "!", "%", "@", "`"):
        raise Malformed(f"not read: {raw[:20]}")
    if raw[:1] in ("[", "{", '"', "'"):
        if re.sub(r"^#.*", "", _flow(raw, path, out).strip()):
            raise Malformed(f"after a value: {raw[:20]}")
    else:
        out.append((path, _plain(raw), True))


def _block(lines: list[str], at: int, base: int, style: str, chomp: str) -> tuple[str, int]:
    """The text of a block scalar whose lines are indented by more than `base`, and the line after it."""
    body = []
    while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > base):
        body.append(lines[at])
        at += 1
    depth = next((len(x) - len(x.lstrip(" ")) for x in body if x.strip()), 0)
    body = [x[depth:] if x.strip() else "" for x in body]
    end = max((i + 1 for i, x in enumerate(body) if x), default=0)
    kept, extra = body[:end], len(body) - end
    text = "\n".join(kept)
    if style == ">":
        text = re.sub(r"(?<!\n)\n(?![\n ])", " ", text)
        text = re.sub(r"(?<=[^\n])\n(\n+)(?=[^\n ])", r"\1", text)
    tail = "" if chomp == "-" else "\n" * (1 + extra) if chomp == "+" else "\n"
    return text + tail if kept else ("\n" * extra if chomp == "+" else ""), at


def entries(text: str) -> list[tuple[str, str | None, bool]]:
    """(path, value, plain) of a YAML text, in order; plain values are neither quoted nor blocks. Raises Malformed."""
    lines, out = re.split(r"\r?\n", text), []
    open_levels: list[list] = [[-1, "", 0, False]]  # indentation, path, entries so far, whether it is an item of a list
    at, begun = 0, False
    while at < len(lines):
        line = lines[at]
        at += 1
        bare = line.strip()
        if not bare or bare[0] == "#" or (bare == "---" and not begun):
            continue
        if bare in ("---", "..."):
            break
        begun, depth = True, len(line) - len(line.lstrip(" "))
        if line[depth] == "\t":
            raise Malformed("tab in indentation")
        rest = bare
        while True:
            item = rest == "-" or rest.startswith("- ")
            while depth < open_levels[-1][0] or (depth == open_levels[-1][0] and (not item or open_levels[-1][3])):
                _closed(open_levels.pop(), out)
            parent = open_levels[-1]
            if item:
                path = f"{parent[1]}[{parent[2]}]"
                parent[2] += 1
                open_levels.append([depth, path, 0, True])
                inner = rest[1:].lstrip()
                if not inner:
                    break
                depth, rest = depth + len(rest) - len(inner), inner
                if not (inner == "-" or inner.startswith("- ") or _KEY.match(inner)):
                    at = _scalar(inner, path, lines, at, depth - 1, out)
                    open_levels[-1][2] = 1
                    break
                continue
            m = _KEY.match(rest)
            if not m:
                raise Malformed(f"no entry: {rest[:20]}")
            name = _quoted(m[1])[0] if m[1][0] in "\"'" else m[1]
            path = f"{parent[1]}.{name}" if parent[1] else name
            parent[2] += 1
            raw = (m[2] or "").strip()
            if raw and raw[0] != "#":
                at = _scalar(raw, path, lines, at, depth, out)
            else:
                open_levels.append([depth, path, 0, False])
            break
    for level in reversed(open_levels[1:]):
        _closed(level, out)
    return out


def _closed(level: list, out: list) -> None:
    """A level that nothing came into is a null."""
    if not level[2]:
        out.append((level[1], None, True))


def _scalar(raw: str, path: str, lines: list[str], at: int, base: int, out: list) -> int:
    """Reads a value that may go on over lines; gives the line after it."""
    m = _BLOCK.match(raw)
    if m:
        text, at = _block(lines, at, base, m[1], m[2] or m[3])
        out.append((path, text, False))
    else:
        _value(raw, path, out)
    return at


#: Files that a task of Python reads at once.
FILES = 64
_TYPE = pa.struct([("error", pa.string()), ("entries", pa.list_(pa.struct([("path", pa.string()), ("value", pa.string()), ("plain", pa.bool_())])))])


def _one(content: bytes | None) -> dict:
    try:
        found = entries(decoded(content or b""))
        return {"error": None, "entries": [{"path": p, "value": v, "plain": q} for p, v, q in found]}
    except Malformed as e:
        return {"error": str(e), "entries": []}


def _read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for b in batches:
        parts = [b.slice(i, FILES) for i in range(0, len(b), FILES)]
        yield pa.concat_arrays([pa.array([_one(c) for c in p.to_pylist()], _TYPE) for p in parts] or [pa.array([], _TYPE)])


def yaml_entries(content: Column) -> Column:
    """struct(error, entries) of the bytes of a file. A filter on it is not moved below it, as files would be read again for it."""
    return F.arrow_udf(_read, ENTRIES).asNondeterministic()(content)


def yaml_files(spark: SparkSession, path: str, pattern: str = "*.y*ml") -> DataFrame:
    """(path, error, entries) of all YAML files below a folder, in any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", yaml_entries(F.col("content")).alias("y")).select("path", "y.error", "y.entries")
