"""Text expressions: extraction of identifiers, cleaning, slugs, truncation, dates. No Python runs in any of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def security_ids(text: Column) -> Column:
    """Identifiers of public catalogues in a text: struct of capec, cwe (ints), cve, technique, grp, software, all_ids."""
    t = F.upper(F.coalesce(text, F.lit("")))
    ints = lambda name: sorted_set(F.transform(found(t, rf"\b{name}[- _]?0*([0-9]+)\b", 1), lambda x: x.cast("int")))
    cve = sorted_set(F.transform(found(t, r"\bCVE[-_ ]?([0-9]{4}[-_ ][0-9]{4,7})\b", 1), lambda x: F.concat(F.lit("CVE-"), F.translate(x, "_ ", "--"))))
    technique = sorted_set(F.flatten(F.transform(found(t, r"\bT[0-9]{4}(?:\.[0-9]{3})?\b"), lambda x: F.array_distinct(F.array(F.substring_index(x, ".", 1), x)))))
    group, software = sorted_set(found(t, r"\bG[0-9]{4}\b")), sorted_set(found(t, r"\bS[0-9]{4}\b"))
    label = lambda ids, name: F.transform(ids, lambda x: F.concat(F.lit(name), x.cast("string")))
    everything = F.concat(label(ints("CAPEC"), "CAPEC-"), label(ints("CWE"), "CWE-"), cve, technique, group, software)
    return F.struct(ints("CAPEC").alias("capec"), ints("CWE").alias("cwe"), cve.alias("cve"), technique.alias("technique"), group.alias("grp"), software.alias("software"), everything.alias("all_ids"))


def brand_of_file(name: Column) -> Column:
    """query-<brand>-command.yaml or -function.yaml -> struct(brand, command_name, func_name)."""
    p = r"^query-(.+)-(command|function)\.ya?ml$"
    brand, kind = F.regexp_extract(name, p, 1), F.regexp_extract(name, p, 2)
    return F.struct(F.nullif(brand, F.lit("")).alias("brand"), F.when(kind == "command", brand).alias("command_name"), F.when(kind == "function", brand).alias("func_name"))


def without_times(text: Column) -> Column:
    """Drops spans of time from a question (before a search), longest phrases first, and squeezes blanks."""
    unit = r"(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)"
    for p in (
        rf"(?i)\b(?:in|over|during|for|within) the (?:last|past|previous) [0-9]+ {unit}\b", rf"(?i)\b(?:the )?(?:last|past|previous) [0-9]+ {unit}\b",
        rf"(?i)\b[0-9]+ {unit} ago\b", rf"(?i)\b(?:this|last|next) {unit}\b", r"(?i)\b(?:today|yesterday|tomorrow|now|recently)\b",
        r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9:]+)?\b", r"\b[0-9]{8,14}\b", r"(?i)\b(?:from|until|since|between)\s*$",
    ):
        text = F.regexp_replace(text, p, " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, size: int = 40) -> Column:
    s = F.trim(F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), 1, size), F.lit("-"))
    return F.when(F.length(s) > 0, s).otherwise(F.lit("item"))


def node_id(text: Column, size: int = 50) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9가-힣]", "_"), "_+", "_"), 1, size)


def script_of(text: Column) -> Column:
    """ko, en or mixed, by the kinds of letters present; null for neither."""
    ko, en = F.regexp_count(text, F.lit("[가-힣]")), F.regexp_count(text, F.lit("[A-Za-z]"))
    return F.when((ko > 0) & (en > 0), "mixed").when(ko > 0, "ko").when(en > 0, "en")


def cut(text: Column, size: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(tail))).otherwise(text)


def masked_key(key: Column) -> Column:
    return F.concat(F.lit("****"), F.right(key, F.lit(4)))


def without_blobs(text: Column, least: int = 500, mark: str = "[data]") -> Column:
    return F.regexp_replace(text, f"[A-Za-z0-9+/=]{{{least},}}", mark)


def word_count(text: Column) -> Column:
    return F.when(F.length(F.trim(text)) > 0, F.size(F.split(F.trim(text), r"\s+"))).otherwise(F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def term_counts(text: Column, least: int = 3) -> Column:
    """Lower-case words of a to z of at least `least` letters, in order, with repeats."""
    return found(F.lower(text), f"[a-z]{{{least},}}")


def term_weights(words: Column) -> Column:
    """Map of each distinct word to its number of occurrences, as a double: words are sorted, and a run of equal ones is one term. Null has no words."""

    def runs(w: Column) -> Column:
        begin = F.filter(F.transform(w, lambda x, i: F.when((i == 0) | (x != F.get(w, i - 1)), i)), lambda i: i.isNotNull())
        counted = lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(w))), lambda i, j: F.struct(F.get(w, i).alias("term"), (j - i).cast("double").alias("n")))
        return F.map_from_entries(held(begin, lambda b: F.when(F.size(b) > 0, counted(b)).otherwise(F.array().cast("array<struct<term:string,n:double>>"))))

    return held(F.array_sort(words), runs)


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def utf16_slice(text: Column, start: int, end: int) -> Column:
    """The UTF-16 units start <= k < end of a text; half of a surrogate pair at a border is left out."""
    units = F.substring(F.encode(text, "UTF-16BE"), 2 * start + 1, 2 * (end - start))
    head = F.hex(F.substring(units, 1, 1)).between("DC", "DF")
    units = F.when(head, F.substring(units, F.lit(3), F.octet_length(units))).otherwise(units)
    tail = F.hex(F.substring(units, F.octet_length(units) - 1, F.lit(1))).between("D8", "DB") & (F.octet_length(units) > 0)
    return F.decode(F.when(tail, F.substring(units, F.lit(1), F.octet_length(units) - 2)).otherwise(units), "UTF-16BE")


def code_blocks(text: Column) -> Column:
    """Distinct bodies of fenced blocks, in order, without a leading language name."""
    return F.array_distinct(F.transform(found(text, r"(?s)```(?:[a-z]+(?=\s))?\n?(.*?)```", 1), lambda b: F.regexp_replace(F.regexp_replace(b, r"^query\s+", ""), r"^\s+|\s+$", "")))


def json_object(text: Column) -> Column:
    """From the first { to the last }; null if there is none."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def fenced_json(text: Column) -> Column:
    """Body of a ```json fence, of any fence, or the trimmed text."""
    body = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.regexp_replace(F.coalesce(body(r"(?s)```json\s*(.*?)```"), body(r"(?s)```\s*(.*?)```"), text), r"^\s+|\s+$", "")


def aliases(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[|;,]"), lambda a: F.trim(a)), lambda a: F.length(a) > 0)


def labelled_text(parts: list[tuple[str, Column]], size: int = 6000) -> Column:
    """'label: value' of the non-empty parts, joined by blanks and cut at `size` characters."""
    each = [F.when(F.length(F.trim(v)) > 0, F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in parts]
    return F.substring(F.concat_ws(" ", *each), 1, size)


def bigrams(words: Column) -> Column:
    """Neighbouring words joined by a blank."""
    return F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def without_tags(html: Column) -> Column:
    """Text of a page: scripts, styles, comments and tags go, common entities are read, blanks squeezed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def point_id(guid: Column) -> Column:
    """60-bit id: the first 15 hexadecimal digits of the guid's sha256."""
    return F.conv(F.substring(F.sha2(guid, 256), 1, 15), 16, 10).cast("long")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHHmmss")


def day_start(ts: Column, days_ago: int = 0) -> Column:
    return stamp(F.date_trunc("day", F.date_sub(ts, days_ago).cast("timestamp_ntz")))


def renewed(ts: Column, amount: Column, unit: Column) -> Column:
    """Expiry counted in days: a month is 30 of them, a year 365."""
    days = F.when(unit == "month", 30).when(unit == "year", 365).otherwise(1)
    return F.date_add(ts, (amount * days).cast("int"))
