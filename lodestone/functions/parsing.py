"""Parsing and rewriting of answers, queries and questions, as column expressions.

A null text gives null, or the empty result named in the docstring; nothing here raises on bad input.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found

FENCE = "```"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def tidy(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def json_array_parts(text: Column) -> Column:
    """struct(before, items, after) around the JSON array from the first [ to the last ]; null without one that parses."""
    array = _first(text, r"(?s)(\[.*\])")
    at = F.locate("[", text)
    parts = F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), array.alias("items"), F.substring(text, at + F.length(array), F.length(text)).alias("after"))
    return F.when(array.isNotNull() & F.try_parse_json(array).isNotNull(), parts)


def answer_kind(text: Column) -> Column:
    """'action' if the text holds a JSON array of objects, else 'qna'."""
    items = json_array_parts(text)["items"]
    return F.when(F.size(F.from_json(items, "array<map<string,string>>")) > 0, "action").otherwise("qna")


def cleaned_queries(items: Column) -> Column:
    """A JSON array of objects with the `query` fields cleaned: no leading pipe, no backslashes, doubled quotes single; null if it does not parse."""
    rows = F.from_json(items, "array<map<string,string>>")

    def clean(q: Column) -> Column:
        return F.replace(F.replace(F.regexp_replace(F.trim(q), r"^\|\s*", ""), F.lit("\\"), F.lit("")), F.lit('""'), F.lit('"'))

    return F.to_json(F.transform(rows, lambda m: F.transform_values(m, lambda k, v: F.when(k == "query", clean(v)).otherwise(v))))


def with_first_block(text: Column, body: Column) -> Column:
    """The text with the body of its first fenced block replaced; a text without a closed block stays."""
    start = F.locate(FENCE, text)
    end = F.locate(FENCE, text, 1) + 3
    close = F.instr(F.substring(text, end, F.length(text)), F.lit(FENCE))
    whole = F.concat(F.substring(text, F.lit(1), start - 1), F.lit(f"{FENCE}query\n"), body, F.lit(f"\n{FENCE}"), F.substring(text, end + close + 2, F.length(text)))
    return F.when((start > 0) & (close > 0), whole).otherwise(text)


def question(text: Column, least: int = 5) -> Column:
    """The trimmed question, null if it is shorter than `least` characters."""
    q = F.trim(text)
    return F.when(F.length(q) >= least, q)


def keywords(given: Column, text: Column, most: int = 10, words: int = 5) -> Column:
    """Given keywords (split at commas) and the first words of a text: distinct, sorted, at most `most`."""
    listed = F.filter(F.transform(F.split(F.coalesce(given, F.lit("")), ","), lambda w: F.trim(w)), lambda w: w != "")
    first = F.slice(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""), 1, words)
    return F.slice(F.array_sort(F.array_distinct(F.concat(listed, first))), 1, most)


def error_parts(message: Column) -> Column:
    """struct(kind, position, note) of an error message: 'kind: ... at offset n ... note: ...'."""
    return F.struct(_first(message, r"^\s*([A-Za-z_-]+)\s*:").alias("kind"), _first(message, r"(?i)offset[ =:]+([0-9]+)").cast("int").alias("position"), _first(message, r"(?i)note\s*:\s*(.+)$").alias("note"))


def file_parts(name: Column) -> Column:
    """struct(header, components): what stands between dashes in a file's name, without its ending."""
    parts = F.split(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "-")
    return F.struct(F.get(parts, F.lit(0)).alias("header"), F.slice(parts, 2, F.size(parts)).alias("components"))


def free_scores(text: Column, names: tuple[str, ...] = ("qna", "plan", "action")) -> Column:
    """Scores named in free text ('qna: 0.7'), scaled by 1/100 if any is above 1, then to sum to 1; null if none is named."""
    raw = [F.coalesce(_first(text, rf"(?i){n}\W{{0,3}}\s*([0-9]+(?:\.[0-9]+)?)").cast("double"), F.lit(0.0)) for n in names]
    scaled = [F.when(F.greatest(*raw) > 1, x / 100).otherwise(x) for x in raw]
    total = sum(scaled[1:], scaled[0])
    return F.when(total > 0, F.struct(*(F.round(x / total, 6).alias(n) for x, n in zip(scaled, names, strict=True))))


def intent_json(text: Column) -> Column:
    """struct(qna, plan, action) from the JSON object in a text, keys of either case; null if there is none that parses."""
    body = _first(text, r"(?s)(\{.*\})")
    m = F.from_json(F.lower(body), "map<string,string>")
    value = lambda n: F.try_element_at(m, F.lit(n)).try_cast("double")
    return F.when(value("qna").isNotNull() | value("plan").isNotNull() | value("action").isNotNull(), F.struct(*(F.coalesce(value(n), F.lit(0.0)).alias(n) for n in ("qna", "plan", "action"))))


#: Endings of word variants (what goes, what comes), in order.
ENDINGS = [("", "ing"), ("", "ed"), ("", "s"), ("e", "ing"), ("e", "ed"), ("", "er"), ("", "ion"), ("e", "ation"), ("", "tion"), ("", "ly"), ("", "ness"), ("", "able"), ("y", "ies")]


def word_variants(word: Column, most: int = 5) -> Column:
    """A word with its endings added and taken away: at most `most` distinct forms, shorter ones first, then in the order of ENDINGS."""
    stem = lambda w, end: F.left(w, F.length(w) - len(end))
    longer = [F.when(F.endswith(word, F.lit(gone)) & (F.length(word) - len(gone) >= 3), F.concat(stem(word, gone), F.lit(new))) for gone, new in ENDINGS]
    shorter = [F.when(F.endswith(word, F.lit(new)) & (F.length(word) - len(new) >= 3), F.concat(stem(word, new), F.lit(gone))) for gone, new in ENDINGS]
    fit = [F.when(F.length(w) <= 15, w) for w in longer]
    forms = F.array_distinct(F.array_compact(F.array(word, *fit, *shorter)))
    ordered = F.array_sort(F.transform(forms, lambda w, i: F.struct(F.length(w).alias("n"), i.alias("i"), w.alias("w"))))
    return F.slice(F.transform(ordered, lambda x: x["w"]), 1, most)


#: Characters of a text that are tried first for its pairs of words.
HEAD = 1000


def english_concepts(text: Column, stop: tuple[str, ...] = ("the", "and", "for", "with", "that"), most: int = 10) -> Column:
    """Capitalised phrases, neighbouring words, then single words of at least three letters (a to z), without stop words: the first `most` distinct, in lower case.

    The first `most` distinct pairs mostly stand in the text's head; only a text whose head has fewer is cut into words as a whole.
    """
    words = lambda x: F.filter(found(F.lower(x), "[a-z]{3,}"), lambda w: ~w.isin(*stop))
    phrases = F.transform(found(text, "[A-Z][a-z]+(?: [A-Z][a-z]+)+"), lambda p: F.lower(p))
    pairs = lambda w: F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.when(b.isNotNull(), F.concat_ws(" ", a, b))), lambda p: p.isNotNull())
    # The last word of the head may be cut, so its pair is left out.
    of_head = F.transform(F.array(words(F.left(text, F.lit(HEAD)))), lambda w: pairs(F.slice(w, 1, F.greatest(F.lit(0), F.size(w) - 1))))
    of_head = F.array_distinct(F.get(of_head, F.lit(0)))
    of_all = F.get(F.transform(F.array(words(text)), lambda w: F.concat(pairs(w), w)), F.lit(0))
    rest = F.get(F.transform(F.array(of_head), lambda h: F.when(F.size(h) >= most, h).otherwise(of_all)), F.lit(0))
    return F.slice(F.array_distinct(F.concat(phrases, rest)), 1, most)


def without_markdown(text: Column) -> Column:
    """Plain text: heading marks, emphasis, links, list marks and table rules go; bodies of fenced blocks stay as they are."""
    pieces = F.split(text, FENCE)

    def plain(p: Column) -> Column:
        for pattern, new in ((r"(?m)^#{1,6}\s+", ""), (r"\*\*|__|~~", ""), (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\|?[\s:|-]*-{3,}[\s:|-]*$", ""), (r"(?m)^\|\s*|\s*\|$", ""), (r"\s*\|\s*", " ")):
            p = F.regexp_replace(p, pattern, new)
        return p

    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 0, plain(p)).otherwise(p)), FENCE)


def without_emoji(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{FE0F}]", "")


def without_dates(prompt: Column) -> Column:
    """A prompt without its date section (a line that begins with 'Current date' and what follows up to a blank line) and without tags."""
    return tidy(F.regexp_replace(F.regexp_replace(prompt, r"(?is)(?:^|\n)current date.*?(?:\n\s*\n|$)", "\n"), r"</?[a-z_]+>", ""))


def normal_term(term: Column, known: dict[str, str]) -> Column:
    """Lower case, then the dictionary's form of it, with or without its blanks."""
    low = F.lower(F.trim(term))
    if not known:
        return low
    m = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.try_element_at(m, low), F.try_element_at(m, F.replace(low, F.lit(" "), F.lit(""))), low)


def repaired_keywords(translated: Column, original: Column) -> Column:
    """English words of the original (three letters or more) that the translation has lost, put before it."""
    lost = F.filter(F.array_distinct(found(original, r"\b[A-Za-z]{3,}\b")), lambda w: ~F.contains(F.lower(translated), F.lower(w)))
    return F.when(F.size(lost) > 0, F.concat_ws(" ", F.array_join(lost, " "), translated)).otherwise(translated)


def protected(text: Column) -> Column:
    """struct(text, words): English words of more than two letters replaced by marks __0__, __1__, ..., longest first."""
    words = F.array_sort(F.array_distinct(found(text, r"\b[A-Za-z]{3,}\b")), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    marked = F.aggregate(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), text, lambda t, x: F.replace(t, x["w"], F.concat(F.lit("__"), x["i"].cast("string"), F.lit("__"))))
    return F.struct(marked.alias("text"), words.alias("words"))


def restored(text: Column, words: Column) -> Column:
    return F.aggregate(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), text, lambda t, x: F.replace(t, F.concat(F.lit("__"), x["i"].cast("string"), F.lit("__")), x["w"]))


def context_line(rank: Column, parts: list[tuple[str, Column]]) -> Column:
    """'[rank]' and the non-empty labelled parts, one on a line."""
    return F.concat_ws("\n", F.format_string("[%d]", rank), *(F.when(F.length(F.trim(v)) > 0, F.concat(F.lit(f"{k}: "), F.trim(v))) for k, v in parts))


#: A whole line of a table: dots, pipes, rules of dashes, or columns parted by wide blanks.
TABLE_LINE = r"^(?:\.\.\.\z|\|(?:[^|]+\|)+$|\+(?:-+\+)+$|\|\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)+\|?$|\S+\s{2,}\S+(?:\s{2,}\S+)*$)"


def table_line(line: Column) -> Column:
    """Whether a line belongs to a table: blank, dots, pipes, rules of dashes, or columns parted by wide blanks."""
    return _table_line(tidy(line))


def _table_line(x: Column) -> Column:
    return (x == "") | x.rlike(TABLE_LINE)


#: What stands in double quotes (to the end, if they stay open), a bracket, a pipe, or a run of anything else. A quote behind a backslash is none.
TOKEN = r'(?s)(?<!\\)".*?(?:(?<!\\)"|\z)|[\[\]|"]|[^"\[\]|]+'


def pipe_parts(text: Column) -> Column:
    """A query cut at pipes that stand outside of quotes and brackets; parts are trimmed, empty ones go. The fold is over tokens, not characters."""
    mark = "\u0001"
    start = F.struct(F.lit(0).alias("d"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        d = a["d"] + F.when(x == "[", 1).when(x == "]", -1).otherwise(0)
        return F.struct(d.alias("d"), F.concat(a["out"], F.when((x == "|") & (a["d"] == 0), mark).otherwise(x)).alias("out"))

    marked = F.aggregate(found(text, TOKEN), start, step, lambda a: a["out"])
    return F.filter(F.transform(F.split(marked, mark), lambda p: F.trim(p)), lambda p: p != "")


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def joined_lines(text: Column) -> Column:
    """Lines of a query put together while a quote or bracket is open; blank and table lines outside of them go.

    Whether a quote is open, and the brackets open outside of quotes, are carried from line to line, so a line is read once.
    """
    start = F.from_json(F.lit('{"out":"","buf":"","q":false,"d":0}'), "struct<out:string,buf:string,q:boolean,d:int>")

    def brackets(x: Column) -> Column:
        bare = F.when(F.contains(x, F.lit('"')), F.regexp_replace(x, r'"[^"]*(?:"|\z)', "")).otherwise(x)
        return _count(bare, "[") - _count(bare, "]")

    def line(x: Column) -> Column:
        turns = (_count(x, '"') % 2 == 1).alias("turns")
        inside = F.when(F.contains(x, F.lit('"')), brackets(F.regexp_replace(x, r'^[^"]*"', ""))).otherwise(0)
        return F.struct(x.alias("x"), turns, brackets(x).alias("d"), inside.alias("inside"))

    lines = F.transform(F.transform(F.split(text, r"\r?\n"), lambda x: tidy(x)), line)

    def step(a: Column, x: Column) -> Column:
        skip = (x["x"] == "") | ((a["buf"] == "") & _table_line(x["x"]))
        q, d = a["q"] != x["turns"], a["d"] + F.when(a["q"], x["inside"]).otherwise(x["d"])
        buf = F.when(a["buf"] == "", x["x"]).otherwise(F.concat_ws(" ", a["buf"], x["x"]))
        done = F.concat(a["out"], F.when(a["out"] == "", "").otherwise("\n"), buf)
        still = F.struct(a["out"].alias("out"), buf.alias("buf"), q.alias("q"), d.alias("d"))
        closed = F.struct(done.alias("out"), F.lit("").alias("buf"), F.lit(False).alias("q"), F.lit(0).alias("d"))
        return F.when(skip, a).when(q | (d > 0), still).otherwise(closed)

    return F.aggregate(lines, start, step, lambda a: F.when(a["buf"] == "", a["out"]).when(a["out"] == "", a["buf"]).otherwise(F.concat_ws("\n", a["out"], a["buf"])))


def yaml_text(text: Column) -> Column:
    """Pilcrows become line ends again; a document mark stands first."""
    t = F.replace(text, F.lit("¶"), F.lit("\n"))
    return F.when(t.startswith("---"), t).otherwise(F.concat(F.lit("---\n"), t))


def final_channel(answer: Column, mark: str = "<|channel|>final", end: str = "<end_of_turn>") -> Column:
    """What follows the last channel mark, up to the end-of-turn mark, without further marks and replacement characters."""
    body = F.substring_index(F.substring_index(answer, mark, -1), end, 1)
    return F.trim(F.replace(F.regexp_replace(body, r"<\|[a-z_]+\|>", ""), F.lit("�"), F.lit("")))


def based(fragment: Column, previous: Column) -> Column:
    """A query that begins with a pipe gets the first part of the query before it; without one it loses the pipe."""
    base = F.trim(F.get(pipe_parts(previous), F.lit(0)))
    rest = F.trim(F.regexp_replace(fragment, r"^\s*\|", ""))
    return F.when(~fragment.rlike(r"^\s*\|"), fragment).when(base.isNull(), rest).otherwise(F.concat_ws(" | ", base, rest))


def demojibaked(text: Column) -> Column:
    """UTF-8 read as Latin-1 is read again: only texts whose characters all fit a byte, hold a lead byte, and give valid UTF-8."""
    raw = F.encode(text, "ISO-8859-1")
    fits = text.rlike(r"^[\x{00}-\x{FF}]*$") & text.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]")
    return F.when(fits & F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(text)


def ticket(lines: Column, references: Column) -> Column:
    """Raw lines, then numbered references; '(no data)' where there are none of either."""
    numbered = F.transform(references, lambda r, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), r))
    return F.concat(F.coalesce(F.nullif(F.array_join(lines, "\n"), F.lit("")), F.lit("(no data)")), F.lit("\n---\n"), F.coalesce(F.nullif(F.array_join(numbered, "\n"), F.lit("")), F.lit("(no data)")))


def analysis(text: Column) -> Column:
    """struct(analysis, kind, queue) of a JSON answer with defaults; a text that does not parse is the analysis itself, of kind 'unknown'."""
    m = F.from_json(_first(text, r"(?s)(\{.*\})"), "struct<analysis:string,kind:string,queue:string>")
    return F.struct(F.coalesce(m["analysis"], text).alias("analysis"), F.coalesce(m["kind"], F.lit("unknown")).alias("kind"), F.coalesce(m["queue"], F.lit("")).alias("queue"))


def mode_flag(text: Column, flag: str = "--brief") -> Column:
    """struct(brief, text): whether the flag is there, and the text without it."""
    return F.struct(F.contains(text, F.lit(flag)).alias("brief"), F.trim(F.replace(text, F.lit(flag), F.lit(""))).alias("text"))


def plan_items(text: Column) -> Column:
    """The steps of a JSON plan: array of struct(ordinal, msg, category, status) with defaults; empty if it does not parse."""
    items = F.from_json(_first(text, r"(?s)(\[.*\])"), "array<struct<msg:string,category:string,status:string>>")
    steps = F.transform(items, lambda x, i: F.struct((i + 1).alias("ordinal"), F.coalesce(x["msg"], F.lit("")).alias("msg"), F.coalesce(x["category"], F.lit("action")).alias("category"), F.coalesce(x["status"], F.lit("pending")).alias("status")))
    return F.coalesce(steps, F.array().cast("array<struct<ordinal:int,msg:string,category:string,status:string>>"))


#: Phrases that name a year by its distance from the current one; longer ones first.
YEAR_WORDS = [("재작년", 2), ("작년", 1), ("올해", 0), ("the year before last", 2), ("last year", 1), ("this year", 0)]


def years_named(text: Column, year: int) -> Column:
    """Distinct years that a question names, in order of size: four digits, or by their distance from `year`."""
    years, left = F.transform(found(text, r"(?:19|20)[0-9]{2}"), lambda y: y.cast("int")), F.lower(text)
    for phrase, back in YEAR_WORDS:
        years = F.concat(years, F.when(F.contains(left, F.lit(phrase)), F.array(F.lit(year - back))).otherwise(F.array().cast("array<int>")))
        left = F.replace(left, F.lit(phrase), F.lit(" "))
    return F.array_sort(F.array_distinct(years))


def with_years(query: Column, years: Column, year: int) -> Column:
    """The years of a query's from= and to= changed to those that the question names (none: `year`; two: the first and the second).

    With up to one year a later end stays as it is; an end that is no time of 8 to 14 digits always does.
    """
    p = r"table\s+from=([0-9]{8,14})\s+to=(\S+)"
    start, end = _first(query, p), _first(query, p, 2)
    dated = end.rlike("^[0-9]{8,14}$")
    low = F.coalesce(F.get(years, F.lit(0)), F.lit(year)).cast("string")
    high = F.get(years, F.lit(1)).cast("string")
    moved = lambda t, y: F.concat(y, F.substring(t, F.lit(5), F.length(t)))
    new_end = F.when(dated & high.isNotNull(), moved(end, high)).when(dated & (F.left(end, F.lit(4)) < low), moved(end, low)).otherwise(end)
    out = F.replace(query, F.concat(F.lit("from="), start), F.concat(F.lit("from="), moved(start, low)))
    out = F.replace(out, F.concat(F.lit("to="), end), F.concat(F.lit("to="), new_end))
    return F.when(start.isNotNull() & (F.size(years) <= 2), out).otherwise(query)


def setting(*levels: Column) -> Column:
    """The first value given: a request's, its subscription's, the default."""
    return F.coalesce(*levels)


def validated(query: Column, rules: dict[str, str]) -> Column:
    """Names of the rules (name -> pattern) that a query breaks; without rules, as without a plug-in, none."""
    if not rules:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*(F.when(query.rlike(p), n) for n, p in rules.items())))
