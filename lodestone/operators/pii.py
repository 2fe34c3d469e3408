"""Personal data and credentials: recognisers as data, findings with places, reversible masks.

Patterns and checksums are facts of the formats; they are listed in RECOGNISERS and CHECKS. Places of matches are what Spark's
functions do not give, so `findings` is one Arrow-batched pandas UDF; `suspicious` is the native pre-filter before it.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.rewrite import unmasked

THRESHOLD = 0.35
#: What a context word near a match adds to its score, the least score then, and how many words before the match are looked at.
BOOST, BOOSTED, NEAR = 0.35, 0.4, 5
ALNUM, HEX = "A-Za-z0-9", "0-9A-Fa-f:"


def bounded(core: str, before: str = r"\d", after: str = r"\d") -> str:
    """A pattern that no character of the class `before` precedes and none of `after` follows; an empty class sets no bound."""
    return (f"(?<![{before}])" if before else "") + core + (f"(?![{after}])" if after else "")


#: Where numbers stand: every match of a recogniser that needs DIGITS lies in such a run, a letter before it aside.
DIGITS = r"\d[\d\s.\-가-힣]{5,}"
# Entity, score of the pattern, pattern, what a text with a match holds (DIGITS, or one of these strings), context words.
RECOGNISERS = [
    ("KR_RRN", 0.6, bounded(r"\d{6}-?[1-8]\d{6}"), DIGITS, "주민 주민등록 주민번호"),
    ("KR_BIZ_NO", 0.5, bounded(r"\d{3}-?\d{2}-?\d{5}"), DIGITS, "사업자 사업자등록 사업자번호"),
    ("KR_CORP_NO", 0.35, bounded(r"\d{6}-?\d{7}"), DIGITS, "법인 법인등록"),
    ("KR_PHONE", 0.7, bounded(r"01[016789]-?\d{3,4}-?\d{4}"), DIGITS, "전화 휴대폰 핸드폰 연락처 tel"),
    ("KR_PHONE", 0.55, bounded(r"0(?:2|[3-6][1-5])-?\d{3,4}-?\d{4}"), DIGITS, "전화 휴대폰 핸드폰 연락처 tel"),
    ("KR_PASSPORT", 0.5, bounded(r"[MSRODmsrod]\d{8}", ALNUM), DIGITS, "여권 passport"),
    ("KR_DRIVER_LICENSE", 0.5, bounded(r"\d{2}-?\d{2}-?\d{6}-?\d{2}"), DIGITS, "운전면허 면허"),
    ("KR_CREDIT_CARD", 0.4, bounded(r"(?:\d{4}[- ]?){3}\d{1,4}", r"\d-"), DIGITS, "카드 신용카드 card"),
    ("KR_ACCOUNT", 0.3, bounded(r"\d{2,6}-\d{2,6}-\d{2,6}(?:-\d{1,6})?", r"\d-"), DIGITS, "계좌 계좌번호 입금 출금 은행 account"),
    ("KR_HEALTH_INSURANCE", 0.25, bounded(r"\d-?\d{9,10}"), DIGITS, "건강보험 보험증 가입자번호 요양"),
    ("KR_VEHICLE", 0.6, bounded(r"\d{2,3}[가-힣]\s?\d{4}"), DIGITS, "차량 차량번호 번호판 자동차"),
    ("KR_IP", 0.6, bounded(r"\d{1,3}(?:\.\d{1,3}){3}", r"\d.", r"\d."), DIGITS, "ip 아이피 접속 주소"),
    ("KR_IP", 0.7, bounded("[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]*:[0-9A-Fa-f]{0,4}", HEX, HEX), ":", "ip 아이피 접속 주소"),
    ("KR_EMAIL", 0.9, bounded(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\w.+-", "A-Za-z"), "@", "이메일 메일 email mail"),
    ("KR_MAC", 0.8, bounded("(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}", HEX + "-", HEX + "-"), ": -", ""),
    ("CREDENTIAL", 0.85, r"(?i)(?:api[_-]?key|secret|access[_-]?key|password|passwd|pwd|auth[_-]?token|token|bearer)\s*[:=]\s*[\"']?[^\s\"']{4,}", ": =", ""),
    ("AWS_KEY", 0.9, bounded("AKIA[0-9A-Z]{16}", ALNUM, ALNUM), "AKIA", ""),
    ("JWT", 0.9, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "eyJ", ""),
    ("PRIVATE_KEY", 0.99, r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----[\s\S]+?-----END[^-]+-----", "-----BEGIN", ""),
    ("API_TOKEN", 0.95, bounded("gh[posru]_[A-Za-z0-9]{36,}", ALNUM, ALNUM), "ghp_ gho_ ghs_ ghr_ ghu_", ""),
    ("API_TOKEN", 0.95, bounded("github_pat_[A-Za-z0-9_]{40,}", ALNUM, ALNUM), "github_pat_", ""),
    ("API_TOKEN", 0.9, bounded("xox[baprs]-[A-Za-z0-9-]{8,}", ALNUM, ALNUM), "xox", ""),
    ("API_TOKEN", 0.9, bounded("(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}", ALNUM, ALNUM), "_live_ _test_", ""),
    ("API_TOKEN", 0.9, bounded("AIza[A-Za-z0-9_-]{30,}", ALNUM, ALNUM), "AIza", ""),
    ("API_TOKEN", 0.85, bounded("sk-(?:proj-)?[A-Za-z0-9]{20,}", ALNUM, ALNUM), "sk-", ""),
]
# Weights of the published checksums, and the modulus whose complement is the check digit.
CHECKSUMS = {"KR_RRN": ((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5), 11), "KR_BIZ_NO": ((1, 3, 7, 1, 3, 7, 1, 3, 5), 10), "KR_CREDIT_CARD": (None, 10)}
FINDING = "array<struct<entity:string,first:int,last:int,score:double>>"


def check_digit(entity: str, digits: list[int]) -> int:
    """The last digit that makes a number valid: weighted sum, taken from the modulus. Card numbers double every second digit (Luhn)."""
    weights, modulus = CHECKSUMS[entity]
    body = digits[:-1]
    terms = [d * w for d, w in zip(body, weights or [1 + (len(body) - k) % 2 for k in range(len(body))], strict=True)]
    if entity == "KR_CREDIT_CARD":
        terms = [t // 10 + t % 10 for t in terms]
    if entity == "KR_BIZ_NO":
        terms.append(terms[-1] // 10)
    return (modulus - sum(terms) % modulus) % 10


def possible(entity: str, text: str, digits: list[int]) -> bool:
    """Whether a match can be a value of the entity at all."""
    if entity == "KR_RRN":
        return 1 <= digits[2] * 10 + digits[3] <= 12 and 1 <= digits[4] * 10 + digits[5] <= 31
    if entity == "KR_CREDIT_CARD":
        return 13 <= len(digits) <= 16
    if entity == "KR_IP":
        try:
            return bool(ipaddress.IPv6Address(text)) if ":" in text else all(int(p) <= 255 for p in text.split("."))
        except ValueError:
            return False
    return True


def near_context(text: str, first: int, words: list[str]) -> bool:
    """Whether a context word stands in one of the NEAR words before a place."""
    before = " ".join(text[max(0, first - 200) : first].split()[-NEAR:]).lower()
    return any(w in before for w in words)


def scored(entity: str, score: float, text: str, first: int, last: int, context: list[str]) -> float:
    """0.0 for an impossible value, 1.0 for one that its checksum or form proves, else the pattern's score, raised by a context word."""
    value = text[first:last]
    digits = [int(c) for c in value if c.isdigit()]
    if not possible(entity, value, digits):
        return 0.0
    if entity in CHECKSUMS and check_digit(entity, digits) == digits[-1] or entity == "KR_IP" and ":" in value:
        return 1.0
    return min(1.0, max(score + BOOST, BOOSTED)) if near_context(text, first, context) else score


def matches(text: str, runs: list[tuple[int, int]], pattern: re.Pattern, needs: str) -> Iterator[re.Match]:
    """All matches of a recogniser. One that needs DIGITS is looked for in the runs of numbers alone, with a character more at both ends."""
    if needs == DIGITS:
        for first, last in runs:
            yield from pattern.finditer(text, max(0, first - 1), min(len(text), last + 1))
    elif any(n in text for n in needs.split(" ")):
        yield from pattern.finditer(text)


def spans_of(text: str, recognisers: list[tuple[str, float, re.Pattern, str, list[str]]]) -> list[dict]:
    """Findings of one text that do not overlap: higher scores first, then earlier ones; in order of place."""
    runs = [m.span() for m in re.finditer(DIGITS, text)]
    found = {(-scored(entity, score, text, *m.span(), words), *m.span(), entity) for entity, score, pattern, needs, words in recognisers for m in matches(text, runs, pattern, needs)}
    kept: list[tuple] = []
    for f in sorted(f for f in found if -f[0] >= THRESHOLD):
        if all(f[2] <= k[1] or k[2] <= f[1] for k in kept):
            kept.append(f)
    return [{"entity": f[3], "first": f[1], "last": f[2], "score": -f[0]} for f in sorted(kept, key=lambda k: k[1])]


def _findings(texts: pd.Series) -> pd.Series:
    recognisers = [(e, s, re.compile(p), n, w.split()) for e, s, p, n, w in RECOGNISERS]
    return texts.map(lambda t: spans_of(t, recognisers) if t else [])


def findings(text: Column | str) -> Column:
    """The findings of a text, in order of place; none for a null or empty one."""
    return F.pandas_udf(_findings, FINDING)(text)


#: What a match of each recogniser holds at least. Digits, blanks and cases are those of Python's patterns, so of all scripts.
SUSPICIOUS = r"(?U)\d{3}|\d{1,3}(?:\.\d{1,3}){3}|\d{2}-\d{2}|@|eyJ|AKIA|-----BEGIN|gh[posru]_|github_pat_|xox[baprs]-|(?:sk|pk|rk)_|AIza|sk-|::|[0-9A-Fa-f]:[0-9A-Fa-f]|(?i:key|secret|password|passwd|pwd|token|bearer)[\s\x1c-\x1f]*[=:]|[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}"


def suspicious(text: Column) -> Column:
    """Whether a text can hold a finding at all: native, and true for every text with one."""
    return text.rlike(SUSPICIOUS)


def replaced(text: Column, spans: Column, mark) -> Column:
    """The text with each span (struct first, last, ..., in order of place) replaced by `mark` of it."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(F.concat(a["out"], F.substring(text, a["at"] + 1, s["first"] - a["at"]), mark(s)).alias("out"), s["last"].alias("at"))
    return F.aggregate(spans, start, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def irreversible(text: Column) -> Column:
    """The text with each finding replaced by its entity's name in angle brackets; a null stays null."""
    return F.when(suspicious(text), replaced(text, findings(text), lambda s: F.concat(F.lit("<"), s["entity"], F.lit(">")))).otherwise(text)


def numbered(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, turn, entity, value, first, last, mark): marks are shared within a conversation, numbered by first appearance."""
    f = rows.where(suspicious(F.col("text"))).withColumn("f", F.explode(findings("text")))
    f = f.select(conv, turn, F.col("f.entity").alias("entity"), F.expr("substring(text, f.first + 1, f.last - f.first)").alias("value"), F.col("f.first").alias("first"), F.col("f.last").alias("last"))
    names = f.groupBy(conv, "value").agg(F.min(F.struct(F.col(turn).alias("t"), (-F.col("first")).alias("p"), F.col("entity").alias("e"))).alias("at"))
    w = Window.partitionBy(conv, "at.e").orderBy("at.t", "at.p")
    marks = names.select(conv, "value", F.concat(F.lit("<"), F.col("at.e"), F.lit("_"), F.row_number().over(w), F.lit(">")).alias("mark"))
    return f.join(marks, [conv, "value"])


def masked(rows: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """`rows` with masked text and the conversation's map mark -> value, which `unmasked` reverses."""
    n = numbered(rows, conv, turn)
    by_turn = n.groupBy(conv, turn).agg(F.array_sort(F.collect_list(F.struct("first", "last", "mark"))).alias("_s"))
    maps = n.groupBy(conv).agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("mark", "value")))).alias("marks"))
    text = replaced(F.col("text"), F.col("_s"), lambda s: s["mark"])
    joined = rows.join(by_turn, [conv, turn], "left").join(maps, conv, "left")
    return joined.withColumn("text", F.coalesce(text, F.col("text"))).drop("_s")


def restored_pieces(chunks: DataFrame) -> DataFrame:
    """(guid, seq, piece): what a stream restorer emits for chunks (guid, seq, chunk, marks), in order.

    A mark may be cut between chunks, so what follows an unclosed '<' is held back until its '>' comes; the last chunk gives out all.
    The chunks of an answer are one group; an answer is bounded by the model that writes it.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "chunk")))
    c = chunks.groupBy("guid").agg(ordered.alias("c"), F.first("marks", True).alias("marks"))
    start = F.from_json(F.lit('{"held":"","out":[]}'), "struct<held:string,out:array<struct<seq:bigint,piece:string>>>")

    def step(a: Column, x: Column) -> Column:
        text = F.concat(a["held"], F.coalesce(x["chunk"], F.lit("")))
        tail = F.regexp_extract(text, r"(<[^>]*)$", 1)
        last = x["seq"] == F.element_at("c", -1)["seq"]
        held = F.when(last, F.lit("")).otherwise(tail)
        piece = F.substring(text, F.lit(1), F.length(text) - F.length(held))
        return F.struct(held.alias("held"), F.array_append(a["out"], F.struct(x["seq"].cast("long").alias("seq"), piece.alias("piece"))).alias("out"))

    pieces = c.select("guid", "marks", F.explode(F.aggregate("c", start, step, lambda a: a["out"])).alias("p"))
    return pieces.select("guid", "p.seq", unmasked(F.col("p.piece"), F.col("marks")).alias("piece"))


def semantic(segments: DataFrame, prototypes: DataFrame, cosine, least: float = 0.6) -> DataFrame:
    """(id, category, score): segments (id, vec) whose most similar prototype (category, proto) has a cosine of at least `least`.

    Vectors come from the caller's embedder. Prototypes are a fixed list, a few for each category, and are broadcast; ties go to the lesser category.
    """
    scored = segments.join(F.broadcast(prototypes)).select("id", "category", cosine(F.col("vec"), F.col("proto")).alias("score"))
    best = scored.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "category")).alias("b"))
    return best.select("id", "b.category", (-F.col("b.s")).alias("score")).where(F.col("score") >= least)
