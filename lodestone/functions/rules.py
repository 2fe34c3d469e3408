"""Rules over questions, answers, paths and requests, as predicates and ordered cases. A null text is an empty one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .intent import Scores, keyword_hits

# Words and patterns of the rules, in Korean and English.
CASUAL = ["^안녕", "^반갑", "^하이$", "^헬로", "^hi$", "^hello", "날씨", "weather", "맛집", "음식", "식당", "영화", "드라마", "음악", "노래", "축구", "야구", "스포츠", "주가", "주식", "비트코인", "여행", "관광", r"몇\s*살", "재미있", "심심", "고마워", "감사합니다", r"자기\s*소개", r"너\s*(는|가)\s*(누구|뭐)", r"이름이\s*뭐"]
ACTIONS = ["조회", "검색", "찾", "분석", "확인", "보여", "알려", "생성", "만들", "query", "search", "show", "find", "analyze", "create", "generate", "어떤", "무엇", "언제", "어디", "왜", "어떻게"]
BARE_VERB = r"^(그럼\s*|좀\s*|다시\s*)?(찾아|보여|알려|만들어|생성해|분석해|확인해|조회해|검색해)\s*(줘|주세요|줄래|봐|봐줘)?\s*[.!?]?\s*$"
CLARIFY = ["어떤 시간", "어떤 ip", "어떤 테이블", "무엇을", "어떤 값을", "필요한 매개변수", "추가 정보", "구체적으로", "알려주세요", "조회 기간", "시간 범위", "기간을 지정", "날짜를 입력", "specify", "provide", "please enter", "time range", "어떤 기간", "언제부터", "언제까지", "몇 시부터", "몇 일", "시작 시간", "종료 시간"]
ASKING = ["언제", "어떤", "무엇", "어디", "몇", "얼마", "어느"]
DATES = r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8}|최근.*[0-9]+.*일|지난.*[0-9]+.*일|[0-9]+월\s*[0-9]+일|어제.*오늘|오늘.*어제|이번.*주|지난.*주|작년.*올해"
TIMES = ["어제", "오늘", "내일", "모레", "그제", "yesterday", "today", "tomorrow", "부터", "까지", "동안", "from", "to", "until", "이번", "지난", "다음", "this", "last", "next"]
FOUR_NUMBERS = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
QNA_WORDS = ["무엇", "뭐", "어떻게", "왜", "차이", "설명", "의미", "개념", "이란", "란", "what", "how", "why", "difference", "explain", "meaning", "concept"]
PLAN_WORDS = ["계획", "전략", "방법", "접근", "구조", "설계", "단계별", "순서대로", "과정", "plan", "strategy", "method", "approach", "structure", "design"]
ACTION_WORDS = ["찾아", "검색", "보여", "생성", "실행", "가져와", "추출", "분석해", "해줘", "만들어", "find", "search", "show", "generate", "run", "get", "extract"]
TYPE_WORDS = [
    ("installation", ["install", "설치"]), ("configuration", ["config", "설정", "setup"]), ("troubleshooting", ["trouble", "문제", "error", "fix", "해결"]), ("reference", ["reference", "ref", "참조", "api"]),
    ("tutorial", ["tutorial", "튜토리얼", "lesson"]), ("faq", ["faq", "자주", "q&a"]), ("playbook", ["playbook", "workflow", "procedure", "runbook"]),
]


def any_word(text: Column, words: list[str]) -> Column:
    """Whether any of the words stands in the text, as a part of it."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def _low(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def casual(text: Column, domain: list[str]) -> Column:
    """Small talk: up to 300 characters, no word of the domain, no address, and a phrase of small talk or at most four characters."""
    q = _low(text)
    serious = any_word(q, domain) if domain else F.lit(False)
    return F.when((q == "") | (F.length(q) > 300) | serious | q.rlike(FOUR_NUMBERS), False).otherwise(q.rlike("|".join(f"(?:{p})" for p in CASUAL)) | (F.length(q) <= 4))


def complete(text: Column) -> Column:
    """A question that stands on its own: eight characters or more, and a verb that is not all of it, or the form of a question."""
    q = _low(text)
    asks = F.contains(q, F.lit("?")) | q.rlike("(?:까|나|요|니)$")
    return F.when(F.length(q) < 8, False).when(any_word(q, ACTIONS), ~q.rlike(BARE_VERB)).otherwise(asks)


def parameters_only(text: Column) -> Column:
    """An answer that only gives values: an address, a time, yes or no, a number, or at most five words that ask for nothing; up to 200 characters."""
    q, raw = _low(text), F.coalesce(text, F.lit(""))
    few = (F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")) <= 5) & ~any_word(q, ["조회", "search", "query", "show", "list"])
    hit = raw.rlike(FOUR_NUMBERS) | raw.rlike(DATES) | any_word(q, TIMES) | q.isin("yes", "no", "네", "아니오", "예") | q.rlike("^[0-9]+$") | few
    return (raw != "") & (F.length(raw) <= 200) & hit


def clarifies(answer: Column) -> Column:
    """Whether an answer asks back for values."""
    a = F.lower(F.coalesce(answer, F.lit("")))
    return F.contains(F.replace(a, F.lit('": "'), F.lit('":"')), F.lit('"action":"clarify"')) | any_word(a, CLARIFY) | a.rlike("from.*to|기간.*알려") | (F.contains(a, F.lit("?")) & any_word(a, ASKING))


def path_type(path: Column, content: Column) -> Column:
    """A document's type from words of its path, or else, for a document with a head, from its question and answer."""
    p, c = F.lower(path), F.lower(F.coalesce(content, F.lit("")))
    named = F.lit(None).cast("string")
    for name, words in reversed(TYPE_WORDS):
        named = F.when(any_word(p, words), name).otherwise(named)
    folder = F.when(p.startswith("qna/"), "faq").when(p.startswith("action/"), "action").when(p.startswith("playbook/"), "playbook")
    inside = F.when(c.rlike("(?m)^question:.*(?:[?]|어떻게|how)"), "faq").when(any_word(c, ["설치", "install"]), "installation").when(any_word(c, ["설정", "config"]), "configuration")
    inside = inside.when(any_word(c, ["문제", "error", "오류"]), "troubleshooting").when(any_word(c, ["api", "reference", "참조"]), "reference").when(any_word(c, ["tutorial", "단계", "step"]), "tutorial")
    return F.coalesce(named, folder, F.when(F.ltrim(c).startswith("---"), inside), F.lit("other"))


def keyword_intent(text: Column) -> Scores:
    """Shares of keywords found; without any, defaults by the question's shape."""
    n = [keyword_hits(text, w).cast("double") for w in (QNA_WORDS, PLAN_WORDS, ACTION_WORDS)]
    total = n[0] + n[1] + n[2]
    q = F.lower(F.coalesce(text, F.lit("")))
    shape = [F.when(F.contains(q, F.lit("?")), a).when(q.rlike("(?:해줘|줘|해봐|실행)$"), b).when(F.length(q) > 40, c).otherwise(d) for a, b, c, d in ((0.8, 0.1, 0.2, 0.6), (0.1, 0.1, 0.6, 0.2), (0.1, 0.8, 0.2, 0.2))]
    return tuple(F.when(total > 0, x / total).otherwise(s) for x, s in zip(n, shape, strict=True))  # type: ignore[return-value]


def emergency_intent(text: Column) -> Scores:
    """Scores without a model: 0.8 for the intent whose words come first, plan if none does."""
    q = F.lower(F.coalesce(text, F.lit("")))
    best = F.when(any_word(q, ["무엇", "설명", "차이", "의미"]), 0).when(any_word(q, ["찾아", "만들어", "보여", "실행"]), 2).otherwise(1)
    return tuple(F.when(best == k, 0.8).otherwise(0.1) for k in range(3))  # type: ignore[return-value]


def clear_pattern(text: Column, patterns: dict[str, list[str]]) -> Column:
    """The first intent one of whose patterns matches; null for none."""
    out = F.lit(None).cast("string")
    for name, each in reversed(patterns.items()):
        out = F.when(F.lower(text).rlike("|".join(f"(?:{p})" for p in each)), name).otherwise(out)
    return out


# Marks of log lines.
LOG_MARKS = r"(?i)\b(CEF:|LEEF:|DETECT\||SyslogAlertForwarder:|%ASA-|PulseSecure:|tlog:\s*\{|src=|dst=|spt=|dpt=|dvc=|dvchost=|deviceExternalId=|rt=|proto=|act=|msg=)\b"


def log_payload(text: Column) -> Column:
    """Whether a question carries raw log lines: a line end, six pipes or more, or a mark of a log line."""
    return F.coalesce(F.contains(text, F.lit("\n")) | (F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit(""))) >= 6) | text.rlike(LOG_MARKS), F.lit(False))


def request_problems(name: Column, role: Column, ranges: Column, roles: list[str]) -> Column:
    """What is wrong with a request: the name's length (2 to 50), an unknown role, ranges that are no IPv4 CIDR."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    cidr = rf"^{octet}(?:\.{octet}){{3}}/(?:3[0-2]|[12]?[0-9])$"
    return F.array_compact(F.array(F.when(~F.length(name).between(2, 50), "name"), F.when(~role.isin(roles), "role"), F.when(F.exists(ranges, lambda c: ~c.rlike(cidr)), "ranges")))


def characters_shared(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' sets of characters; 0 if one is empty."""
    letters = lambda x: F.array_distinct(F.filter(F.split(x, ""), lambda c: c != ""))
    x, y = letters(a), letters(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)


def name_similarity(a: Column, b: Column, a_aliases: Column, b_aliases: Column, ratio: Column) -> Column:
    """1.0 for equal names, 0.9 where one's name is the other's alias, 0.8 for a common alias, 0.7 where one name holds the other, else the ratio if above 0.5."""
    one = F.array_contains(a_aliases, b) | F.array_contains(b_aliases, a)
    held = F.contains(a, b) | F.contains(b, a)
    return F.when(a == b, 1.0).when(one, 0.9).when(F.arrays_overlap(a_aliases, b_aliases), 0.8).when(held, 0.7).when(ratio > 0.5, ratio).otherwise(0.0)
