"""Concepts of texts in Korean and English, and the terms that the two languages share.

A text with a Hangul syllable is Korean: its words lose their particle (the longest that they end with), and neighbours and words are
its concepts. In any other text capitalised phrases come first. Concepts that are one term after `normal` count once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import found, held

# Stop words of both languages, and particles that a Korean word may end with.
KOREAN_STOP = ("이", "그", "저", "것", "은", "는", "가", "를", "에", "와", "과", "이다", "있다")
ENGLISH_STOP = ("the", "a", "an", "of", "in", "on", "at", "by", "for", "with", "about")
PARTICLES = ("이", "가", "을", "를", "에", "의", "로", "으로", "와", "과", "이나", "나", "은", "는")
PHRASE = r"[A-Z][a-z]+(?:\s+[A-Z]?[a-z]+){0,2}"
HANGUL, MOST = "[가-힣]", 10
#: Characters of a text that are tried first.
HEAD = 1000


def without_particle(word: Column) -> Column:
    """A word without the longest particle that it ends with; looked up by the last letters, longer endings first."""
    out = F.when(F.lit(False), word)
    for size in sorted({len(p) for p in PARTICLES}, reverse=True):
        ends = [p for p in PARTICLES if len(p) == size]
        out = out.when(F.right(word, F.lit(size)).isin(ends), F.left(word, F.length(word) - size))
    return out.otherwise(word)


def normal(term: Column, known: Column | None = None) -> Column:
    """Lower case; the dictionary's form without blanks where it has only that. known: map of terms."""
    low = F.lower(term)
    if known is None:
        return low
    bare = F.replace(low, F.lit(" "), F.lit(""))
    return F.when(F.map_contains_key(known, low), low).when(F.map_contains_key(known, bare), bare).otherwise(low)


def _neighbours(words: Column, least: int) -> Column:
    """Neighbouring words joined by a blank, of more than `least` characters."""
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.filter(pairs, lambda p: F.length(p) > least)


def concepts(text: Column, known: Column | None = None, most: int = MOST) -> Column:
    """The first `most` concepts of a text, as they are written there; none for a null or empty one.

    They mostly stand in the text's head, whose phrases and neighbours are the first of the whole text's; only a text whose head has fewer is
    cut into words as a whole. What the head's end may have cut, its last word and its last phrase, is left out.
    """
    cut = lambda x: F.split(x, r"\s+")
    but_last = lambda xs: F.slice(xs, 1, F.greatest(F.lit(0), F.size(xs) - 1))

    def korean(words: Column) -> Column:
        kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*KOREAN_STOP))
        return F.filter(F.transform(kept, without_particle), lambda w: F.length(w) > 1)

    def english(words: Column) -> Column:
        return F.filter(F.transform(F.filter(words, lambda w: F.length(w) > 2), lambda w: F.lower(w)), lambda w: ~w.isin(*ENGLISH_STOP))

    def firsts(names: Column) -> Column:
        named = F.filter(F.transform(names, lambda c: F.struct(normal(c, known).alias("key"), c.alias("name"))), lambda c: F.length(c["key"]) > 2)

        def of(all_named: Column) -> Column:
            keys = F.slice(F.array_distinct(F.transform(all_named, lambda c: c["key"])), 1, most)
            return F.transform(keys, lambda k: F.get(F.filter(all_named, lambda c: c["key"] == k), F.lit(0))["name"])

        return held(named, of)

    def enough(names: Column, rest: Column) -> Column:
        """`names` if there are `most`, else `rest`, which is worked out only then."""
        return held(names, lambda h: F.when(F.size(h) >= most, h).otherwise(rest))

    def of_text(t: Column) -> Column:
        head = F.left(t, F.lit(HEAD))
        of_korean = enough(
            firsts(held(korean(but_last(cut(head))), lambda w: _neighbours(w, 3))),
            firsts(held(korean(cut(t)), lambda w: F.concat(_neighbours(w, 3), w))),
        )
        of_english = enough(
            firsts(but_last(found(head, PHRASE))),
            enough(
                firsts(F.concat(found(t, PHRASE), held(english(but_last(cut(head))), lambda w: _neighbours(w, 4)))),
                firsts(held(english(cut(t)), lambda w: F.concat(found(t, PHRASE), _neighbours(w, 4), w))),
            ),
        )
        return F.when(t.rlike(HANGUL), of_korean).otherwise(of_english)

    return F.coalesce(held(F.coalesce(text, F.lit("")), of_text), F.array().cast("array<string>"))
