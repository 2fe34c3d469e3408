"""Intent scores: validation, sharpening, fusion and multi-intent, as column arithmetic over (qna, plan, action)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Scores = tuple[Column, Column, Column]


def clamped(s: Scores) -> Scores:
    return tuple(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0)))) for x in s)  # type: ignore[return-value]


def validated(s: Scores) -> Scores:
    """Scores in [0, 1]; .33/.33/.34 if all are 0; scaled to sum to 1 if the sum is off by more than .01."""
    c = clamped(s)
    total = c[0] + c[1] + c[2]
    default = (0.33, 0.33, 0.34)
    return tuple(F.when(total <= 0, F.lit(d)).when(F.abs(total - 1) > 0.01, x / total).otherwise(x) for x, d in zip(c, default, strict=True))  # type: ignore[return-value]


def best(s: Scores) -> Column:
    """The greatest; ties go to qna, then plan."""
    q, p, a = s
    return F.when(q >= F.greatest(p, a), "qna").when(p >= a, "plan").otherwise("action")


def sharpened(s: Scores) -> Scores:
    """A lead of .4 or more with a top of .6 or more becomes .85 against .075 each."""
    ordered = F.reverse(F.array_sort(F.array(*s)))
    clear, top = (ordered[0] - ordered[1] >= 0.4) & (ordered[0] >= 0.6), best(s)
    return tuple(F.when(clear, F.when(top == n, 0.85).otherwise(0.075)).otherwise(x) for x, n in zip(s, ("qna", "plan", "action"), strict=True))  # type: ignore[return-value]


def multi(s: Scores, least: float = 0.30, gap: float = 0.3) -> Column:
    ordered = F.reverse(F.array_sort(F.array(*s)))
    return (ordered[1] >= least) & (F.round(ordered[0] - ordered[1], 12) <= gap)


def fused(model: Scores, rules: Scores, weights: tuple[float, float] = (0.4, 0.6)) -> Scores:
    """The model's scores where both agree on the best, else a weighted mean scaled to sum to 1."""
    agree = best(model) == best(rules)
    mixed = [m * weights[0] + r * weights[1] for m, r in zip(model, rules, strict=True)]
    total = mixed[0] + mixed[1] + mixed[2]
    return tuple(F.when(agree, m).otherwise(F.when(total > 0, x / total).otherwise(x)) for m, x in zip(model, mixed, strict=True))  # type: ignore[return-value]


def keyword_hits(text: Column, words: list[str]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w)))
