"""Hashed terms of texts for the linear models: term ids of a whole chunk, with the text that each belongs to."""

from __future__ import annotations

import numpy as np

from . import hashing

#: Words, and runs of marks between them, with case: what tells prose from junk.
_KINDS = np.where(hashing.ALNUM, 1, np.where(hashing.NON_SPACE, 2, 0)).astype(np.uint8)


def word_and_mark_terms(data: np.ndarray, offsets: np.ndarray, n_max: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Term ids below 2**bits and texts' indices, for all 1- to n_max-grams of words and runs of marks."""
    kinds = _KINDS[data]
    starts, ends = [], []
    for kind in (1, 2):
        s, e = hashing.spans(kinds == kind, offsets)
        starts.append(s)
        ends.append(e)
    s, e = np.concatenate(starts), np.concatenate(ends)
    order = np.argsort(s, kind="stable")
    s, e = s[order], e[order]
    h = hashing.span_hashes(hashing.prefix_sums(data), s, e)
    text = hashing.text_of(s, offsets)
    ids, texts = _grams(h, text, n_max, bits)
    again = text[1:][(h[1:] == h[:-1]) & (text[1:] == text[:-1])]  # the 2-gram "a word and itself" is one term
    return np.concatenate([ids, np.full(len(again), (1 << bits) - 1)]), np.concatenate([texts, again])


def lower_word_terms(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words, and for longer words their first bytes, as many as each of `prefixes` says."""
    data = hashing.LOWER[data]
    s, e = hashing.spans(hashing.ALNUM[data], offsets)
    sums, text = hashing.prefix_sums(data), hashing.text_of(s, offsets)
    ids, texts = [hashing.span_hashes(sums, s, e)], [text]
    for n in prefixes:
        longer = e - s > n
        ids.append(hashing.mix(hashing.span_hashes(sums, s[longer], s[longer] + n) + np.uint64(n)))
        texts.append(text[longer])
    return (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(texts)


def _grams(h: np.ndarray, text: np.ndarray, n_max: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    ids, texts = [h], [text]
    for n in range(2, n_max + 1):
        if len(h) >= n:
            same = text[: len(h) - n + 1] == text[n - 1 :]
            ids.append(hashing.ngrams(h, n)[same])
            texts.append(text[: len(h) - n + 1][same])
    return (np.concatenate(ids) >> np.uint64(64 - bits)).astype(np.int64), np.concatenate(texts)
