"""Hashes of words and n-grams, taken over whole byte buffers at once.

A word's hash is a polynomial of its bytes modulo 2**64, read from one running sum over the buffer, and then
mixed. Equal words have equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
_M64 = (1 << 64) - 1
INVERSE = pow(BASE, -1, 1 << 64)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2**64; grown by doubling and kept."""
    p = _powers.get(base)
    if p is None:
        p = np.ones(1, np.uint64)
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
    if len(p) <= 1 << 22:
        _powers[base] = p
    return p[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over all 64 (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def byte_class(words: str) -> np.ndarray:
    """256 flags; `words` holds the characters below 0x80 that belong to words, all bytes from 0x80 on do."""
    flags = np.zeros(256, bool)
    flags[[ord(c) for c in words]] = True
    flags[128:] = True
    return flags


def lower_table() -> np.ndarray:
    """Lower-cases A-Z only."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


#: Words are runs of what is neither space nor 0x09-0x0D.
NON_SPACE = np.array([b not in (32, 9, 10, 11, 12, 13) for b in range(256)])
#: Words are runs of 0-9, a-z, A-Z and all bytes from 0x80 on.
ALNUM = byte_class("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = lower_table()


def prefix_sums(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """n + 1 running sums of (byte + 1) * base ** position."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of set flags; runs end at the texts' borders."""
    n = len(flags)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], flags[:-1]])
    after = np.concatenate([flags[1:], [False]])
    return np.flatnonzero(flags & (~before | edge[:-1])), np.flatnonzero(flags & (~after | edge[1:])) + 1


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASE) -> np.ndarray:
    """Mixed hashes of data[start:end] from the buffer's running sums."""
    inverse = powers(pow(base, -1, 1 << 64), len(sums))
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def text_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The index of the text that each position stands in."""
    return np.searchsorted(offsets, starts, "right") - 1


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n consecutive word hashes, in order; the caller drops runs over texts' borders."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1]
    for k in range(1, n):
        out = mix(out * np.uint64(BASE) + h[k : len(h) - n + 1 + k])
    return out
