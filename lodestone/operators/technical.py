"""The telling pieces of technical content in a text: requests, paths, addresses, names of files, obfuscated lookups.

Python's patterns give the place of each match, which Spark's functions do not; texts without anything to find never reach them.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What technical content looks like, without regard to case, in the order in which equal pieces count; points of folder names.
# Repeats of repeats are written as one repeat, which matches the same and does not run away on long lines of marks.
TECHNICAL = [
    r"CVE-\d{4}-\d{4,7}",
    r"(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s+(?![가-힣])[^\s]+",
    r"/[^\s'\"]*",
    r"\.\./?[^\s]*",
    r"https?://[^\s]+",
    r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"\b[a-zA-Z0-9]+\.[a-zA-Z]{2,4}\b",
    r"\?[a-zA-Z0-9_]+=\w*",
    r"\$\{.*?j.*?n.*?d.*?i.*?:[a-zA-Z]+://[^\s\}]+\}",
    r"(?:\$\{(?:[^{}]|\$\{[^{}]*\})*\}|[a-zA-Z0-9_\-])*j(?:[^a-zA-Z0-9]|\$\{[^{}]*\})*n(?:[^a-zA-Z0-9]|\$\{[^{}]*\})*d(?:[^a-zA-Z0-9]|\$\{[^{}]*\})*i(?:[^:]|\$\{[^{}]*\})*:[a-zA-Z]+://[^\s\}]+",
    r"\$\{(?:\$\{[^{}]*\}|[^{}])*j(?:\$\{[^{}]*\}|[^{}])*n(?:\$\{[^{}]*\}|[^{}])*d(?:\$\{[^{}]*\}|[^{}])*i(?:\$\{[^{}]*\}|[^{}])*:[^}]*",
    r"(?s)\$\{\s*\$\{.*?j.*?n.*?d.*?i.*?:.*?l.*?d.*?a.*?p.*?\}.*?://.*",
    r"(?<=/)[^/\s'\"?#]+(?=/|$)",
    r"/([^/\s]+)/([^/\s]+)/",
    r"\.[a-zA-Z0-9]+$",
]
FOLDER_POINTS = {
    100: "admin administrator upload uploads filemanager file-manager config configuration backup backups shell webshell install installation setup",
    50: "editor fckeditor ckeditor tinymce plugins plugin includes include temp tmp test testing debug",
    25: "assets js css images img templates themes api ajax",
}
#: Patterns of lookups: only a text with these strings can match them.
LOOKUP = {8: "${", 9: "://", 10: "${", 11: "${"}
_NEEDS = r"[./]|(?i)CVE-|\?|[$][{]|(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH)\s"


def points(piece: str) -> int:
    """How telling a piece is: by its best folder name, a long path, a script, a risky word."""
    low = piece.lower()
    folder = max((n for n, words in FOLDER_POINTS.items() if any(w in low for w in words.split())), default=0)
    return folder + 10 * (piece.startswith("/") and len(piece) > 20) + 20 * any(e in low for e in (".php", ".jsp", ".asp")) + 30 * any(w in low for w in ("upload", "admin", "config"))


def pieces(text: str, patterns: list[re.Pattern], most: int) -> str | None:
    """The `most` best pieces, one on a line: by points, then place, then length. Of equal pieces the one of the first pattern counts."""
    at: dict[str, int] = {}
    for k, pattern in enumerate(patterns):
        if LOOKUP.get(k, "") in text:
            for m in pattern.finditer(text):
                at.setdefault(m[0], m.start())
    ranked = sorted((-points(x), start, -len(x), x) for x, start in at.items() if x)
    return "\n".join(r[3] for r in ranked[:most]) or None


def _parts(most: int):
    def read(texts: pd.Series) -> pd.Series:
        patterns = [re.compile(p, re.IGNORECASE) for p in TECHNICAL]
        return texts.map(lambda t: pieces(t, patterns, most) if t else None)

    return read


def technical_parts(text: Column, most: int = 5) -> Column:
    """The most telling pieces of a text's technical content; null if there is none, or no text."""
    return F.when(text.rlike(_NEEDS), F.pandas_udf(_parts(most), "string")(text))
