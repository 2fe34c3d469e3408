"""Every query of the library by name, with its DuckDB twin where SQL can express it."""

from __future__ import annotations

from . import catalog, conversations, evaluation, files, graphs, intents, knowledge, korean, lookups, parsing, pii, retrieval, rewrites, rules, snapshots, streams, texts, whole_texts  # noqa: F401
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
