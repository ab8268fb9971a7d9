"""The registered queries over the driver's tables, with their SQL equivalents."""

from __future__ import annotations

from . import corpus_queries, fragment_queries, ledger_queries, mention_queries, provenance_queries, queue_queries, store_queries, stream_queries, text_queries  # noqa: F401
from ._registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
