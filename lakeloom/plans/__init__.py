"""The registered queries: operators applied to the derived views, with SQL twins."""

from __future__ import annotations

from importlib import import_module

MODULES = ("market_queries", "text_queries", "question_queries", "news_queries", "document_queries", "retrieval_queries", "stream_queries", "legacy_queries")


def all_queries() -> tuple[dict, dict]:
    """All queries of this package and their SQL, by name."""
    queries, oracles = {}, {}
    for name in MODULES:
        module = import_module(f"lakeloom.plans.{name}")
        queries |= module.QUERIES
        oracles |= module.ORACLES
    return queries, oracles
