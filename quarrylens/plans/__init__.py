"""Queries over the tables, with the SQL that checks them."""

from __future__ import annotations

import importlib

MODULES = ("scoring_queries", "join_queries", "graph_queries", "window_queries", "text_queries", "more_queries", "code_queries", "record_queries", "contract_queries", "index_queries", "script_queries", "state_queries", "version_queries", "chunk_queries")


def load_all() -> None:
    """Import every module of queries, which registers them."""
    for name in MODULES:
        importlib.import_module(f"{__name__}.{name}")
