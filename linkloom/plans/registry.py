"""Registry of named queries: a Spark builder and, where SQL can express it,
the equivalent DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all():
    # importing the modules fills the registry
    from linkloom.plans import (  # noqa: F401
        q_entries, q_text, q_html, q_boilerplate, q_keywords, q_vectors, q_cluster, q_pipeline, q_streaming)
    return QUERIES, ORACLES
