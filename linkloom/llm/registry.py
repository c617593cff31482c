"""Queries of the subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
MODULES = ("q_redirects", "q_toolcalls", "q_license", "q_warc", "q_packing", "q_ann", "q_simhash", "q_debruijn", "q_toxicity", "q_decontaminate",
           "q_merkle", "q_minhash", "q_whitening")


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all():
    for m in MODULES:
        importlib.import_module(f"linkloom.llm.{m}")
    import corpus_pipeline
    queries = QUERIES | {"pipeline": corpus_pipeline.run}
    return queries, ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
