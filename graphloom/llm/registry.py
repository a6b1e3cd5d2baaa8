"""Queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["minhash", "quality", "context_mixing", "mixing", "token_files", "licenses", "byte_bpe", "ball_tree", "warc", "ngram_join", "exact_dedup", "filter_audit", "whitening"]

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _name in MODULES:
    _module = import_module(f"graphloom.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= getattr(_module, "ORACLE_SQL", {})
