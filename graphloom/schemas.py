"""Schemas of all tables and the stored numbers of kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tables and their columns.
TABLES = {
    "meta": "key string, value string",
    "snapshot": "id bigint, uuid string, kind string, commit_sha string, label string, parent_id bigint, created_at bigint",
    "file_identity": "id string, path string, language string",
    "file_version": "id string, identity_id string, content_hash string, size_bytes bigint, visible_from bigint, visible_until bigint",
    "symbol_identity": "id string, file_identity_id string, qualified_name string, name string, kind int",
    "symbol_version": "id string, identity_id string, start_byte bigint, end_byte bigint, start_line int, end_line int, content_hash string, visible_from bigint, visible_until bigint",
    "edge_version": "from_symbol_identity string, to_symbol_identity string, kind int, confidence int, visible_from bigint, visible_until bigint",
    "telemetry_event": "id bigint, event_kind int, payload string, created_at bigint",
    "symbol_usefulness": "identity_id string, times_included bigint, times_accepted bigint, last_seen bigint, avg_score bigint",
    "context_pack": "id string, snapshot_id bigint, task string, token_budget int, estimated_tokens int, created_at bigint",
    "context_pack_item": "pack_id string, rank int, symbol_identity_id string, file_identity_id string, reason string, score int",
    "memory_fact": "id string, kind string, promotion string, body string, confidence int, provenance string, created_at bigint, updated_at bigint",
    "project": "uuid string, canonical_path string, display_name string, snapshot_source string, created_at bigint, last_attached_at bigint, last_indexed_at bigint, db_size_bytes bigint, status string",
}

# The stored numbers of symbol, edge and event kinds.
SYMBOL_KINDS = {"Function": 1, "Struct": 2, "Enum": 3, "TypeAlias": 4, "Trait": 5, "Impl": 6, "Module": 7, "Variable": 8, "Macro": 9, "Other": 99}
EDGE_KINDS = {"Calls": 1, "Imports": 2, "Contains": 3, "Implements": 4, "FileDepends": 5}
EVENT_KINDS = {"pack_built": 1, "symbol_included": 2, "symbol_accepted": 3, "tool_invoked": 4}
# The group of each kind of memory; a session is never stored.
MEMORY_GROUPS = {"constitution": "semantic", "preference": "semantic", "outcome": "episodic", "skill": "procedural", "session": "working"}
# File extensions of each language.
EXTENSIONS = {"rust": ["rs"], "typescript": ["ts", "tsx", "js", "jsx", "mjs", "cjs"]}
# Top-level folders that are never indexed.
IGNORED = [".git", "node_modules", "target", "dist", "build", ".cache", ".venv", "venv", "__pycache__"]


def _number(names: dict[str, int], column: Column, other: int) -> Column:
    out = F.when(F.lit(False), F.lit(0))
    for name, number in names.items():
        out = out.when(column == name, F.lit(number))
    return out.otherwise(F.lit(other))


def _name(names: dict[str, int], column: Column, other: str) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, number in names.items():
        out = out.when(column == number, F.lit(name))
    return out.otherwise(F.lit(other))


def symbol_kind_number(name: Column) -> Column:
    """Unknown kinds are Other."""
    return _number(SYMBOL_KINDS, name, SYMBOL_KINDS["Other"])


def symbol_kind_name(number: Column) -> Column:
    return _name(SYMBOL_KINDS, number, "Other")


def edge_kind_number(name: Column) -> Column:
    """Unknown kinds are Calls."""
    return _number(EDGE_KINDS, name, EDGE_KINDS["Calls"])


def edge_kind_name(number: Column) -> Column:
    return _name(EDGE_KINDS, number, "Calls")


def memory_group(kind: Column) -> Column:
    """semantic, episodic, procedural or working; null for an unknown kind."""
    return F.coalesce(*(F.when(kind == k, F.lit(group)) for k, group in MEMORY_GROUPS.items()))


def is_persistent(kind: Column) -> Column:
    return kind != "session"
