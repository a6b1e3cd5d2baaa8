"""Callers, callees, search and reverse reachability over node and edge tables.

Nodes have (id, name, qualified_name, file_path, kind, byte_len ...), edges (src, dst). Edge tables are
bags: repeated edges give repeated neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import contains_any_case
from graphloom.operators import reach
from graphloom.operators.visibility import visible_at
from graphloom.schemas import EDGE_KINDS


def named(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.where(F.col("name") == name)


def search(nodes: DataFrame, needle: str) -> DataFrame:
    """Nodes whose name or qualified name holds the needle, whatever the case."""
    return nodes.where(contains_any_case(F.col("name"), needle) | contains_any_case(F.col("qualified_name"), needle))


def relations(nodes: DataFrame, calls: DataFrame, name: str, direction: str) -> DataFrame:
    """(match_id, related_id, related_name, related_file) for the nodes of a name and their callers or callees.

    A match without neighbours stays, with nulls; neighbours that are no nodes are left out; repeated
    edges give repeated rows. The few matches are found before edges are joined.
    """
    own, other = {"callers": ("dst", "src"), "callees": ("src", "dst")}[direction]
    matches = named(nodes, name).select(F.col("id").alias("match_id"))
    found = calls.join(matches, calls[own] == matches["match_id"]).select("match_id", F.col(other).alias("related_id"))
    known = nodes.select(F.col("id").alias("related_id"), F.col("name").alias("related_name"), F.col("file_path").alias("related_file"))
    return matches.join(found.join(known, "related_id"), "match_id", "left")


def trace(nodes: DataFrame, calls: DataFrame, name: str, direction: str = "both") -> DataFrame:
    """Relations in one or both directions; any other direction gives no rows."""
    kinds = {"callers": ["callers"], "callees": ["callees"], "both": ["callers", "callees"]}.get(direction, [])
    parts = [relations(nodes, calls, name, k).withColumn("direction", F.lit(k)) for k in kinds]
    out = parts[0] if parts else relations(nodes, calls, name, "callers").withColumn("direction", F.lit("")).limit(0)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def degrees(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, callers, callees): numbers of edges, repeated ones included."""
    ends = calls.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(calls.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    counts = ends.groupBy("id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees"))
    return nodes.select("id").join(counts, "id", "left").na.fill(0, ["callers", "callees"])


def _backwards(calls: DataFrame) -> DataFrame:
    return calls.select(F.col("dst").alias("at"), F.col("src").alias("to"))


def reverse_reach(calls: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth): every transitive caller of the ``start`` ids at its smallest depth, up to ``max_depth``.

    The start itself is never reported, in cycles either.
    """
    return reach.distances(_backwards(calls), start, max_depth)


def reverse_reach_of_each(calls: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(group, id, depth): the transitive callers of each group of ``starts`` (group, id), all groups in one walk."""
    return reach.reach(_backwards(calls), starts, max_depth).pairs()


def reverse_reach_totals(calls: DataFrame, starts: DataFrame, max_depth: int, *totals: Column) -> DataFrame:
    """(group, totals ...): ``totals`` over the (id, depth) of each group's transitive callers, in waves of groups."""
    return reach.summed(_backwards(calls), starts, max_depth, *totals)


def explained(nodes: DataFrame, calls: DataFrame, versions_changed: DataFrame, identity: str, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """What changed: (id, change) of symbols (both added and removed: modified), and the files that callers carry it to."""
    sides = versions_changed.groupBy(F.col(identity).alias("id")).agg(F.min("change").alias("a"), F.max("change").alias("b"))
    named = sides.select("id", F.when(F.col("a") != F.col("b"), "modified").otherwise(F.col("a")).alias("change"))
    return named, impact(nodes, calls, named.select("id"), max_depth)


def at_snapshot(versions: DataFrame, identities: DataFrame, edge_versions: DataFrame, snapshot: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, calls) visible at a snapshot: versions (identity, ...) with their identities (id, name ...), and the calls among edges."""
    nodes = visible_at(versions, snapshot).join(identities, F.col("identity") == F.col("id"))
    return nodes, visible_at(edge_versions, snapshot).where(F.col("kind") == EDGE_KINDS["Calls"]).select("src", "dst")


def impact(nodes: DataFrame, calls: DataFrame, start: DataFrame, max_depth: int) -> DataFrame:
    """(file_path, symbols, nearest, tests) of what a change to ``start`` can reach through callers."""
    reached = reverse_reach(calls, start, max_depth).join(nodes, "id")
    is_test = contains_any_case(F.col("name"), "test") | contains_any_case(F.col("file_path"), "test")
    return reached.groupBy("file_path").agg(F.count("*").alias("symbols"), F.min("depth").alias("nearest"), F.sum(is_test.cast("int")).alias("tests"))


def impact_of_each(nodes: DataFrame, calls: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(group, file_path, symbols, nearest, tests): as ``impact``, for each group of ``starts`` (group, id) in one walk."""
    reached = reverse_reach_of_each(calls, starts, max_depth).join(nodes, "id")
    is_test = contains_any_case(F.col("name"), "test") | contains_any_case(F.col("file_path"), "test")
    return reached.groupBy("group", "file_path").agg(F.count("*").alias("symbols"), F.min("depth").alias("nearest"), F.sum(is_test.cast("int")).alias("tests"))
