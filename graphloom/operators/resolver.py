"""Resolving references by name: same file first, then a unique name, else ambiguous or not found.

symbols: (identity, file_id, qualified_name, name, ord); references: (file_id, from_qualified_name,
to_name, kind, ord). ``ord`` is the build order. All files are resolved at once; the file is a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.dedup import keep_first


def origins(symbols: DataFrame) -> DataFrame:
    """(file_id, from_qualified_name, from_identity): of symbols that share both, the last built."""
    last = symbols.groupBy("file_id", "qualified_name").agg(F.max_by("identity", "ord").alias("from_identity"))
    return last.withColumnRenamed("qualified_name", "from_qualified_name")


def resolve_targets(references: DataFrame, symbols: DataFrame) -> DataFrame:
    """``references`` with ``target`` and ``reason`` (SameFile, Unique, Ambiguous, NotFound).

    Candidates are counted per name and per (name, file) before the join, so a name with very many
    symbols stays one row. Rows of symbols are counted, not distinct names.
    """
    by_name = symbols.groupBy(F.col("name").alias("to_name")).agg(F.count("*").alias("_n"), F.min("identity").alias("_only"))
    by_file = symbols.groupBy(F.col("name").alias("to_name"), "file_id").agg(F.min_by("identity", "ord").alias("_local"))
    joined = references.join(by_name, "to_name", "left").join(by_file, ["to_name", "file_id"], "left")
    reason = F.when(F.col("_local").isNotNull(), "SameFile").when(F.col("_n") == 1, "Unique").when(F.col("_n") > 1, "Ambiguous").otherwise("NotFound")
    target = F.when(F.col("_local").isNotNull(), F.col("_local")).when(F.col("_n") == 1, F.col("_only"))
    return joined.withColumn("target", target).withColumn("reason", reason).drop("_n", "_only", "_local")


def resolve_edges(references: DataFrame, symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, unresolved): edges (src, dst, kind, ord) with the first of repeats kept; unresolved (src, to_name, kind, reason).

    References whose origin is no known symbol are passed over.
    """
    known = references.join(origins(symbols), ["file_id", "from_qualified_name"])
    resolved = resolve_targets(known, symbols)
    edges = resolved.where("target IS NOT NULL").select(F.col("from_identity").alias("src"), F.col("target").alias("dst"), "kind", "ord")
    unresolved = resolved.where("target IS NULL").select(F.col("from_identity").alias("src"), "to_name", "kind", "reason")
    return keep_first(edges, ["src", "dst", "kind"], ["ord"]), unresolved
