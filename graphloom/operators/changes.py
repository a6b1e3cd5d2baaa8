"""Writes as set operations: upserts, version openings and closings, and change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.visibility import open_rows


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with the rows of these keys replaced by ``rows`` and new ones added."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows.select(*table.columns))


def new_versions(candidates: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates of which no open version has the same keys."""
    return candidates.join(open_rows(versions).select(*keys), keys, "left_anti")


def close_versions(versions: DataFrame, changed: DataFrame, keys: list[str], snapshot: int) -> DataFrame:
    """``versions`` with the open rows of the changed keys closed at ``snapshot``."""
    marked = versions.join(changed.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    end = F.when(F.col("visible_until").isNull() & F.coalesce("_hit", F.lit(False)), F.lit(snapshot).cast("long")).otherwise(F.col("visible_until"))
    return marked.withColumn("visible_until", end).select(*versions.columns)


def difference(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose keys are not in ``gone``; nulls in ``gone`` take nothing away."""
    return rows.join(gone.select(*keys), keys, "left_anti")


def last_values(written: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """(key, value): of all that was set under each key the last; ties go to the larger value."""
    return written.groupBy(key).agg(F.max(F.struct(at, value)).alias("_v")).select(key, F.col(f"_v.{value}").alias(value))


def detect(walked: DataFrame, known: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): Added, Deleted, Modified or Unchanged, by a full join of both sides on the key."""
    a, b = walked.select(key, F.col(content).alias("_new")), known.select(key, F.col(content).alias("_old"))
    there = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full_outer")
    change = F.when(F.col("_b").isNull(), "Added").when(F.col("_a").isNull(), "Deleted").when(F.col("_new").eqNullSafe(F.col("_old")), "Unchanged").otherwise("Modified")
    return there.select(key, change.alias("change"))


def overlay_nodes(base: DataFrame, changed_files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Base nodes outside the changed files, and the nodes parsed from them."""
    return base.join(changed_files.select("file_path").distinct(), "file_path", "left_anti").select(*parsed.columns).unionByName(parsed)


def overlay_edges(base_edges: DataFrame, base_nodes: DataFrame, changed_files: DataFrame, new_edges: DataFrame) -> DataFrame:
    """Base edges that do not start in a changed file, and new ones. Edges from nodes unknown to the base stay."""
    hidden = base_nodes.join(changed_files.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("src"))
    return base_edges.join(hidden, "src", "left_anti").select("src", "dst").unionByName(new_edges.select("src", "dst"))
