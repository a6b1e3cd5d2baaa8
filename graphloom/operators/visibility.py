"""Snapshot visibility: a row is visible at S when visible_from <= S < visible_until, or it is still open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(snapshot: int | Column, start: str = "visible_from", end: str = "visible_until") -> Column:
    return (F.col(start) <= snapshot) & (F.col(end).isNull() | (F.col(end) > snapshot))


def visible_at(versions: DataFrame, snapshot: int) -> DataFrame:
    """Plain column predicates, so they reach the Parquet scan."""
    return versions.where(visible(snapshot))


def open_rows(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("visible_until").isNull())


def live_versions(versions: DataFrame, snapshots: DataFrame, id_column: str = "id") -> DataFrame:
    """Every (snapshot, version) pair that is visible: a range join on the interval.

    Snapshots are joined by year-like buckets of ``BUCKET`` ids, so the join is an equi-join that can
    spread over tasks and not a nested loop; an open interval ends after the last snapshot.
    """
    last = snapshots.agg(F.max(id_column).alias("last"))
    spans = versions.crossJoin(F.broadcast(last)).withColumn("_end", F.least(F.coalesce(F.col("visible_until") - 1, F.col("last")), F.col("last"))).where("visible_from <= _end")
    bucket = lambda c: F.floor(c / BUCKET)
    dealt = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("visible_from")), bucket(F.col("_end")))))
    at = snapshots.select(F.col(id_column).alias("snapshot_id"), bucket(F.col(id_column)).alias("_bucket"))
    return dealt.join(at, "_bucket").where(F.col("snapshot_id").between(F.col("visible_from"), F.col("_end"))).drop("_bucket", "_end", "last")


BUCKET = 12


def interval_ends(starts: DataFrame, key: str, start: str = "visible_from") -> DataFrame:
    """``visible_until`` of each version: the start of the key's next version; null for the last."""
    return starts.withColumn("visible_until", F.lead(start).over(Window.partitionBy(key).orderBy(start)))


def latest_before(versions: DataFrame, key: str, snapshot: int, tie: str, start: str = "visible_from") -> DataFrame:
    """As-of pick: of each key the last version that starts at or before ``snapshot``; ties go to the largest ``tie``.

    A maximum per key, so it is combined before the shuffle.
    """
    rest = [c for c in versions.columns if c not in {key, start, tie}]
    best = versions.where(F.col(start) <= snapshot).groupBy(key).agg(F.max(F.struct(start, tie, *rest)).alias("v"))
    return best.select(key, "v.*")


def snapshot_diff(versions: DataFrame, base: int, head: int, keys: list[str]) -> DataFrame:
    """(keys, change): what is visible at one of two snapshots only, by one pass over the versions."""
    seen = versions.where(visible(base) | visible(head)).groupBy(*keys).agg(F.max(visible(base).cast("int")).alias("b"), F.max(visible(head).cast("int")).alias("h"))
    return seen.where("b <> h").select(*keys, F.when(F.col("h") == 1, "added").otherwise("removed").alias("change"))
