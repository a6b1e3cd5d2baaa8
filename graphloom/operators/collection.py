"""Garbage collection of ephemeral snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared_storage import drop_shared, write_shared

EPHEMERAL = ["anonymous", "working_tree"]
KEEP_EPHEMERAL, KEEP_DAYS = 5, 30


def victims(snapshots: DataFrame, now: int, keep: int = KEEP_EPHEMERAL, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Ids, ascending, of ephemeral snapshots that are too old and outside the newest ``keep``.

    The newest are found by a limit, not by a rank over all snapshots.
    """
    ephemeral = snapshots.where(F.col("kind").isin(EPHEMERAL))
    newest = ephemeral.orderBy(F.desc("created_at"), F.desc("id")).limit(keep).select("id")
    old = ephemeral.where(F.col("created_at") < now - keep_days * 86400)
    return old.join(newest, "id", "left_anti").select("id").orderBy("id")


def survivors(snapshots: DataFrame, gone: DataFrame) -> DataFrame:
    """Remaining snapshots; a parent that goes is replaced by its nearest remaining ancestor, null if there is none.

    The way up from each snapshot that goes is doubled in every round, so rounds grow with the logarithm
    of the longest chain; what has not left those that go by then is a cycle and has no ancestor.
    """
    spark = snapshots.sparkSession
    up, path = write_shared(snapshots.join(gone.select("id"), "id", "left_semi").select(F.col("id").alias("_p"), F.col("parent_id").alias("_up")), "ancestors")
    total, rounds = up.count(), 0
    while 1 << rounds <= 2 * total and not up.join(up.select(F.col("_p").alias("_up")), "_up", "left_semi").isEmpty():
        further = up.select(F.col("_p").alias("_up"), F.col("_up").alias("_next"), F.lit(True).alias("_hit"))
        new, new_path = write_shared(up.join(further, "_up", "left").select("_p", F.when(F.col("_hit"), F.col("_next")).otherwise(F.col("_up")).alias("_up")), "ancestors")
        drop_shared(spark, path)
        up, path, rounds = new, new_path, rounds + 1
    left = snapshots.join(gone.select("id"), "id", "left_anti")
    ends = up.join(gone.select(F.col("id").alias("_up"), F.lit(True).alias("_cycle")), "_up", "left").select("_p", F.when(F.col("_cycle").isNull(), F.col("_up")).alias("_up"), F.lit(True).alias("_lost"))
    moved = left.join(ends, left["parent_id"] == ends["_p"], "left")
    return moved.withColumn("parent_id", F.when(F.col("_lost"), F.col("_up")).otherwise(F.col("parent_id"))).select(*snapshots.columns)


def surviving_versions(versions: DataFrame, gone: DataFrame) -> DataFrame:
    """Versions that neither begin nor end at a snapshot that goes."""
    ids = gone.select("id")
    kept = versions.join(ids, versions["visible_from"] == ids["id"], "left_anti")
    return kept.join(ids, kept["visible_until"] == ids["id"], "left_anti")


def report(snapshots: DataFrame, versions: DataFrame, gone: DataFrame) -> DataFrame:
    """One row: how many snapshots and versions go."""
    freed = snapshots.join(gone, "id", "left_semi").agg(F.count("*").alias("freed_snapshots"))
    kept = surviving_versions(versions, gone).agg(F.count("*").alias("kept"))
    total = versions.agg(F.count("*").alias("total"))
    return freed.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(kept)).select("freed_snapshots", (F.col("total") - F.col("kept")).alias("freed_versions"))  # one row each


def freed_by_snapshot(versions: DataFrame, gone: DataFrame) -> DataFrame:
    """(snapshot_id, begins, ends): how many versions begin and end at each snapshot that goes, zeros included.

    Versions are counted per point before they meet the snapshots, so what moves is a row per point.
    """
    ids = gone.select(F.col("id").alias("snapshot_id")).distinct()
    points = versions.select(F.col("visible_from").alias("at"), F.lit(1).cast("long").alias("begins"), F.lit(0).cast("long").alias("ends"))
    points = points.unionAll(versions.where(F.col("visible_until").isNotNull()).select("visible_until", F.lit(0).cast("long"), F.lit(1).cast("long")))
    counts = points.groupBy("at").agg(F.sum("begins").alias("begins"), F.sum("ends").alias("ends"))
    return ids.join(counts, F.col("snapshot_id") == F.col("at"), "left").na.fill(0, ["begins", "ends"]).select("snapshot_id", "begins", "ends")


def newest_rank(snapshots: DataFrame) -> DataFrame:
    """Rank of each snapshot within its kind, the newest first."""
    order = Window.partitionBy("kind").orderBy(F.desc("created_at"), F.desc("id"))
    return snapshots.withColumn("recency", F.row_number().over(order))
