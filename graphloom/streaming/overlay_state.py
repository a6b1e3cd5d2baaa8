"""Working-tree changes as a stream: debounced batches and the latest content of every dirty path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.sources import tree

DEBOUNCE = "2 seconds"


def latest(changes: DataFrame) -> DataFrame:
    """Of every path its last change (at, seq); null content is a deletion. Combined before the shuffle."""
    return changes.groupBy("path").agg(F.max(F.struct("at", "seq", "content")).alias("v")).select("path", "v.at", "v.seq", "v.content")


def debounced(changes: DataFrame, gap: str = DEBOUNCE, late: str = "1 minute") -> DataFrame:
    """(root, started, changes, paths) per burst of changes; works on a stream (with a watermark) and on a table."""
    rows = changes.withWatermark("at", late) if changes.isStreaming else changes
    bursts = rows.groupBy("root", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("changes"), F.collect_set("path").alias("paths"))
    return bursts.select("root", F.col("w.start").alias("started"), "changes", F.array_sort("paths").alias("paths"))


def relevant(changes: DataFrame, root: str) -> DataFrame:
    """Changes of supported files below the root and outside ignored folders, their path relative to it."""
    below = changes.where(F.startswith("path", F.lit(root.rstrip("/") + "/")))
    rows = below.withColumn("path", tree.relative(F.col("path"), root))
    return rows.where(tree.language_of(F.col("path")).isNotNull() & ~tree.is_ignored(F.col("path")))


def maintain(changes: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a query that hands each batch's latest content per path to ``merge`` (batch, number).

    ``merge`` must take the same batch twice without harm; it gets the number for that.
    """
    return changes.writeStream.foreachBatch(lambda batch, number: merge(latest(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
