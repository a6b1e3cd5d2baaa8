"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared_storage import write_shared

WIDTH = 4096


def disc_quantile(rows: DataFrame, key: str, value: str, num: int, den: int, width: int = WIDTH) -> DataFrame:
    """(key, value): of each key's n integer values in ascending order the one at 0-based place ``n * num div den``.

    Counts per range of ``width`` values are summed first; only the range that holds the place is looked
    at value by value, so a key with most of the rows is no larger task than another.
    """
    bucket = F.floor(F.col(value) / width)
    known = rows.where(F.col(value).isNotNull())
    spread = known.groupBy(key, bucket.alias("_b")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(key))
    place = F.least(F.call_function("div", total * num, F.lit(den)), total - 1)
    target = spread.withColumn("_before", before).withColumn("_place", place).where("_place >= _before AND _place < _before + _n").select(F.col(key).alias("_k"), F.col("_b").alias("_t"), "_before", "_place")
    inside = known.withColumn("_b", bucket).join(target, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_t")))
    counts = inside.groupBy(key, "_before", "_place", F.col(value).alias("value")).agg(F.count("*").alias("_n"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(key).orderBy("value"))
    return counts.withColumn("_upto", upto).where("_upto > _place AND _upto - _n <= _place").select(key, "value")


def latest_version(projects: DataFrame, migrations: DataFrame, key: str) -> DataFrame:
    """(key, version): the largest version of each project, 0 where it has none."""
    newest = migrations.groupBy(key).agg(F.max("version").alias("version"))
    return projects.select(key).join(newest, key, "left").na.fill(0, ["version"])


def ranked(rows: DataFrame, *order) -> DataFrame:
    """``rows`` with ``rank`` from 1 on, for all rows: ranges of the order are ranked alone and moved by an offset."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt, _ = write_shared(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").count().orderBy("_range").collect()  # a row per range
    offsets, total = [], 0
    for r in sizes:
        offsets.append((r["_range"], total))
        total += r["count"]
    offset = rows.sparkSession.createDataFrame(offsets, "_range int, _offset long")
    within = Window.partitionBy("_range").orderBy(*order)
    return dealt.join(F.broadcast(offset), "_range").withColumn("rank", F.row_number().over(within) + F.col("_offset")).drop("_range", "_offset")
