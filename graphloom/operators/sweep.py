"""Counts over intervals by a sweep: what is visible at each snapshot, without forming (snapshot, row) pairs.

An interval adds at its start and takes away at its end. Changes are summed per point first, and a running
sum over the points gives what is visible from each on. Work grows with rows and points, not with the
length of intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared_storage import write_shared


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``_range``, the number of the range of (by, order) that they lie in; written."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return write_shared(rows.repartitionByRange(parts, *by, *order).withColumn("_range", F.spark_partition_id()), "sweep-ranges")[0]


def _beside(rows: DataFrame, by: list[str], table: DataFrame) -> DataFrame:
    """``rows`` left joined to a table (_at, _k0, _k1 ..., columns) of at most a row per range."""
    met = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        met = met & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(F.broadcast(table), met, "left")


def running_sums(dealt: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """``dealt`` (of ``ranged``) with ``values`` replaced by their running sums within ``by`` in this order, ends included.

    One key, or no key at all, spreads over ranges: sums run within a range, and what a key has in the
    ranges before is added. Only a range's first key can have begun before, so the table of additions has
    no more rows than there are ranges. Rows should be distinct in (by, order); nulls in them are values
    of their own, and null values count as 0.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range", *(F.col(c).alias(k) for c, k in zip(by, keys))).agg(*(F.coalesce(F.sum(v), F.lit(0)).alias(f"_t_{v}") for v in values))
    carried = totals.select(F.col("_range").alias("_at"), *keys, *(F.sum(f"_t_{v}").over(earlier).alias(f"_c_{v}") for v in values)).where(F.col(f"_c_{values[0]}").isNotNull())
    within = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = dealt.withColumns({v: F.coalesce(F.sum(v).over(within), F.lit(0)) for v in values})
    return _beside(sums, by, carried).withColumns({v: F.col(v) + F.coalesce(f"_c_{v}", F.lit(0)) for v in values}).select(*dealt.columns)


def followed(dealt: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """``dealt`` (of ``ranged`` by this column) with the column's next value of the same key; null at a key's end."""
    first = dealt.groupBy("_range").agg(F.min(F.struct(*by, column)).alias("_first"))  # a row per range
    after = Window.orderBy("_range")
    border = first.select(F.col("_range").alias("_at"), F.lead("_first").over(after).alias("_next"))
    border = border.select("_at", *(F.col(f"_next.{c}").alias(f"_k{i}") for i, c in enumerate(by)), F.col(f"_next.{column}").alias("_after"))
    inside = F.lead(column).over(Window.partitionBy("_range", *by).orderBy(column))
    return _beside(dealt.withColumn("_inside", inside), by, border).select(*dealt.columns, F.coalesce("_inside", "_after").alias(name))


def _deltas(versions: DataFrame, by: list[str], measures: dict[str, Column]) -> DataFrame:
    """(by, at, live and measures): the sums of what begins less what ends at each point."""
    there = versions.where(F.col("visible_from").isNotNull() & (F.col("visible_until").isNull() | (F.col("visible_until") > F.col("visible_from"))))
    rows = there.select(*by, "visible_from", "visible_until", F.lit(1).cast("long").alias("live"), *(F.coalesce(m, F.lit(0)).cast("long").alias(n) for n, m in measures.items()))
    names = ["live", *measures]
    begins = rows.select(*by, F.col("visible_from").alias("at"), *names)
    ends = rows.where(F.col("visible_until").isNotNull()).select(*by, F.col("visible_until").alias("at"), *((-F.col(n)).alias(n) for n in names))
    return begins.unionAll(ends).groupBy(*by, "at").agg(*(F.sum(n).alias(n) for n in names))


def live_at(versions: DataFrame, snapshots: DataFrame, id_column: str = "id", **measures: Column) -> DataFrame:
    """(snapshot_id, live, measures): how many versions are visible at each snapshot, and the sums of these columns over them.

    A version is visible on [visible_from, visible_until), without end where that is null; one without
    start, or that ends before it starts, never is. Every snapshot has a row, with zeros where nothing is
    visible; repeated snapshots count once, null ones have no row; null measures count as 0.
    """
    names = ["live", *measures]
    zero = [F.lit(0).cast("long").alias(n) for n in names]
    asked = snapshots.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("at"), F.lit(1).alias("asked"), *zero).distinct()
    changes = _deltas(versions, [], measures).select(F.col("at").cast("long").alias("at"), F.lit(0).alias("asked"), *names)
    dealt = ranged(changes.unionAll(asked), [], ["at", "asked"])
    run = running_sums(dealt, [], ["at", "asked"], names)  # changes at a point come before the question
    return run.where("asked = 1").select(F.col("at").alias("snapshot_id"), *names)


def live_spans(versions: DataFrame, by: list[str], **measures: Column) -> DataFrame:
    """(by, since, until, live, measures) for each key and span of snapshots over which no sum changes; until is null at the end.

    Spans in which nothing is visible have no row. Nulls in ``by`` are values of their own. Otherwise as ``live_at``.
    """
    names = ["live", *measures]
    moved = _deltas(versions, by, measures).where(" OR ".join(f"{n} <> 0" for n in names))
    dealt = ranged(moved, by, ["at"])
    run = followed(running_sums(dealt, by, ["at"], names), by, "at", "until")
    return run.where("live <> 0").select(*by, F.col("at").alias("since"), "until", *names)
