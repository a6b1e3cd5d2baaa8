"""Connected components of an undirected edge table, by alternating large-star and small-star rounds.

Every round is a minimum per vertex and an equi-join, written to the shared folder, so lineage stays
short and no vertex set or component passes through the driver. A vertex of very high degree costs a
partial minimum and a join that adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.shared_storage import drop_shared, write_shared


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (hi, lo) with lo < hi. Links neighbours to the smallest vertex of each neighbourhood."""
    if large:
        around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        around = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = joined.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionAll(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.where("hi <> lo").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every vertex of an edge; component is the smallest vertex reachable.

    Nulls and loops are ignored, repeated edges count once, an empty table gives an empty result.
    """
    spark = edges.sparkSession
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now, path = write_shared(now.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "cc")
    mark = None
    while True:
        new, new_path = write_shared(_star(_star(now, True), False), "cc")
        drop_shared(spark, path)
        now, path = new, new_path
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        mark = tuple(seen)
    members = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return members.unionAll(now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
