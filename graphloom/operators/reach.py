"""Reachability from many starts in one walk: a bitmap of start groups per vertex, OR-ed from round to round.

Groups are numbered, and 64 of them share a row (id, block, bits). A round sends each vertex's new bits
along its edges and combines what arrives at a vertex by OR, before and after the shuffle; bits that it had
before are taken off, and what is left is the next round's frontier. Edges are written once, bucketed by
the vertex that they are followed from, so a round shuffles bits and never edges. A vertex with very many
edges is split over buckets by its edges' other ends.

Where each group's reach is only summed up, ``summed`` walks in waves of blocks: what a wave wrote and
shuffled is gone before the next, so that the disk holds one wave's pairs and not all.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.statistics import ranked
from graphloom.sources.shared_storage import drop_shared, new_path, write_shared

#: Edges of a vertex that stay together in a bucket; most split vertices for which their table is broadcast.
HUB_EDGES, MAX_BROADCAST_HUBS = 1 << 16, 1 << 18
BITS = 64
#: Most rows (id, block) that the groups of a wave reach, about.
WAVE_ROWS = 1 << 27


class _Edges:
    """Edges (at, to) bucketed by (at, salt), in a table of the session that lives until ``drop``."""

    def __init__(self, edges: DataFrame):
        self.spark = edges.sparkSession
        self.name, self.path = f"reach_{uuid.uuid4().hex}", new_path(self.spark, "reach-edges")
        edges, edges_path = write_shared(edges, "reach-plain")  # derived once, for counting and for writing
        counts, self.hub_path = write_shared(edges.groupBy("at").count().where(F.col("count") > HUB_EDGES).select("at", F.ceil(F.col("count") / HUB_EDGES).cast("int").alias("salts")), "reach-hubs")
        few = counts.count() <= MAX_BROADCAST_HUBS
        self.hubs = F.broadcast(counts) if few else counts
        salted = edges.join(self.hubs, "at", "left").select("at", "to", F.coalesce(F.pmod(F.xxhash64("to"), F.col("salts")), F.lit(0)).cast("int").alias("salt"))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        salted.repartition(buckets, "at", "salt").write.bucketBy(buckets, "at", "salt").sortBy("at").option("path", self.path).saveAsTable(self.name)
        drop_shared(self.spark, edges_path)

    def follow(self, frontier: DataFrame) -> DataFrame:
        """(id, block, bits) of what the frontier (id, block, bits) reaches in one step, once for each vertex and block."""
        salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
        going = frontier.withColumnRenamed("id", "at").join(self.hubs, "at", "left").select("at", salts, "block", "bits")
        return self.spark.table(self.name).join(going, ["at", "salt"]).groupBy(F.col("to").alias("id"), "block").agg(F.bit_or("bits").alias("bits"))

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop_shared(self.spark, self.path, self.hub_path)


@dataclass
class Reached:
    """``levels`` (id, block, bits, depth): the groups that reach a vertex first at this depth, 0 for their own members; ``groups`` (group, block, bit)."""

    levels: DataFrame
    groups: DataFrame
    paths: list[str]

    def pairs(self) -> DataFrame:
        """(group, id, depth): every vertex that a group reaches, without the group's own, at its smallest depth."""
        return _each_bit(self.levels).join(self.groups, ["block", "bit"]).select("group", "id", "depth")

    def drop(self) -> None:
        drop_shared(self.groups.sparkSession, *self.paths)


def _each_bit(levels: DataFrame) -> DataFrame:
    """(id, depth, block, bit) of what is reached, without the groups' own members."""
    several = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit("bits", i) == 1)
    only = F.coalesce(F.bit_count(F.try_subtract("bits", F.lit(1).cast("long"))), F.lit(BITS - 1))  # the sign bit less one overflows
    bits = F.when(F.bit_count("bits") == 1, F.array(only)).otherwise(several)  # most rows of a sparse graph have one
    return levels.where("depth > 0").select("id", "depth", "block", F.explode(bits).alias("bit"))


def _edges(edges: DataFrame) -> _Edges:
    return _Edges(edges.select("at", "to").where("at IS NOT NULL AND to IS NOT NULL").distinct())


def _levels(kept: _Edges, first: DataFrame, max_depth: int, write_last: bool = True) -> tuple[DataFrame, list[str]]:
    """(id, block, bits, depth) and its tables; first: (id, block, bits), each id and block once. The level of ``max_depth`` is written if asked."""
    level, path = write_shared(first.withColumn("depth", F.lit(0)), "reach-level")
    levels, paths = level, [path]
    for depth in range(1, max_depth + 1):
        arrived = kept.follow(level.select("id", "block", "bits"))
        known = levels.groupBy("id", "block").agg(F.bit_or("bits").alias("old"))
        unknown = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long"))))
        new = arrived.join(known, ["id", "block"], "left").select("id", "block", unknown.alias("bits"), F.lit(depth).alias("depth")).where("bits <> 0")  # arrived lies by id and block already
        if depth == max_depth and not write_last:
            levels = levels.unionAll(new)
            break
        level, path = write_shared(new, "reach-level")
        paths.append(path)
        if level.isEmpty():
            break
        levels = levels.unionAll(level)
    return levels, paths


def _walk(edges: DataFrame, first: DataFrame, max_depth: int) -> tuple[DataFrame, list[str]]:
    kept = _edges(edges)
    levels, paths = _levels(kept, first, max_depth)
    kept.drop()
    return levels, paths


def _numbered(starts: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Seeds (id, block, bits), groups (group, block, bit) and the tables that they read."""
    members = starts.where("group IS NOT NULL AND id IS NOT NULL").select("group", "id").distinct()
    members, members_path = write_shared(members, "reach-starts")
    numbered = ranked(members.select("group").distinct(), "group").select("group", F.floor((F.col("rank") - 1) / BITS).cast("int").alias("block"), ((F.col("rank") - 1) % BITS).cast("int").alias("bit"))
    groups, groups_path = write_shared(numbered, "reach-groups")
    return members.join(groups, "group").groupBy("id", "block").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")), groups, [members_path, groups_path]


def reach(edges: DataFrame, starts: DataFrame, max_depth: int) -> Reached:
    """What each group of ``starts`` (group, id) reaches along ``edges`` (at, to), up to ``max_depth`` steps, all in one walk.

    Repeated edges and starts count once; nulls in them reach nothing. A start that no edge knows reaches
    nothing; cycles end, since bits are sent on once only. No starts give an empty result.
    """
    seeds, groups, own = _numbered(starts)
    levels, paths = _walk(edges, seeds, max_depth)
    return Reached(levels, groups, [*paths, *own])


@contextmanager
def _no_shuffle_left(spark: SparkSession):
    """Within it a query's shuffle files go when it ends, not when the driver next collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _waves(kept: _Edges, seeds: DataFrame, max_depth: int) -> int:
    """How many waves of blocks there are to be, by the walks that begin at each block's members, and by the vertices."""
    edges = kept.spark.table(kept.name).select("at", "to")
    vertices, blocks = edges.select("to").distinct().count(), seeds.agg(F.max("block")).first()[0] or 0
    if vertices * (blocks + 1) <= WAVE_ROWS:
        return 1
    walks, paths = write_shared(edges.groupBy("at").agg(F.count("*").cast("double").alias("n")), "reach-walks")
    paths = [paths]
    for _ in range(1, max_depth):
        further = walks.select(F.col("at").alias("to"), "n")
        walks, path = write_shared(edges.join(further, "to", "left").groupBy("at").agg(F.sum(F.coalesce("n", F.lit(0.0)) + 1).alias("n")), "reach-walks")
        paths.append(path)
    each = seeds.join(walks, F.col("id") == F.col("at")).groupBy("block").agg(F.sum("n").alias("n"))  # a member of more than one group of a block counts once
    total = each.agg(F.sum(F.least("n", F.lit(float(vertices))))).first()[0] or 0
    drop_shared(kept.spark, *paths)
    return max(1, -int(-total // WAVE_ROWS))


def summed(edges: DataFrame, starts: DataFrame, max_depth: int, *totals: Column) -> DataFrame:
    """(group, totals ...): ``totals`` over the (id, depth) that each group of ``starts`` (group, id) reaches, as ``reach`` finds them.

    Groups that reach nothing have no row. Blocks of groups are walked in as many waves as WAVE_ROWS asks for.
    """
    spark = edges.sparkSession
    with _no_shuffle_left(spark):
        seeds, groups, own = _numbered(starts)
        seeds, seeds_path = write_shared(seeds, "reach-seeds")
        kept = _edges(edges)
        waves = _waves(kept, seeds, max_depth)
        out = None
        for wave in range(waves):
            levels, paths = _levels(kept, seeds.where(F.col("block") % waves == wave), max_depth, write_last=False)
            found = _each_bit(levels).groupBy("block", "bit").agg(*totals).join(groups, ["block", "bit"]).drop("block", "bit")
            found, _ = write_shared(found.select("group", *(c for c in found.columns if c != "group")), "reach-totals")
            drop_shared(spark, *paths)
            out = found if out is None else out.unionAll(found)
        kept.drop()
        drop_shared(spark, seeds_path, *own)
    return out


def distances(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth) of what any of ``starts`` (id) reaches, without the starts themselves: one bit for all of them."""
    seeds = starts.where("id IS NOT NULL").select("id").distinct().select("id", F.lit(0).alias("block"), F.lit(1).cast("long").alias("bits"))
    return _walk(edges.select("at", "to"), seeds, max_depth)[0].where("depth > 0").select("id", "depth")
