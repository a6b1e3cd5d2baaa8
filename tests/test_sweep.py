"""Sweeps over intervals against counting each point."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import collection, sweep

VERSIONS = "file string, identity long, visible_from long, visible_until long, live string"


def versions(rng, n):
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.randrange(100), rng.randrange(1, 60), rng.choice([None, rng.randrange(1, 70)])) for _ in range(n)]
    return rows + [("c", 1, None, 5), ("c", 2, 9, 9), ("c", 3, 12, 4), ("d", None, 3, 8)]


def visible(row, s):
    return row[2] is not None and row[2] <= s and (row[3] is None or s < row[3])


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_live_counts(spark, parts):
    rng = random.Random(parts)
    rows = versions(rng, 300)
    table = spark.createDataFrame([(*r, "x") for r in rows], VERSIONS)
    asked = [0, 1, 5, 5, 30, 59, 60, 69, 70, 1000, None]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = sweep.live_at(table, spark.createDataFrame([(s,) for s in asked], "id long"), total=F.col("identity")).collect()
        spans = sweep.live_spans(table, ["file"], total=F.col("identity")).collect()
        empty = sweep.live_at(table.limit(0), spark.createDataFrame([(4,)], "id long")).collect()
        nothing = sweep.live_spans(table.limit(0), ["file"]).count() + sweep.live_at(table, spark.createDataFrame([], "id long")).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    expected = {s: [r for r in rows if visible(r, s)] for s in asked if s is not None}
    assert {(r["snapshot_id"], r["live"], r["total"]) for r in found} == {(s, len(v), sum(r[1] or 0 for r in v)) for s, v in expected.items()}
    assert len(found) == len(expected) and [tuple(r) for r in empty] == [(4, 0)] and not nothing
    by = {}
    for r in spans:
        for s in range(r["since"], r["until"] or 80):
            assert (r["file"], s) not in by
            by[r["file"], s] = (r["live"], r["total"])
    for name in {r[0] for r in rows}:
        for s in range(80):
            here = [r for r in rows if r[0] == name and visible(r, s)]
            assert by.get((name, s)) == ((len(here), sum(r[1] or 0 for r in here)) if here else None)
    following = {(r["file"], r["since"]): r for r in spans}
    for r in spans:  # no two neighbours are the same
        after = following.get((r["file"], r["until"]))
        assert after is None or (after["live"], after["total"]) != (r["live"], r["total"])


def test_long_intervals_make_no_more_rows(spark):
    """What is shuffled depends on how many intervals there are, not on how long they are."""
    snapshots = spark.range(2000).select("id")
    plans = []
    for length in (1, 1900):
        table = spark.range(50).select(F.lit("f").alias("file"), F.col("id").alias("identity"), F.col("id").alias("visible_from"), (F.col("id") + length).alias("visible_until"))
        live = sweep.live_at(table, snapshots)
        plans.append(live._jdf.queryExecution().executedPlan().toString())
        assert live.agg(F.sum("live")).first()[0] == 50 * length
    assert not any("Generate" in p or "NestedLoop" in p or "CartesianProduct" in p for p in plans)


def test_running_sums_of_one_key_over_many_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 4000, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 7)).alias("k"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        dealt = sweep.ranged(rows, ["k"], ["o"])
        got = {(r["k"], r["o"]): (r["v"], r["n"]) for r in sweep.followed(sweep.running_sums(dealt, ["k"], ["o"], ["v"]), ["k"], "o", "n").collect()}
        assert dealt.where("k = 'hot'").select("_range").distinct().count() > 8
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for key in {k for k, _ in got}:
        own = sorted(o for k, o in got if k == key)
        total = 0
        for o, after in zip(own, [*own[1:], None]):
            total += o % 5
            assert got[key, o] == (total, after)


def test_freed_by_snapshot(spark):
    table = spark.createDataFrame([("f", 1, 3, 5, ""), ("f", 2, 3, None, ""), ("f", 3, 5, 9, "")], VERSIONS)
    gone = spark.createDataFrame([(3,), (5,), (7,)], "id long")
    assert sorted(map(tuple, collection.freed_by_snapshot(table, gone).collect())) == [(3, 2, 0), (5, 1, 1), (7, 0, 0)]
