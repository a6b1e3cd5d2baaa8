"""Walks from many starts against a plain breadth-first search."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, reach


def plain(edges, members, depth):
    out = defaultdict(list)
    for a, b in edges:
        if a is not None and b is not None:
            out[a].append(b)
    seen, ring = {m: 0 for m in members}, set(members)
    for d in range(1, depth + 1):
        ring = {b for a in ring for b in out[a] if b not in seen}
        seen |= {b: d for b in ring}
    return {i: d for i, d in seen.items() if d}


@pytest.mark.parametrize("hub", [1 << 16, 5])
def test_a_thousand_starts(spark, monkeypatch, hub):
    """Vertices with more edges than HUB_EDGES are split, with the same result."""
    monkeypatch.setattr(reach, "HUB_EDGES", hub)
    rng = random.Random(hub)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(420)] + [(7, i) for i in range(60)] + [(i, 7) for i in range(40)] + [(3, 3), (None, 4), (4, None), (900, 901)]
    edges += edges[:50]
    table = spark.createDataFrame(edges, "at long, to long")
    starts = [(f"g{i}", i % 320) for i in range(1000)] + [("both", 1), ("both", 2), ("both", 2), (None, 5), ("nobody", None), ("far", 900)]
    walked = reach.reach(table, spark.createDataFrame(starts, "group string, id long"), 4)
    got = defaultdict(dict)
    for r in walked.pairs().collect():
        assert r["id"] not in got[r["group"]]
        got[r["group"]][r["id"]] = r["depth"]
    members = defaultdict(set)
    for g, i in starts:
        if g is not None and i is not None:
            members[g].add(i)
    expected = {g: found for g, ids in members.items() if (found := plain(edges, ids, 4))}
    assert {g: v for g, v in got.items() if v} == expected
    walked.drop()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("reach_")]


def test_edges_are_not_shuffled_in_a_round(spark):
    edges = spark.createDataFrame([(i, (i * 7) % 50) for i in range(50)], "at long, to long")
    kept = reach._Edges(edges)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for edges of some size
    plan = kept.follow(spark.createDataFrame([(1, 0, 5)], "id long, block int, bits long"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    kept.drop()
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and "reach_" in line)
    join = max(i for i, line in enumerate(lines[:scan]) if "Join" in line)
    assert not any("Exchange" in line for line in lines[join:scan])


@pytest.mark.parametrize("rows", [1 << 27, 150])
def test_sums_in_waves(spark, monkeypatch, rows):
    """As the pairs summed up, in one wave or in many; a wave's tables are gone at the end, and the session is as before."""
    monkeypatch.setattr(reach, "WAVE_ROWS", rows)
    rng = random.Random(rows)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(500)] + [(3, 3), (None, 4), (4, None), (900, 901)]
    table = spark.createDataFrame(edges + edges[:50], "at long, to long")
    starts = [(f"g{i}", i % 320) for i in range(400)] + [("both", 1), ("both", 2), (None, 5), ("nobody", None), ("far", 900)]
    walked, levels = [], reach._levels
    monkeypatch.setattr(reach, "_levels", lambda *a, **k: walked.append(levels(*a, **k)) or walked[-1])
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    found = reach.summed(table, spark.createDataFrame(starts, "group string, id long"), 3, F.count("*").alias("n"), F.sum(F.col("id") * F.col("depth")).alias("s"))
    assert (len(walked) > 3) == (rows == 150) and spark.conf.get(name) == before
    members = defaultdict(set)
    for g, i in starts:
        if g is not None and i is not None:
            members[g].add(i)
    reached = {g: far for g, ids in members.items() if (far := plain(edges, ids, 3))}
    assert sorted(map(tuple, found.collect())) == sorted((g, len(far), sum(i * d for i, d in far.items())) for g, far in reached.items())
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("reach_")]
    path = spark._jvm.org.apache.hadoop.fs.Path(walked[0][1][0])
    assert not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_nothing_to_sum(spark):
    edges, one = spark.createDataFrame([(1, 2)], "at long, to long"), spark.createDataFrame([(1, 1)], "group long, id long")
    for e, starts, depth in ((edges, one.limit(0), 3), (edges.limit(0), one, 3), (edges, one, 0)):
        assert reach.summed(e, starts, depth, F.count("*").alias("n")).count() == 0


def test_nothing_to_walk(spark):
    edges = spark.createDataFrame([(1, 2)], "at long, to long")
    none = spark.createDataFrame([], "group long, id long")
    assert reach.reach(edges, none, 3).pairs().count() == 0
    assert reach.reach(edges.limit(0), spark.createDataFrame([(1, 1)], "group long, id long"), 3).pairs().count() == 0
    assert reach.distances(edges, none, 3).count() == 0 == reach.distances(edges, spark.createDataFrame([(1,)], "id long"), 0).count()


def test_impact_of_each_group(spark):
    nodes = spark.createDataFrame([(1, "a", "x.rs"), (2, "b", "y.rs"), (3, "test_b", "z.rs"), (4, "d", "x.rs")], "id long, name string, file_path string")
    calls = spark.createDataFrame([(2, 1), (3, 2), (4, 2), (1, 4)], "src long, dst long")
    found = graph.impact_of_each(nodes, calls, spark.createDataFrame([("p", 1), ("q", 2)], "group string, id long"), 2)
    assert sorted(map(tuple, found.collect())) == [("p", "x.rs", 1, 2, 0), ("p", "y.rs", 1, 1, 0), ("p", "z.rs", 1, 2, 1), ("q", "x.rs", 2, 1, 0), ("q", "z.rs", 1, 1, 1)]
    same = graph.impact(nodes, calls, spark.createDataFrame([(1,)], "id long"), 2)
    assert {tuple(r) for r in same.collect()} == {tuple(r)[1:] for r in found.where(F.col("group") == "p").collect()}
