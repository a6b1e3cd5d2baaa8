"""The truncating running mean in pieces, against the plain fold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import feedback

EVENTS = "identity_id string, seq long, score long, seen_at long"
STATE = "identity_id string, times_included long, last_seen long, avg_score long"


def plain(events, before=()):
    out = {i: (n, seen, mean, None) for i, n, seen, mean in before}
    for symbol, seq, score, seen in sorted(events, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or 0)):
        n, last, mean, last_seq = out.get(symbol, (0, None, 0, "none"))
        score = None if score is None else max(0, min(1000, score))
        mean = None if mean is None or score is None else (mean * n + score) // (n + 1)
        if last_seq == seq and last is not None and (seen is None or seen < last):
            seen = last
        out[symbol] = (n + 1, seen, mean, seq)
    return {i: r[:3] for i, r in out.items()}


def got(spark, events, before=None, parts=6):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        table = spark.createDataFrame(events, EVENTS).repartition(3)
        found = feedback.usefulness(table.withColumn("row", F.lit("x")), None if before is None else spark.createDataFrame(before, STATE)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    rows = {r["identity_id"]: (r["times_included"], r["last_seen"], r["avg_score"]) for r in found}
    assert len(rows) == len(found)
    return rows


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000, 5000])
def test_maps_compose(n):
    """A map of the whole run is that of its parts, one after another, and agrees with every starting mean."""
    rng = random.Random(n)
    scores = np.array([rng.choice([rng.randrange(1001), rng.randrange(400, 420)]) for _ in range(1500)])
    whole = feedback.advance(np.arange(1001), n, scores)
    cuts = [0, 1, 13, 800, 801, 1500]
    parts = [feedback.advance(np.arange(1001), n + a, scores[a:b]) for a, b in zip(cuts, cuts[1:])]
    assert (np.resize(feedback.compose(parts), 1001) == whole).all()
    for mean in (0, 5, 410, 1000):
        expected, count = mean, n
        for x in scores.tolist():
            expected, count = (expected * count + x) // (count + 1), count + 1
        assert whole[mean] == expected
    assert (np.diff(whole) >= 0).all()
    assert feedback.compose([np.array([3]), np.array([-1])]).tolist() == [-1] == feedback.compose([np.array([-1]), whole]).tolist()[:1]


@pytest.mark.parametrize("piece, fan, batch", [(50, 2, 70), (1 << 16, 256, 10_000), (7, 3, 1)])
def test_against_the_plain_fold(spark, monkeypatch, piece, fan, batch):
    monkeypatch.setattr(feedback, "PIECE", piece)
    monkeypatch.setattr(feedback, "FAN", fan)
    rng = random.Random(piece)
    size = 400 if batch == 1 else 4000
    events = [(rng.choice(["hot"] * 6 + ["a", "b", None, f"s{rng.randrange(60)}"]), rng.randrange(size), rng.randrange(1001), rng.choice([None, rng.randrange(99)])) for _ in range(size)]
    events += [("lost", i, None if i == 5 else 7, i) for i in range(9)] + [("beyond", 1, 5000, 1), ("beyond", 2, -7, 2), ("same", 4, 10, None)] + [("same", 4, 10, 3)] * 20 + [("no seq", None, 9, 1), ("no seq", None, 3, 2)]
    before = [("hot", 1700, 3, 512), ("a", 3, None, 999), ("only before", 4, 8, 77), (None, 1, 2, 40), ("lost before", 2, 1, None)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert got(spark, events) == plain(events)
        assert got(spark, events + [("lost before", 1, 3, 9)], before, parts=9) == plain(events + [("lost before", 1, 3, 9)], before)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_nothing_and_little(spark):
    assert got(spark, []) == {}
    assert got(spark, [], [("x", 5, 6, 7)]) == {"x": (5, 6, 7)}
    assert got(spark, [("x", 1, 3, 4)]) == {"x": (1, 4, 3)}


def test_a_symbol_with_half_of_all_events_spreads(spark):
    """Its events lie in many tasks, and go from one job to the next as packed pieces, not as rows."""
    table = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id"))).alias("identity_id"), F.col("id").alias("seq"), (F.col("id") % 1001).alias("score"), F.col("id").alias("seen_at"))
    sizes = []
    take = feedback.write_shared

    def spy(df, name, *more):
        out = take(df, name, *more)
        if name == "feedback-pieces":
            sizes.extend(out[0].where("identity_id = 'hot' AND scores IS NOT NULL").select("events").collect())
        return out

    feedback.write_shared = spy
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 16)
    try:
        rows = {r["identity_id"]: r for r in feedback.usefulness(table).where("identity_id = 'hot'").collect()}
    finally:
        feedback.write_shared = take
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(sizes) >= 6 and max(r["events"] for r in sizes) < 4000
    mean = 0
    for n, i in enumerate(range(0, 20_000, 2)):
        mean = (mean * n + i % 1001) // (n + 1)
    assert (rows["hot"]["times_included"], rows["hot"]["last_seen"], rows["hot"]["avg_score"]) == (10_000, 19_998, mean)
