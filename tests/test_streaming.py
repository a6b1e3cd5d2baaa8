"""Flushes by quiet time, events counted once, and commits of a sink, over restarts."""

import time

import pytest
from pyspark.sql import functions as F

from graphloom.operators import feedback
from graphloom.streaming import committed, feedback_stream, flush

pytest.importorskip("google.protobuf")  # Spark's keyed state needs it
CHANGES = "root string, path string, at timestamp, seq long, content string"


def put(spark, folder, rows, schema, at=None):
    table = spark.createDataFrame(rows, schema)
    if at:
        table = table.withColumn(at, F.timestamp_seconds(at))
    table.coalesce(1).write.mode("append").parquet(folder)


def wait(what, seconds=40):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.3)
    assert what()


def test_last_burst_is_flushed_without_a_further_event(spark, tmp_path):
    raw = CHANGES.replace("timestamp", "long")
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"

    def run(rows, flushes):
        put(spark, folder, rows, raw, "at")
        stream = spark.readStream.schema(CHANGES).parquet(folder)
        query = flush.flushed(stream, 1500).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(processingTime="300 milliseconds").start()
        try:
            got = lambda: [tuple(r) for r in spark.read.schema("root string, flush long, path string, content string").parquet(out).collect()]
            wait(lambda: {(r[0], r[1]) for r in got()} >= flushes)
            return sorted(map(str, got()))
        finally:
            query.stop()

    first = run([("p", "a.rs", 1, 1, "old"), ("p", "a.rs", 2, 2, "new"), ("p", "b.rs", 3, 3, None), ("q", "c.rs", 1, 1, "x"), ("p", "a.rs", 1, 3, "late")], {("p", 1), ("q", 1)})
    assert first == sorted(map(str, [("p", 1, "a.rs", "new"), ("p", 1, "b.rs", None), ("q", 1, "c.rs", "x")]))
    second = run([("p", "d.rs", 9, 9, "y")], {("p", 2)})  # another query, from the checkpoint
    assert sorted(set(second) - set(first)) == sorted(map(str, [("p", 2, "a.rs", "new"), ("p", 2, "b.rs", None), ("p", 2, "d.rs", "y")]))


def test_events_count_once(spark, tmp_path):
    schema = "batch long, event long, identity_id string, score long"
    folder = f"{tmp_path}/in"
    rows = [(1, 1, "x", 500), (1, 2, "x", None), (1, 1, "x", 500), (2, 1, "y", 7), (None, 1, "z", 1), (None, 1, "z", 1)]

    got = lambda: sorted(map(str, map(tuple, committed.read_committed(spark, f"{tmp_path}/out", schema).collect())))

    def run(expected):
        stream = flush.counted_once(spark.readStream.schema(schema).parquet(folder), ["batch", "event"])
        query = committed.write_committed(stream, f"{tmp_path}/out", f"{tmp_path}/check").trigger(processingTime="300 milliseconds").start()
        try:
            wait(lambda: len(got()) >= len(expected))
            assert got() == sorted(map(str, expected))
        finally:
            query.stop()

    put(spark, folder, rows, schema)
    expected = [(1, 1, "x", 500), (1, 2, "x", None), (2, 1, "y", 7), (None, 1, "z", 1)]
    run(expected)
    put(spark, folder, [*rows, (3, 1, "x", 9)], schema)  # a sender that was killed sends its batch again
    run([*expected, (3, 1, "x", 9)])


def test_a_batch_that_runs_again_is_committed_once(spark, tmp_path):
    """The query dies after the sink's commit and before its own; files of tasks that never committed do not count."""
    folder, out, check = f"{tmp_path}/in", f"{tmp_path}/out", tmp_path / "check"
    put(spark, folder, [(i,) for i in range(10)], "n long")
    assert committed.read_committed(spark, out, "n long").count() == 0

    def run():
        committed.write_committed(spark.readStream.schema("n long").parquet(folder), out, str(check)).trigger(availableNow=True).start().awaitTermination(60)
        return sorted(r["n"] for r in committed.read_committed(spark, out, "n long").collect())

    assert run() == list(range(10))
    (check / "commits" / "0").unlink()
    (check / "commits" / ".0.crc").unlink(missing_ok=True)
    assert run() == list(range(10))  # batch 0 ran again
    put(spark, folder, [(77,)], "n long")
    assert run() == [*range(10), 77]
    spark.createDataFrame([(5,)], "n long").coalesce(1).write.mode("append").parquet(f"{out}/data")
    assert len(committed.read_committed(spark, out, "n long").collect()) == 11
    writer = committed.CommittedWriter(out)
    writer.abort([None, committed.Written(None)], 9)


def test_null_scores_in_a_stream(spark, tmp_path):
    schema = "identity_id string, seq long, score long, seen_at long"
    events = [("x", 1, 900, 1), ("x", 2, None, 2), ("x", 3, 10, None), ("y", 4, 5000, 3), ("y", 5, -3, 4), (None, 6, 8, 6)]
    put(spark, f"{tmp_path}/in", events, schema)
    query = feedback_stream.running_usefulness(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("update").format("memory").queryName("null_scores").start()
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.sql("SELECT identity_id, times_included, last_seen, avg_score FROM null_scores").collect()}
    assert got == {tuple(r) for r in feedback.usefulness(spark.createDataFrame(events, schema)).collect()}
