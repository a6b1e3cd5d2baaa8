"""Debounced flushes and events counted once, as state that survives restarts.

Both keep their state by key in the query's checkpoint, in a store on disk, so that neither the changed
paths of a root nor the events seen lately have to fit in a worker.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

DEBOUNCE_MS = 2000
#: How long an event stays known after it was first seen.
KNOWN_MS = 7 * 86_400_000


def stateful(spark: SparkSession) -> None:
    """Chooses the state store that keyed state and timers need; queries of this session started later use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Flush(StatefulProcessor):
    """Per root: the last content of every path changed so far, and a timer that each change puts off."""

    def __init__(self, quiet_ms: int):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.dirty = handle.getMapState("dirty", "path string", "at bigint, seq bigint, content string")
        self.state = handle.getValueState("state", "due bigint, flushes bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        for r in rows:
            path, new = (r["path"],), (r["at"], r["seq"], r["content"])
            old = self.dirty.getValue(path) if self.dirty.containsKey(path) else None
            if old is None or _place(old) <= _place(new):
                self.dirty.updateValue(path, new)
        due, flushes = self.state.get() if self.state.exists() else (None, 0)
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.handle.registerTimer(due)
        self.state.update((due, flushes))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, flushes = self.state.get()
        self.state.update((None, flushes + 1))
        for path, value in self.dirty.iterator():
            yield Row(root=key[0], flush=flushes + 1, path=path[0], content=value[2])

    def close(self) -> None:
        pass


def _place(value: tuple) -> tuple:
    """Order of changes, (at, seq), nulls first."""
    return tuple(x for part in value[:2] for x in (part is not None, part or 0))


def flushed(changes: DataFrame, quiet_ms: int = DEBOUNCE_MS) -> DataFrame:
    """Stream of (root, flush, path, content): a root's whole dirty set, once it has been quiet for ``quiet_ms``.

    changes: a stream of (root, path, at, seq, content); of a path the last by (at, seq) counts, null content
    is a deletion. A flush has every path that changed since the stream began, numbered from 1; no further
    change is needed for the last one, since quiet time is measured by the clock: the query runs a batch at
    every trigger, with or without changes, so give it a trigger by time. Other columns are ignored.
    """
    stateful(changes.sparkSession)
    rows = changes.select("root", "path", F.unix_micros("at").alias("at"), "seq", "content").where("path IS NOT NULL")
    return rows.groupBy("root").transformWithState(_Flush(quiet_ms), "root string, flush bigint, path string, content string", "append", "ProcessingTime")


class _Once(StatefulProcessor):
    """Per key: passes on its first row, and remembers the key for a while."""

    def __init__(self, columns: list[str], known_ms: int):
        self.columns, self.known_ms = columns, known_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "known boolean", self.known_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = next(rows)
        if self.seen.exists():
            return
        self.seen.update((True,))
        yield Row(**{c: first[c] for c in self.columns})

    def close(self) -> None:
        pass


def counted_once(events: DataFrame, keys: list[str], known_ms: int = KNOWN_MS) -> DataFrame:
    """``events``, a stream, with one row for each value of ``keys`` (such as batch and event): the first to come.

    A key is forgotten ``known_ms`` after it came, so state does not grow without end. Nulls are values.
    """
    stateful(events.sparkSession)
    schema: StructType = events.schema
    return events.groupBy(*keys).transformWithState(_Once(events.columns, known_ms), schema, "append", "ProcessingTime")
