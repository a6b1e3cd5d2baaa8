"""Usefulness of symbols from inclusion events: a count and a truncating running mean, folded in pieces.

The mean is updated in order, ``(mean * n + x) div (n + 1)``, and truncates at every step, so it is no sum.
But scores and means lie in 0..TOP, and a run of events that begins at a known count is a map of the mean
before to the mean after: TOP + 1 numbers, never falling. Such maps compose. So a symbol's events are dealt
over tasks by ranges of their order: a run that begins in a task is folded there; one that may have begun
before is packed (two bytes an event), gets its starting count from the pieces before it, and becomes a
map, any number of them at once. Maps of a symbol are composed in groups until one is left.

From count TOP on a step is simple: ``mean - 1`` where the score is below the mean, else ``mean``. A map then
changes at most TOP times, whatever the number of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared_storage import drop_shared, write_shared

#: Largest score; others stop at 0 and here.
TOP = 1000
#: Events of one packed piece, maps composed at once, events looked at together for the next one that changes a map.
PIECE, FAN, WINDOW = 1 << 16, 256, 1024
#: The mean of a symbol with a null score, from that event on.
LOST = -1


def advance(means: np.ndarray, n: int, scores: np.ndarray) -> np.ndarray:
    """Each of these means (never falling) after the scores, of which n came before. A null score is LOST, and so are all means after it."""
    if len(scores) and scores.min() < 0:
        return np.full(len(means), LOST, np.int64)
    at = 0
    while at < len(scores) and n < TOP:
        means = (means * n + scores[at]) // (n + 1)
        at, n = at + 1, n + 1
    while at < len(scores):
        below = scores[at : at + WINDOW] < means[-1]
        first = int(below.argmax())
        if not below[first]:
            at += WINDOW
            continue
        means = means - (means > scores[at + first])
        at += first + 1
    return means


def fold_runs(n: np.ndarray, means: np.ndarray, scores: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and means of many runs after their scores, scores[bounds[i]:bounds[i+1]] for run i; all runs step at once."""
    n, means = n.copy(), means.copy()
    at, ends = bounds[:-1].copy(), bounds[1:]
    active = np.flatnonzero((at < ends) & (n < TOP))
    while len(active):
        x = scores[at[active]]
        next_mean = (means[active] * n[active] + x) // (n[active] + 1)
        means[active] = np.where((x < 0) | (means[active] < 0), LOST, next_mean)
        n[active] += 1
        at[active] += 1
        active = active[(at[active] < ends[active]) & (n[active] < TOP)]
    for i in np.flatnonzero(at < ends):  # counts of TOP and more: few and long
        if means[i] >= 0:
            means[i] = advance(means[i : i + 1], int(n[i]), scores[at[i] : ends[i]])[0]
        n[i] += ends[i] - at[i]
    return n, means


# ---- a task's range of events


def _last(seqs: pa.Array, seens: pa.Array, lo: int, hi: int):
    """(seq, seen_at) of the last event of a sorted slice; of equal seqs the latest seen_at counts."""
    seq = seqs[hi - 1]
    first = hi - 1
    while first > lo and seqs[first - 1].equals(seq):
        first -= 1
    return seq.as_py(), pc.max(seens.slice(first, hi - first)).as_py()


class _Range:
    """Turns sorted rows of (symbol, known, seq, score, seen_at) into pieces.

    Rows come in batches. The first run is packed, since it may have begun in an earlier range, unless it
    opens with a known state; the others are folded. One run is open between batches.
    """

    NAMES = ["identity_id", "place", "events", "mean", "scores", "last_seq", "last_seen"]

    def __init__(self, part: int):
        self.part, self.made, self.opened = part, 0, False
        self.symbol, self.folded, self.n, self.mean, self.last = None, False, 0, 0, (None, None)
        self.packed: list[np.ndarray] = []
        self.out: list[tuple] = []

    def _emit(self, events: int, mean: int | None, scores: bytes | None) -> None:
        self.out.append((self.symbol, (self.part << 32) + self.made, events, mean, scores, *self.last))
        self.made += 1

    def close(self) -> None:
        """Ends the open run."""
        if self.folded:
            self._emit(self.n, self.mean, None)
        else:
            self._pack(0)

    def _pack(self, least: int) -> None:
        held = np.concatenate(self.packed) if self.packed else np.zeros(0, np.int16)
        while len(held) > least:
            self._emit(len(held[:PIECE]), None, held[:PIECE].tobytes())
            held = held[PIECE:]
        self.packed = [held]

    def _later(self, last: tuple) -> None:
        """Takes over the last event of a further part of the open run."""
        if self.last[0] == last[0] and self.last[1] is not None and (last[1] is None or last[1] < self.last[1]):
            return
        self.last = last

    def take(self, batch: pa.RecordBatch) -> None:
        symbols, known, seqs, scores, seens = (batch.column(i) for i in range(5))
        codes = pc.dictionary_encode(symbols, null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])
        values = scores.fill_null(LOST).to_numpy(zero_copy_only=False)
        state = known.is_valid().to_numpy(zero_copy_only=False)  # a state so far, first in its run
        counts = known.fill_null(0).to_numpy(zero_copy_only=False)
        first = 0
        if self.opened:
            same = symbols[0].as_py() == self.symbol
        else:
            same, self.opened, self.symbol = True, True, symbols[0].as_py()  # the range's first run
            self.folded = bool(state[0])
            self.n, self.mean = (int(counts[0]), int(values[0])) if self.folded else (0, 0)
            if self.folded:
                self._later((None, seens[0].as_py()))
        if same:
            lo, hi = int(cuts[0]), int(cuts[1])
            first = 1
            skip = int(state[lo])
            if hi > lo + skip:
                if self.folded:
                    n, mean = fold_runs(np.array([self.n]), np.array([self.mean]), values[lo + skip : hi], np.array([0, hi - lo - skip]))
                    self.n, self.mean = int(n[0]), int(mean[0])
                else:
                    self.packed.append(values[lo:hi].astype(np.int16))
                    self._pack(PIECE)
                self._later(_last(seqs, seens, lo + skip, hi))
        if first == len(cuts) - 1:
            return
        self.close()
        lo = cuts[first:-1]
        skip = state[lo]
        n = np.where(skip, counts[lo], 0).astype(np.int64)
        mean = np.where(skip, values[lo], 0).astype(np.int64)
        keep = np.ones(len(values), bool)
        keep[lo[skip]] = False
        keep[: lo[0]] = False
        total = np.concatenate([[0], np.cumsum(keep)])
        n, mean = fold_runs(n, mean, values[keep].astype(np.int64), np.append(total[lo], total[-1]))
        ends = cuts[first + 1 :]
        for i in range(len(lo)):
            self.symbol, self.folded, self.n, self.mean, self.packed = symbols[int(lo[i])].as_py(), True, int(n[i]), int(mean[i]), []
            begin = int(lo[i] + skip[i])
            self.last = _last(seqs, seens, begin, int(ends[i])) if begin < ends[i] else (None, seens[int(lo[i])].as_py())
            if i < len(lo) - 1:
                self.close()


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    held, schema = _Range(TaskContext.get().partitionId()), None

    def drain() -> pa.RecordBatch:
        columns = list(zip(*held.out))
        held.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.binary(), batch.schema.field(2).type, batch.schema.field(4).type]
        schema = pa.schema(list(zip(_Range.NAMES, kinds)))
        held.take(batch)
        if held.out:
            yield drain()
    if schema is not None:
        held.close()
        yield drain()


# ---- maps


def _as_table(ids: pa.Array, places: pa.Array, maps: list[np.ndarray]) -> dict:
    """Maps as bytes, with the value of those that are constant (null: lost)."""
    values = [int(m[0]) if len(m) == 1 and m[0] >= 0 else None for m in maps]
    return {"identity_id": ids, "place": places, "map": pa.array([m.astype(np.int16).tobytes() for m in maps], pa.binary()), "value": pa.array(values, pa.int64())}


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(identity_id, place, map, value) of pieces (identity_id, place, start, mean, scores): one number where the map is constant."""
    for batch in batches:
        maps = []
        for start, mean, scores in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
            means = np.array([mean]) if mean is not None else advance(np.arange(TOP + 1), start, np.frombuffer(scores.as_py(), np.int16).astype(np.int64))
            maps.append(means[:1] if means[0] == means[-1] else means)
        yield pa.RecordBatch.from_pydict(_as_table(batch.column(0), batch.column(1), maps))


def compose(maps: list[np.ndarray]) -> np.ndarray:
    """One map for these, the first one first."""
    out = maps[0]
    for after in maps[1:]:
        out = after[:1] if len(after) == 1 else np.where(out < 0, LOST, after[out])
        if out[0] == out[-1]:
            out = out[:1]
    return out


def _composed(table: pa.Table) -> pa.Table:
    table = table.sort_by("place")
    out = compose([np.frombuffer(m, np.int16) for m in table.column("map").to_pylist()])
    return pa.table(_as_table(table.column("identity_id")[:1], table.column("place")[:1], [out]))


def usefulness(events: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(identity_id, times_included, last_seen, avg_score) after events (identity_id, seq, score, seen_at), in order of seq.

    ``before`` holds rows of the same shape as the result, one for each symbol known so far; counts and
    means go on from there. Scores lie in 0..TOP, and others stop at these ends; a null score makes the
    mean null from then on. Events of equal seq are ordered by score; last_seen is that of the last seq, the
    latest of several. Null symbols are a symbol of their own; null seqs come first; other columns are
    ignored; no events and no rows before give an empty result. A task holds a batch and one open piece.
    """
    spark = events.sparkSession
    kind = {f.name: f.dataType.simpleString() for f in events.select("identity_id", "seq", "seen_at").schema}
    score = F.greatest(F.lit(0), F.least(F.lit(TOP), F.col("score"))).cast("long")
    none = F.lit(None).cast("long")
    rows = events.select("identity_id", none.alias("known"), "seq", F.when(F.col("score").isNotNull(), score).alias("score"), "seen_at")
    if before is not None:
        mean = F.greatest(F.lit(0), F.least(F.lit(TOP), F.col("avg_score"))).cast("long")
        rows = before.select(F.col("identity_id").cast(kind["identity_id"]), F.col("times_included").cast("long").alias("known"), F.lit(None).cast(kind["seq"]).alias("seq"), F.when(F.col("avg_score").isNotNull(), mean).alias("score"), F.col("last_seen").cast(kind["seen_at"]).alias("seen_at")).unionAll(rows)
    order = [F.col("identity_id"), F.col("known").isNull(), F.col("seq"), F.col("score"), F.col("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id())
    ranged = dealt.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).drop("row")
    found = ranged.mapInArrow(_pieces, f"identity_id {kind['identity_id']}, place long, events long, mean long, scores binary, last_seq {kind['seq']}, last_seen {kind['seen_at']}")
    pieces, path = write_shared(found, "feedback-pieces")

    by_symbol = Window.partitionBy("identity_id").orderBy("place")
    start = F.coalesce(F.sum("events").over(by_symbol.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = F.count("*").over(Window.partitionBy("identity_id")) > 1
    placed = pieces.withColumn("start", start).withColumn("several", several).withColumn("place", F.row_number().over(by_symbol).cast("long") - 1)
    split = placed.where(F.col("several") | F.col("scores").isNotNull()).select("identity_id", "place", "start", "mean", "scores")
    shape = f"identity_id {kind['identity_id']}, place long, map binary, value long"
    maps, maps_path = write_shared(split.mapInArrow(_mapped, shape), "feedback-maps")
    most = maps.agg(F.max("place")).first()[0]
    while most:
        group = F.floor(F.col("place") / FAN).cast("long")
        grouped = maps.groupBy("identity_id", group.alias("group")).applyInArrow(_composed, shape)
        maps, new_path = write_shared(grouped.withColumn("place", group), "feedback-maps")
        drop_shared(spark, maps_path)
        maps_path, most = new_path, most // FAN
    ends = maps.select("identity_id", F.col("value").alias("avg_score"))  # a symbol's first piece begins at a known state
    whole = F.when(F.col("mean") >= 0, F.col("mean"))
    totals = pieces.groupBy("identity_id").agg(
        F.sum("events").alias("times_included"),
        F.max(F.struct("last_seq", "last_seen"))["last_seen"].alias("last_seen"),
        F.count("*").alias("pieces"),
        F.max(F.col("scores").isNotNull()).alias("packed"),
        F.max(whole).alias("mean"),
    )
    alone = totals.where("pieces = 1 AND NOT packed").select("identity_id", "times_included", "last_seen", F.col("mean").alias("avg_score"))
    met = totals.where("pieces > 1 OR packed").alias("t").join(ends.alias("e"), F.col("t.identity_id").eqNullSafe(F.col("e.identity_id")))
    return alone.unionAll(met.select("t.identity_id", "times_included", "last_seen", "avg_score"))


def clamped(usefulness_rows: DataFrame) -> DataFrame:
    """Stored counters never read as negative."""
    counters = [c for c in ("times_included", "times_accepted", "avg_score") if c in usefulness_rows.columns]
    return usefulness_rows.withColumns({c: F.greatest(F.lit(0), F.col(c)) for c in counters})


def with_inclusions(uses: DataFrame, included: DataFrame) -> DataFrame:
    """(id, times_included) after each row of ``included`` (id) counts once more."""
    both = uses.select("id", F.col("times_included").cast("long").alias("n")).unionAll(included.select("id", F.lit(1).cast("long")))
    return both.groupBy("id").agg(F.sum("n").alias("times_included"))
