"""Usefulness kept up to date by a stream of inclusion events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

from graphloom.operators.feedback import LOST, TOP, advance

OUTPUT = "identity_id string, times_included bigint, last_seen bigint, avg_score bigint"


def _fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """A symbol's count and truncating mean after this batch's events, taken in order of ``seq`` and score."""
    n, mean, seen, known = state.get if state.exists else (0, 0, 0, False)
    rows = pd.concat(list(batches)).sort_values(["seq", "score"], na_position="first")
    scores = rows["score"].astype(float).clip(0, TOP).fillna(LOST).to_numpy().astype(np.int64)
    if mean != LOST:
        mean = int(advance(np.array([mean]), n, scores)[0])
    n += len(rows)
    times = rows.loc[rows["seq"].isna() if rows["seq"].isna().all() else rows["seq"] == rows["seq"].max(), "seen_at"]
    known = bool(times.notna().any())
    seen = int(times.max()) if known else 0
    state.update((n, mean, seen, known))
    yield pd.DataFrame({"identity_id": [key[0]], "times_included": [n], "last_seen": pd.array([seen if known else None], "Int64"), "avg_score": pd.array([None if mean == LOST else mean], "Int64")})


def running_usefulness(events: DataFrame) -> DataFrame:
    """Stream of (identity_id, times_included, last_seen, avg_score), one row per symbol and batch that names it.

    events: (identity_id, seq, score, seen_at); batches must come in order of seq. Scores stop at 0 and TOP;
    after a null score the mean is null from then on, as in ``feedback.usefulness``; a null symbol is one of
    its own; last_seen is that of the batch's last seq, null if it has none. State is three numbers per symbol.
    """
    return events.groupBy("identity_id").applyInPandasWithState(_fold, OUTPUT, "n bigint, mean bigint, seen bigint, known boolean", "update", GroupStateTimeout.NoTimeout)
