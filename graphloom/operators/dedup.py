"""First and last rows of a key in a stated order, as aggregates that combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: list[str], order: list[str], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    best = df.groupBy(*keys).agg((F.max(row) if last else F.min(row)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that comes first in ``order``; remaining columns break ties."""
    return _pick(df, keys, order, last=False)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _pick(df, keys, order, last=True)
