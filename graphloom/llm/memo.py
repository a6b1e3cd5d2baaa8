"""Results kept for words that repeat: numbers for keys, and runs of integers by number."""

from __future__ import annotations

from collections import defaultdict
from itertools import count, islice

import numpy as np


class Codes(dict):
    """Numbers keys in the order they are met; those met since ``new`` was last cleared are in it."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self.new.append(key)
        code = self[key] = len(self)
        return code


class Numbers(defaultdict):
    """Numbers keys in the order they are met, from 0, without a call of Python code for each."""

    def __init__(self, keys=()):
        super().__init__(count().__next__)
        for key in keys:
            self[key]

    def since(self, n: int) -> list:
        """The keys but for the first n, in order."""
        return list(islice(reversed(self), len(self) - n))[::-1]


class Runs:
    """Runs of integers, one after another."""

    def __init__(self):
        self.values = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def append(self, values: np.ndarray, lengths: np.ndarray) -> None:
        ends = len(self.values) + np.cumsum(lengths, dtype=np.int64)
        self.values = np.concatenate([self.values, values.astype(np.int32)])
        self.starts = np.concatenate([self.starts, ends - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])

    def first(self, n: int) -> Runs:
        """A copy of the first n runs."""
        out = Runs()
        out.append(self.values[: int(self.lengths[:n].sum())], self.lengths[:n])
        return out

    def take(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs with these numbers, one after another, and their lengths."""
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.values[np.arange(total) + np.repeat(self.starts[codes] - ends + lengths, lengths)], lengths


def grouped(lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of ``lengths`` over consecutive groups of these sizes."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return np.diff(total[np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)])
