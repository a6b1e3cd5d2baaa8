"""Whitening of embeddings: leading eigenvectors of the covariance by Chebyshev-filtered subspace iteration.

The covariance V is never formed. A pass over the distinct vectors multiplies it with a thin block Q: each
task sums X'(XQ) over its centred rows, and only blocks of the size of Q travel. A round applies a
Chebyshev polynomial of V to the block by its three-term recurrence, one pass for each degree: it stays
within 1 on the unwanted part of the spectrum and grows fast above it. QR and a Rayleigh-Ritz step follow;
rounds go on until the residuals |Vq - eq| of all wanted components certify them.

The unwanted part lies between the smallest eigenvalue and the smallest Ritz value of the block. A Lanczos
recurrence of one further column, carried along in the passes of the first round, bounds the former.

Vectors are integers here. Sums are exact, and rows are centred in integers before they become doubles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.textarrays import bounded_batches
from graphloom.sources.shared_storage import drop_shared, write_shared

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Largest size of an integer entry; entries beyond stop there.
MOST = 1 << 60
#: Columns of the block besides the wanted ones, degree of the polynomial, most growth of a column in a round.
SPARE, DEGREE, GROWTH = 16, 8, 1e12
#: Residual of a certified component and least eigenvalue of one, as parts of the largest eigenvalue; rounds before giving up.
RESIDUAL, RANK, ROUNDS = 2e-14, 1e-9, 200
#: Tasks whose blocks are summed on the driver; blocks of more are summed in groups first.
DIRECT = 64
ROWS = 4096


def integer_rows(table: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``table`` (vec_id, embedding) as (vec_id, x), x = floor(scale * c) + shift; without null vectors and those with null or non-finite entries."""
    c = F.col("embedding").cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: (F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), v * scale))) + shift).cast("long")
    return table.where(F.col("embedding").isNotNull()).where(fine).select("vec_id", F.transform(c, whole).alias("x"))


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _batches(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield _matrix(batch.column(column).slice(at, ROWS))


@dataclass
class Centre:
    """Exact mean of n integer vectors, as whole parts and fractions: sum = n * whole + rest."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        parts = [divmod(s, n) for s in sums]
        return cls(n, np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64))

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """Sums of (n * x - S)^2, exact; those beyond 64 bits stop at the end."""
        away = x - self.whole
        largest = self.n * (int(np.abs(away).max(initial=0)) + 1)
        if largest**2 * x.shape[1] < 1 << 62:
            return ((self.n * away - self.rest) ** 2).sum(axis=1)
        exact = ((self.n * away.astype(object) - self.rest.astype(object)) ** 2).sum(axis=1)
        return np.minimum(exact, (1 << 63) - 1).astype(np.int64)


# ---- distributed sums


@dataclass
class Fit:
    """The distinct vectors of one dimension (x), written, and how many tasks read them."""

    rows: DataFrame
    dim: int
    tasks: int
    centre: Centre

    def summed(self, make: Callable[[Iterator[np.ndarray]], np.ndarray], direct: int = DIRECT) -> np.ndarray:
        """The sum of the float blocks that ``make`` gives for each task's centred rows, always added in the same order."""
        centre = self.centre

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            block = make(centre.rows(x) for x in _batches(batches))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([block.tobytes()], pa.binary())], ["part", "block"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, at = None, None
            for batch in batches:
                for part, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                    values = np.frombuffer(block.as_py(), np.float64)
                    total, at = (values, part) if total is None else (total + values, at)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "block"])

        schema = "part long, block binary"
        found = self.rows.mapInArrow(blocks, schema)
        if self.tasks > direct:
            found = found.repartition(direct, "part").sortWithinPartitions("part").mapInArrow(add, schema)
        got = sorted((r["part"], r["block"]) for r in found.collect())  # at most ``direct`` blocks of the size of Q, whatever the rows
        return sum(np.frombuffer(b, np.float64) for _, b in got)

    def times(self, q: np.ndarray) -> np.ndarray:
        """V q, without V."""

        def make(rows: Iterator[np.ndarray]) -> np.ndarray:
            total = np.zeros(q.shape)
            for c in rows:
                total += c.T @ (c @ q)
            return total

        return self.summed(make).reshape(q.shape) / self.centre.n

    def trace(self) -> float:
        return float(self.summed(lambda rows: np.array([sum(float((c**2).sum()) for c in rows)]))[0]) / self.centre.n

    def identity_error(self, q: np.ndarray, values: np.ndarray) -> float:
        """Largest absolute entry of the whitened vectors' covariance minus the identity."""
        k = len(values)

        def make(rows: Iterator[np.ndarray]) -> np.ndarray:
            total = np.zeros((k, k + 1))
            for c in rows:
                w = c @ q / np.sqrt(values)
                total[:, :k] += w.T @ w
                total[:, k] += w.sum(axis=0)
            return total

        total = self.summed(make).reshape(k, k + 1) / self.centre.n
        mean = total[:, k]
        return float(np.abs(total[:, :k] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of a task's vectors: per entry the sums of its high and low 32 bits."""
    n, high, low = 0, None, None
    for x in _batches(batches):
        if high is None:
            high, low = np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64)
        n += len(x)
        high += (x >> 32).sum(axis=0)
        low += (x & 0xFFFFFFFF).sum(axis=0)
    if n:
        k = len(high)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k)), pa.array(high), pa.array(low), pa.array(np.full(k, n))], ["entry", "high", "low", "n"])


def fitted(rows: DataFrame, dim: int) -> Fit:
    """``rows`` (x) of this dimension, which is at least 1, with their exact mean."""
    of_tasks = rows.mapInArrow(_sums, "entry long, high long, low long, n long")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    total = of_tasks.groupBy("entry").agg(exact("high"), exact("low"), exact("n"), F.count("*").alias("tasks")).orderBy("entry").collect()  # a row per entry
    n = int(total[0]["n"])
    return Fit(rows, dim, total[0]["tasks"], Centre.of(n, [(int(r["high"]) << 32) + int(r["low"]) for r in total]))


# ---- eigenvectors


class Lanczos:
    """Steps of a Lanczos recurrence whose products come from outside; bounds the smallest eigenvalue."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    @property
    def ask(self) -> np.ndarray:
        return self.basis[-1]

    def take(self, product: np.ndarray) -> None:
        self.alpha.append(float(self.ask @ product))
        for _ in range(2):
            for v in self.basis:
                product = product - (v @ product) * v
        self.beta.append(float(np.linalg.norm(product)))
        self.basis.append(product / self.beta[-1] if self.beta[-1] > 0 else np.zeros_like(product))

    def lower_bound(self) -> float:
        """The smallest Ritz value less its residual, at least 0."""
        between = self.beta[:-1]
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + np.diag(between, 1) + np.diag(between, -1))
        return max(0.0, float(values[0] - self.beta[-1] * abs(vectors[-1, 0])))


def leading(times: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int = COMPONENTS, spare: int = SPARE, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a positive semi-definite matrix known by its products.

    Gives up to ``wanted``, all certified by residuals of RESIDUAL times the largest eigenvalue, or, where
    rounding keeps them above that, by residuals that no longer fall and are within 1e4 times of it. Signs
    make each vector's largest entry positive. A matrix of zeros has any vectors, with zeros as values.
    """
    k = min(dim, wanted + spare)
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(dim, k)))[0]
    probe = Lanczos(rng.normal(size=dim))
    wanted, low, last = min(wanted, dim), 0.0, []

    def product(y: np.ndarray) -> np.ndarray:
        if probe is None:
            return times(y)
        both = times(np.column_stack([y, probe.ask]))
        probe.take(both[:, -1])
        return both[:, :-1]

    for _ in range(ROUNDS):
        v = product(q)
        values, turn = np.linalg.eigh((q.T @ v + v.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, v = q @ turn, v @ turn
        if values[0] <= 0:
            break
        residual = float(np.linalg.norm(v - q * values, axis=0)[:wanted].max()) / values[0]
        last.append(residual)
        if residual <= RESIDUAL or (residual <= 1e4 * RESIDUAL and len(last) > 3 and residual > min(last[-4:-1]) / 2):
            break
        if len(last) == 2:  # the probe has gone along for a whole round
            low = probe.lower_bound()
        high = max(float(values[-1]), 0.0)
        if len(last) >= 2:
            probe = None
        bottom = low if low < high else 0.0
        middle, half = (bottom + high) / 2, (high - bottom) / 2
        half = max(half, 1e-12 * values[0])
        growth = np.arccosh(max((values[0] - middle) / half, 1 + 1e-12))
        steps = int(np.clip(np.log(2 * GROWTH) / growth, 1, degree))
        before, now = q, (v - middle * q) / half
        for _ in range(steps - 1):
            before, now = now, 2 * (product(now) - middle * now) / half - before
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0).clip(1e-300))[0]
    else:
        raise RuntimeError(f"components are not certified after {ROUNDS} rounds: residual {residual:.1e}")
    values, q = values[:wanted].clip(0.0), q[:, :wanted]
    return values, q * np.where(q[np.abs(q).argmax(axis=0), np.arange(wanted)] < 0, -1.0, 1.0)


# ---- whitened rows


def _whitened(centre: Centre, q: np.ndarray, values: np.ndarray, explained: np.ndarray, error: float):
    k = len(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, x = batch.column(0).slice(at, ROWS), _matrix(batch.column(1).slice(at, ROWS))
                w = centre.rows(x) @ q / np.sqrt(values)
                m = len(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                        pa.array(np.full(m * k, centre.n)),
                        pa.array(np.repeat(centre.deviations(x), k)),
                        pa.array(w.reshape(-1)),
                        pa.array(np.tile(explained, m)),
                        pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return run


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of ``rows`` (vec_id, x): a row per vector and component.

    Each distinct x counts once in mean and covariance, whichever rows repeat it. There are as many
    components as ``components``, dimensions and eigenvalues above RANK times the largest allow: one vector
    alone, or equal ones, give none and so no rows. Deviations beyond 64 bits stop at the end. Vectors of
    different lengths are whitened apart, each length as a table of its own; empty ones give no rows. Null
    and repeated vec_ids stay as they are; other columns are ignored; an empty table gives an empty result.
    A task holds one batch of vectors and some blocks of dimensions by components; so does the driver.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = rows.select("vec_id", "x")
    fit, path = write_shared(rows.select("x").distinct().withColumn("dim", F.size("x")), "whitening-fit")
    out = spark.createDataFrame([], schema)
    for dim in sorted(r["dim"] for r in fit.select("dim").distinct().collect()):  # lengths of vectors: usually one
        if dim < 1:
            continue
        f = fitted(fit.where(F.col("dim") == dim).select("x"), dim)
        trace = f.trace()
        values, q = leading(f.times, dim, components) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
        used = values > RANK * values.max(initial=0.0)
        values, q = values[used], q[:, used]
        if len(values):
            run = _whitened(f.centre, q, values, values / trace, f.identity_error(q, values))
            out = out.unionAll(rows.where(F.size("x") == dim).mapInArrow(run, schema))
    drop_shared(spark, path)
    return out


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(integer_rows(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")))


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
