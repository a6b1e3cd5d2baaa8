"""Whitening against dense eigenvectors and exact integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import whitening


def dense(x, components=16):
    """Eigenvalues, eigenvectors, whitened rows and explained parts over distinct rows."""
    fit = np.unique(x, axis=0).astype(np.float64)
    c = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / len(fit))
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return values, vectors, (x - fit.mean(axis=0)) @ vectors / np.sqrt(values), values / (c**2).sum() * len(fit)


def exact_deviations(x):
    fit = {tuple(map(int, r)) for r in x}
    n, sums = len(fit), [sum(r[j] for r in fit) for j in range(x.shape[1])]
    return n, [min(sum((n * int(v) - s) ** 2 for v, s in zip(r, sums)), 2**63 - 1) for r in x]


def spectrum(rng, rows, values):
    dim = len(values)
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    return rng.normal(size=(rows, dim)) * np.sqrt(values) @ turn


def check(got, ids, x, components=16):
    values, _, want, explained = dense(x, components)
    n, deviations = exact_deviations(x)
    k = len(values)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(got) == len(by) == len(ids) * k
    w = np.array([[by[i, c + 1]["whitened"] for c in range(k)] for i in ids])
    assert np.abs(w * np.sign((w * want).sum(axis=0)) - want).max() < 1e-7
    assert [by[i, 1]["deviation"] for i in ids] == deviations and {r["n"] for r in got} == {n}
    assert np.abs(np.array([by[ids[0], c + 1]["explained"] for c in range(k)]) / explained - 1).max() < 1e-9
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("shape", ["flat", "steep", "narrow", "one group"])
def test_against_dense_eigenvectors(spark, shape):
    rng = np.random.default_rng(7)
    values = {"flat": 1 - np.arange(48) / 200, "steep": 10.0 ** (-np.arange(48) / 8), "narrow": np.array([3.0, 2.0, 1.0]), "one group": 1 - np.arange(40) / 100}[shape]
    v = spectrum(rng, 500, values) * 40
    if shape == "one group":  # a third of all rows are one vector
        v[rng.random(500) < 0.4] = v[0]
    table = spark.createDataFrame([(i, r.tolist(), 7, 1.5) for i, r in enumerate(v)], "vec_id long, embedding array<double>, component int, x double").repartition(6)
    got = whitening.whiten(whitening.integer_rows(table)).collect()
    check(got, list(range(500)), np.floor(64 * v).astype(np.int64) + 1_000_000)


def test_awkward_vectors(spark):
    """Null, non-finite, empty and repeated ones, null and repeated ids, two lengths, and a length of one vector alone."""
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(50, 4)), rng.normal(size=(40, 2))
    rows = [(i, r.tolist()) for i, r in enumerate(a)] + [(100 + i, r.tolist()) for i, r in enumerate(b)]
    odd = [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4), (203, [float("-inf"), 0.0, 0.0, 0.0]), (204, []), (205, [1.0, 2.0, 3.0])]
    again = [(300, a[0].tolist()), (None, a[1].tolist()), (3, a[2].tolist())]
    table = spark.createDataFrame(rows + odd + again, "vec_id long, embedding array<double>")
    got = whitening.whiten(whitening.integer_rows(table)).collect()
    whole = lambda v: np.floor(64 * v).astype(np.int64) + 1_000_000
    check([r for r in got if r["vec_id"] is not None and 100 <= r["vec_id"] < 200], list(range(100, 140)), whole(b))
    four = [r for r in got if r["vec_id"] is None or r["vec_id"] < 100 or r["vec_id"] == 300]
    assert len(four) == (50 + 3) * 4 and len(got) == len(four) + 40 * 2
    assert {r["n"] for r in four} == {50}
    same = {(r["vec_id"], r["component"]): r["whitened"] for r in four if r["vec_id"] in (0, 300)}
    assert all(same[0, c] == same[300, c] for c in range(1, 5))


def test_too_little_for_components(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(whitening.integer_rows(empty)).count() == 0
    alone = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(whitening.integer_rows(alone)).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 5.0]) for i in range(9)], "vec_id long, embedding array<float>")
    got = whitening.whiten(whitening.integer_rows(line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 9 and abs(got[0]["explained"] - 1) < 1e-12


def test_very_large_entries(spark):
    rows = [(1, [1e15, 1.0]), (2, [-1e15, 2.0]), (3, [1e300, 0.0]), (4, [0.5, -7.0])]
    got = whitening.whiten(whitening.integer_rows(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    assert {r["vec_id"] for r in got} == {1, 2, 3, 4} and all(r["deviation"] == 2**63 - 1 for r in got)
    centre = whitening.Centre.of(3, [10, -5])
    x = np.array([[2**40, 5], [3, -(2**41)]])
    assert centre.deviations(x).tolist() == [min((3 * int(a) - 10) ** 2 + (3 * int(b) + 5) ** 2, 2**63 - 1) for a, b in x]
    assert centre.deviations(np.array([[3, 4]])).tolist() == [1 + 17**2]


@pytest.mark.parametrize("direct", [1, 2, 64])
def test_sums_in_groups(spark, direct):
    rng = np.random.default_rng(2)
    x = rng.integers(-1000, 1000, (300, 5))
    fit = whitening.fitted(spark.createDataFrame([(r.tolist(),) for r in x], "x array<long>").repartition(7), 5)
    assert fit.tasks == 7
    c = x - x.mean(axis=0)
    got = fit.summed(lambda rows: sum((r.T @ r for r in rows), np.zeros((5, 5))), direct).reshape(5, 5)
    assert np.allclose(got, c.T @ c, rtol=1e-12)


@pytest.mark.parametrize("values", [np.r_[5.0, 4.0, 3.0 * np.ones(60)], np.linspace(1, 0, 150), 10.0 ** -np.linspace(0, 8, 90), np.ones(70), np.r_[1e9, np.linspace(2, 1, 99)], np.zeros(40)])
def test_iteration_alone(values):
    rng = np.random.default_rng(5)
    turn = np.linalg.qr(rng.normal(size=(len(values), len(values))))[0]
    matrix = turn * values @ turn.T
    calls = []
    got, q = whitening.leading(lambda y: calls.append(1) or matrix @ y, len(values))
    assert np.abs(got - np.sort(values)[::-1][:16]).max() <= 1e-10 * max(values.max(), 1e-300)
    assert np.abs(matrix @ q - q * got).max() <= 1e-9 * max(values.max(), 1e-300) and np.abs(q.T @ q - np.eye(16)).max() < 1e-12
    assert len(calls) < 150
