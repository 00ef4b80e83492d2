"""Whitening against a dense eigendecomposition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm.whitening import bidiagonalise, fit_whitening, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, x string, id string, v int, s int, n int, component string"


def table(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, 1, "x", "i", 2, 3, 4, "c") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def dense(vectors):
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(fit), fit.sum(0)
    a = ((n * fit - s) / n).astype(float)
    e, q = np.linalg.eigh(a.T @ a / n)
    order = np.argsort(-e)
    return np.array(x, object), n, s, a, e[order], q[:, order].T


def check(spark, vectors, components=16, tolerance=1e-8):
    got = whiten(table(spark, vectors), fit_whitening(table(spark, vectors), components)).toPandas().sort_values(["vec_id", "component"])
    x, n, s, a, e, q = dense(vectors)
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    assert len(got) == len(vectors) * k and set(got["n"]) == {n}
    assert got["deviation"].tolist()[::k] == [int(v) for v in ((n * x - s) ** 2).sum(1)]
    y = got["whitened"].to_numpy().reshape(-1, k)
    want = ((n * x - s) / n).astype(float) @ q[:k].T / np.sqrt(e[:k])
    sign = np.sign((y * want).sum(0))
    assert np.abs(y * sign - want).max() < tolerance
    assert np.allclose(got["explained"].to_numpy()[:k], e[:k] / e.sum(), rtol=1e-10)
    assert got["identity_error"].max() < 1e-10


def test_whitening(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.standard_normal((700, 24)) * np.linspace(0.2, 3, 24)).tolist()
    vectors += [vectors[0]] * 300 + vectors[5:9]  # a hot vector and copies count once in the fit
    check(spark, vectors)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(3)
    low = rng.standard_normal((90, 3)) @ rng.integers(-4, 5, (3, 7))
    check(spark, [[*map(float, np.round(v)), 2.0, 0.0] for v in low.tolist()])  # constant columns, rank 3 at most 9


def test_equal_eigenvalues(spark):
    """Equal deviations: any orthonormal components do, all of them are found."""
    vectors = [[float(s * (i == j)) for j in range(4)] for i in range(4) for s in (-1, 1)]
    got = whiten(table(spark, vectors), fit_whitening(table(spark, vectors))).toPandas()
    assert len(got) == 8 * 4 and got["identity_error"].max() < 1e-12
    assert np.allclose(got["explained"], 0.25)


def test_unusable_rows(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [1.0, None], [nan, 1.0], [inf, 0.0], [-inf, 0.0], [], [1.0, 2.0, 3.0], [0.0, 0.0], [1.0, 0.5], [1.0, 0.5], [3.0, -1.0]]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, None, 7]
    got = whiten(table(spark, vectors, ids), fit_whitening(table(spark, vectors, ids))).collect()
    assert sorted((r["vec_id"] is None, r["vec_id"]) for r in got if r["component"] == 1) == [(False, 7), (False, 7), (False, 8), (True, None)]
    assert {r["n"] for r in got} == {3} and {r["component"] for r in got} == {1, 2}


def test_nothing_to_fit(spark):
    for vectors in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5):
        assert whiten(table(spark, vectors), fit_whitening(table(spark, vectors))).count() == 0


def test_huge_entries(spark):
    vectors = [[3e38, 1.0], [-3e38, 2.0], [0.0, 1.0], [1e9, 7.0]]
    got = whiten(table(spark, vectors), fit_whitening(table(spark, vectors))).collect()
    assert got and all(math.isfinite(r["whitened"]) for r in got)


@pytest.mark.parametrize("rows,dims", [(2000, 600), (50, 80)])
def test_bidiagonalisation_alone(rows, dims):
    rng = np.random.default_rng(4)
    a = rng.standard_normal((rows, dims)) * (0.9 ** np.arange(dims))
    a -= a.mean(0)

    def product(w, earlier):
        u = a @ w
        return a.T @ u, (a @ earlier.T).T @ u, float(u @ u)

    values, right = bidiagonalise(product, dims, 16)
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(values, s[:16], rtol=1e-11)
    assert np.allclose(np.abs((right * vt[:16]).sum(1)), 1, atol=1e-10)
