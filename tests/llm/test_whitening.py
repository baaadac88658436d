"""Components by Lanczos steps against the eigenvectors of the whole covariance."""

import numpy as np
import pytest

from emberlog.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, n string, component string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "n", "c") for i, v in enumerate(vectors)], SCHEMA).repartition(3)


def covariance(x):
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    rows = (fit * n - sums) / n
    return n, sums, rows.T @ rows / n


def checked(spark, vectors, count):
    """Compares the result with the definition and returns its rows by vector."""
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    n, sums, cov = covariance(x)
    values = np.linalg.eigvalsh(cov)[::-1]
    out = whitening.whiten(frame(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    assert len(out) == count * len(vectors) and set(out.component) == set(range(1, count + 1))
    assert (out.n == n).all()
    exact = {i: sum((n * int(c) - int(s)) ** 2 for c, s in zip(row, sums)) for i, row in enumerate(x)}
    assert all(exact[i] == d for i, d in zip(out.vec_id, out.deviation))
    for i in range(count):
        assert np.allclose(out[out.component == i + 1].explained, values[i] / np.trace(cov), rtol=1e-9)
    assert out.identity_error.nunique() == 1 and out.identity_error.max() < 1e-8
    # the axes follow from the whitened values, and have to be eigenvectors
    white = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    axes = np.linalg.lstsq(np.c_[(x * n - sums) / n], white * np.sqrt(values[:count]), rcond=None)[0]
    assert np.allclose(cov @ axes, axes * values[:count], atol=1e-7 * values[0])
    return white


def test_random_vectors(spark):
    rng = np.random.default_rng(3)
    scales = np.r_[3, 2.5, 1, 0.99, np.linspace(0.9, 0.1, 20)]
    checked(spark, (rng.standard_normal((300, 24)) * scales + 5).tolist(), 4)


def test_fewer_vectors_than_entries(spark):
    rng = np.random.default_rng(4)
    checked(spark, rng.standard_normal((6, 40)).tolist() * 2, 4)
    checked(spark, rng.standard_normal((3, 40)).tolist(), 2)


def test_equal_eigenvalues_are_all_found(spark):
    axes = np.eye(6) * np.array([2, 2, 2, 1, 1, 0.5])[:, None]
    white = checked(spark, np.concatenate([axes, -axes]).tolist(), 4)
    assert np.linalg.matrix_rank(white) == 4


def test_less_than_full_rank(spark):
    rng = np.random.default_rng(5)
    low = rng.integers(-3, 4, (80, 3)) @ rng.integers(-2, 3, (3, 10))
    checked(spark, low.tolist(), 3)


def test_rows_that_do_not_count(spark):
    good = [[0, 1, 2], [3, 1, 0], [3, 1, 0], [1, 5, 2], [0.999, 0, -0.001]]
    bad = [None, [1, None, 2], [float("nan"), 0, 0], [float("inf"), 0, 0], [1, 2], []]
    out = whitening.whiten(frame(spark, good + bad)).toPandas()
    assert set(out.vec_id) == set(range(5)) and (out.n == 4).all()
    same = [sorted(map(tuple, out[out.vec_id == i][["component", "deviation", "whitened"]].to_numpy().tolist())) for i in (1, 2)]
    assert same[0] == same[1]


@pytest.mark.parametrize("vectors", [[], [None, []], [[1, 2]], [[1, 2], [1, 2]], [[float("nan")]]])
def test_nothing_to_whiten(spark, vectors):
    out = whitening.whiten(frame(spark, vectors))
    assert out.collect() == [] and out.columns == [f.split()[0] for f in whitening.SCHEMA.split(", ")]


def test_deviations_are_exact_or_null():
    x = np.array([[2**40, 0], [2**20, 1]])
    assert whitening.deviations(x, 2**10, np.array([1, 3])) == [None, (2**30 - 1) ** 2 + (2**10 - 3) ** 2]


def test_many_vectors_one_hot(spark):
    """A vector in a third of all rows counts once."""
    rng = np.random.default_rng(6)
    checked(spark, rng.standard_normal((400, 8)).tolist() + [[1.0] * 8] * 200, 4)


def test_u_is_orthonormal(spark):
    """R has no more above its second diagonal than rounding leaves, as U and V are orthonormal."""
    rng = np.random.default_rng(8)
    x = rng.integers(-99, 99, (200, 12))
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "x array<long>")
    values, axes = whitening.bidiagonalise(fit, 12, 200, x.sum(axis=0), 12)
    rows = (x * 200 - x.sum(axis=0)) / 200
    assert np.allclose(values, np.linalg.svd(rows)[1][: len(values)], rtol=1e-12) and len(values) == 12
    assert np.allclose(axes.T @ axes, np.eye(12), atol=1e-12)
