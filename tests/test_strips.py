"""Packed matrices, strips of vectors and conjugate gradients on them against NumPy."""

import numpy as np
import pytest

from polyadic.operators import strips
from polyadic.tensor import Tensor, from_numpy


@pytest.fixture
def small(monkeypatch):
    """Strips of 4 cells."""
    monkeypatch.setattr(strips, "LEAST_STRIP", 4)
    monkeypatch.setattr(strips, "STRIPS", 1000)
    monkeypatch.setattr(strips, "CHUNK_CELLS", 3)
    monkeypatch.setattr(strips, "TASK_CELLS", 9)
    monkeypatch.setattr(strips, "HELD_CELLS", 5)


def bipartite(n, m, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.integers(1, 9, size=(n, m)) * (rng.random((n, m)) < 0.3)
    a = np.block([[np.zeros((n, n)), p], [p.T, np.zeros((m, m))]]).astype(float)
    return a + np.diag(a.sum(axis=1) + 1)


@pytest.mark.parametrize("most", [1 << 23, 0])
def test_products(spark, small, monkeypatch, most):
    """Neither way is the packed matrix shuffled if vectors can be broadcast; its cells were looked up by a shuffled vector from 2^21 cells on."""
    monkeypatch.setattr(strips, "BROADCAST_CELLS", most)
    rng = np.random.default_rng(1)
    n = 23
    a = rng.normal(size=(n, n)) * (rng.random((n, n)) < 0.3)
    a[8:12] = 0  # a strip of rows without cells
    x = rng.normal(size=n)
    m = strips.packed(from_numpy(spark, a, ("i", "j")).df, n, int((a != 0).sum()))
    v = strips.dense({"x": from_numpy(spark, x, ("i",)).df}, n)
    for ways, want in (((False,), a @ x), ((True,), a.T @ x), ((False, True), (a + a.T) @ x)):
        got = strips.product(m, v, "x", ways=ways)
        if most:
            assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1 + len(ways)
        y = np.zeros(n)
        for r in strips.cells(got, "sum", n).df.collect():
            y[r["i"]] = r["v"]
        assert np.allclose(y, want)
    assert np.allclose(strips.cells(v, "x", n).to_numpy(), x)


def arrow(n):
    """Three levels: pairs, their heads, and one row of all heads."""
    a = np.diag(np.arange(3.0, 3 + n))
    for i in range(0, n - 2, 2):
        a[i, i + 1] = a[i + 1, i] = 0.5
        a[i + 1, n - 1] = a[n - 1, i + 1] = -0.75
    return a


@pytest.mark.parametrize("a", [bipartite(17, 6), arrow(11), np.diag(np.arange(1.0, 10))], ids=["two sides", "three levels", "diagonal"])
@pytest.mark.parametrize("levels", [64, 0])
def test_conjugate_gradients(spark, small, monkeypatch, a, levels):
    monkeypatch.setattr(strips, "LEVELS", levels)
    b = np.random.default_rng(2).normal(size=len(a))
    got, image = strips.ic_cg(from_numpy(spark, a, ("p", "q")), from_numpy(spark, b, ("i",)), tolerance=1e-9)
    assert got.converged and got.residual <= 1e-9 and got.rounds < len(a)
    assert np.allclose(got.x.to_numpy(), np.linalg.solve(a, b)) and np.allclose(image.to_numpy(), b)


def test_odd_systems(spark, small):
    a = bipartite(9, 4, seed=3)
    m, zero = from_numpy(spark, a, ("i", "j")), from_numpy(spark, np.zeros(13), ("i",))
    got, image = strips.ic_cg(m, zero)
    assert got.rounds == 0 and not got.x.to_numpy().any() and image.df.count() == 13
    with pytest.raises(RuntimeError, match="no convergence"):
        strips.ic_cg(m, from_numpy(spark, np.ones(13), ("i",)), max_rounds=1)
    assert not strips.ic_cg(m, from_numpy(spark, np.ones(13), ("i",)), max_rounds=1, strict=False)[0].converged
    with pytest.raises(ZeroDivisionError):
        strips.ic_cg(from_numpy(spark, np.array([[1.0, 2.0], [2.0, 1.0]]), ("i", "j")), Tensor(zero.df, ("i",), (2,)))
