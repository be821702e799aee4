"""Incomplete factorisations and triangular solves against NumPy."""

import numpy as np
import pytest

from polyadic.operators import factorization as fz
from polyadic.operators import krylov, sparse
from polyadic.tensor import from_numpy


def matrix(spark, a):
    return from_numpy(spark, a, ("i", "j"))


def vector(spark, b):
    return from_numpy(spark, b, ("i",))


def plain_ilu(a):
    lu, n = a.copy(), len(a)
    there = a != 0
    for i in range(1, n):
        for k in range(i):
            if there[i, k]:
                lu[i, k] /= lu[k, k]
                for j in range(k + 1, n):
                    if there[i, j]:
                        lu[i, j] -= lu[i, k] * lu[k, j]
    return np.tril(lu, -1) + np.eye(n), np.triu(lu)


def bipartite(n, m, seed=0):
    """A symmetric, diagonally dominant matrix of two levels."""
    rng = np.random.default_rng(seed)
    p = rng.random((n, m)) * (rng.random((n, m)) < 0.4)
    a = np.block([[np.zeros((n, n)), p], [p.T, np.zeros((m, m))]])
    return a + np.diag(a.sum(axis=1) * 1.02 + 0.01)


def test_ilu_and_ic(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(7, 7)) * (rng.random((7, 7)) < 0.3)
    a += np.diag(5 + rng.random(7))
    low, up = fz.ilu0(matrix(spark, a))
    want = plain_ilu(a)
    assert np.allclose(low.to_numpy(), want[0]) and np.allclose(up.to_numpy(), want[1])
    there = a != 0
    assert np.allclose((low.to_numpy() @ up.to_numpy())[there], a[there])
    s = bipartite(6, 4)
    c = fz.ic0(matrix(spark, s)).to_numpy()
    assert np.allclose(c, np.tril(c)) and np.allclose((c @ c.T)[s != 0], s[s != 0])


def test_triangular_solves(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(8, 8)) * (rng.random((8, 8)) < 0.2)
    a[np.diag_indices(8)] = 2 + rng.random(8)
    b = rng.normal(size=8)
    b[3] = 0
    for lower in (True, False):
        t = np.tril(a) if lower else np.triu(a)
        assert np.allclose(fz.solve(fz.triangle(matrix(spark, a), lower=lower), vector(spark, b)).to_numpy(), np.linalg.solve(t, b))
    unit = np.tril(a, -1) + np.eye(8)
    assert np.allclose(fz.solve(fz.triangle(matrix(spark, a), unit=True), vector(spark, b)).to_numpy(), np.linalg.solve(unit, b))
    levels, count = fz.level_sets(spark.createDataFrame([(2, 0), (2, 1), (3, 2)], "i long, j long"), spark.range(5).withColumnRenamed("id", "i"))
    assert count == 3 and sorted(map(tuple, levels.collect())) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 0)]
    with pytest.raises(ValueError):
        fz.level_sets(spark.createDataFrame([(0, 1), (1, 0)], "i long, j long"), spark.range(3).withColumnRenamed("id", "i"))


def test_singular_pivots(spark):
    with pytest.raises(ZeroDivisionError):
        fz.ilu0(matrix(spark, np.array([[0.0, 1.0], [1.0, 1.0]])))
    with pytest.raises(Exception, match="pivot"):
        fz.ilu0(matrix(spark, np.array([[1.0, 1.0], [1.0, 1.0]])))
    with pytest.raises(ZeroDivisionError):
        fz.ic0(matrix(spark, np.array([[1.0, 2.0], [2.0, 1.0]])))
    with pytest.raises(ValueError):
        fz.ssor_preconditioner(matrix(spark, np.eye(2)), 2.0)


def test_preconditioned_solvers(spark):
    a = bipartite(8, 4, seed=3)
    b = np.random.default_rng(4).normal(size=12)
    m, v = matrix(spark, a), vector(spark, b)
    plain = krylov.cg(m, v, tolerance=1e-5, preconditioner=krylov.jacobi(m))
    ic = krylov.cg(m, v, tolerance=1e-5, preconditioner=fz.ic_preconditioner(m))
    gmres = krylov.gmres(m, v, tolerance=1e-5, preconditioner=fz.ilu_preconditioner(m))
    for got in (plain, ic, gmres):
        assert np.allclose(got.x.to_numpy(), np.linalg.solve(a, b), atol=1e-3)
    assert ic.rounds < plain.rounds and gmres.rounds < plain.rounds


def test_ssor(spark):
    a = bipartite(5, 3, seed=5)
    b, w = np.arange(1.0, 9.0), 1.3
    d = np.diag(np.diag(a))
    m = (d + w * np.tril(a, -1)) @ np.linalg.inv(d) @ (d + w * np.triu(a, 1)) / (w * (2 - w))
    assert np.allclose(fz.ssor_preconditioner(matrix(spark, a), w)(vector(spark, b)).to_numpy(), np.linalg.solve(m, b))


def test_only_cells_that_count_are_sent(spark):
    """Two sides: each cell left of the diagonal needs its pivot and changes the diagonal, and pairs of one column's cells are not made."""
    n, m = 6, 5
    a = bipartite(n, m)
    cells = matrix(spark, a).df
    rows, done = cells.where(f"i >= {n}"), cells.where(f"i < {n} and j >= i")
    needed = fz._needed(rows, done)
    left = int((a[n:, :n] != 0).sum())
    assert needed.count() == 2 * left and needed.where("column <> k and column <> row").isEmpty()
    got = sparse.masked_product(matrix(spark, np.tril(a)), matrix(spark, np.triu(a)), cells.select("i", "j")).to_numpy()
    assert np.allclose(got, np.where(a != 0, np.tril(a) @ np.triu(a), 0))


def test_masked_product(spark):
    rng = np.random.default_rng(5)
    a, b = (rng.normal(size=(9, 9)) * (rng.random((9, 9)) < 0.5) for _ in range(2))
    mask = rng.random((9, 9)) < 0.4
    got = sparse.masked_product(matrix(spark, a), matrix(spark, b), matrix(spark, mask.astype(float)).df.select("i", "j")).to_numpy()
    assert np.allclose(got, np.where(mask, a @ b, 0))


@pytest.mark.parametrize("most", [1 << 21, 0])
def test_products_do_not_sort_the_matrix(spark, monkeypatch, most):
    """Cells look up their factor, in a broadcast or a shuffled table; before, each product sorted them all."""
    from polyadic import iterate

    plans, kept = [], krylov.cut
    monkeypatch.setattr(iterate, "VECTOR_CELLS", most)
    monkeypatch.setattr(krylov, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    a = bipartite(5, 3)
    x = np.arange(1.0, 9.0)
    assert np.allclose(krylov.apply(matrix(spark, a), vector(spark, x)).to_numpy(), a @ x)
    assert np.allclose(krylov.apply(matrix(spark, a[:5]), vector(spark, x[:5]), transposed=True).to_numpy(), a[:5].T @ x[:5])
    assert len(plans) == 2 and all("HashJoin" in p and "SortMergeJoin" not in p for p in plans)
    t = np.tril(a)
    assert np.allclose(fz.solve(fz.triangle(matrix(spark, a)), vector(spark, x)).to_numpy(), np.linalg.solve(t, x))


def test_two_sides_are_shuffled_once(spark):
    """Before, the product on the pattern joined the triangles five times and then the pattern, and each level its rows three times."""
    n, m = 6, 5
    a = bipartite(n, m, seed=7)
    cells = matrix(spark, a).df
    rows, done = cells.where(f"i >= {n}"), cells.where(f"i < {n} and j >= i")
    assert not fz._meet(rows, done)
    got = fz._eliminated(rows, done)
    assert "Join" not in got._jdf.queryExecution().toString()
    low, up = plain_ilu(a)
    want = np.tril(low, -1) + up
    assert np.allclose(np.array(sorted(got.collect())), [(i, j, want[i, j]) for i, j in np.argwhere(a) if i >= n])
    low, up = fz.ilu0(matrix(spark, a))
    product = sparse.triangles_product(low, up)
    plan = product.df._jdf.queryExecution().toString()
    assert "Join" not in plan and "CoGroup" not in plan
    assert np.allclose(product.to_numpy(), a) and product.df.count() == int((a != 0).sum())


@pytest.mark.parametrize("density", [0.05, 0.2, 0.6])
def test_triangles_product(spark, density):
    """Patterns in which cells beside the diagonal meet or not, and cells that are missing on it."""
    rng = np.random.default_rng(8)
    there = rng.random((9, 9)) < density
    there[np.arange(6), np.arange(6)] = True
    x, y = np.tril(np.where(there, rng.normal(size=(9, 9)), 0)), np.triu(np.where(there, rng.normal(size=(9, 9)), 0))
    got = sparse.triangles_product(matrix(spark, x), matrix(spark, y))
    assert np.allclose(got.to_numpy(), np.where((x != 0) | (y != 0), x @ y, 0))
    mask = matrix(spark, ((x != 0) | (y != 0)).astype(float)).df.select("i", "j")
    want = sparse.masked_product(matrix(spark, x), matrix(spark, y), mask).df
    assert {tuple(r) for r in got.df.select("i", "j").collect()} == {tuple(r) for r in want.select("i", "j").collect()}


def test_levels_with_and_without_meeting_cells(spark):
    """An arrow (only the last row changes, at its diagonal) and a band with a corner, whose levels mix both ways."""
    n = 7
    arrow = np.diag(np.arange(2.0, 2 + n))
    arrow[-1, :-1], arrow[:-1, -1] = 0.5, 0.25
    band = np.diag(np.full(n, 4.0)) + np.diag(np.ones(n - 1), 1) + np.diag(np.ones(n - 1), -1) + np.diag(np.full(n - 2, 0.5), 2)
    band[n - 1, 0] = band[0, n - 1] = 0.75
    for a in (arrow, band):
        low, up = fz.ilu0(matrix(spark, a))
        want = plain_ilu(a)
        assert np.allclose(low.to_numpy(), want[0]) and np.allclose(up.to_numpy(), want[1])
    tight = np.diag(np.ones(n))
    tight[-1, 0] = tight[0, -1] = 1.0
    with pytest.raises(ZeroDivisionError, match=f"pivot of row {n - 1}"):
        fz.ilu0(matrix(spark, tight))
