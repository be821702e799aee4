import math

import numpy as np
import pytest

from polyadic.operators import ad, elementwise, fourier, krylov, optim, reduce
from polyadic.tensor import from_numpy

rng = np.random.default_rng(11)


def vector(spark, x):
    return from_numpy(spark, np.asarray(x, dtype=float), ("i",))


def matrix(spark, x):
    return from_numpy(spark, np.asarray(x, dtype=float), ("i", "j"))


@pytest.mark.parametrize("solve", [krylov.bicgstab, krylov.gmres])
def test_square_systems(spark, solve):
    a, b = rng.random((8, 8)) + 6 * np.eye(8), rng.random(8)
    got = solve(matrix(spark, a), vector(spark, b), tolerance=1e-8)
    assert got.converged and got.rounds and got.residual <= 1e-8
    np.testing.assert_allclose(got.x.to_numpy(), np.linalg.solve(a, b), atol=1e-7)


def test_symmetric_systems(spark):
    a, b = rng.random((6, 6)), rng.random(6)
    indefinite = (a + a.T) / 2 + np.diag([4, -4, 5, -5, 6, 7])
    got = krylov.minres(matrix(spark, indefinite), vector(spark, b), tolerance=1e-8)
    np.testing.assert_allclose(got.x.to_numpy(), np.linalg.solve(indefinite, b), atol=1e-6)
    positive = a @ a.T + 3 * np.eye(6)
    m = matrix(spark, positive)
    got = krylov.cg(m, vector(spark, b), tolerance=1e-8, preconditioner=krylov.jacobi(m))
    np.testing.assert_allclose(got.x.to_numpy(), np.linalg.solve(positive, b), atol=1e-6)


def test_rectangular_systems(spark):
    a, b = rng.random((7, 3)), rng.random(7)
    got = krylov.cgnr(matrix(spark, a), vector(spark, b), tolerance=1e-9)
    np.testing.assert_allclose(got.x.to_numpy(), np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-6)
    got = krylov.cgne(matrix(spark, a.T), vector(spark, b[:3]), tolerance=1e-9)
    np.testing.assert_allclose(got.x.to_numpy(), np.linalg.pinv(a.T) @ b[:3], atol=1e-6)


def test_no_convergence_is_told(spark):
    a, b = matrix(spark, rng.random((6, 6)) + 4 * np.eye(6)), vector(spark, rng.random(6))
    with pytest.raises(RuntimeError, match="no convergence"):
        krylov.bicgstab(a, b, tolerance=1e-12, max_rounds=1)
    assert not krylov.gmres(a, b, tolerance=1e-12, max_rounds=1, strict=False).converged
    zero = krylov.cg(a, vector(spark, np.zeros(6)))
    assert zero.rounds == 0 and not zero.x.to_numpy().any()


def test_fourier(spark):
    x = rng.random((3, 10))
    t = matrix(spark, x)
    re, im = fourier.fft(t, "j")
    want = np.fft.fft(x, axis=1)
    np.testing.assert_allclose(re.to_numpy() + 1j * im.to_numpy(), want, atol=1e-12)
    np.testing.assert_allclose(fourier.ifft(re, "j", im)[0].to_numpy(), x, atol=1e-12)
    re, im = fourier.rfft(t, "j")
    np.testing.assert_allclose(re.to_numpy() + 1j * im.to_numpy(), np.fft.rfft(x), atol=1e-12)
    np.testing.assert_allclose(fourier.irfft(re, im, "j", 10).to_numpy(), x, atol=1e-12)
    re, im = fourier.fftn(t, ["i", "j"])
    np.testing.assert_allclose(re.to_numpy() + 1j * im.to_numpy(), np.fft.fft2(x), atol=1e-12)
    k, j = np.arange(10)[:, None], np.arange(10)[None, :]
    np.testing.assert_allclose(fourier.dct(t, "j").to_numpy(), 2 * x @ np.cos(np.pi * k * (2 * j + 1) / 20).T, atol=1e-12)
    np.testing.assert_allclose(fourier.hilbert(t, "j")[0].to_numpy(), x, atol=1e-12)


def test_statistics_of_sparse_constant_and_large_columns(spark):
    sparse = np.array([[1.0, 0], [0, 2], [3, 0]])
    np.testing.assert_allclose(reduce.covariance_matrix(matrix(spark, sparse)).to_numpy(), np.cov(sparse.T))
    large = 1e9 + np.array([[1.0, 7], [2, 5], [3, 9]])
    np.testing.assert_allclose(reduce.covariance_matrix(matrix(spark, large)).to_numpy(), np.cov(large.T), rtol=1e-9)
    np.testing.assert_allclose(reduce.variance(matrix(spark, large), ["i"], 1).to_numpy(), large.var(axis=0, ddof=1), rtol=1e-9)
    constant = np.array([[1.0, 5, 0], [2, 5, 0], [4, 5, 0]])
    got = reduce.covariance_matrix(matrix(spark, constant), correlation=True).to_numpy()
    assert got[0, 0] == pytest.approx(1) and np.isnan(got[1]).all() and np.isnan(got[2, 2])


def test_zero_cells(spark):
    a, b = np.array([[0.0, 2], [0, 0]]), np.array([[0.0, 0], [3, 0]])
    for name, f in (("pow", np.power), ("div", np.divide)):
        with np.errstate(all="ignore"):
            np.testing.assert_array_equal(elementwise.binary(matrix(spark, a), matrix(spark, b), name).to_numpy(), f(a, b))
    x, g = vector(spark, [0.0, 4.0]), vector(spark, [1.0, 1.0])
    assert ad.unary_vjp(x, "log", g).to_numpy().tolist() == [math.inf, 0.25]
    assert ad.unary_vjp(x, "sqrt", g).to_numpy().tolist() == [math.inf, 0.25]
    assert ad.unary_vjp(x, "recip", g).to_numpy().tolist() == [-math.inf, -0.0625]


def reference(name, x, grads):
    m = s = np.zeros_like(x)
    for t, g in enumerate(grads, 1):
        if name == "nesterov":
            m = 0.9 * m + g
            x = x - 0.1 * (g + 0.9 * m)
        elif name == "adamw":
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            x = x * (1 - 0.1 * 0.01) - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        elif name == "rmsprop":
            s = 0.99 * s + 0.01 * g * g
            x = x - 0.1 * g / (np.sqrt(s) + 1e-8)
        elif name == "adagrad":
            s = s + g * g
            x = x - 0.1 * g / (np.sqrt(s) + 1e-8)
        elif name == "radam":
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            inf = 2 / 0.001 - 1
            rho = inf - 2 * t * 0.999**t / (1 - 0.999**t)
            move = m / (1 - 0.9**t)
            if rho > 4:
                r = ((rho - 4) * (rho - 2) * inf / ((inf - 4) * (inf - 2) * rho)) ** 0.5
                move = move * r / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
            x = x - 0.1 * move
    return x


@pytest.mark.parametrize(
    "name,rule",
    [("nesterov", optim.sgd(0.1, 0.9, nesterov=True)), ("adamw", optim.adam(0.1, decay=0.01, decoupled=True)), ("rmsprop", optim.rmsprop(0.1)), ("adagrad", optim.adagrad(0.1)), ("radam", optim.radam(0.1))],
)
def test_optimisers(spark, name, rule):
    x = np.array([1.0, 0.0, -2.0, 3.0])
    grads = [np.array([0.5, 1.0, 0.0, -1.0]) * k for k in range(1, 7)]
    t = vector(spark, x)
    for g in grads:
        t, rule = rule.step(t, vector(spark, g))
    np.testing.assert_allclose(t.to_numpy(), reference(name, x, grads), atol=1e-12)


def test_rates():
    assert optim.rate_at(5, 1.0, "linear", total=10) == 0.5 and optim.rate_at(0, 1.0, "constant", warmup=4) == 0.25
    with pytest.raises(ValueError):
        optim.rate_at(0, 1.0, "cosine")
    assert optim.plateau_rate([3, 2, 2, 2, 2, 2], 1.0, patience=2) == 0.5


def test_eigenvalues(spark):
    from polyadic.operators import linalg

    with pytest.raises(RuntimeError):
        linalg.power_iteration(matrix(spark, np.diag([2.0, -2.0])), max_rounds=6)
    assert linalg.power_iteration(matrix(spark, np.diag([0.5, -3.0])))[0] == pytest.approx(-3.0)
    assert np.allclose(linalg.lanczos(matrix(spark, np.diag([3.0, 3.0, 1.0, 1.0])), 3), [3.0, 3.0, 1.0])
    assert np.allclose(linalg.lanczos(matrix(spark, np.array([[2.25, -1.5], [-1.5, 1.0]])), 2), [3.25, 0.0])
    with pytest.raises(ValueError):
        linalg.lanczos(matrix(spark, np.eye(2)), 3)


def test_indefinite_breaks_down(spark):
    got = krylov.cg(matrix(spark, np.array([[0.0, 1.0], [1.0, 0.0]])), vector(spark, np.array([1.0, 0.0])), strict=False)
    assert not got.converged
    with pytest.raises(RuntimeError):
        krylov.cg(matrix(spark, np.array([[0.0, 1.0], [1.0, 0.0]])), vector(spark, np.array([1.0, 0.0])))


def test_the_system_is_joined_once(spark):
    """What comes after works on the nations' cells, not on the tables again."""
    from polyadic.queries import _system

    a, b = _system(spark, "/root/testdata/sf0.001", symmetric=False)
    for t in (a, b):
        plan = t.df._jdf.queryExecution().toString()
        assert "Join" not in plan and "lineitem" not in plan
