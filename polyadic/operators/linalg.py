"""Iterative solvers, eigenvectors and factorisations; long vectors are frames, small matrices are arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from polyadic.iterate import cut
from polyadic.operators import krylov, tall
from polyadic.operators.kernels import gram
from polyadic.plans.einsum import einsum
from polyadic.tensor import Tensor, from_numpy


#: Sides of small matrices that may be gathered on the driver.
DRIVER_SIDE = 2048


def on_driver(t: Tensor) -> np.ndarray:
    """A small matrix as an array; refuses sides beyond DRIVER_SIDE."""
    if max(t.shape, default=0) > DRIVER_SIDE:
        raise ValueError(f"a side of {max(t.shape)} is too large for one node; the limit is {DRIVER_SIDE}")
    return t.to_numpy()


def conjugate_gradient(a: Tensor, b: Tensor, tolerance: float = 1e-10, max_rounds: int = 200, jacobi: bool = False) -> Tensor:
    """x with a x = b for a symmetric positive definite matrix; raises unless the residual's norm comes below ``tolerance``."""
    return krylov.cg(a, b, tolerance, max_rounds, krylov.jacobi(a) if jacobi else None).x


def power_iteration(a: Tensor, tolerance: float = 1e-9, max_rounds: int = 500) -> tuple[float, Tensor]:
    """The eigenvalue of largest modulus and its unit vector, largest entry positive.

    Rounds go on until |A x - value x| is at most ``tolerance`` times |value| (or 1, if that is more),
    so a matrix with two such eigenvalues of opposite signs raises instead of giving a wrong one.
    """
    a = a.with_df(cut(a.df))
    n = a.shape[0]
    x = _start(a, 0)
    value = 0.0
    for _ in range(max_rounds):
        y = einsum("ij,j->i", a, x)
        y = Tensor(cut(y.df), ("i",), (n,))
        both = x.df.withColumnRenamed("v", "x").join(y.df.withColumnRenamed("v", "y"), "i", "full").na.fill(0.0, ["x", "y"])
        value, size = both.agg(F.sum(F.col("x") * F.col("y")), F.sqrt(F.sum(F.col("y") * F.col("y")))).first()
        if not size:
            return 0.0, x
        rest = F.col("y") - value * F.col("x")
        if both.agg(F.sqrt(F.sum(rest * rest))).first()[0] <= tolerance * max(1.0, abs(value)):
            break
        x = y.with_df(y.df.withColumn("v", F.col("v") / size))
    else:
        raise RuntimeError(f"no convergence after {max_rounds} rounds: the eigenvalue is about {value:g}")
    sign = x.df.agg(F.signum(F.max_by("v", F.abs("v")))).first()[0] or 1.0
    return value, x.with_df(x.df.withColumn("v", F.col("v") * sign))


def _start(a: Tensor, seed: int) -> Tensor:
    """A unit vector from a hash of the index."""
    n = a.shape[0]
    bits = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20))
    x = Tensor(cut(a.df.sparkSession.range(n).select(F.col("id").alias("i"), (bits / (1 << 19) - 0.9990234375).alias("v"))), ("i",), (n,))
    return krylov.combine((krylov.dot(x, x) ** -0.5, x))


def svd(x: Tensor, rank: int | None = None) -> tuple[Tensor, np.ndarray, np.ndarray]:
    """U (a frame), singular values and V of a matrix with few columns, by a tree of QR factorisations."""
    return tall.svd(x, rank)


def randomized_svd(x: Tensor, rank: int, oversampling: int = 8, power: int = 2, seed: int = 0) -> tuple[Tensor, np.ndarray, np.ndarray]:
    """Leading singular triplets by a seeded range finder: projections are products with thin matrices."""
    rng = np.random.default_rng(seed)
    spark = x.df.sparkSession
    q = np.linalg.qr(rng.standard_normal((x.shape[1], min(rank + oversampling, x.shape[1]))))[0]
    for _ in range(power + 1):
        y = einsum("ij,jk->ik", x, from_numpy(spark, q, ("j", "k")))
        q = np.linalg.qr(einsum("ij,ik->jk", x, y).to_numpy())[0]
    y = einsum("ij,jk->ik", x, from_numpy(spark, q, ("j", "k")))
    y = Tensor(cut(y.df), ("i", "k"), y.shape)
    u, s, v = svd(y)
    return Tensor(u.df.where(F.col("k") < rank), u.axes, (x.shape[0], rank)), s[:rank], (q @ v)[:, :rank]


def tall_qr(x: Tensor) -> tuple[Tensor, np.ndarray]:
    """Q (a frame) and R of a matrix with few columns, dependent or not, by a tree of QR factorisations."""
    q, r = tall.qr(x)
    return q.renamed(("i", "j")), r


def least_squares(a: Tensor, b: Tensor, ridge: float = 0.0) -> np.ndarray:
    """x that minimises |a x - b| for a matrix with few columns, by the normal equations."""
    normal = on_driver(gram(a)) + ridge * np.eye(a.shape[1])
    return np.linalg.solve(normal, einsum("ij,i->j", a, b).to_numpy())


def small(a: Tensor, what: str) -> np.ndarray:
    """det, inv, pinv, cholesky, eigvalsh and the like of a matrix that fits the driver."""
    return np.asarray(getattr(np.linalg, what)(on_driver(a)))


def _lanczos_run(a: Tensor, locked: krylov.Basis, count: int, tolerance: float, seed: int) -> tuple[np.ndarray, list[Tensor]]:
    """Leading eigenvalues of ``a`` beside some locked eigenvectors, and their vectors.

    Steps go on until the residuals of ``count`` values are small or the space is used up.
    """
    n = a.shape[0] - len(locked)
    basis = krylov.Basis(a.df.sparkSession, a.shape[0])
    along: list[float] = []
    beside: list[float] = []
    y = locked.off(_start(a, seed))[0]
    size = krylov.dot(y, y) ** 0.5
    while len(basis) < n:
        y = krylov.apply(a, basis.add(y, 1.0 / size))
        y, products = basis.off(locked.off(y)[0])
        along.append(float(products[-1]))
        size = krylov.dot(y, y) ** 0.5
        scale = max(1e-300, max(map(abs, along)), max(beside, default=0.0))
        values, vectors = np.linalg.eigh(np.diag(along) + np.diag(beside, 1) + np.diag(beside, -1))
        values, vectors = values[::-1], vectors[:, ::-1]
        if len(basis) >= count and (size * np.abs(vectors[-1, :count]) <= tolerance * scale).all():
            break
        if size <= 1e-12 * scale:  # the space is invariant: go on from a new vector
            seed += 1_000
            y = basis.off(locked.off(_start(a, seed))[0])[0]
            beside.append(0.0)
            size = krylov.dot(y, y) ** 0.5
        else:
            beside.append(size)
    return values[:count], [basis.combined(v) for v in vectors[:, :count].T]


def lanczos(a: Tensor, count: int, tolerance: float = 1e-9) -> np.ndarray:
    """The ``count`` largest eigenvalues of a symmetric matrix, in falling order, repeated as often as they occur.

    Lanczos vectors are one frame, each made orthogonal to all before it; only the tridiagonal matrix
    reaches the driver.  A single start finds one vector of a repeated eigenvalue, so further runs
    beside the vectors found look for larger values than the smallest found, until there are none.
    """
    a = a.renamed(("i", "j"))
    if not 1 <= count <= a.shape[0]:
        raise ValueError("count must be from 1 to the number of rows")
    a = a.with_df(cut(a.df))
    locked, found = krylov.Basis(a.df.sparkSession, a.shape[0]), []
    values, vectors = _lanczos_run(a, locked, count, tolerance, 1)
    while True:
        found += list(values)
        for v in vectors:
            locked.add(v)
        if len(locked) >= a.shape[0]:
            break
        values, vectors = _lanczos_run(a, locked, 1, tolerance, 1 + len(locked))
        smallest = sorted(found, reverse=True)[count - 1]
        if values[0] <= smallest + tolerance * max(1.0, abs(smallest)):
            break
    return np.sort(found)[::-1][:count]
