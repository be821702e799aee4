"""Krylov solvers for square and rectangular systems: vectors are frames, only scalars reach the driver.

Each gives a Solution; with ``strict`` (the default) one that has not converged raises.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyadic.functions.numeric import safe_div
from polyadic.iterate import cut, looked_up, shared_folder, written
from polyadic.plans.einsum import einsum
from polyadic.tensor import Tensor

#: A preconditioner: from a residual to an estimate of the error.
Preconditioner = Callable[[Tensor], Tensor]


@dataclass(frozen=True)
class Solution:
    x: Tensor
    rounds: int
    residual: float
    converged: bool


def dot(x: Tensor, y: Tensor) -> float:
    return float(einsum("i,i->", x, y).df.first()[0] or 0.0)


class Basis:
    """Orthonormal vectors as one frame (k, i, v), each written once; products with all of them are one grouped sum."""

    def __init__(self, spark: SparkSession, n: int):
        self.spark, self.n, self.size = spark, n, 0
        self.folder = shared_folder(spark, "basis")

    def __len__(self) -> int:
        return self.size

    def add(self, y: Tensor, scale: float = 1.0) -> Tensor:
        y.renamed(("i",)).df.select("i", (F.col("v") * scale).alias("v")).write.parquet(f"{self.folder}/k={self.size}")
        self.size += 1
        return self[self.size - 1]

    def __getitem__(self, k: int) -> Tensor:
        return Tensor(self.spark.read.schema("i long, v double").parquet(f"{self.folder}/k={k}"), ("i",), (self.n,))

    def _all(self) -> DataFrame:
        return self.spark.read.schema("i long, v double, k int").parquet(self.folder)

    def dots(self, y: Tensor) -> np.ndarray:
        """The product of a vector with each one."""
        out = np.zeros(self.size)
        if self.size:
            for r in self._all().withColumnRenamed("v", "x").join(y.renamed(("i",)).df, "i").groupBy("k").agg(F.sum(F.col("x") * F.col("v")).alias("s")).collect():  # a number for each vector
                out[r["k"]] = r["s"]
        return out

    def combined(self, factors: np.ndarray, plus: Tensor | None = None) -> Tensor:
        """The sum of multiples of the vectors, and of ``plus``; written."""
        some = self._all().where(F.col("k") < len(factors)).select("i", (F.col("v") * F.get(F.array(*(F.lit(float(c)) for c in factors)), F.col("k"))).alias("v"))
        if plus is not None:
            some = some.unionByName(plus.renamed(("i",)).df)
        return Tensor(cut(some.groupBy("i").agg(F.sum("v").alias("v"))), ("i",), (self.n,))

    def off(self, y: Tensor) -> tuple[Tensor, np.ndarray]:
        """What is left of a vector beside these, taken off twice, and its products with them."""
        total = np.zeros(self.size)
        for _ in range(2 if self.size else 0):
            along = self.dots(y)
            total += along
            y = self.combined(-along, plus=y)
        return y, total


def combine(*terms: tuple[float, Tensor]) -> Tensor:
    """The sum of some multiples of vectors, written."""
    first = terms[0][1]
    rows = None
    for factor, t in terms:
        part = t.renamed(("i",)).df.select("i", (F.col("v") * factor).alias("v"))
        rows = part if rows is None else rows.unionByName(part)
    return Tensor(cut(rows.groupBy("i").agg(F.sum("v").alias("v"))), ("i",), first.shape)


def apply(a: Tensor, x: Tensor, transposed: bool = False) -> Tensor:
    """A x (or A' x): cells look up their factor and are summed where they are first, so few of them are shuffled if rows lie together."""
    if len(a.axes) != 2 or x.shape != (a.shape[0] if transposed else a.shape[1],):
        raise ValueError(f"a matrix of {a.shape} does not meet a vector of {x.shape}")
    cells = a.renamed(("j", "i") if transposed else ("i", "j")).df
    factors = x.renamed(("j",)).df.select("j", F.col("v").alias("x"))
    out = cells.join(looked_up(factors, x.shape[0]), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
    return Tensor(cut(out), ("i",), (a.shape[1] if transposed else a.shape[0],))


def jacobi(a: Tensor) -> Preconditioner:
    """Division by the diagonal; it must have no zero."""
    i, j = a.axes
    scale = Tensor(cut(a.df.where(F.col(i) == F.col(j)).select(F.col(i).alias("i"), safe_div(F.lit(1.0), F.col("v")).alias("v"))), ("i",), (a.shape[0],))
    return lambda r: Tensor(cut(einsum("i,i->i", r, scale).df), ("i",), r.shape)


def _ready(a: Tensor, b: Tensor) -> tuple[Tensor, Tensor, Tensor]:
    a, b = a.with_df(written(a.df.repartition(a.axes[0]).sortWithinPartitions(*a.axes), "matrix")), b.renamed(("i",))
    zero = Tensor(b.df.sparkSession.range(0).select(F.col("id").alias("i"), F.lit(0.0).alias("v")), ("i",), (a.shape[1],))
    return a, b.with_df(cut(b.df)), zero


def _done(x: Tensor, rounds: int, residual: float, limit: float, strict: bool) -> Solution:
    good = residual <= limit
    if strict and not good:
        raise RuntimeError(f"no convergence after {rounds} rounds: the residual is {residual:g}, not {limit:g}")
    return Solution(x, rounds, residual, good)


def cg(a: Tensor, b: Tensor, tolerance: float = 1e-10, max_rounds: int = 200, preconditioner: Preconditioner | None = None, strict: bool = True) -> Solution:
    """Conjugate gradients for a symmetric positive definite matrix; ``tolerance`` is of the residual's norm."""
    a, r, x = _ready(a, b)
    z = preconditioner(r) if preconditioner else r
    p, rz, rounds = z, dot(r, z), 0
    while (size := dot(r, r) ** 0.5) > tolerance and rounds < max_rounds:
        ap = apply(a, p)
        if not rz or (below := dot(p, ap)) <= 0:  # not positive definite
            break
        alpha = rz / below
        x, r = combine((1.0, x), (alpha, p)), combine((1.0, r), (-alpha, ap))
        z = preconditioner(r) if preconditioner else r
        rz, before = dot(r, z), rz
        p, rounds = combine((1.0, z), (rz / before, p)), rounds + 1
    return _done(x, rounds, size, tolerance, strict)


def bicgstab(a: Tensor, b: Tensor, tolerance: float = 1e-10, max_rounds: int = 200, preconditioner: Preconditioner | None = None, strict: bool = True) -> Solution:
    """Stabilised bi-conjugate gradients for any square matrix (van der Vorst, 1992)."""
    a, r, x = _ready(a, b)
    shadow, p, rounds = r, r, 0
    rho = dot(shadow, r)
    size = dot(r, r) ** 0.5
    while size > tolerance and rounds < max_rounds and rho:
        ph = preconditioner(p) if preconditioner else p
        v = apply(a, ph)
        if not (below := dot(shadow, v)):
            break
        alpha = rho / below
        s = combine((1.0, r), (-alpha, v))
        sh = preconditioner(s) if preconditioner else s
        t = apply(a, sh)
        tt = dot(t, t)
        omega = dot(t, s) / tt if tt else 0.0
        x, r = combine((1.0, x), (alpha, ph), (omega, sh)), combine((1.0, s), (-omega, t))
        rho, before = dot(shadow, r), rho
        size, rounds = dot(r, r) ** 0.5, rounds + 1
        if not omega:
            break
        beta = rho / before * alpha / omega
        p = combine((1.0, r), (beta, p), (-beta * omega, v))
    return _done(x, rounds, size, tolerance, strict)


def gmres(a: Tensor, b: Tensor, tolerance: float = 1e-10, max_rounds: int = 200, restart: int = 30, preconditioner: Preconditioner | None = None, strict: bool = True) -> Solution:
    """Least residual over Krylov spaces of up to ``restart`` vectors; the small Hessenberg matrix is on the driver.

    A preconditioner is applied from the right, so residuals are those of the system itself.
    """
    a, b, x = _ready(a, b)
    r, rounds = b, 0
    size = dot(r, r) ** 0.5
    while size > tolerance and rounds < max_rounds:
        basis, h = Basis(a.df.sparkSession, a.shape[1]), np.zeros((restart + 1, restart))
        now = basis.add(r, 1.0 / size)
        for k in range(restart):
            w = apply(a, preconditioner(now) if preconditioner else now)
            w, h[: k + 1, k] = basis.off(w)
            h[k + 1, k] = dot(w, w) ** 0.5
            rounds += 1
            target = np.zeros(k + 2)
            target[0] = size
            y = np.linalg.lstsq(h[: k + 2, : k + 1], target, rcond=None)[0]
            left = float(np.linalg.norm(h[: k + 2, : k + 1] @ y - target))
            if left <= tolerance / 2 or h[k + 1, k] < 1e-14 * size or rounds >= max_rounds:
                break
            now = basis.add(w, 1.0 / h[k + 1, k])
        step = basis.combined(y)
        x = combine((1.0, x), (1.0, preconditioner(step) if preconditioner else step))
        r = combine((1.0, b), (-1.0, apply(a, x)))
        size, before = dot(r, r) ** 0.5, size
        if size >= before:
            break
    return _done(x, rounds, size, tolerance, strict)


def minres(a: Tensor, b: Tensor, tolerance: float = 1e-10, max_rounds: int = 200, strict: bool = True) -> Solution:
    """Least residual for a symmetric, maybe indefinite matrix: Lanczos vectors and Givens rotations (Paige and Saunders, 1975)."""
    a, b, x = _ready(a, b)
    size = beta = dot(b, b) ** 0.5
    rounds, old, now = 0, None, combine((1.0 / beta, b)) if beta else b
    signed, c0, c1, s0, s1 = beta, 1.0, 1.0, 0.0, 0.0
    d0 = d1 = None
    while size > tolerance and rounds < max_rounds:
        w = apply(a, now)
        alpha = dot(now, w)
        w = combine((1.0, w), (-alpha, now), *([(-beta, old)] if old is not None else []))
        after = dot(w, w) ** 0.5
        # Column of the tridiagonal matrix under the two rotations before, then a new one.
        lower = beta if old is not None else 0.0
        r2, r1 = s0 * lower, c0 * lower
        r1, r0 = c1 * r1 + s1 * alpha, -s1 * r1 + c1 * alpha
        norm = float(np.hypot(r0, after))
        if not norm:
            break
        c, s = r0 / norm, after / norm
        d = combine((1.0 / norm, now), *([(-r1 / norm, d1)] if d1 is not None else []), *([(-r2 / norm, d0)] if d0 is not None else []))
        x, signed = combine((1.0, x), (c * signed, d)), -s * signed
        size, rounds = abs(signed), rounds + 1
        c0, s0, c1, s1, d0, d1 = c1, s1, c, s, d1, d
        if after < 1e-14:
            break
        old, now, beta = now, combine((1.0 / after, w)), after
    return _done(x, rounds, size, tolerance, strict)


def cgnr(a: Tensor, b: Tensor, tolerance: float = 1e-10, max_rounds: int = 200, strict: bool = True) -> Solution:
    """Conjugate gradients on a' a x = a' b: least squares of a system of any shape; ``tolerance`` is of a' r."""
    a, r, x = _ready(a, b)
    z = apply(a, r, transposed=True)
    p, zz, rounds = z, dot(z, z), 0
    while zz**0.5 > tolerance and rounds < max_rounds:
        w = apply(a, p)
        if not (below := dot(w, w)):
            break
        alpha = zz / below
        x, r = combine((1.0, x), (alpha, p)), combine((1.0, r), (-alpha, w))
        z = apply(a, r, transposed=True)
        zz, before = dot(z, z), zz
        p, rounds = combine((1.0, z), (zz / before, p)), rounds + 1
    return _done(x, rounds, zz**0.5, tolerance, strict)


def cgne(a: Tensor, b: Tensor, tolerance: float = 1e-10, max_rounds: int = 200, strict: bool = True) -> Solution:
    """Conjugate gradients on a a' y = b, x = a' y: the shortest solution of a consistent system."""
    a, r, x = _ready(a, b)
    p, rr, rounds = apply(a, r, transposed=True), dot(r, r), 0
    while rr**0.5 > tolerance and rounds < max_rounds:
        if not (below := dot(p, p)):  # nothing of the residual is in reach
            break
        alpha = rr / below
        x, r = combine((1.0, x), (alpha, p)), combine((1.0, r), (-alpha, apply(a, p)))
        rr, before = dot(r, r), rr
        p, rounds = combine((1.0, apply(a, r, transposed=True)), (rr / before, p)), rounds + 1
    return _done(x, rounds, rr**0.5, tolerance, strict)
