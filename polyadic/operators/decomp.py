"""CP, Tucker and tensor-train decompositions: the tensor stays distributed, factors are small arrays."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import functions as F

from polyadic.iterate import cut
from polyadic.operators.kernels import mttkrp, nmode_products
from polyadic.operators import tall
from polyadic.operators.shape import reshape, unfold
from polyadic.plans.einsum import einsum
from polyadic.tensor import Tensor, from_numpy


@dataclass
class CP:
    factors: list[np.ndarray]
    fit: float
    fits: list[float] = field(default_factory=list)

    def reconstruct(self) -> np.ndarray:
        letters = "abcdefgh"[: len(self.factors)]
        return np.einsum(",".join(c + "z" for c in letters) + "->" + letters, *self.factors)


@dataclass
class Tucker:
    core: np.ndarray
    factors: list[np.ndarray]

    def reconstruct(self) -> np.ndarray:
        out = self.core
        for k, u in enumerate(self.factors):
            out = np.moveaxis(np.tensordot(u, out, (1, k)), 0, k)
        return out


def _squares(x: Tensor) -> float:
    return float(x.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0)


def cp_als(x: Tensor, rank: int, rounds: int = 50, tolerance: float = 1e-6, seed: int = 0, nonnegative: bool = False, ridge: float = 0.0) -> CP:
    """CP by alternating least squares; each mode is one distributed MTTKRP of mode size by rank cells.

    The fit 1 - |X - X'| / |X| comes from the last mode's MTTKRP; rounds stop when it changes by less
    than ``tolerance``.
    """
    if rank < 1 or rank > min(x.shape):
        raise ValueError("the rank must be from 1 to the smallest mode size")
    x = x.with_df(cut(x.df))
    spark, total = x.df.sparkSession, _squares(x)
    rng = np.random.default_rng(seed)
    factors = [rng.random((n, rank)) for n in x.shape]
    fits: list[float] = []
    for _ in range(rounds):
        for mode in range(len(factors)):
            frames = [from_numpy(spark, u, (f"i{k}", "r")) for k, u in enumerate(factors)]
            m = mttkrp(x, frames, mode).to_numpy()
            g = np.prod([u.T @ u for k, u in enumerate(factors) if k != mode], axis=0) + ridge * np.eye(rank)
            if nonnegative:
                factors[mode] = factors[mode] * np.maximum(m, 0) / np.maximum(factors[mode] @ g, 1e-12)
            else:
                factors[mode] = np.linalg.lstsq(g, m.T, rcond=None)[0].T
        norm = float(np.prod([u.T @ u for u in factors], axis=0).sum())
        error = max(total + norm - 2 * float((m * factors[-1]).sum()), 0.0)
        fits.append(min(max(1 - (error / total) ** 0.5, 0.0), 1.0) if total else 1.0)
        if len(fits) > 1 and abs(fits[-1] - fits[-2]) < tolerance:
            break
    return CP(factors, fits[-1], fits)


def cp_completion(x: Tensor, rank: int, rounds: int = 50, ridge: float = 1e-6, seed: int = 0) -> CP:
    """CP of the stored cells only: each row's own Gram matrix is summed over its observed cells."""
    spark = x.df.sparkSession
    x = x.with_df(cut(x.df))
    rng = np.random.default_rng(seed)
    factors = [rng.random((n, rank)) for n in x.shape]
    for _ in range(rounds):
        for mode, axis in enumerate(x.axes):
            rows = x.df
            for k, other in enumerate(x.axes):
                if k != mode:
                    u = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(factors[k])], f"{other} long, " + ", ".join(f"f{k}_{c} double" for c in range(rank)))
                    rows = rows.join(u, other)
            product = [np.prod([F.col(f"f{k}_{c}") for k in range(len(factors)) if k != mode]) for c in range(rank)]
            sums = [F.sum(product[a] * product[b]).alias(f"g{a}_{b}") for a in range(rank) for b in range(a, rank)] + [F.sum(F.col("v") * product[c]).alias(f"m{c}") for c in range(rank)]
            for r in rows.groupBy(axis).agg(*sums).toLocalIterator():
                g = np.array([[r[f"g{min(a, b)}_{max(a, b)}"] for b in range(rank)] for a in range(rank)])
                factors[mode][r[axis]] = np.linalg.solve(g + ridge * np.eye(rank), [r[f"m{c}"] for c in range(rank)])
    return CP(factors, float("nan"))


def _leading(m: Tensor, rank: int) -> np.ndarray:
    """Leading left singular vectors of an unfolding, by a tree QR of its transpose; only its triangle reaches the driver."""
    i, j = m.axes
    return tall.right_vectors(Tensor(m.df.select(j, i, "v"), (j, i), m.shape[::-1]), rank)[0]


def tucker(x: Tensor, ranks: Sequence[int], rounds: int = 0, tolerance: float = 1e-8) -> Tucker:
    """Tucker by HOSVD, refined by up to ``rounds`` sweeps of HOOI."""
    if len(ranks) != len(x.shape) or any(not 1 <= r <= n for r, n in zip(ranks, x.shape)):
        raise ValueError("each rank must be from 1 to its mode's size")
    x = x.with_df(cut(x.df))
    spark = x.df.sparkSession
    factors = [_leading(unfold(x, a), r) for a, r in zip(x.axes, ranks, strict=True)]

    def project(skip: int | None = None) -> Tensor:
        return nmode_products(x, {k: from_numpy(spark, u.T, ("m", "n")) for k, u in enumerate(factors) if k != skip})

    before = None
    for _ in range(rounds):
        for k, axis in enumerate(x.axes):
            factors[k] = _leading(unfold(project(skip=k), axis), ranks[k])
        size = _squares(project())
        if before is not None and abs(size - before) <= tolerance * max(before, 1e-300):
            break
        before = size
    return Tucker(project().to_numpy(), factors)


def tt_svd(x: Tensor, max_ranks: Sequence[int] | None = None, tolerance: float = 1e-8) -> list[np.ndarray]:
    """Tensor-train cores [r, n, r'] by successive SVDs; the long side of each unfolding stays distributed.

    At each step singular values above ``tolerance`` times the largest are kept, at least one.  They come
    from a tree QR of the unfolding's transpose; a tolerance below 1e-14 is refused, as rounding is above it.
    """
    if tolerance < 1e-14:
        raise ValueError("singular values below 1e-14 of the largest cannot be told from 0")
    spark, shape = x.df.sparkSession, x.shape
    cores, left, rest = [], 1, x
    for k, n in enumerate(shape[:-1]):
        columns = int(np.prod(shape[k + 1 :]))
        m = reshape(rest, ("row", "col"), (left * n, columns))
        m = m.with_df(cut(m.df))
        vectors, s = tall.right_vectors(Tensor(m.df.select("col", "row", "v"), ("col", "row"), m.shape[::-1]), left * n)
        r = max(1, int((s > tolerance * s[0]).sum()))
        r = min(r, max_ranks[k]) if max_ranks else r
        u = vectors[:, :r]
        cores.append(u.reshape(left, n, r))
        rest = einsum("ik,ij->kj", from_numpy(spark, u, ("i", "k")), m)
        left = r
    cores.append(rest.to_numpy().reshape(left, shape[-1], 1))
    return cores


def tt_reconstruct(cores: Sequence[np.ndarray]) -> np.ndarray:
    out = cores[0]
    for c in cores[1:]:
        out = np.tensordot(out, c, (-1, 0))
    return out[0, ..., 0]


def tt_round(cores: Sequence[np.ndarray], tolerance: float = 1e-10) -> list[np.ndarray]:
    """Smaller cores of nearly the same tensor: orthogonalise from the right, then truncate from the left."""
    cores = [c.copy() for c in cores]
    for k in range(len(cores) - 1, 0, -1):
        r0, n, r1 = cores[k].shape
        q, t = np.linalg.qr(cores[k].reshape(r0, n * r1).T)
        cores[k] = q.T.reshape(-1, n, r1)
        cores[k - 1] = np.tensordot(cores[k - 1], t.T, (2, 0))
    for k in range(len(cores) - 1):
        r0, n, r1 = cores[k].shape
        u, s, v = np.linalg.svd(cores[k].reshape(r0 * n, r1), full_matrices=False)
        r = max(1, int((s > tolerance * s[0]).sum()))
        cores[k] = u[:, :r].reshape(r0, n, r)
        cores[k + 1] = np.tensordot(s[:r, None] * v[:r], cores[k + 1], (1, 0))
    return cores


def rank_scores(x: Tensor, ranks: Sequence[int], seed: int = 0) -> list[dict[str, float]]:
    """Fit, AIC and BIC of CP models of some ranks."""
    n, total, out = int(np.prod(x.shape)), _squares(x), []
    for r in ranks:
        model = cp_als(x, r, seed=seed)
        rss, k = max(total * (1 - model.fit) ** 2, 1e-300), r * sum(x.shape)
        out.append({"rank": r, "fit": model.fit, "aic": n * np.log(rss / n) + 2 * k, "bic": n * np.log(rss / n) + k * np.log(n)})
    return out


def tt_add(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The sum of two tensor trains: ranks add up, cores are block-diagonal."""
    out = []
    for k, (x, y) in enumerate(zip(a, b, strict=True)):
        first, last = k == 0, k == len(a) - 1
        core = np.zeros((1 if first else x.shape[0] + y.shape[0], x.shape[1], 1 if last else x.shape[2] + y.shape[2]))
        core[: x.shape[0], :, : x.shape[2]] = x
        core[0 if first else x.shape[0] :, :, 0 if last else x.shape[2] :] += y
        out.append(core)
    return out


def tt_dot(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> float:
    """Sum of products of all cells of two tensor trains, core by core."""
    carried = np.ones((1, 1))
    for x, y in zip(a, b, strict=True):
        carried = np.einsum("ab,aic,bid->cd", carried, x, y, optimize=True)
    return float(carried[0, 0])


def tt_norm(cores: Sequence[np.ndarray]) -> float:
    return max(tt_dot(cores, cores), 0.0) ** 0.5


def tt_matvec(matrix: Sequence[np.ndarray], x: Sequence[np.ndarray]) -> list[np.ndarray]:
    """A train of matrices [r, n, m, r'] times a tensor train; ranks multiply."""
    out = []
    for a, b in zip(matrix, x, strict=True):
        core = np.einsum("rnms,pmq->rpnsq", a, b)
        out.append(core.reshape(a.shape[0] * b.shape[0], a.shape[1], a.shape[3] * b.shape[2]))
    return out
