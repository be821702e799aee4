"""CP models whose factors stay distributed: frames (i, u) with a row's ``rank`` numbers as an array.

A mode's update is one join with each other factor, one grouped sum and a solve where the rows are.
Only matrices of rank x rank numbers come to the driver.  A row that is missing is 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyadic.iterate import cut
from polyadic.tensor import Tensor

#: Columns of a factor; the solves carry rank x rank numbers for each row or plan.
MOST_RANK = 128


@dataclass
class CPFrames:
    """Factors as frames, the fit after each round, and whether rounds "converged" or ran out ("rounds")."""

    factors: list[DataFrame]
    rank: int
    fits: list[float] = field(default_factory=list)
    stopped: str = "rounds"

    @property
    def fit(self) -> float:
        return self.fits[-1] if self.fits else float("nan")


def start_frame(spark: SparkSession, n: int, rank: int, mode: int, seed: int = 0) -> DataFrame:
    """Rows of numbers from 0.25 to 1.25 by index arithmetic, made where they are."""
    number = lambda r: 0.25 + ((F.col("id") * 7919 + (r + 1) * (104729 * (mode + 1)) + seed * 15485863) % 1009) / 1009.0
    return spark.range(n).select(F.col("id").alias("i"), F.array(*(number(r) for r in range(rank))).alias("u"))


def _products(x: DataFrame, axes: Sequence[str], factors: Sequence[DataFrame], skip: int | None) -> DataFrame:
    """Cells with ``u``: the products of their rows in all factors, or in all but one."""
    found = []
    for k, axis in enumerate(axes):
        if k != skip:
            x = x.join(factors[k].select(F.col("i").alias(axis), F.col("u").alias(f"__u{k}")), axis)
            found.append(F.col(f"__u{k}"))
    u = reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p * q), found)
    return x.select(*axes, "v", u.alias("u"))


def _summed(values: Sequence[Column]) -> Column:
    return F.array(*(F.sum(v) for v in values))


def mttkrp_rows(x: Tensor, factors: Sequence[DataFrame], mode: int, rank: int) -> DataFrame:
    """(i, m): the matricised tensor times the Khatri-Rao product of the other factors, a row for each index with cells."""
    rows = _products(x.df, x.axes, factors, mode)
    return rows.groupBy(F.col(x.axes[mode]).alias("i")).agg(_summed([F.col("v") * F.get("u", F.lit(r)) for r in range(rank)]).alias("m"))


def gram(factor: DataFrame, rank: int) -> np.ndarray:
    """U'U by one aggregate of rank x rank numbers."""
    pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
    sums = factor.agg(_summed([F.get("u", F.lit(a)) * F.get("u", F.lit(b)) for a, b in pairs]).alias("g")).first()["g"]
    out = np.zeros((rank, rank))
    for (a, b), s in zip(pairs, sums, strict=True):
        out[a, b] = out[b, a] = s or 0.0
    return out


def _times(rows: Column, matrix: np.ndarray) -> Column:
    """A row's array times a small matrix."""
    rank = matrix.shape[0]
    return F.array(*(reduce(lambda a, b: a + b, (F.get(rows, F.lit(k)) * float(matrix[k, r]) for k in range(rank))) for r in range(matrix.shape[1])))


def _check(x: Tensor, rank: int) -> None:
    if not 1 <= rank <= MOST_RANK:
        raise ValueError(f"the rank must be from 1 to {MOST_RANK}")
    if len(x.axes) < 2:
        raise ValueError("a CP model needs two modes at least")


def cp_als_frames(x: Tensor, rank: int, rounds: int = 50, tolerance: float = 1e-6, seed: int = 0, nonnegative: bool = False, ridge: float = 0.0, sparsity: float = 0.0, start: Sequence[DataFrame] | None = None) -> CPFrames:
    """CP by alternating least squares with keyed factor frames.

    Each row is solved for on the executors, by a rank x rank matrix that the driver inverts; a
    singular one is taken by its pseudo-inverse.  ``nonnegative`` takes multiplicative updates and
    refuses negative cells; ``ridge`` adds to the diagonal; ``sparsity`` shrinks every number of an
    updated row towards 0 by that much over its diagonal element (L1).  ``start`` continues from
    earlier factors.  The fit is 1 - |X - X'| / |X|, and of a tensor of zeros 1.
    """
    _check(x, rank)
    spark = x.df.sparkSession
    x = x.with_df(cut(x.df))
    found = x.df.agg(F.sum(F.col("v") * F.col("v")).alias("total"), F.min("v").alias("least")).first()
    total = found["total"] or 0.0
    if nonnegative and (found["least"] or 0.0) < 0:
        raise ValueError("a nonnegative model needs cells of 0 or more")
    factors = list(start) if start else [start_frame(spark, n, rank, k, seed) for k, n in enumerate(x.shape)]
    if len(factors) != len(x.axes):
        raise ValueError("one factor for each mode")
    grams = [gram(u, rank) for u in factors]
    out = CPFrames(factors, rank)
    for _ in range(rounds):
        for mode in range(len(factors)):
            g = np.prod([h for k, h in enumerate(grams) if k != mode], axis=0) + ridge * np.eye(rank)
            m = mttkrp_rows(x, factors, mode, rank)
            if nonnegative:
                both = factors[mode].join(m, "i")
                ratio = F.zip_with(F.zip_with("u", "m", lambda a, b: a * b), _times(F.col("u"), g), lambda a, b: a / F.greatest(b, F.lit(1e-12)))
                solved = both.select("i", "m", ratio.alias("u"))
            else:
                solved = m.select("i", "m", _times(F.col("m"), np.linalg.pinv(g, rcond=1e-13, hermitian=True)).alias("u"))
            if sparsity:
                limits = [sparsity / max(float(g[r, r]), 1e-300) for r in range(rank)]
                shrunk = [F.signum(F.get("u", F.lit(r))) * F.greatest(F.abs(F.get("u", F.lit(r))) - t, F.lit(0.0)) for r, t in enumerate(limits)]
                solved = solved.withColumn("u", F.array(*shrunk))
            solved = cut(solved)
            factors[mode] = solved.select("i", "u")
            grams[mode] = gram(factors[mode], rank)
        met = solved.agg(F.sum(F.aggregate(F.zip_with("u", "m", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)).alias("met")).first()["met"] or 0.0
        error = max(total + float(np.prod(grams, axis=0).sum()) - 2 * met, 0.0)
        out.fits.append(1 - (error / total) ** 0.5 if total else 1.0)
        if len(out.fits) > 1 and abs(out.fits[-1] - out.fits[-2]) < tolerance:
            out.stopped = "converged"
            break
    return out


def cp_complete_frames(x: Tensor, rank: int, rounds: int = 50, tolerance: float = 1e-8, ridge: float = 1e-6, seed: int = 0, start: Sequence[DataFrame] | None = None) -> CPFrames:
    """CP of the stored cells only: cells without a row are unknown and not 0.

    Every index has its own rank x rank system, summed over its cells and solved on the executors;
    an index without cells has no row.  Rounds stop when the error over the stored cells, as part of
    their norm, changes by less than ``tolerance``.  ``ridge`` must be above 0, as an index may have
    fewer cells than columns.
    """
    _check(x, rank)
    if ridge <= 0:
        raise ValueError("the ridge must be above 0")
    spark = x.df.sparkSession
    x = x.with_df(cut(x.df))
    total = x.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
    factors = list(start) if start else [start_frame(spark, n, rank, k, seed) for k, n in enumerate(x.shape)]
    pairs = [(a, b) for a in range(rank) for b in range(a, rank)]
    upper = np.array(pairs).T

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            g, m = (batch[c].flatten().to_numpy().reshape(n, -1) for c in ("g", "m"))
            full = np.zeros((n, rank, rank))
            full[:, upper[0], upper[1]] = g
            full[:, upper[1], upper[0]] = g
            u = np.linalg.solve(full + ridge * np.eye(rank), m[:, :, None])[:, :, 0]
            yield pa.RecordBatch.from_arrays([batch["i"], pa.FixedSizeListArray.from_arrays(pa.array(u.ravel()), rank).cast(pa.list_(pa.float64()))], names=["i", "u"])

    out = CPFrames(factors, rank)
    for _ in range(rounds):
        for mode, axis in enumerate(x.axes):
            rows = _products(x.df, x.axes, factors, mode)
            at = [F.get("u", F.lit(r)) for r in range(rank)]
            systems = rows.groupBy(F.col(axis).alias("i")).agg(_summed([at[a] * at[b] for a, b in pairs]).alias("g"), _summed([F.col("v") * a for a in at]).alias("m"))
            factors[mode] = cut(systems.mapInArrow(solve, "i long, u array<double>"))
        error = cp_cells(x.df, x.axes, factors).agg(F.sum((F.col("v") - F.col("model")) ** 2)).first()[0] or 0.0
        out.fits.append(1 - (error / total) ** 0.5 if total else 1.0)
        if len(out.fits) > 1 and abs(out.fits[-1] - out.fits[-2]) < tolerance:
            out.stopped = "converged"
            break
    return out


def cp_cells(cells: DataFrame, axes: Sequence[str], factors: Sequence[DataFrame]) -> DataFrame:
    """The model's value at each given cell, as ``model``; 0 where a factor has no row.  Other columns stay."""
    for k, axis in enumerate(axes):
        cells = cells.join(factors[k].select(F.col("i").alias(axis), F.col("u").alias(f"__u{k}")), axis, "left")
    u = reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p * q), [F.col(f"__u{k}") for k in range(len(axes))])
    value = F.coalesce(F.aggregate(u, F.lit(0.0), lambda a, b: a + b), F.lit(0.0))
    return cells.withColumn("model", value).drop(*(f"__u{k}" for k in range(len(axes))))


def as_cells(factors: Sequence[DataFrame]) -> DataFrame:
    """(mode, i, r, v): all numbers of all factors."""
    parts = [u.select(F.lit(k).cast("long").alias("mode"), "i", F.posexplode("u").alias("r", "v")) for k, u in enumerate(factors)]
    return reduce(DataFrame.unionByName, parts).withColumn("r", F.col("r").cast("long"))
