"""Reductions and statistics over axes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyadic.operators.covariances import covariances
from polyadic.tensor import Tensor


#: Aggregates of stored cells; those of DENSE also count the cells that have no row.
AGGREGATES: dict[str, Callable[[], Column]] = {
    "sum": lambda: F.sum("v"),
    "prod": lambda: F.product("v"),
    "mean": lambda: F.avg("v"),
    "min": lambda: F.min("v"),
    "max": lambda: F.max("v"),
    "var": lambda: F.var_pop("v"),
    "std": lambda: F.stddev_pop("v"),
    "var_samp": lambda: F.var_samp("v"),
    "std_samp": lambda: F.stddev_samp("v"),
    "median": lambda: F.median("v"),
    "skewness": lambda: F.skewness("v"),
    "kurtosis": lambda: F.kurtosis("v"),
    "norm_l1": lambda: F.sum(F.abs("v")),
    "norm_l2": lambda: F.sqrt(F.sum(F.col("v") * F.col("v"))),
    "norm_linf": lambda: F.max(F.abs("v")),
    "all": lambda: F.min((F.col("v") != 0).cast("double")),
    "any": lambda: F.max((F.col("v") != 0).cast("double")),
    "count_nonzero": lambda: F.sum((F.col("v") != 0).cast("double")),
}
_STORED = frozenset("sum norm_l1 norm_l2 norm_linf any count_nonzero".split())


def reduce(t: Tensor, axes: Sequence[str], op: str, aggregate: Column | None = None) -> Tensor:
    """Reduce over ``axes`` by an operation of AGGREGATES (or by ``aggregate``)."""
    if not axes:
        raise ValueError("no axis to reduce")
    keep = t.others(*axes)
    source = t if op in _STORED and aggregate is None else t.dense()
    out = source.df.groupBy(*keep).agg((AGGREGATES[op]() if aggregate is None else aggregate).cast("double").alias("v"))
    return Tensor(out.select(*keep, "v"), keep, tuple(t.size_of(a) for a in keep))


def norm_lp(t: Tensor, axes: Sequence[str], p: float) -> Tensor:
    return reduce(t, axes, "norm_lp", F.pow(F.sum(F.pow(F.abs("v"), F.lit(p))), F.lit(1.0 / p)))


def quantile(t: Tensor, axes: Sequence[str], q: float) -> Tensor:
    """Exact, by linear interpolation on (n - 1) q."""
    return reduce(t, axes, "quantile", F.percentile("v", F.lit(q)))


def variance(t: Tensor, axes: Sequence[str], ddof: int = 0) -> Tensor:
    """Sum of squared deviations over n - ``ddof``; NaN where that is not positive."""
    left = F.count("v") - ddof
    return reduce(t, axes, "variance", F.when(left > 0, F.var_pop("v") * F.count("v") / left).otherwise(float("nan")))


def arg_extreme(t: Tensor, axis: str, largest: bool = True) -> Tensor:
    """Position along ``axis`` of the largest (or smallest) cell; the first of equal ones."""
    best = F.max(F.struct(F.col("v") if largest else -F.col("v"), (-F.col(axis)).alias("k")))
    return reduce(t, [axis], "arg", -best["k"])


def sparse_extreme(t: Tensor, axis: str, largest: bool = True) -> Tensor:
    """Largest (or smallest) of stored cells, and of 0 where a slice is not fully stored."""
    f = F.max("v") if largest else F.min("v")
    other = F.greatest(f, F.lit(0.0)) if largest else F.least(f, F.lit(0.0))
    keep = t.others(axis)
    out = t.df.groupBy(*keep).agg(F.when(F.count("v") < t.size_of(axis), other).otherwise(f).alias("v"))
    return Tensor(out, keep, tuple(t.size_of(a) for a in keep))


def unique(t: Tensor) -> DataFrame:
    """(v, n): the distinct values of all cells and how often they occur."""
    return t.dense().df.groupBy("v").agg(F.count("*").alias("n"))


def histogram(t: Tensor, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) for equal bins of [low, high]; the last one is closed."""
    width = (high - low) / bins
    k = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("long")
    return t.dense().df.where((F.col("v") >= low) & (F.col("v") <= high)).groupBy(k.alias("bin")).agg(F.count("*").alias("n"))


def covariance_matrix(t: Tensor, correlation: bool = False) -> Tensor:
    """Covariance (n - 1) or correlation of the columns of a matrix [sample, variable]; every pair has a row.

    Deviations from the columns' means are summed, so that large means do not cancel; cells that have
    no row deviate by minus the mean and are accounted for by count.  Sums are made by tiles of pairs
    of columns.  A constant column's correlations are NaN, and so is all with fewer than 2 samples.
    """
    return covariances(t, correlation)
